"""Encoding of a whole corpus by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, ship_package, write_shared
from .lexicon import Lexicon
from .pretokens import word_starts

#: Words of the corpus that the lexicon holds at most: the bound of what the driver collects.
LEXICON_WORDS = 131_072
#: Longest word, in bytes, that is counted for the lexicon.
WORD_BYTES = 32
#: Bytes of text handled at once; longer single texts are handled whole.
PIECE = 1 << 20
#: Bytes of text whose ids go into one list column, whose offsets have 32 bits.
SLICE = 1 << 30
#: Distinct words that a task keeps before it hands on its counts.
COUNTED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def merger(vocabulary: str):
    """The exact merges of single words under a rank file."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Words are split before; the pattern is not used.
    enc = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return enc._core_bpe.encode_single_piece


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, row offsets) of runs of about ``PIECE`` bytes; NULL counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _split(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.unique(offsets[:-1][offsets[:-1] < b.size])
    starts = word_starts(b, begins)
    return starts, np.diff(np.append(starts, b.size))


def _word_hashes(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of up to ``WORD_BYTES`` bytes."""
    order = np.argsort(lengths.astype(np.uint8), kind="stable")[::-1]
    pos, size = starts[order], lengths[order]
    h = np.full(order.size, 0x9E3779B97F4A7C15, np.uint64)
    active = np.searchsorted(-size, -np.arange(1, WORD_BYTES + 1), side="right")
    for k in range(WORD_BYTES):
        stop = int(active[k])
        if stop == 0:
            break
        h[:stop] ^= b[pos[:stop] + k]
        h[:stop] *= np.uint64(0x100000001B3)
        h[:stop] ^= h[:stop] >> np.uint64(29)
    out = np.empty_like(h)
    out[order] = h
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a partition, combined before it is sent on."""
    counts: dict[int, int] = {}
    words: dict[int, bytes] = {}

    def sent():
        keys = [h for h in counts]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[h] for h in keys], pa.binary()), pa.array([counts[h] for h in keys], pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for _, _, b, offsets in _pieces(batch.column(0)):
            starts, lengths = _split(b, offsets)
            short = lengths <= WORD_BYTES
            starts, lengths = starts[short], lengths[short]
            if not starts.size:
                continue
            h, at, n = np.unique(_word_hashes(b, starts, lengths), return_index=True, return_counts=True)
            raw = b.tobytes()
            for x, i, c in zip(h.tolist(), at.tolist(), n.tolist(), strict=True):
                if x in counts:
                    counts[x] += c
                else:
                    counts[x] = c
                    words[x] = raw[starts[i] : starts[i] + lengths[i]]
            if len(counts) > COUNTED:
                yield sent()
                counts.clear()
                words.clear()
    if counts:
        yield sent()


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words over all texts, at most ``most`` and all seen twice or more.

    Counts are combined in the tasks, then by word. Instead of a sort into one
    task a histogram of the counts (some thousand rows) tells from which count on
    there are at most ``most`` words; words of one count are taken or left together.
    """
    ship_package(docs.sparkSession)
    counted = docs.select(text_col).filter(F.length(text_col) > 0).mapInArrow(_count_words, "word binary, n bigint")
    words = materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "word-counts")
    # Counts up to 1024 exactly, larger ones in 64 classes per doubling.
    level = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024.0) * 64)).cast("bigint")
    least, held = None, 0
    for row in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > most:
            break
        least = row.level
    return words.filter(F.lit(False) if least is None else level >= least)


def publish_lexicon(spark: SparkSession, words: list[bytes], vocabulary: str | None = None) -> str:
    """Compile a lexicon, put it into the shared folder and announce it to all executors; returns its name."""
    vocabulary = vocabulary or default_vocabulary()
    raw = Lexicon.build(words, merger(vocabulary)).to_bytes()
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_shared(spark, name, raw))
    return name


class Encoder:
    """Ids of texts by lexicon and, for words that it lacks, by exact merges."""

    def __init__(self, lexicon: Lexicon, vocabulary: str, remembered: int = 200_000):
        self.lexicon, self.merge = lexicon, merger(vocabulary)
        self.known: dict[bytes, list[int]] = {}
        self.remembered = remembered

    def _unseen(self, word: bytes) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            ids = self.merge(word)
            if len(word) <= 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def _words(self, b: np.ndarray, offsets: np.ndarray):
        """(starts, lexicon numbers, ids of each word not held) of a piece."""
        starts, lengths = _split(b, offsets)
        number = self.lexicon.find(b, starts, lengths)
        missing = np.flatnonzero(number < 0)
        raw = b.tobytes() if missing.size else b""
        extra = [self._unseen(raw[s:e]) for s, e in zip(starts[missing].tolist(), (starts[missing] + lengths[missing]).tolist(), strict=True)]
        return starts, number, missing, extra

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(column), np.int64)
        for row, end, b, offsets in _pieces(column):
            if b.size:
                starts, number, missing, extra = self._words(b, offsets)
                n = self.lexicon.counts[np.maximum(number, 0)] if self.lexicon.size else np.zeros(starts.size, np.int64)
                n[missing] = [len(x) for x in extra]
                run = np.concatenate(([0], np.cumsum(n)))
                at = run[np.searchsorted(starts, offsets)]
                out[row:end] = np.diff(at)
        return out

    def ids(self, column: pa.Array) -> pa.ListArray:
        """Ids of each text; NULL and empty texts have the empty list."""
        parts, sizes = [], np.zeros(len(column) + 1, np.int64)
        for row, end, b, offsets in _pieces(column):
            if not b.size:
                continue
            starts, number, missing, extra = self._words(b, offsets)
            held = self.lexicon
            flat = np.concatenate([held.ids, np.fromiter((i for x in extra for i in x), np.int32)]) if extra else held.ids
            size = held.counts[np.maximum(number, 0)] if held.size else np.zeros(starts.size, np.int64)
            first = held.first[np.maximum(number, 0)]
            if extra:
                grown = np.fromiter(map(len, extra), np.int64, len(extra))
                size[missing] = grown
                first[missing] = held.ids.size + np.cumsum(grown) - grown
            run = np.concatenate(([0], np.cumsum(size)))
            where = np.repeat(first - run[:-1], size)
            where += np.arange(run[-1])
            parts.append(flat[where])
            sizes[row + 1 : end + 1] = np.diff(run[np.searchsorted(starts, offsets)])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat, pa.int32()))


@cache
def _encoder(name: str, vocabulary: str) -> Encoder:
    """The encoder of a worker, from files that were sent to it."""
    root = SparkFiles.getRootDirectory()
    return Encoder(Lexicon.open(os.path.join(root, name)), os.path.join(root, vocabulary))


def _sent_vocabulary(spark: SparkSession, path: str) -> str:
    """Name under which workers find the vocabulary file of the driver; sent once per context."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_keyfold_vocabularies", {})
    if path not in sent:
        name = f"vocabulary-{uuid.uuid4().hex}"
        with open(path, "rb") as f:
            sc.addFile(write_shared(spark, name, f.read()))
        sent[path] = name
    return sent[path]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``SLICE`` bytes (or one row): a list of ids has no more entries."""
    sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        before = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
        yield batch.slice(row, end - row)
        row = end


def _prepared(docs: DataFrame, text_col: str, vocabulary: str | None, lexicon: str | None) -> tuple[str, str]:
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    if lexicon is None:
        words = [bytes(r.word) for r in frequent_words(docs, text_col).select("word").collect()]
        lexicon = publish_lexicon(docs.sparkSession, words, vocabulary)
    return _sent_vocabulary(docs.sparkSession, vocabulary), lexicon


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, lexicon: str | None = None
) -> DataFrame:
    """(``id_col``, ids) of every row: the ids of its whole text without special tokens.

    Words that are frequent in the corpus are looked up in a memory-mapped
    transducer, all others merged exactly, so the lexicon decides about speed
    only. NULL and empty texts have the empty list; strings that spell special
    tokens are ordinary text; rows with a NULL id are kept. ``lexicon`` names one
    published before; else it is compiled from the counts of all texts.
    """
    vocabulary, lexicon = _prepared(docs, text_col, vocabulary, lexicon)

    def run(batches):
        enc = _encoder(lexicon, vocabulary)
        for whole in batches:
            for batch in _slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), enc.ids(batch.column(1))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(
    docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, lexicon: str | None = None, name: str = "n_tokens"
) -> DataFrame:
    """The rows without their text and with the number of its ids (0 for NULL and empty)."""
    vocabulary, lexicon = _prepared(docs, text_col, vocabulary, lexicon)
    kept = [c for c in docs.columns if c != text_col]
    if name in kept:
        raise ValueError(f"a column {name} is there already")

    def run(batches):
        enc = _encoder(lexicon, vocabulary)
        for batch in batches:
            n = pa.array(enc.counts(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], n], [*kept, name])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` bigint"])
    return docs.select(*kept, text_col).mapInArrow(run, schema)


def decoded_equal(docs: DataFrame, encoded: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(``id_col``, equal): whether the bytes of a document's ids are those of its text, NULL being as empty.

    An exact round trip; ids must be unique and not NULL.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = _sent_vocabulary(spark, vocabulary or default_vocabulary())

    def run(batches):
        tokens, size, first = _token_bytes(os.path.join(SparkFiles.getRootDirectory(), vocabulary))
        for batch in batches:
            equal = []
            for text, ids in zip(batch.column(1), batch.column(2), strict=True):
                i = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                n = size[i]
                run_ = np.cumsum(n)
                at = np.repeat(first[i] - (run_ - n), n) + np.arange(int(run_[-1]) if i.size else 0)
                equal.append(tokens[at].tobytes() == (text.as_py() or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(equal, pa.bool_())], ["id", "equal"])

    kind = docs.schema[id_col].dataType.simpleString()
    both = docs.select(id_col, text_col).join(encoded.select(id_col, "ids"), id_col)
    return both.mapInArrow(run, f"id {kind}, equal boolean").withColumnRenamed("id", id_col)


@cache
def _token_bytes(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all token bytes one after another, length, first byte) by id."""
    with open(vocabulary, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks) + 1, np.int64)
    for i, t in ranks.items():
        size[i] = len(t)
    raw = b"".join(ranks.get(i, b"") for i in range(size.size))
    return np.frombuffer(raw, np.uint8), size, np.cumsum(size) - size
