"""Text garbled by a wrong character encoding: found and restored by expectation-maximization."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup, materialise, ship_package
from . import chains

#: Buckets of the hashed table of character pairs: the bound of what the driver collects.
PAIRS = 1 << 18
#: Rounds of expectation and maximization at most, and the change of the expected number of garbled records that ends them.
ROUNDS = 8
SETTLED = 0.005
#: Share of a chain among the documents of a source before any evidence.
PRIOR = 0.0003
#: Weight, in documents, of the shares over all sources in those of one.
POOL = 50.0
#: Least gain of a restored word that counts as evidence.
GAIN = 1.0
#: A candidate whose letters are that much less likely than the word's is not pursued.
HOPELESS = 6.0
#: Words whose candidates are scored together.
SCORED = 256
#: Times that a symbol is taken to have come in a context where it never came.
NEW_CONTEXT = 0.5

_NO_SOURCE = "\x00"


def _pair_buckets(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of characters but the last, and of the pairs that they begin."""
    first = (cp[:-1] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    pair = ((cp[:-1] * np.uint64(0x100000001B3) + cp[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
    return first.astype(np.int64), pair.astype(np.int64)


def _pair_codes(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the characters and of the pairs of a word with its two ends."""
    return _pair_buckets(np.frombuffer(f"\x02{word}\x03".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))


def _count_pairs(batches):
    """(bucket, n) of character pairs (from 0) and of first characters (from ``PAIRS``)."""
    total = np.zeros(2 * PAIRS, np.int64)
    for batch in batches:
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            first, pair = _pair_codes(w)
            np.add.at(total, pair, n)
            np.add.at(total, first + PAIRS, n)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


class _Letters:
    """Log probability of a word's letters under hashed pair counts."""

    def __init__(self, counts: np.ndarray):
        self.pairs, self.firsts = counts[:PAIRS], counts[PAIRS:]

    def many(self, words: list[str]) -> np.ndarray:
        """Of many words at once."""
        if not words:
            return np.zeros(0)
        cp = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        first, pair = _pair_buckets(cp)
        logs = np.append(np.log((self.pairs[pair] + 0.02) / (self.firsts[first] + 100.0)), 0.0)
        logs[ends - 1] = 0.0  # from one word to the next
        return np.add.reduceat(logs, ends - sizes)


def _tokens(docs: DataFrame, id_col: str, source_col: str, text_cols: list[str]) -> DataFrame:
    """(id, source, field, word, context, beside, n) of all words outside ASCII."""

    def run(batches):
        for batch in batches:
            ids, sources = batch.column(0), batch.column(1).to_pylist()
            row, field, word, context, beside, n = [], [], [], [], [], []
            for f, name in enumerate(text_cols):
                for i, text in enumerate(batch.column(2 + f).to_pylist()):
                    if text is None or text.isascii():
                        continue
                    for (w, c, q), k in Counter((w, c, q) for w, c, _, _, q in chains.words(text)).items():
                        row.append(i)
                        field.append(name)
                        word.append(w)
                        context.append(c)
                        beside.append(q)
                        n.append(k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int64())), pa.array([sources[i] for i in row], pa.string()), pa.array(field, pa.string()),
                 pa.array(word, pa.string()), pa.array(context, pa.string()), pa.array(beside, pa.list_(pa.string())), pa.array(n, pa.int64())],
                ["id", "source", "field", "word", "context", "beside", "n"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    other = F.lit(False)
    for c in text_cols:
        other = other | F.coalesce(F.col(c).rlike(r"[^\x00-\x7F]"), F.lit(False))
    rows = docs.filter(F.col(id_col).isNotNull() & other).select(
        F.col(id_col), F.coalesce(F.col(source_col).cast("string"), F.lit(_NO_SOURCE)).alias("source"), *text_cols
    )
    return rows.mapInArrow(run, f"id {kind}, source string, field string, word string, context string, beside array<string>, n bigint")


def _candidates(vocabulary: DataFrame, letters) -> DataFrame:
    """(word, context, n, chain, restored, weight, and the log probabilities of the letters)."""

    def run(batches):
        score = _Letters(letters.value)
        for batch in batches:
            out: list[tuple] = []
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for at in range(0, len(rows), SCORED):
                piece = [(w, c, n, chains.candidates(w)) for w, c, n in rows[at : at + SCORED]]
                # Letters tell nothing of a word without any, nor of plain text.
                texts = {w for w, *_ in piece} | {r for w, _, _, found in piece if any(x.isalpha() for x in w) for chain, r, _ in found if r is not None and not chain.startswith("utf-16")}
                known = dict(zip(order := list(texts), score.many(order).tolist(), strict=True))
                for w, c, n, found in piece:
                    own = known[w]
                    lettered = any(x.isalpha() for x in w)
                    for chain, restored, weight in found:
                        if restored is None:
                            if c != chains.QUOTED or w.strip("\ufffd"):  # else the replacement character itself, quoted
                                out.append((w, c, n, chain, None, weight, own, 0.0))
                            continue
                        letters_ = known[restored] if lettered and not chain.startswith("utf-16") else own
                        if letters_ + weight > own - HOPELESS:
                            out.append((w, c, n, chain, restored, weight, own, letters_))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)],
                ["word", "context", "n", "chain", "restored", "weight", "own_letters", "letters"],
            )

    # The vocabulary is small in bytes but costly by row: spread it over all tasks.
    tasks = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vocabulary.repartition(tasks, "word", "context").mapInArrow(
        run, "word string, context string, n bigint, chain string, restored string, weight double, own_letters double, letters double"
    )


def _gains(candidates: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Log ratio of a restored word's probability to the garbled one's, where it is evidence.

    A word's probability mixes its count, of which the garbled word itself is one,
    with that of its letters; a symbol's is its count in its context alone.
    """
    own = counts.select("word", "context", F.col("held").alias("own_held"))
    other = counts.select(F.col("word").alias("restored"), "context", "held")

    def p(held, letters):
        new = F.when(F.col("context") == "", 0.1 * F.exp(letters)).otherwise(NEW_CONTEXT / max(total, 1))
        return F.log(F.lit(0.9 / max(total, 1)) * F.greatest(held, F.lit(0.0)) + new + F.lit(1e-300))

    gain = (
        F.when(F.col("restored").isNull(), F.col("weight")).otherwise(
            p(F.coalesce("held", F.lit(0.0)), F.col("letters")) - p(F.col("own_held") - 1, F.col("own_letters")) + F.col("weight")
        )
    )
    return (
        candidates.join(own, ["word", "context"]).join(other, ["restored", "context"], "left")
        .withColumn("gain", gain).filter(F.col("gain") > GAIN)
        .select("word", "context", "chain", "gain", "restored")  # a word has one candidate per chain
    )


def _evidence(tokens: DataFrame, gains: DataFrame) -> DataFrame:
    """Words of records with their gains, but for garbled words that are quoted on purpose: beside their clean form, quoted too."""
    meant = F.coalesce(F.array_contains("beside", F.col("restored")), F.lit(False))
    return tokens.join(gains, ["word", "context"]).filter(~meant)


def _posteriors(evidence: DataFrame, shares: DataFrame) -> DataFrame:
    """(id, source, field, chain, posterior) from the evidence of a record's words and the chain's share."""
    # A word that comes again tells less each time: like the sum 1 + 1/2 + ... + 1/n.
    repeated = F.col("gain") * (1 + F.log(F.col("n").cast("double")))
    per = evidence.groupBy("id", "source", "field", "chain").agg(F.sum(repeated).alias("gain"))
    scored = per.join(shares, ["source", "field", "chain"], "left").withColumn(
        "score", F.col("gain") + F.log(F.coalesce("share", F.lit(PRIOR)))
    )
    record = Window.partitionBy("id", "field")  # at most a row per chain
    top = F.greatest(F.max("score").over(record), F.lit(0.0))
    scored = scored.withColumn("top", top).withColumn("e", F.exp(F.col("score") - F.col("top")))
    return scored.withColumn("posterior", F.col("e") / (F.exp(-F.col("top")) + F.sum("e").over(record))).select(
        "id", "source", "field", "chain", "posterior"
    )


def _shares(posteriors: DataFrame, records: DataFrame) -> DataFrame:
    """Share of each chain per source and field, drawn towards its share over all sources."""
    per = posteriors.groupBy("source", "field", "chain").agg(F.sum("posterior").alias("sum"))
    every = records.groupBy("field").agg(F.sum("docs").alias("all_docs"))
    pooled = per.groupBy("field", "chain").agg(F.sum("sum").alias("all_sum")).join(every, "field").select(
        "field", "chain", F.greatest((F.col("all_sum") + 0.3) / F.col("all_docs"), F.lit(PRIOR / 10)).alias("pooled")
    )
    return (
        per.join(records, ["source", "field"]).join(pooled, ["field", "chain"])
        .select("source", "field", "chain", ((F.col("sum") + POOL * F.col("pooled")) / (F.col("docs") + POOL)).alias("share"))
    )


class Garbled:
    """Result of ``find``.

    ``records`` (id, field, chain, probability) are the found ones, ``words``
    (id, field, word, context, n) all words outside ASCII, ``gains`` (word,
    context, chain, gain, restored) the evidence of the last round and
    ``shares`` the chains' shares per source and field.
    """

    def __init__(self, records: DataFrame, words: DataFrame, gains: DataFrame, shares: DataFrame):
        self.records, self.words, self.gains, self.shares = records, words, gains, shares


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_cols: tuple[str, ...] = ("text",),
    rounds: int = ROUNDS,
    least: float = 0.5,
) -> Garbled:
    """Records that hold passages decoded with a wrong encoding.

    Each record of a field has a latent chain (true encoding, wrong encoding, or
    none). Words outside ASCII give evidence for a chain if undoing it makes them
    more likely; likelihoods come from word counts and letter pairs of the whole
    corpus. The expectation step weighs the evidence of a record's words with
    the chain's share in its source and field; the maximization step takes these
    shares and the counts of words, garbled ones less and less, from the
    posteriors. Evidence that is weak in one record is so settled by many. Rounds
    end when the expected number of garbled records hardly changes.

    Every word of every text is used; a word that comes n times in a record counts
    1 + ln n times. A word that fills a pair of quotes gives no evidence if its
    restored form is quoted in the same line too, for then it is quoted on
    purpose. Defined results: NULL, empty and ASCII
    texts are never found; a NULL source is a source of its own; rows with a NULL
    id are left out; repeated texts are judged each; an empty table gives none.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokens = materialise(_tokens(docs, id_col, source_col, list(text_cols)), "garbled-words")
    vocabulary = materialise(tokens.groupBy("word", "context").agg(F.sum("n").alias("n")), "garbled-vocabulary")
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    table = np.zeros(2 * PAIRS, np.int64)
    pairs = vocabulary.select("word", "n").mapInArrow(_count_pairs, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = pairs.toArrow()  # a row per bucket at most
    table[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    letters = spark.sparkContext.broadcast(table)
    candidates = materialise(_candidates(vocabulary, letters), "garbled-candidates")

    names = [F.lit(c) for c in text_cols]
    records = materialise(
        docs.filter(F.col(id_col).isNotNull())
        .groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(_NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("docs"))
        .withColumn("field", F.explode(F.array(*names))), "garbled-records",
    )
    counts = vocabulary.select("word", "context", F.col("n").cast("double").alias("held"))
    shares = spark.createDataFrame([], "source string, field string, chain string, share double")
    gains = posteriors = before = None
    for r in range(rounds):
        gains = materialise(_gains(candidates, counts, total), "garbled-gains")
        evidence = _evidence(tokens, gains)
        posteriors = materialise(_posteriors(evidence, lookup(shares, "garbled-shares")[0]), "garbled-posteriors")
        shares = _shares(posteriors, records)
        now = posteriors.agg(F.coalesce(F.sum("posterior"), F.lit(0.0))).first()[0]
        settled, before = before is not None and abs(now - before) <= SETTLED * max(before, 1.0), now
        if settled:
            break
        if r + 1 < rounds:
            moved = evidence.join(posteriors, ["id", "source", "field", "chain"]).groupBy("word", "context").agg(
                F.sum(F.col("n") * F.col("posterior")).alias("moved")
            )
            counts = materialise(
                vocabulary.join(moved, ["word", "context"], "left").select(
                    "word", "context", (F.col("n") - F.coalesce("moved", F.lit(0.0))).alias("held")
                ), "garbled-counts",
            )
    found = posteriors.groupBy("id", "field").agg(
        F.sum("posterior").alias("probability"), F.max(F.struct("posterior", "chain")).alias("best")
    ).filter(F.col("probability") > least).select(F.col("id").alias(id_col), "field", F.col("best.chain").alias("chain"), "probability")
    return Garbled(materialise(found, "garbled-found"), tokens, gains, shares)


def restore(docs: DataFrame, garbled: Garbled, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chain, probability, restored, complete) of the found records.

    The words that are evidence for a record's chain are replaced by what the
    chain makes of them; clean words between them stay. ``complete`` is false if
    a word has lost characters for good, or if a word that stays, quoted ones
    included, has evidence for another chain or could still be restored.
    """
    ship_package(docs.sparkSession)
    found = garbled.records.filter(F.col("field") == text_col)
    fixes = (
        found.join(_evidence(garbled.words, garbled.gains).withColumnsRenamed({"id": id_col, "chain": "by"}), [id_col, "field"])
        .groupBy(id_col, "word", "context").agg(F.max(F.when(F.col("by") == F.col("chain"), F.col("restored"))).alias("restored"))
        .groupBy(id_col).agg(F.collect_list(F.struct("word", "context", "restored")).alias("fixes"))  # NULL: evidence for other chains alone
    )
    wanted = docs.select(id_col, text_col).join(found.drop("field"), id_col).join(fixes, id_col, "left")

    def run(batches):
        for batch in batches:
            fixed, complete = [], []
            for text, chain, known in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4)), strict=True):
                new = {(x["word"], x["context"]): x["restored"] for x in known or []}
                out, at, whole = [], 0, True
                for w, c, a, b, q in chains.words(text):
                    fixed_word = new.get((w, c))
                    if q and fixed_word in q:
                        fixed_word = None  # quoted on purpose
                    if fixed_word is None:  # stays
                        fixed_word = w
                        whole = whole and (w, c) not in new and not chains.may_be_garbled(w, chain)
                    whole = whole and "\ufffd" not in fixed_word
                    out += [text[at:a], fixed_word]
                    at = b
                fixed.append("".join(out) + text[at:])
                complete.append(whole)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:1], *batch.columns[2:4], pa.array(fixed, pa.string()), pa.array(complete)],
                [id_col, "chain", "probability", "restored", "complete"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return wanted.select(id_col, text_col, "chain", "probability", "fixes").mapInArrow(
        run, f"`{id_col}` {kind}, chain string, probability double, restored string, complete boolean"
    )
