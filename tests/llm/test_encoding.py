"""Ids against the public tokenizer, the automaton against a dictionary."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import encoding
from keyfold.llm.lexicon import Lexicon, minimal_automaton
from tests.conftest import DATA

EDGE = [
    "", " ", "\n", "  \n\n x", "a  b", "it's we're I'll 'tis 's's '' 'S don't!'s", " 's\n's\t's", "x'", "x'l", "'re", "a b　　c  d",
    "<|endoftext|> is text", "日本語 текст ελληνικά 😀🚀 é", "123 456abc٣٤", "﻿​\x00\x07", "tab\t\tend\t", "\r\n\r\n", "word " * 300, "x" * 5000, "é" * 700, " " * 3000 + "z", "ab'" * 40,
]


@pytest.fixture(scope="module")
def truth():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def encoder(words):
    vocabulary = encoding.default_vocabulary()
    return encoding.Encoder(Lexicon.build(words, encoding.merger(vocabulary)), vocabulary)


@pytest.mark.parametrize("words", [[], [b" the", b"a", b" b", b"it", b"'s", b"word", b" word", b"x", b"\n", b" "]])
def test_edge_texts(truth, words, monkeypatch):
    enc = encoder(words)
    for piece in (1, 64, 1 << 20):
        monkeypatch.setattr(encoding, "PIECE", piece)
        column = pa.array([*EDGE, None])
        got = enc.ids(column).to_pylist()
        assert got == [*truth(EDGE), []]
        assert enc.counts(column).tolist() == [len(x) for x in got]
    assert enc.ids(pa.array([], pa.string())).to_pylist() == []
    assert enc.ids(column.slice(3, 4)).to_pylist() == got[3:7]


PIECES = st.lists(st.sampled_from(["'s", "'ll", "'", " ", "  ", "\n", "\t", " ", "　", "a", "Wörd", "the", "9", "٣", "!", "…", "日", "😀", "́"]), max_size=25).map("".join)


@given(st.lists(PIECES | st.text(max_size=20), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_random_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _T, _E
    if "_T" not in globals():
        _T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _T.encode_special_tokens = True
        _E = encoder([b" the", b"the", b"'s", b" a", b"a", b" ", b"\n", "Wörd".encode()])
    # Letters that Unicode has assigned only lately are classed as the installed libraries know them.
    import unicodedata

    texts = ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in texts]
    assert _E.ids(pa.array(texts)).to_pylist() == [e.ids for e in _T.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(min_size=1, max_size=8), min_size=1, max_size=30))
@settings(max_examples=80, deadline=None)
def test_lexicon_is_a_dictionary(words, asked):
    lex = Lexicon.build(words, lambda w: list(w))
    ordered = sorted(set(words))
    probe = asked + words
    data = np.frombuffer(b"".join(probe), np.uint8)
    lengths = np.array([len(p) for p in probe])
    got = lex.find(data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [ordered.index(p) if p in set(words) else -1 for p in probe]
    for i, w in enumerate(ordered):
        assert lex.ids[lex.first[i] : lex.first[i + 1]].tolist() == list(w)


def test_automaton_is_minimal(tmp_path):
    words = sorted(a + b for a in (b"re", b"un", b"pre") for b in (b"ading", b"doing", b"going"))
    states, _ = minimal_automaton(words)
    assert len(states) == len(set(states)) < 16
    lex = Lexicon.build(words, lambda w: [len(w)])
    path = tmp_path / "lex.bin"
    path.write_bytes(lex.to_bytes())
    again = Lexicon.open(str(path))
    assert isinstance(again.owner.base, np.ndarray) and again.size == 9
    assert again.find(np.frombuffer(b"rereading", np.uint8), np.array([0, 2]), np.array([2, 7])).tolist() == [-1, words.index(b"reading")]


def test_corpus(spark, truth):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in encoding.encode(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    want = dict(zip(texts, truth([t or "" for t in texts.values()]), strict=True))
    assert got == want
    counted = encoding.token_counts(docs.select("doc_id", "source", "text"))
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {k: len(v) for k, v in want.items()}


def test_rows_of_all_kinds(spark, truth):
    long = "long text, very 12 " * 60_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "null id", "c"), (3, long, "d"), (3, long, "d")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, len(r.ids)) for r in encoding.encode(df).collect()))
    n = len(truth([long])[0])
    assert got == [(0, 2), (1, 0), (2, 0), (3, n), (3, n)]
    assert encoding.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encoding.token_counts(df.withColumn("n_tokens", F.lit(1)))


def test_frequent_words_count_all_texts(spark):
    df = spark.createDataFrame([("a a b",), ("b a c",), (None,), ("",)], "text string").repartition(3)
    assert [(bytes(r.word), r.n) for r in encoding.frequent_words(df).collect()] == [(b" a", 2)]
    more = spark.createDataFrame([(" x" * 5 + " y" * 3 + " z" * 3 + " w" * 2,)] * 2 + [(" h" * 3000,)], "text string")
    count = lambda most: sorted((bytes(r.word).decode(), r.n) for r in encoding.frequent_words(more, most=most).collect())
    assert count(9) == [(" h", 3000), (" w", 4), (" x", 10), (" y", 6), (" z", 6)]
    assert count(3) == count(2) == [(" h", 3000), (" x", 10)]
    assert count(0) == []
