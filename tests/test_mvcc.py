"""Reads of versions: tombstones, snapshots, seek, lookup, merge order."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import merge, mvcc
from keyfold.session import lookup as sized_lookup
from keyfold.schema import Corruption

from .conftest import rows


def versions(spark, *data):
    out = [(k, s, o, v) for k, s, o, v in data]
    return spark.createDataFrame(out, "key string, seq bigint, op int, value string")


def latest(df, as_of=None):
    return rows(mvcc.latest(df, ["key"], "seq", F.col("op") == 0, as_of, ["op"]), "key", "value")


@pytest.fixture
def layered(spark):
    return versions(
        spark, ("alpha", 9, 1, "new"), ("beta", 8, 0, None), ("alpha", 7, 0, None), ("alpha", 5, 1, "old"), ("beta", 4, 1, "hidden"), ("charlie", 3, 1, "visible")
    )


def test_latest(layered):
    assert latest(layered) == [("alpha", "new"), ("charlie", "visible")]


def test_as_of(spark):
    df = versions(spark, ("alpha", 9, 1, "new"), ("alpha", 7, 0, None), ("alpha", 4, 1, "old"), ("beta", 3, 1, "b"))
    assert latest(df, 9) == [("alpha", "new"), ("beta", "b")]
    assert latest(df, 8) == [("beta", "b")]
    assert latest(df, 6) == [("alpha", "old"), ("beta", "b")]
    assert latest(df, 0) == []


def test_seek_scan_limit(spark):
    df = versions(spark, ("alpha", 10, 1, "future"), ("alpha", 5, 1, "visible"), ("charlie", 4, 1, "c"), ("echo", 3, 1, "e"))

    def scan(start, limit=0):
        return [r.key for r in mvcc.scan(df, ["key"], "seq", F.col("op") == 0, start, limit, 5).collect()]

    assert scan("bravo") == ["charlie", "echo"] == scan("charlie")
    assert scan("zulu") == []
    assert scan(None) == ["alpha", "charlie", "echo"]
    assert scan(None, 2) == ["alpha", "charlie"]


def test_lookup_states(spark):
    df = versions(spark, ("key", 1, 1, "old"), ("key", 2, 0, None))
    asked = spark.createDataFrame([("key",), ("none",), ("key",)], "key string")

    def look(as_of):
        return rows(mvcc.lookup(df, asked, ["key"], "seq", F.col("op") == 0, as_of), "key", "state")

    assert look(3) == [("key", "deleted"), ("none", "absent")]
    assert look(1) == [("key", "value"), ("none", "absent")]
    assert rows(mvcc.multi_get(df, asked, ["key"], ["value"], "seq", F.col("op") == 0, 1)) == [("key", "old"), ("none", None)]


def test_nulls_empties_ties_and_extra_columns(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, None, "x"), (None, 2, 1, "", "y"), ("", 1, 1, "", "z"), ("t", 5, 0, None, "d"), ("t", 5, 1, "put", "p"), ("t", 5, 1, "put", "p")],
        "key string, seq bigint, op int, value string, __best string",
    )
    got = mvcc.latest(df, ["key"], "seq", F.col("op") == 0, None, ["op"])
    assert rows(got, "key", "value", "__best") == sorted([(None, "", "y"), ("", "", "z"), ("t", "put", "p")], key=repr)
    assert mvcc.latest(df.limit(0), ["key"], "seq", F.col("op") == 0).count() == 0
    assert rows(mvcc.get(df, ["key"], [None], "seq", F.col("op") == 0), "value") == [("",)]


def test_prefix_bounds(spark):
    df = spark.createDataFrame([(bytearray(b),) for b in (b"", b"a", b"a\xff", b"a\xffz", b"b", b"\xff\xff")], "key binary")
    assert rows(mvcc.prefix(df, "key", b"a")) == [(b"a",), (b"a\xff",), (b"a\xffz",)]
    assert rows(mvcc.prefix(df, "key", b"a\xff")) == [(b"a\xff",), (b"a\xffz",)]
    assert rows(mvcc.prefix(df, "key", b"\xff")) == [(b"\xff\xff",)]
    assert mvcc.prefix(df, "key", b"").count() == 6


def test_merge_order_and_duplicates(spark):
    a = versions(spark, ("b", 1, 1, "x"), ("a", 7, 0, None))
    b = versions(spark, ("a", 9, 1, "y"), ("a", 7, 1, "z"), ("a", 7, 0, None))
    got = [(r.key, r.seq, r.op, r.src) for r in merge.merge([a, b], ["key"], "seq", "op").collect()]
    assert got == [("a", 9, 1, 1), ("a", 7, 1, 1), ("a", 7, 0, 0), ("a", 7, 0, 1), ("b", 1, 1, 0)]
    with pytest.raises(Corruption):
        merge.require_unique(a.unionByName(b), ["key", "seq", "op"])
    merge.require_unique(b, ["key", "seq", "op"])


def test_running_number_sum_gaps_prefix(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("size", F.col("id") % 5)
    got = {r.id: r.seq for r in merge.running_number(df, ["id"], first=10).collect()}
    assert got == {i: i + 10 for i in range(1000)}
    total, want = 0, {}
    for i in range(1000):
        total += i % 5
        want[i] = total
    assert {r.id: r.running for r in merge.running_sum(df, ["id"], "size").collect()} == want
    assert rows(merge.sequence_gaps(df.filter("id NOT IN (0, 5, 6, 900)"), "id")) == [(7, 4), (901, 899)]
    assert merge.sequence_gaps(df.limit(0), "id").count() == 0
    assert rows(merge.valid_prefix(df, "id", F.col("id") != 50)) == [(49,)]
    assert rows(merge.valid_prefix(df, "id", F.col("id") >= 0)) == [(999,)]
    assert rows(merge.valid_prefix(df, "id", F.col("id") < 0)) == [(None,)]


def test_bloom_prune_both_ways(spark, monkeypatch):
    left, right = spark.range(100), spark.range(0, 50, 3)
    want = list(range(0, 50, 3))
    assert sorted(r.id for r in mvcc.bloom_prune(left, right.withColumnRenamed("id", "k"), "id", "k").collect()) == want
    monkeypatch.setattr(mvcc, "sized_lookup", lambda df, label: sized_lookup(df, label, max_bytes=0))
    assert sorted(r.id for r in mvcc.bloom_prune(left, right.withColumnRenamed("id", "k"), "id", "k").collect()) == want


def test_scan_pushes_key_bound(spark, duck):
    from .conftest import DATA

    e = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", "event_type", "value")
    plan = mvcc.scan(e, ["user_id"], "event_id", F.col("event_type") == "error", 5, 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_id,5)" in plan and "TakeOrderedAndProject" in plan


def test_empty_if_absent(spark):
    df = spark.createDataFrame([(None,), (bytearray(b"x"),)], "v binary")
    assert rows(df.select(mvcc.empty_if_absent(F.col("v")).alias("v"))) == [(b"",), (b"x",)]
