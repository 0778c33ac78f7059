"""Rules on small cases: nulls, ties, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import dispatch, levels, merge, mvcc, raftlog, reads, regions
from keyfold.schema import InvalidArgument
from keyfold.sources import tables

from .conftest import rows


def test_newest_by_hash_aggregate(spark):
    """Fixed columns never sort; wide ones are fetched by what identifies a version; ties and NULL keys are defined."""
    data = [(None, 1, 5, "a", 1.0), (None, 2, 5, "b", 2.0), ("k", 7, 1, "c", None), ("k", 7, 3, "d", 4.0), ("k", 3, 9, "e", 5.0), ("z", None, 1, "f", 6.0)]
    df = spark.createDataFrame(data, "k string, seq bigint, op int, wide string, v double")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    narrow = mvcc.newest(df.drop("wide"), ["k"], "seq", ["op"])
    assert rows(narrow, "k", "seq", "op", "v") == [("k", 7, 3, 4.0), (None, 2, 5, 2.0)]
    assert "SortAggregate" not in plan(narrow) and "Sort " not in plan(narrow)
    wide = mvcc.newest(df, ["k"], "seq", ["op"], unique=["k", "seq", "op"])
    assert rows(wide, "k", "wide") == [("k", "d"), (None, "b")] and "SortAggregate" not in plan(wide)
    assert rows(mvcc.newest(df, ["k"], "seq", ["op"]), "k", "wide") == [("k", "d"), (None, "b")]
    assert mvcc.newest(df.limit(0), ["k"], "seq").count() == 0
    assert rows(mvcc.newest(df.selectExpr("k", "seq", "CAST(op - 4 AS TINYINT) AS op", "op > 2 AS b", "v"), ["k"], "seq", ["op", "b"]), "k", "op") == [("k", -1), (None, 1)]


@pytest.mark.parametrize("count", [2, 72])
def test_overlapping_regions_are_refused(spark, count):
    made = [(i, bytearray(b"%04d" % (10 * i)), bytearray(b"%04d" % (10 * i + 5))) for i in range(1, count)]
    schema = "region_id bigint, start_key binary, end_key binary"
    keys = spark.createDataFrame([(bytearray(b"0012"),)], "k binary")
    assert rows(regions.route(keys, spark.createDataFrame(made + [(999, bytearray(b"0016"), bytearray(b"0018"))], schema), "k"), "region_id") == [(1,)]
    with pytest.raises(InvalidArgument):
        regions.route(keys, spark.createDataFrame(made + [(999, bytearray(b"0011"), bytearray(b"0018"))], schema), "k")
    with pytest.raises(InvalidArgument):
        regions.validate(spark.createDataFrame([(*m, [1]) for m in made] + [(999, bytearray(b""), None, [1])], schema + ", peers array<bigint>"))


@pytest.mark.parametrize("count", [2, 80])
def test_open_and_empty_ranges(spark, count):
    made = [(i, bytearray(b"m%04d" % (2 * i)), bytearray(b"m%04d" % (2 * i + 1))) for i in range(1, count)]
    table = spark.createDataFrame(made + [(500, None, bytearray(b"b")), (501, bytearray(b"z"), None), (502, bytearray(b"y"), bytearray(b"x"))], "region_id bigint, start_key binary, end_key binary")
    df = spark.createDataFrame([(bytearray(k) if k is not None else None, "x") for k in (b"", b"a", b"b", b"m0002", b"m0003", b"y", b"zz", None)], "k binary, __k string").withColumns({"region_id_found": F.lit(1), "region_id": F.lit("clash")})
    got = rows(regions.route(df, table, "k"), "k", "region_id")
    assert regions.route(df, table, "k").columns == ["k", "__k", "region_id_found", "region_id"]
    assert dict(got) == {b"": 500, b"a": 500, b"b": None, b"m0002": 1, b"m0003": None, b"y": None, b"zz": 501, None: None}


def test_seventy_ranges_of_numbers(spark):
    ranges = spark.createDataFrame([(10 * i, 10 * i + 3) for i in range(70)] + [(20, 28), (None, 5)], "smallest bigint, largest bigint")
    got = levels.covered(spark.range(-3, 700).withColumn("largest", F.lit("clash")), ranges, "id")
    assert {r.id for r in got.filter("__covered").collect()} == {i for i in range(700) if i % 10 <= 3 or 20 <= i <= 28}
    assert rows(levels.covered(spark.createDataFrame([(2**63 - 1,), (None,)], "id bigint"), spark.createDataFrame([(5, 2**63 - 1)], "smallest bigint, largest bigint"), "id"), "__covered") == [(False,), (True,)]


def test_carried_values(spark):
    df = spark.createDataFrame([(i, (7 * i) % 11 if i % 3 else None) for i in range(200)], "o bigint, v bigint")
    got = {r.o: r.m for r in merge.carried_max(df, "o", "v", "m").collect()}
    best, want = None, {}
    for i in range(200):
        want[i] = best
        v = (7 * i) % 11 if i % 3 else None
        best = v if best is None or (v is not None and v > best) else best
    assert got == want and merge.carried_max(df.limit(0), "o", "v", "m").count() == 0


@pytest.mark.parametrize("more", [0, 80])
def test_dispatch(spark, more):
    b = lambda x: None if x is None else bytearray(x)
    data = [
        (1, 1, 2, "c", b"a", b"v", None), (1, 2, 2, "c", b"b", b"v", None), (1, 3, 2, "c", b"a", b"v", None),  # a batch, one command twice
        (2, 4, 2, "c", b"a", b"v", None), (2, 5, 1, "c", b"a", None, None), (3, 6, 1, "c", b"a", None, None), (3, 7, 3, "c", b"a", None, None),
        (4, 8, 2, "c", b"a", b"v", None), (4, 9, 3, "c", b"z", None, None), (5, 10, 2, "c", b"a", None, None), (6, 11, 0, None, None, None, None),
        (7, 12, 4, "c", None, None, b"n"), (8, 13, 1, "c", None, None, None), (9, 14, 1, "c", b"q", None, None), (None, 15, 1, "c", b"a", None, None), (10, 16, 9, "c", b"a", None, None),
    ]
    df = spark.createDataFrame([(i, n, k, cf, b(key), b(v), b(s), None, "x") for i, n, k, cf, key, v, s in data], "batch_id bigint, req_no bigint, cmd_type int, cf string, key binary, value binary, start_key binary, scan_limit bigint, leader string")
    table = spark.createDataFrame([(1, b(b""), b(b"m"), 7), (2, b(b"m"), b(b"p"), None), (3, b(b"x"), b(b""), 9)] + [(100 + i, b(b"t%03d" % (2 * i)), b(b"t%03d" % (2 * i + 1)), 1) for i in range(more)], "region_id bigint, start_key binary, end_key binary, leader bigint")
    got = {r.batch_id: (r.results, r.error, r.region_id, r.leader) for r in dispatch.answers(df, table).collect()}
    assert got == {
        1: (2, None, 1, 7), 2: (0, dispatch.NOT_WRITES, 1, 7), 3: (0, dispatch.NOT_ALONE, 1, 7), 4: (0, dispatch.SPANS, 1, 7), 5: (0, dispatch.NO_VALUE, 1, 7),
        6: (0, dispatch.NO_KEY, None, None), 7: (1, None, 2, None), 8: (0, dispatch.NO_KEY, None, None), 9: (0, dispatch.NO_REGION, None, None), 10: (0, dispatch.NO_KEY, None, None),
    }
    assert dispatch.answers(df.limit(0), table).count() == 0


def test_log_storage_and_outcomes(spark):
    log = spark.createDataFrame([(1, i, 1 + i // 4) for i in range(1, 9)], "region_id bigint, idx bigint, term bigint")
    s = raftlog.LogStorage(log).compact(3)
    assert rows(s.bounds()) == [(1, 3, 8)] and rows(s.entries(3, 5), "idx") == [(3,), (4,)]
    with pytest.raises(InvalidArgument):
        s.entries(2, 5)
    longer = s.append(spark.createDataFrame([(1, 7, 9), (1, 6, 2)], "region_id bigint, idx bigint, term bigint"))
    assert rows(longer.rows, "idx", "term") == [(3, 1), (4, 2), (5, 2), (6, 2), (7, 9)]
    asked = spark.createDataFrame([(1, 7, 9), (1, 7, 2), (1, 99, 1), (2, 1, 1)], "region_id bigint, idx bigint, term bigint")
    applied = spark.createDataFrame([(1, 8)], "region_id bigint, applied bigint")
    assert rows(raftlog.proposal_results(asked, longer.rows, applied), "idx", "term", "outcome") == [(1, 1, "waiting"), (7, 2, "superseded"), (7, 9, "done"), (99, 1, "waiting")]


def test_read_states(spark):
    asked = spark.createDataFrame([(1, 1, 5, True), (1, 2, 50, True), (1, 3, 5, False), (1, 4, 5, None), (1, 5, 5, True), (2, 1, 5, True), (1, 6, 5, True)], "region_id bigint, read_id bigint, read_idx bigint, leads boolean")
    ok = spark.createDataFrame([(1, i) for i in (1, 1, 2, 3, 6)] + [(2, 1)], "region_id bigint, read_id bigint")
    got = reads.lifecycle(asked, ok, spark.createDataFrame([(1, 10)], "region_id bigint, applied bigint"), spark.createDataFrame([(1, 6)], "region_id bigint, read_id bigint"))
    assert {(r.region_id, r.read_id): r.state for r in got.collect()} == {
        (1, 1): "served", (1, 2): "waiting", (1, 3): "not leader", (1, 4): "not leader", (1, 5): "unconfirmed", (2, 1): "waiting", (1, 6): "cancelled",
    }


def test_filters_both_ways(spark, monkeypatch):
    monkeypatch.setattr(tables, "FILTER_KEYS", 100)
    keys = spark.range(450).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "'x' AS may2")
    filters = tables.materialise(tables.build_filters(keys, "key"), "f")
    assert filters.count() == 5 and filters.agg(F.sum("keys")).first()[0] == 450
    asked = keys.unionByName(spark.range(10_000, 12_000).selectExpr("CAST(CAST(id AS STRING) AS BINARY) AS key", "'x' AS may2")).unionByName(spark.createDataFrame([(None, "x")], "key binary, may2 string"))
    first = tables.may_contain(asked, "key", filters)
    monkeypatch.setattr(tables, "broadcastable", lambda df: False)
    for got in (first, tables.may_contain(asked, "key", filters)):
        table = rows(got.groupBy("may").count())
        by = dict(table)
        assert by[None] == 1 and 450 <= by[True] <= 450 + 60 and by[True] + by[False] == 2450
        assert got.filter("NOT may").join(keys, "key", "left_semi").count() == 0
    assert tables.build_filters(keys.limit(0), "key").count() == 0
    assert [r.may for r in tables.may_contain(keys.limit(1), "key", filters.limit(0)).collect()] == [False]
