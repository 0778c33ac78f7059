"""Routing, batch checks, region snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.operators import regions
from keyfold.schema import InvalidArgument

from .conftest import rows


def test_static_routes(spark):
    df = spark.createDataFrame([("apple",), ("beta",), ("moon",), ("zebra",), ("",), ("m",), ("t",), (None,)], "k string")
    got = dict(rows(regions.route(df, regions.static_regions(spark), "k")))
    assert got == {"apple": 1, "beta": 1, "moon": 2, "zebra": 3, "": 1, "m": 2, "t": 3, None: None}


@pytest.mark.parametrize("count", [5, 200])
def test_routes_against_brute_force(spark, count):
    rng = random.Random(count)
    cuts = sorted({bytes(rng.choices(range(256), k=rng.randint(1, 3))) for _ in range(2 * count)})
    regs = [(i + 1, cuts[2 * i], cuts[2 * i + 1]) for i in range(len(cuts) // 2)]  # gaps between them
    regs[-1] = (*regs[-1][:2], b"")
    keys = [bytes(rng.choices(range(256), k=rng.randint(0, 4))) for _ in range(800)] + [r[1] for r in regs] + [r[2] for r in regs]
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)] + [(-1, None)], "i bigint, k binary")
    table = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, a, b in regs], "region_id bigint, start_key binary, end_key binary")
    want = {i: next((r for r, a, b in regs if a <= k and (not b or k < b)), None) for i, k in enumerate(keys)} | {-1: None}
    assert {r.i: r.region_id for r in regions.route(df, table, "k").collect()} == want


def test_batch_span(spark):
    df = spark.createDataFrame([(1, "apple"), (1, "beta"), (2, "apple"), (2, "moon")], "b bigint, k string")
    routed = regions.route(df, regions.static_regions(spark), "k")
    assert rows(regions.batch_spans(routed, "b")) == [(2, 2)]
    regions.require_one_region(routed.filter("b = 1"), "b")
    with pytest.raises(InvalidArgument):
        regions.require_one_region(routed, "b")
    with pytest.raises(InvalidArgument):
        regions.require_one_region(routed.withColumn("region_id", F.lit(None).cast("bigint")), "b")


def test_validate(spark):
    schema = "region_id bigint, start_key string, end_key string, peers array<bigint>"
    regions.validate(spark.createDataFrame([(1, "", "", [1])], schema))
    for bad in ([], [(0, "", "", [1])], [(1, "", "", [])], [(1, "", "", None)], [(1, "", "a", [1]), (1, "a", "", [1])]):
        with pytest.raises(InvalidArgument):
            regions.validate(spark.createDataFrame(bad, schema))


def test_contains(spark):
    df = spark.createDataFrame([(bytearray(b"a"), bytearray(b"a"), bytearray(b"")), (bytearray(b"b"), bytearray(b"a"), bytearray(b"b"))], "k binary, lo binary, hi binary")
    assert [r[0] for r in df.select(regions.contains(F.col("k"), F.col("lo"), F.col("hi"))).collect()] == [True, False]
