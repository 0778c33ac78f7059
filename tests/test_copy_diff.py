"""Differences between two copies."""

from keyfold.operators import copy_diff

from .conftest import rows

SCHEMA = "cf string, key binary, region_id bigint, idx bigint, value binary, side string"


def compare(spark, left, right):
    make = lambda data: spark.createDataFrame([(c, None if k is None else bytearray(k), r, i, None if v is None else bytearray(v), "extra") for c, k, r, i, v in data], SCHEMA)
    return copy_diff.compare_copies(make(left), make(right), ["cf", "key"], ["region_id", "idx", "value"])


def test_field_by_field(spark):
    left = [("a", b"1", 1, 1, b"x"), ("a", b"2", None, 1, b""), ("a", b"3", 1, 1, None), ("a", b"4", 1, 1, b"x"), ("a", b"4", 1, 1, b"x"), (None, b"", 5, 5, b"n"), ("b", None, 1, 1, b"")]
    right = [("a", b"1", 1, 1, b"x"), ("a", b"2", None, 1, None), ("a", b"3", 2, None, None), ("b", b"4", 1, 1, b"x"), (None, b"", 5, 6, b"n"), ("b", None, 1, 1, b"")]
    df = compare(spark, left, right)
    got = {(r.cf, None if r.key is None else bytes(r.key)): (r.side, [tuple(d) for d in r.differences]) for r in df.collect()}
    assert got == {
        ("a", b"1"): ("both", []),
        ("a", b"2"): ("both", [("value", "", None)]),
        ("a", b"3"): ("both", [("region_id", "1", "2"), ("idx", "1", None)]),
        ("a", b"4"): ("left", []),
        ("b", b"4"): ("right", []),
        (None, b""): ("both", [("idx", "5", "6")]),
        ("b", None): ("both", []),
    }
    assert rows(copy_diff.difference_rows(df, "no_left", "no_right")) == sorted(
        [("a", b"2", "value"), ("a", b"3", "region_id"), ("a", b"3", "idx"), ("a", b"4", "no_right"), ("b", b"4", "no_left"), (None, b"", "idx")], key=repr
    )


def test_empty_copies(spark):
    one = [("a", b"1", 1, 1, b"x")]
    assert rows(compare(spark, [], []), "side") == []
    assert rows(compare(spark, one, []), "side") == [("left",)]
    assert rows(compare(spark, [], one * 50), "side") == [("right",)]


def test_hot_key_repeats_collapse(spark):
    df = compare(spark, [("a", b"1", 1, 1, b"x")] * 3000, [("a", b"1", 1, 1, b"y")] * 3000)
    assert [(r.side, [tuple(d) for d in r.differences]) for r in df.collect()] == [("both", [("value", "78", "79")])]


def test_key_with_many_rows_gives_one_row(spark):
    left = [("a", b"1", 1, i, b"x") for i in range(300)]
    assert [(r.side, [tuple(d) for d in r.differences]) for r in compare(spark, left, [("a", b"1", 1, i, b"x") for i in range(1, 301)]).collect()] == [("both", [("idx", "0", "300")])]
    assert [(r.side, r.differences) for r in compare(spark, left, left[::-1]).collect()] == [("both", [])]
    got = compare(spark, left, [("a", b"1", None, i, b"x") for i in range(300)]).collect()
    assert [tuple(d) for d in got[0].differences] == [("region_id", "1", None)]


def test_equal_left_out_and_plan(spark):
    make = lambda data: spark.createDataFrame([(c, bytearray(k), r, i, bytearray(v), "") for c, k, r, i, v in data], SCHEMA)
    a = make([("a", b"1", 1, 1, b"x"), ("a", b"2", 1, 1, b"x")])
    b = make([("a", b"1", 1, 1, b"x"), ("a", b"2", 1, 2, b"x")])
    assert rows(copy_diff.compare_copies(a, b, ["cf", "key"], ["idx"], equal=False), "key") == [(b"2",)]


def test_normalised_numbers(spark):
    a = spark.createDataFrame([(1, 1.0, 0.0), (2, float("nan"), -0.0), (3, 2.5, 1.0)], "k bigint, x double, y double").selectExpr("k", "CAST(nanvl(x, 7.0) AS DECIMAL(10, 1)) AS d", "y", "x")
    b = spark.createDataFrame([(1, 1.0, -0.0), (2, float("nan"), 0.0), (3, 2.25, 1.0)], "k bigint, x double, y double").selectExpr("CAST(k AS INT) AS k", "CAST(nanvl(x, 7.0) AS DECIMAL(12, 2)) AS d", "y", "x")
    got = {r.k: [tuple(x) for x in r.differences] for r in copy_diff.compare_copies(a, b, ["k"], ["d", "y", "x"]).collect()}
    assert got == {1: [], 2: [], 3: [("d", "2.50", "2.25"), ("x", "2.5", "2.25")]}
