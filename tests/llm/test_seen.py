"""First-or-repeat answers, also over restarts and disorder."""

import random

import pytest
from pyspark.sql import functions as F

from keyfold.llm import seen
from keyfold.session import shared_path

SCHEMA = "n bigint, cf string, key binary, first_order string"


def write(spark, data, path, files=3):
    df = spark.createDataFrame([(n, c, None if k is None else bytearray(k), "x") for n, c, k in data], SCHEMA)
    df.repartition(files).write.parquet(path)
    return path


def brute(data, known):
    have, out = set(known), []
    for n, c, k in sorted(data):
        if k is not None:
            if (c, k) in have:
                out.append(n)
            have.add((c, k))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_with_restart(spark, seed):
    rng = random.Random(seed)
    data = [(n, rng.choice(["a", "b", None]), rng.choice([b"hot"] * 6 + [b"", None, b"\xff", bytes([rng.randint(0, 255)])])) for n in range(400)]
    known = [("a", b"\x05"), ("a", b""), ("a", b"")]
    rng.shuffle(data)
    p1, p2 = (write(spark, part, shared_path(spark, "req")) for part in (data[:250], data[250:]))
    old = shared_path(spark, "old")
    spark.createDataFrame([(c, bytearray(k)) for c, k in known], "cf string, key binary").write.parquet(old)
    both = shared_path(spark, "req")
    spark.read.parquet(p1).write.parquet(both)
    keys = seen.SeenKeys(spark, shared_path(spark, "seen"), ["cf", "key"])
    streams = lambda: (keys.stream(old, None), keys.stream(both, "n"))
    keys.absorb(*streams())
    asked = lambda: spark.read.parquet(both).select("*", keys.file_id().alias("__file"))
    first = asked()
    assert sorted(r.n for r in keys.repeats(first, "n").collect()) == brute(data[:250], known)
    spark.read.parquet(p2).write.mode("append").parquet(both)
    keys.absorb(*streams())
    every = asked()
    # Records of files that came after the last batch are not answered, whether their key is known or not.
    late = write(spark, [(9001, "a", b"hot"), (9002, "zz", b"never seen")], shared_path(spark, "late"), 1)
    unread = spark.read.parquet(late).select("*", keys.file_id().alias("__file"))
    assert [r.seen for r in keys.flagged(unread, "n").collect()] == [None, None] and keys.repeats(unread, "n").count() == 0
    want = brute(data, known)
    assert sorted(r.n for r in keys.repeats(every, "n").collect()) == want
    flagged = keys.flagged(every, "n")
    assert sorted(r.n for r in flagged.filter("seen").collect()) == want
    assert flagged.filter("seen IS NULL").count() == sum(k is None for _, _, k in data)
    report = seen.wrong_answers(flagged, spark.read.parquet(old), ["cf", "key"], "n").first()
    assert (report.records, report.repeats, report.wrong, report.wrong_rate) == (sum(k is not None for _, _, k in data), len(want), 0, 0.0)
    wrong = flagged.withColumn("seen", F.when(F.col("n") == want[0], False).otherwise(F.col("seen")))
    assert seen.wrong_answers(wrong, spark.read.parquet(old), ["cf", "key"], "n").first().wrong == 1


def test_empty_table(spark):
    path = write(spark, [], shared_path(spark, "req"), 1)
    keys = seen.SeenKeys(spark, shared_path(spark, "seen"), ["cf", "key"])
    keys.absorb(keys.stream(path, "n"))
    df = spark.read.parquet(path).select("*", keys.file_id().alias("__file"))
    assert keys.repeats(df, "n").count() == 0
    report = seen.wrong_answers(keys.flagged(df, "n"), df.select("cf", "key"), ["cf", "key"], "n").first()
    assert (report.records, report.wrong_rate) == (0, 0.0)


def test_files_out_of_order_are_corrected(spark):
    """A later file brings smaller orders: what was a first becomes a repeat, by the corrections alone."""
    path = write(spark, [(10, "a", b"k"), (11, None, b"m"), (12, "a", b"n")], shared_path(spark, "req"), 1)
    keys = seen.SeenKeys(spark, shared_path(spark, "seen"), ["cf", "key"], partitions=2)
    keys.absorb(keys.stream(path, "n"))
    asked = lambda: spark.read.parquet(path).select("*", keys.file_id().alias("__file"))
    assert keys.repeats(asked(), "n").count() == 0
    spark.createDataFrame([(1, "a", bytearray(b"k"), "x"), (2, None, bytearray(b"m"), "x"), (30, "a", bytearray(b"n"), "x")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    keys.absorb(keys.stream(path, "n"))
    assert sorted(r.n for r in keys.repeats(asked(), "n").collect()) == [10, 11, 30]
    spark.createDataFrame([(0, "a", bytearray(b"k"), "x")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    keys.absorb(keys.stream(path, "n"))
    assert sorted(r.n for r in keys.repeats(asked(), "n").collect()) == [1, 10, 11, 30]


def test_plan_reads_no_state(spark):
    path = write(spark, [(1, "a", b"k"), (2, "a", b"k")], shared_path(spark, "req"), 1)
    keys = seen.SeenKeys(spark, shared_path(spark, "seen"), ["cf", "key"], partitions=2)
    keys.absorb(keys.stream(path, "n"))
    df = keys.repeats(spark.read.parquet(path).select("*", keys.file_id().alias("__file")), "n")
    assert [r.n for r in df.collect()] == [2]
    assert "StateTable" not in df._jdf.queryExecution().executedPlan().toString()
