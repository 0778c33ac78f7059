"""Compaction: what survives, what is picked, how outputs are split."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import levels
from keyfold.schema import Corruption

from .conftest import rows


def parse(text):
    """'alpha9 delta8D' as versions."""
    out = []
    for w in text.split():
        op = 0 if w.endswith("D") else 1
        w = w.removesuffix("D")
        key = w.rstrip("0123456789")
        out.append((key, int(w[len(key) :]), op))
    return out


def survivors(spark, text, snapshot, lower):
    df = spark.createDataFrame(parse(text), "key string, seq bigint, op int")
    ranges = spark.createDataFrame(lower, "smallest string, largest string")
    kept = levels.collect_garbage(df, ["key"], "seq", "op", F.col("op") == 0, snapshot, ranges)
    return sorted(f"{r.key}{r.seq}{'' if r.op else 'D'}" for r in kept.collect())


@pytest.mark.parametrize(
    "text, snapshot, lower, want",
    [
        ("alpha9 delta8 alpha7D bravo6 alpha5 alpha3 charlie2", 9, [], "alpha9 bravo6 charlie2 delta8"),
        ("alpha9 alpha7 alpha4 bravo8 alpha3 charlie2", 4, [], "alpha4 alpha7 alpha9 bravo8 charlie2"),
        ("key8D key7 key6 key5 key4", 8, [], ""),
        ("key8D key7 key6 key5", 8, [("key", "key")], "key8D"),
        ("key8D key7 key6 key5", 8, [("a", "kex"), ("kez", "z")], ""),
        ("key9 key7 key4 key3", 4, [], "key4 key7 key9"),
        ("key8D key7 key4", 8, [], ""),
        ("key8D key7 key4", 7, [], "key7 key8D"),
        ("", 5, [], ""),
    ],
)
def test_garbage(spark, text, snapshot, lower, want):
    assert survivors(spark, text, snapshot, lower) == want.split()


def test_many_lower_ranges(spark):
    lower = [(f"k{i:03d}a", f"k{i:03d}c") for i in range(100)]
    assert survivors(spark, "k050b5D k050d4D k099c3D zz2D", 9, lower) == ["k050b5D", "k099c3D"]


def manifest(spark, *files):
    return spark.createDataFrame(
        [(lv, i, n, size, bytearray(a.encode()), bytearray(b.encode())) for lv, i, n, size, a, b in files],
        "level int, ord bigint, number bigint, file_size bigint, smallest binary, largest binary",
    )


L1 = [(1, 0, 11, 5, "a", "alpha"), (1, 1, 12, 5, "bravo", "charlie"), (1, 2, 13, 5, "golf", "hotel"), (1, 3, 14, 5, "xray", "zulu")]


def test_pick_level0(spark):
    l0 = [(0, i, i + 1, 5, k, k) for i, k in enumerate(["bravo", "delta", "hotel", "foxtrot"])]
    assert levels.pick(manifest(spark, *l0[:3], *L1)) is None
    p = levels.pick(manifest(spark, *l0, *L1))
    assert (p.level, p.inputs, p.overlap) == (0, [1, 2, 3, 4], [12, 13])


def test_pick_level1(spark):
    files = [(1, 0, 1, 6 << 20, "bravo", "foxtrot"), (1, 1, 2, 6 << 20, "hotel", "india"),
             (2, 0, 3, 9, "alpha", "charlie"), (2, 1, 4, 9, "delta", "echo"), (2, 2, 5, 9, "golf", "zulu")]
    p = levels.pick(manifest(spark, *files))
    assert (p.level, p.inputs, p.overlap) == (1, [1], [3, 4])
    assert levels.pick(manifest(spark, *files), l1_bytes=99 << 20) is None


def test_overlap_pairs(spark):
    import random

    rng = random.Random(3)
    targets, at = [], 0
    for fn in range(30):
        lo = at + rng.randint(1, 3)
        at = lo + rng.randint(0, 4)
        targets.append((fn, lo, at))
    sources = [(fn, lo, lo + rng.randint(0, 30)) for fn in range(40) for lo in [rng.randint(-5, at + 5)]]
    want = sorted((s, t) for s, a, b in sources for t, lo, hi in targets if a <= hi and lo <= b)
    got = levels.overlaps(spark.createDataFrame(sources, "fn bigint, lo bigint, hi bigint"), spark.createDataFrame(targets, "fn bigint, lo bigint, hi bigint"))
    assert sorted((r.source_file, r.target_file) for r in got.collect()) == want


def test_split(spark):
    df = spark.createDataFrame(parse("alpha9 alpha8 bravo7 charlie6"), "key string, seq bigint, op int")
    got = levels.split_outputs(df, ["key"], "seq", "op", F.lit(10), target=1, parts=1)
    sizes = {}
    for r in got.collect():
        sizes.setdefault(r.file_no, []).append(r.key)
    assert sorted(sizes.values()) == [["alpha", "alpha"], ["bravo"], ["charlie"]]
    whole = levels.split_outputs(df, ["key"], "seq", "op", F.lit(10), target=1000, parts=1)
    assert {r.file_no for r in whole.collect()} == {0}


@pytest.mark.parametrize(
    "files",
    [
        [(1, 0, 1, 9, "alpha", "delta"), (1, 1, 2, 9, "delta", "omega")],
        [(1, 0, 1, 9, "hotel", "zulu"), (1, 1, 2, 9, "alpha", "india")],
        [(0, 0, 1, 9, "a", "b"), (2, 0, 1, 9, "c", "d")],
        [(1, 0, 1, 9, "", ""), (1, 1, 2, 9, "", "alpha")],
        [(0, 0, 1, 0, "a", "b")],
        [(0, 0, 1, 9, "b", "a")],
    ],
)
def test_bad_layouts(spark, files):
    with pytest.raises(Corruption):
        levels.validate(manifest(spark, *files))


def test_good_layout_and_files(spark):
    m = manifest(spark, (0, 0, 1, 9, "a", "z"), (0, 1, 2, 9, "a", "z"), (1, 0, 3, 9, "a", "b"), (1, 1, 4, 9, "c", "d"))
    levels.validate(m)
    files = spark.createDataFrame([(i, 9, "sst") for i in (1, 2, 3, 4)], "number bigint, file_size bigint, kind string")
    levels.check_files(m, files)
    with pytest.raises(Corruption):
        levels.check_files(m, files.filter("number <> 3"))
    with pytest.raises(Corruption):
        levels.check_files(m, files.withColumn("file_size", F.lit(8)))
    listed = spark.createDataFrame([(1, "sst"), (9, "sst"), (7, "sst.tmp"), (1, "log"), (5, "log")], "number bigint, kind string")
    assert rows(levels.obsolete_files(listed, m, 5)) == [(1, "log"), (7, "sst.tmp"), (9, "sst")]
