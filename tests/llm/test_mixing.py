"""Copies and shares of mixed sources."""

import math
import random

import pytest

from keyfold.llm import mixing
from tests.conftest import rows

SIZES = "doc_id bigint, source string, n_tokens bigint, expected string"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, sizes, targets, seed=1):
    docs, report = mixing.mixed(spark.createDataFrame([(*s, "x") for s in sizes], SIZES), spark.createDataFrame(targets, TARGETS), seed=seed)
    return {r.doc_id: r.copies for r in docs.collect()}, {r.source: r for r in report.collect()}, docs


@pytest.mark.parametrize("block", [10, 200_000])
def test_shares_and_caps(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rng = random.Random(4)
    sizes = [(i, rng.choices(["big", "mid", "small"], [6, 3, 1])[0], rng.randint(1, 400)) for i in range(4000)]
    targets = [("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("nothing", 0.1, 3)]
    copies, report, _ = run(spark, sizes, targets)
    have = {s: sum(n for _, x, n in sizes if x == s) for s in ("big", "mid", "small")}
    total = min(have[s] * r / t for s, t, r in targets[:3])
    for s, t, r in targets[:3]:
        e = min(r, total * t / have[s])
        mine = [copies[i] for i, x, _ in sizes if x == s]
        assert set(mine) <= {math.floor(e), math.ceil(e)} and max(mine) <= r
        # one random offset: the number of uses is the expected one, rounded up or down
        assert abs(sum(mine) - e * len(mine)) <= 1
        used = sum(copies[i] * n for i, x, n in sizes if x == s)
        assert report[s].used_size == used and report[s].available_size == have[s]
        assert abs(report[s].reached_share - t / 0.9) < 0.01
    assert (report["nothing"].used_size, report["nothing"].reached_share, report["nothing"].docs) == (0, 0.0, 0)
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)


def test_total_and_shortfall(spark):
    sizes = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(10)] + [(None, "a", 10 + i) for i in range(5)]
    make = lambda total: mixing.mixed(spark.createDataFrame([(*s, "x") for s in sizes], SIZES), spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 2)], TARGETS), total=total)
    small = {r.source: r for r in make(200)[1].collect()}
    assert all(r.wanted_size == 100 and r.shortfall == 0 and 80 <= r.used_size <= 120 for r in small.values())
    large = {r.source: r for r in make(1000)[1].collect()}
    assert (large["b"].wanted_size, large["b"].used_size, large["b"].shortfall, large["b"].most_copies) == (500, 200, 300, 2)
    assert large["a"].shortfall == 0 and 480 <= large["a"].used_size <= 520
    assert make(1000)[0].count() == len(sizes)


def test_every_row_comes_out(spark):
    sizes = [(1, "a", 10), (2, "a", 0), (3, "a", None), (4, None, 10), (5, "other", 10), (6, "never", 10), (7, "zero", 10), (1, "a", 10)]
    copies, report, docs = run(spark, sizes, [("a", 0.5, 2), ("never", 0.5, 0), ("zero", 0.0, 5)])
    assert docs.count() == len(sizes)
    assert copies == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
    assert report["a"].reached_share == 1.0 and report["never"].used_size == 0


def test_empty(spark):
    copies, report, _ = run(spark, [], [("a", 1.0, 1)])
    assert copies == {} and report["a"].reached_share == 0.0
    copies, report, _ = run(spark, [(1, "a", 5)], [])
    assert copies == {1: 0} and report == {}


def test_same_seed_same_result(spark):
    sizes = [(i, "a", i % 50 + 1) for i in range(500)] + [(1000 + i, "b", 3) for i in range(50)]
    targets = [("a", 0.5, 1), ("b", 0.5, 2)]
    assert run(spark, sizes, targets)[0] == run(spark, sizes[::-1], targets)[0]
    assert run(spark, sizes, targets, seed=2)[0] != run(spark, sizes, targets)[0]


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]
