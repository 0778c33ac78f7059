"""Changes between snapshots against brute force."""

import random

import pytest

from keyfold.operators import snapshot_diff
from keyfold.session import lookup, materialise

from .conftest import rows

SCHEMA = "region_id bigint, snap_index bigint, key binary, value binary, change string, __side int"


def brute(data):
    snaps = {}
    for g, i, k, v, *_ in data:
        if g is None or i is None:
            continue
        s = snaps.setdefault(g, {}).setdefault(i, {})
        if k is not None:
            s[bytes(k)] = None if v is None else bytes(v)
    out = []
    for g, by in snaps.items():
        order = sorted(by)
        for a, b in zip(order, order[1:], strict=False):
            old, new = by[a], by[b]
            for k in old.keys() | new.keys():
                if k not in old:
                    out.append((g, b, k, "added"))
                elif k not in new:
                    out.append((g, b, k, "removed"))
                elif old[k] != new[k]:
                    out.append((g, b, k, "changed"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, broadcast, seed):
    if not broadcast:
        monkeypatch.setattr(snapshot_diff, "lookup", lambda df, label: (lookup(df, label)[0], False))
    rng, data = random.Random(seed), []
    for g in (1, 2, 3):
        for i in rng.sample(range(50), 4):
            held = {bytes([k]): rng.choice([None, b"", b"a", b"b"]) for k in rng.sample(range(12), rng.randint(0, 8))}
            rows_ = [(g, i, bytearray(k), None if v is None else bytearray(v), "x", 1) for k, v in held.items()] or [(g, i, None, None, "x", 1)]
            data += rows_ + rng.sample(rows_, rng.randint(0, len(rows_)))
    data += [(None, 1, bytearray(b"k"), None, "x", 1), (1, None, bytearray(b"k"), None, "x", 1)]
    rng.shuffle(data)
    got = snapshot_diff.snapshot_changes(spark.createDataFrame(data, SCHEMA))
    assert rows(got, "region_id", "snap_index", "key", "change") == brute(data)


def test_null_empty_and_empty_table(spark):
    k = bytearray(b"")
    data = [(1, 1, k, None, "", 0), (1, 2, k, bytearray(b""), "", 0), (1, 3, k, bytearray(b""), "", 0), (1, 4, None, None, "", 0), (1, 5, k, None, "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(snapshot_diff.snapshot_changes(df)) == [(1, 2, b"", "changed"), (1, 4, b"", "removed"), (1, 5, b"", "added")]
    assert snapshot_diff.snapshot_changes(df.limit(0)).count() == 0


def test_very_long_value(spark):
    a = bytearray(b"x" * 2_000_000)
    data = [(1, 1, bytearray(b"k"), a, "", 0), (1, 2, bytearray(b"k"), a + b"y", "", 0)]
    assert rows(snapshot_diff.snapshot_changes(spark.createDataFrame(data, SCHEMA)), "change") == [("changed",)]


def test_each_of_several_values_counts(spark):
    make = lambda g, i, vs: [(g, i, bytearray(b"k"), bytearray([v]), "", 0) for v in vs]
    data = []
    for gone in range(8):
        data += make(gone, 1, range(8)) + make(gone, 2, [v for v in range(8) if v != gone])
    data += make(8, 1, range(8)) + make(8, 2, range(7, -1, -1)) + make(8, 2, [3, 3])
    got = snapshot_diff.snapshot_changes(spark.createDataFrame(data, SCHEMA))
    assert rows(got, "region_id", "change") == [(g, "changed") for g in range(8)]


def subtrees(plan, name):
    """The parts of a printed plan below the nodes of that name."""
    lines = plan.split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if line.lstrip(" :+-").startswith(name):
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


@pytest.mark.parametrize("part_rows", [250_000, 40])
def test_a_long_snapshot_list_is_neither_multiplied_nor_broadcast(spark, monkeypatch, part_rows):
    rng, data = random.Random(3), []
    for g, snaps, keys in ((1, 200, 3), (2, 5, 90), (3, 1, 50), (4, 40, 4)):
        for i in rng.sample(range(1000), snaps):
            data += [(g, i, bytearray([k]), rng.choice([None, bytearray(b""), bytearray(b"a")]), "x", 1) for k in range(keys) if rng.random() < 0.8]
            data.append((g, i, None, None, "x", 1))
    rng.shuffle(data)
    plans = []

    def stored(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, label)

    monkeypatch.setattr(snapshot_diff, "lookup", lambda df, label: lookup(df, label, 100))
    monkeypatch.setattr(snapshot_diff, "materialise", stored)
    monkeypatch.setattr(snapshot_diff, "PART_ROWS", part_rows, raising=False)
    got = snapshot_diff.snapshot_changes(spark.createDataFrame(data, SCHEMA))
    assert rows(got, "region_id", "snap_index", "key", "change") == brute(data)
    sent = [x for plan in plans for x in subtrees(plan, "BroadcastExchange")]
    assert not [x for x in sent if "explode" in x or "snap_index" in x]
    assert plans[-1].count("Exchange hashpartitioning") == 1
