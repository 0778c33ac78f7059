"""Delete-vector tables: late, repeated and outranked changes in many batches, against a model."""

import random

import pytest

from keyfold.operators.change_feed import DELETE, PUT, DeleteVectorTable, rebuild
from keyfold.session import shared_path

from .conftest import rows

SCHEMA = "region_id bigint, idx bigint, term bigint, pos int, cmd_type int, cf string, key binary, value binary, file string"


def model(data):
    """Present pairs: highest term per index, then order of index and place."""
    top, state = {}, {}
    for g, i, t, *_ in data:
        top[g, i] = max(t, top.get((g, i), t))
    for g, i, t, p, op, cf, k, v, _ in sorted(data, key=lambda r: (r[0], r[1], r[3])):
        if t == top[g, i] and k is not None:
            if op == PUT:
                state[g, cf, bytes(k)] = (i, p, None if v is None else bytes(v))
            elif op == DELETE:
                state.pop((g, cf, bytes(k)), None)
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


def feed(seed, n=300):
    rng, out = random.Random(seed), {}
    for _ in range(n):
        g, i, t, p = rng.choice([1, 1, 1, 2]), rng.randint(1, 60), rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 2)
        op = rng.choices([PUT, DELETE, 1, 0], [6, 3, 1, 1])[0]
        key = None if op == 0 else rng.choice([b"hot"] * 4 + [b"", b"a", b"b", b"\xff"])
        value = rng.choice([None, b"", b"v%d" % i]) if op == PUT else None
        out[g, i, t, p] = (g, i, t, p, op, rng.choice(["default", None]), None if key is None else bytearray(key), None if value is None else bytearray(value), "x")
    data = list(out.values())
    data += rng.sample(data, len(data) // 4)
    rng.shuffle(data)
    return data


def state(table):
    return rows(table.read(), "region_id", "cf", "key", "idx", "pos", "value")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order(spark, seed):
    data, table = feed(seed), DeleteVectorTable(spark, shared_path(spark, "dv"))
    step = len(data) // 3 + 1
    for at in range(0, len(data), step):
        table.apply(spark.createDataFrame(data[at : at + step], SCHEMA))
        assert state(table) == model(data[: at + step])
    assert table.log.current() == 3
    assert rows(table.read(1), "region_id", "cf", "key", "idx", "pos", "value") == model(data[:step])


def test_outranked_entry_brings_older_image_back(spark):
    table = DeleteVectorTable(spark, shared_path(spark, "dv"))
    put = lambda i, t, k, v: (1, i, t, 0, PUT, "c", bytearray(k), bytearray(v), "")
    table.apply(spark.createDataFrame([put(1, 1, b"k", b"old"), put(2, 1, b"k", b"new")], SCHEMA))
    assert state(table) == [(1, "c", b"k", 2, 0, b"new")]
    table.apply(spark.createDataFrame([(1, 2, 5, 0, 0, None, None, None, "")], SCHEMA))
    assert state(table) == [(1, "c", b"k", 1, 0, b"old")]


def test_empty_null_rows_and_slices(spark):
    table = DeleteVectorTable(spark, shared_path(spark, "dv"))
    with pytest.raises(LookupError):
        table.read()
    empty = spark.createDataFrame([], SCHEMA)
    table.apply(empty)
    assert table.log.current() == 0
    table.apply(spark.createDataFrame([(1, 1, 1, 0, PUT, "c", bytearray(b"k"), None, ""), (None, 1, 1, 0, PUT, "c", bytearray(b"z"), None, "")], SCHEMA))
    assert state(table) == [(1, "c", b"k", 1, 0, None)]
    data = feed(9, 80)
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "timestamp_millis(idx * 1000) AS at")
    assert state(rebuild(df, shared_path(spark, "dv"), "at", 3)) == model(data)


@pytest.mark.parametrize("seed", [5])
def test_many_small_batches(spark, seed):
    """Bitmaps, ranks and index are merged by size while late, repeated and outranking changes come."""
    data, table = feed(seed, 220), DeleteVectorTable(spark, shared_path(spark, "dv"))
    step = len(data) // 9 + 1
    for at in range(0, len(data), step):
        table.apply(spark.createDataFrame(data[at : at + step], SCHEMA))
    assert state(table) == model(data)
    content = table.log.read(table.log.current())
    assert all(len(content[k]) <= 5 for k in ("ranks", "index", "vectors")) and len(content["batches"]) == 9
    assert rows(table.read(4), "region_id", "cf", "key", "idx", "pos", "value") == model(data[: 4 * step])


def test_failed_commit_leaves_the_table(spark, monkeypatch):
    from keyfold.sources.commits import CommitLog

    data, table = feed(3, 60), DeleteVectorTable(spark, shared_path(spark, "dv"))
    table.apply(spark.createDataFrame(data[:40], SCHEMA))
    commit = CommitLog.commit
    monkeypatch.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.apply(spark.createDataFrame(data[40:], SCHEMA))
    monkeypatch.setattr(CommitLog, "commit", commit)
    assert state(table) == model(data[:40])
    table.apply(spark.createDataFrame(data[40:], SCHEMA))
    assert state(table) == model(data)
