"""The store: batches, snapshots, compaction, region snapshots, failures."""

import random

import pytest

from keyfold.operators import levels
from keyfold.schema import AlreadyExists, Busy, Corruption, InvalidArgument, NotFound, StorageIOError
from keyfold.session import shared_path
from keyfold.store import MemoryStore, Store, WriteBatch

from .conftest import rows


@pytest.fixture
def store(spark):
    return Store(spark, shared_path(spark, "store"), "create")


def test_modes(spark, store):
    assert store.last_sequence == 0
    with pytest.raises(AlreadyExists):
        Store(spark, store.path, "create")
    with pytest.raises(NotFound):
        Store(spark, shared_path(spark, "store"), "open")
    with pytest.raises(InvalidArgument):
        Store(spark, store.path, "maybe")
    store.put(1, "default", b"k", b"v")
    assert Store(spark, store.path, "open").get(1, "default", b"k") == b"v"


def test_batch_order_and_empties(store):
    b = WriteBatch().put(1, "c", b"one", b"old").put(1, "c", b"two", b"2").put(1, "c", b"one", b"new").delete(1, "c", b"two").put(1, "c", b"", b"")
    assert store.write(b) == 5
    assert store.get(1, "c", b"one") == b"new"
    assert store.get(1, "c", b"two") is None
    assert store.get(1, "c", b"") == b""
    assert store.get(1, "other", b"one") is None and store.get(2, "c", b"one") is None
    assert store.write(WriteBatch()) == 5
    b.clear()
    assert len(b) == 0


def test_family_and_key_never_mix(store):
    store.write(WriteBatch().put(1, "a", b"b/x", b"1").put(1, "a/b", b"x", b"2"))
    assert rows(store.scan(1, "a")) == [(b"b/x", b"1")]
    assert rows(store.scan(1, "a/b")) == [(b"x", b"2")]


def test_scan_and_multi_get(spark, store):
    store.write(WriteBatch().put(1, "c", b"apple", b"1").put(1, "c", b"beta", b"2").put(1, "c", b"\xff", b"3").put(2, "c", b"zebra", b"4"))
    store.delete(1, "c", b"beta")
    assert [bytes(r.key) for r in store.scan(1, "c", b"apple", 10).collect()] == [b"apple", b"\xff"]
    assert [bytes(r.key) for r in store.scan(1, "c", b"b", 1).collect()] == [b"\xff"]
    with pytest.raises(InvalidArgument):
        store.scan(1, "c", b"", -1)
    asked = spark.createDataFrame([(1, "c", bytearray(b"apple")), (1, "c", bytearray(b"beta")), (9, "c", bytearray(b"x"))], "region_id bigint, cf string, key binary")
    assert rows(store.multi_get(asked)) == [(1, "c", b"apple", b"1"), (1, "c", b"beta", None), (9, "c", b"x", None)]


def test_snapshots_survive_compaction(spark, store):
    for i in range(4):
        store.put(1, "c", b"k", b"%d" % i)
        if i == 1:
            snap = store.snapshot()
    other = Store(spark, shared_path(spark, "store")).snapshot()
    with pytest.raises(InvalidArgument):
        store.get(1, "c", b"k", other)
    assert store.compact() == 0
    assert store.get(1, "c", b"k", snap) == b"1" and store.get(1, "c", b"k") == b"3"
    assert rows(store.versions(), "seq") == [(2,), (3,), (4,)]
    del snap
    store.delete(1, "c", b"k")
    assert store.compact(force=True) == 0
    assert store.versions().count() == 0 and store.get(1, "c", b"k") is None
    assert store.compact(force=True) is None
    assert store.clean() != [] and store.clean() == []


def test_compaction_levels_against_model(spark, store):
    rng, model = random.Random(5), {}
    for step in range(6):
        b = WriteBatch()
        for _ in range(20):
            k = b"%02d" % rng.randint(0, 25)
            if rng.random() < 0.3:
                b.delete(1, "c", k)
                model.pop(k, None)
            else:
                v = b"%d" % rng.randint(0, 99)
                b.put(1, "c", k, v)
                model[k] = v
        store.write(b)
        if step % 2:
            store.compact(force=True)
    while store.compact(force=True) is not None:
        pass
    assert rows(store.scan(1, "c")) == sorted(model.items())
    assert {f["level"] for f in store.manifest["files"]} == {2}
    assert store.versions().count() == len(model)


def test_table_batch_and_bad_rows(spark, store):
    df = spark.createDataFrame([(1, "c", bytearray(b"k"), 1, bytearray(b"a"), 2), (1, "c", bytearray(b"k"), 1, bytearray(b"b"), 1)], "region_id bigint, cf string, key binary, op int, value binary, n int")
    assert store.write(df, ["n"]) == 2
    assert store.get(1, "c", b"k") == b"a"
    with pytest.raises(InvalidArgument):
        store.write(df.selectExpr("region_id", "cf", "key", "7 AS op", "value", "n"), ["n"])
    with pytest.raises(InvalidArgument):
        store.write(df)
    assert store.write(df, ["n"], ("feed", 0)) == 4
    assert store.write(df, ["n"], ("feed", 0)) == 4


def test_region_snapshot_isolation(store):
    store.write(WriteBatch().put(1, "default", b"alpha", b"r1-alpha").put(1, "write", b"beta", b"r1-beta").put(2, "default", b"alpha", b"r2-alpha"))
    snap = store.snapshot()
    pairs = store.region_snapshot(1, snap)
    assert pairs.count() == 2
    store.write(WriteBatch().put(1, "default", b"alpha", b"x").put(1, "default", b"new", b"y").delete(1, "write", b"beta").put(2, "default", b"alpha", b"r2-still"))
    store.apply_region_snapshot(1, pairs)
    assert rows(store.view(), "region_id", "cf", "key", "value") == [(1, "default", b"alpha", b"r1-alpha"), (1, "write", b"beta", b"r1-beta"), (2, "default", b"alpha", b"r2-still")]


def test_failures_latch_and_lost_files(spark, store, monkeypatch):
    store.put(1, "c", b"k", b"v")

    def broken(*_a, **_k):
        raise RuntimeError("disk")

    monkeypatch.setattr(levels, "collect_garbage", broken)
    with pytest.raises(RuntimeError):
        store.compact(force=True)
    with pytest.raises(StorageIOError):
        store.put(1, "c", b"k", b"w")
    again = Store(spark, store.path)
    assert again.get(1, "c", b"k") == b"v"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{again.path}/data/{again.manifest['files'][0]['name']}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    with pytest.raises(Corruption):
        Store(spark, store.path)


def test_only_overlapping_files_are_read_and_rewritten(spark, store):
    store.write(WriteBatch().put(1, "c", b"a", b"1").put(1, "c", b"b", b"1"))
    while store.compact(force=True) is not None:
        pass
    deep = {f["name"] for f in store.manifest["files"]}
    store.write(WriteBatch().put(1, "c", b"x", b"2").put(2, "c", b"a", b"2"))
    assert store.compact(force=True) == 0
    assert deep <= {f["name"] for f in store.manifest["files"]}
    assert store.compact(force=True) == 1
    assert deep <= {f["name"] for f in store.manifest["files"]}
    assert len(store._of(1, "c", b"b", b"b").inputFiles()) == 1
    assert len(store._of(3, "c").inputFiles()) == 0
    store.delete(1, "c", b"a")
    store.compact(force=True)
    assert rows(store.versions().filter("op = 0"), "key") == [(b"a",)]  # the deeper level holds the key
    while store.compact(force=True) is not None:
        pass
    assert rows(store.versions(), "region_id", "key") == [(1, b"b"), (1, b"x"), (2, b"a")]


def test_snapshots_of_other_processes(spark, store):
    """A lease protects versions and files from a compaction by someone who knows nothing of it."""
    store.put(1, "c", b"k", b"1")
    snap = store.snapshot()
    store.put(1, "c", b"k", b"2")
    other = Store(spark, store.path, "open")
    assert other.oldest_snapshot() == 1
    other.compact(force=True)
    assert store.get(1, "c", b"k", snap) == b"1"
    assert len(other.clean()) == 1  # the file of the second put; that of the first belongs to the lease
    expired = store.snapshot(seconds=-1)
    assert other.oldest_snapshot() == 1 and expired.seq == 2
    del snap
    assert other.oldest_snapshot() == 2
    other.compact(force=True)
    assert len(other.clean()) == 2 and store.get(1, "c", b"k") == b"2"


def test_lock_and_close(spark):
    path = shared_path(spark, "store")
    first = Store(spark, path, "create", lock=True)
    with pytest.raises(Busy):
        Store(spark, path, "open", lock=True)
    first.put(1, "c", b"k", b"v")
    held = first.snapshot()
    first.close()
    with pytest.raises(StorageIOError):
        first.put(1, "c", b"k", b"w")
    second = Store(spark, path, "open", lock=True)
    assert second.get(1, "c", b"k") == b"v" and second.snapshots.live() == {} and held.seq == 1
    second.close()


def test_hot_key_is_cut_in_level_0_only(spark):
    store = Store(spark, shared_path(spark, "store"), "create", file_bytes=2000)
    df = spark.range(400).selectExpr("1L AS region_id", "'c' AS cf", "CASE WHEN id % 4 = 0 THEN CAST('hot' AS BINARY) ELSE CAST(printf('k%03d', id) AS BINARY) END AS key", "1 AS op", "CAST(repeat('v', 20) AS BINARY) AS value", "id AS n")
    store.write(df, ["n"])
    files = store.manifest["files"]
    hot = [f for f in files if f["smallest"][3] <= b"hot".hex() <= f["largest"][3]]
    assert len(files) >= 8 and len(hot) >= 2 and sum(f["rows"] for f in files) == 400
    snap = store.snapshot()
    store.compact(force=True)
    files = sorted(store.manifest["files"], key=lambda f: f["smallest"])
    assert len(files) >= 4 and all(a["largest"] < b["smallest"] for a, b in zip(files, files[1:], strict=False))
    assert store.view(snap).count() == 301


def test_manifests_as_deltas(spark, monkeypatch):
    from keyfold import store as module

    monkeypatch.setattr(module, "FULL_EVERY", 4)
    store = Store(spark, shared_path(spark, "store"), "create")
    for i in range(6):
        store.put(1, "c", b"%d" % i, b"v")
    store.compact()
    store.put(1, "c", b"9", b"v")
    assert [("files" in store.log.read(v)) for v in store.log.versions()] == [True, False, False, True, False, False, False, True, False]
    again = Store(spark, store.path)
    assert {f["name"] for f in again.manifest["files"]} == {f["name"] for f in store.manifest["files"]} and len(again.manifest["files"]) == 2
    assert again.view().count() == 7
    assert len(again._manifest(3)["files"]) == 2 and len(again._manifest(7)["files"]) == 6


def test_memory_store_agrees(spark, store):
    rng, memory = random.Random(8), MemoryStore(spark)
    for _ in range(4):
        b = WriteBatch()
        for _ in range(15):
            k = b"%02d" % rng.randint(0, 12)
            b.delete(1, "c", k) if rng.random() < 0.3 else b.put(1, "c", k, b"%d" % rng.randint(0, 99))
        assert store.write(b) == memory.write(b)
    assert memory.write(WriteBatch()) == 60
    assert rows(memory.view()) == rows(store.view()) and rows(memory.view(20)) == rows(store.view(20))
    assert rows(memory.scan(1, "c", b"05", 3)) == rows(store.scan(1, "c", b"05", 3))
    assert [memory.get(1, "c", b"%02d" % i) for i in range(13)] == [store.get(1, "c", b"%02d" % i) for i in range(13)]
    with pytest.raises(InvalidArgument):
        memory.get(1, "c", b"x", store.snapshot())
    memory.apply_region_snapshot(1, spark.createDataFrame([("c", bytearray(b"only"), bytearray(b"1"))], "cf string, key binary, value binary"))
    assert rows(memory.scan(1, "c")) == [(b"only", b"1")] and MemoryStore(spark, memory.versions()).last_sequence == memory.last_sequence
