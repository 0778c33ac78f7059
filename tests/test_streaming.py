"""Applying entries as a stream, with restarts."""

import pytest

from keyfold.session import shared_path
from keyfold.store import Store
from keyfold.streaming import apply

from .conftest import rows

SCHEMA = "region_id bigint, idx bigint, pos int, cmd_type int, cf string, key binary, value binary"


def entries(spark, folder, data, name):
    df = spark.createDataFrame([(g, i, p, c, "c", None if k is None else bytearray(k), None if v is None else bytearray(v)) for g, i, p, c, k, v in data], SCHEMA)
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_apply_restart_and_failure(spark):
    folder, check = shared_path(spark, "feed"), shared_path(spark, "checkpoint")
    store = Store(spark, shared_path(spark, "store"))
    entries(spark, folder, [(1, 1, 0, 2, b"a", b"1"), (1, 1, 1, 2, b"b", b"2"), (1, 2, 0, 0, None, None), (1, 1, 0, 2, b"a", b"1")], "p1")
    apply.apply_stream(stream(spark, folder), store, check).awaitTermination()
    assert rows(store.scan(1, "c")) == [(b"a", b"1"), (b"b", b"2")]
    assert store.last_sequence == 2
    entries(spark, folder, [(1, 3, 0, 3, b"a", None), (1, 4, 0, 2, b"b", None), (2, 1, 0, 2, b"a", b"z")], "p2")
    store._failed = RuntimeError("down")
    with pytest.raises(Exception, match="earlier job failed"):
        apply.apply_stream(stream(spark, folder), store, check).awaitTermination()
    again = Store(spark, store.path)
    apply.apply_stream(stream(spark, folder), again, check).awaitTermination()
    assert rows(again.scan(1, "c")) == [(b"b", b"")] and rows(again.scan(2, "c")) == [(b"a", b"z")]
    seq = again.last_sequence
    sink = apply.apply_to_store(again)
    sink(spark.read.schema(SCHEMA).parquet(f"{folder}/p2"), 1)  # a batch that is run again
    assert again.last_sequence == seq == 5


def test_latest_watermarks_and_due(spark):
    folder = shared_path(spark, "feed")
    entries(spark, folder, [(1, i, 0, 2, b"k", b"%d" % i) for i in range(1, 8)] + [(1, 3, 0, 2, b"k", b"3")], "p1")
    entries(spark, folder, [(1, i, 0, 2, b"k", b"%d" % i) for i in range(8, 12)], "p2")
    for name, df, want in (
        ("latest", apply.latest_stream(stream(spark, folder), ["region_id", "key"], "idx", ["value"]), (1, b"k", 11, b"11")),
        ("water", apply.applied_watermarks(stream(spark, folder)), (1, 11)),
    ):
        df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", shared_path(spark, name)).trigger(availableNow=True).start().awaitTermination()
        assert want in rows(spark.table(name))


def test_due_snapshots_count_applied_entries(spark):
    """Holes don't count, redelivered entries count once, whatever batch brings them."""
    folder, path = shared_path(spark, "feed"), shared_path(spark, "due")
    entries(spark, folder, [(1, i, 0, 2, b"k", b"v") for i in (1, 2, 3, 100, 101)] + [(2, 7, 0, 2, b"k", b"v")], "p1")
    entries(spark, folder, [(1, i, 0, 2, b"k", b"v") for i in (3, 64, 63, 1)] + [(3, i, 0, 2, b"k", b"v") for i in range(130)], "p2")
    words = apply.final_updates(apply.applied_words(stream(spark, folder)), ["region_id", "word"], path)
    assert rows(apply.due_snapshots(words)) == [(1, 7, 1), (2, 1, 0), (3, 130, 26)]
