"""Log, table and manifest files through Spark."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keyfold.functions import codec
from keyfold.operators import levels
from keyfold.schema import Corruption, NotFound
from keyfold.sources import tables, wal

from .conftest import rows

BATCHES = [(1, [(1, b"a", b"x"), (0, b"b", None)]), (3, [(1, b"", b"")]), (4, [(1, b"c", b"z" * 1000)] * 3)]


def write(folder: Path, number: int, batches) -> bytes:
    raw = b"".join(codec.log_record(codec.write_batch(s, ops)) for s, ops in batches)
    (folder / codec.file_name(number, "log")).write_bytes(raw)
    return raw


def test_read_log_and_torn_tail(spark, tmp_path):
    write(tmp_path, 1, BATCHES[:2])
    raw = write(tmp_path, 2, BATCHES[2:])
    (tmp_path / "000009.sst").write_bytes(b"not a log")
    want = [(1, 1, b"a", b"x"), (2, 0, b"b", None), (3, 1, b"", b""), (4, 1, b"c", b"z" * 1000), (5, 1, b"c", b"z" * 1000), (6, 1, b"c", b"z" * 1000)]
    assert rows(wal.read_log(spark, str(tmp_path)), "seq", "op", "key", "value") == want
    assert rows(wal.recover(spark, str(tmp_path), 2), "seq") == [(3,), (4,), (5,), (6,)]
    (tmp_path / "000002.log").write_bytes(raw[:-1])
    assert rows(wal.recover(spark, str(tmp_path)), "seq") == [(1,), (2,), (3,)]
    assert rows(wal.read_log(spark, str(tmp_path), oldest=2), "seq") == []


def test_log_gap_and_corruption(spark, tmp_path):
    write(tmp_path, 1, [BATCHES[0], BATCHES[2]])
    with pytest.raises(Corruption):
        wal.recover(spark, str(tmp_path))
    with pytest.raises(Corruption):
        wal.recover(spark, str(tmp_path), after_seq=2)
    raw = bytearray((tmp_path / "000001.log").read_bytes())
    raw[10] ^= 1
    (tmp_path / "000001.log").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        wal.read_log(spark, str(tmp_path)).count()


def test_write_log_round_trip(spark, tmp_path):
    ops = spark.createDataFrame([(s, i, op, bytearray(k), None if v is None else bytearray(v)) for s, o in BATCHES for i, (op, k, v) in enumerate(o)], "batch_seq bigint, pos int, op int, key binary, value binary")
    folder = tmp_path / "log"
    wal.write_log(ops, str(folder), first=5, files=2)
    assert {p.name for p in folder.iterdir()} <= {"000005.log", "000006.log"}
    got = wal.recover(spark, str(folder))
    assert rows(got, "batch_seq", "pos", "op", "key", "value") == rows(ops)
    assert wal.read_log(spark, str(tmp_path)).count() == 0


def test_tables_round_trip(spark, tmp_path):
    data = [(f"k{i:04d}".encode(), 2 * i + 2, i % 2, b"v" * (i % 9) if i % 2 else b"") for i in range(300)]
    df = spark.createDataFrame([(bytearray(k), s, o, bytearray(v)) for k, s, o, v in data], "key binary, seq bigint, op int, value binary")
    split = levels.split_outputs(df, ["key"], "seq", "op", F.length("key") + F.length("value") + 8, target=2000, parts=2)
    files = tables.encode_tables(split.select("file_no", "key", "seq", "op", "value")).collect()
    assert len(files) > 2
    for i, f in enumerate(files):
        (tmp_path / codec.file_name(i + 1, "sst")).write_bytes(f.content)
    assert rows(tables.read_tables(spark, str(tmp_path), verify=True), "key", "seq", "op", "value") == data
    assert {r.number for r in tables.read_tables(spark, str(tmp_path), numbers=[2]).collect()} == {2}
    bad = bytearray(files[0].content)
    bad[2] ^= 1
    (tmp_path / "000001.sst").write_bytes(bad)
    with pytest.raises(Exception, match="checksum"):
        tables.read_tables(spark, str(tmp_path), verify=True).count()


def test_manifest_files(spark, tmp_path):
    path = f"file://{tmp_path}/MANIFEST"
    with pytest.raises(NotFound):
        tables.read_manifest(spark, path)
    meta = codec.TableMeta(1, 10, codec.internal_key(b"a", 5, 1), codec.internal_key(b"z", 1, 1))
    for seq in (1, 2):
        m = codec.Manifest(seq, 1, [[meta], [], []])
        tables.write_manifest(spark, path, m)
        assert tables.read_manifest(spark, path) == m
    table = tables.manifest_table(spark, m)
    levels.validate(table)
    assert rows(table) == [(0, 0, 1, 10, b"a", b"z")]
