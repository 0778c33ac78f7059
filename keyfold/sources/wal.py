"""Log files as a Spark source and sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import schema
from ..functions import codec
from ..session import qualified

NAME = "keyfold_log"
SCHEMA = "file bigint, offset bigint, batch_seq bigint, seq bigint, pos int, op tinyint, key binary, value binary"
_ARROW = pa.schema(
    [("file", pa.int64()), ("offset", pa.int64()), ("batch_seq", pa.int64()), ("seq", pa.int64()), ("pos", pa.int32()), ("op", pa.int8()), ("key", pa.binary()), ("value", pa.binary())]
)


def _filesystem(path: str):
    """File system and path of a fully qualified folder (``session.qualified``), never a machine's own by default."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


#: Operations in one batch of rows.
ROWS = 10_000
#: Bytes of records that a writer holds before it writes them.
HELD = 4 << 20


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class LogReader(DataSourceReader):
    """One partition per log file; a cut-off tail ends a file, a wrong record fails the query."""

    def __init__(self, path: str, oldest: int):
        self.path, self.oldest = path, oldest

    def partitions(self):
        import pyarrow.fs as pafs

        fs, root = _filesystem(self.path)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root)):
            parsed = codec.parse_file_name(info.base_name)
            if parsed and parsed[1] == "log" and parsed[0] >= self.oldest:
                out.append(_File(info.path, parsed[0]))
        return sorted(out, key=lambda f: f.number) or [_File("", 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _filesystem(self.path)
        columns: list[list] = [[] for _ in _ARROW]

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)
            for c in columns:
                c.clear()
            return out

        with fs.open_input_stream(partition.path) as f:
            for offset, payload in codec.log_stream(f.read):
                seq, op, key, value = zip(*codec.parse_write_batch(payload), strict=True)
                n = len(seq)
                for c, v in zip(columns, ([partition.number] * n, [offset] * n, [seq[0]] * n, seq, range(n), op, key, value), strict=True):
                    c.extend(v)
                if len(columns[0]) >= ROWS:
                    yield batch()
        if columns[0]:
            yield batch()


class _Wrote(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class LogWriter(DataSourceArrowWriter):
    """Writes rows (batch_seq, pos, op, key, value) as records, one numbered file per task; files appear on commit only."""

    def __init__(self, path: str, first: int):
        self.path, self.first = path, first

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        part = TaskContext.get().partitionId()
        number = self.first + part
        target = f"{root}/{codec.file_name(number, 'log')}.{TaskContext.get().taskAttemptId()}.part"
        fs.create_dir(root, recursive=True)
        seq, ops, records, held, size = None, [], 0, [], 0

        def send():
            nonlocal size
            out.write(codec.log_records_of(held))
            held.clear()
            size = 0

        with fs.open_output_stream(target) as out:
            for batch in iterator:
                cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("batch_seq", "op", "key", "value")]
                for s, op, key, value in zip(*cols, strict=True):
                    if seq is not None and s != seq:
                        held.append(codec.write_batch(seq, ops))
                        ops, records, size = [], records + 1, size + len(held[-1])
                        if size >= HELD:
                            send()
                    seq = s
                    ops.append((op, key, value))
            if ops:
                held.append(codec.write_batch(seq, ops))
                records += 1
            if held:
                send()
        if not records:
            fs.delete_file(target)
        return _Wrote(target if records else None)

    def commit(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, m.path.rsplit(".", 2)[0])

    def abort(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class LogSource(DataSource):
    """``spark.read.format("keyfold_log").load(folder)`` and ``df.write.format("keyfold_log")``.

    Options: ``oldest`` is the least file number to read, ``first`` the number of
    the first file to write.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return LogReader(self.options["path"], int(self.options.get("oldest", 1)))

    def writer(self, schema, overwrite):
        return LogWriter(self.options["path"], int(self.options.get("first", 1)))


def _register(spark: SparkSession) -> None:
    """Register the source with its code in it, so that workers need not import it."""
    import sys

    from pyspark import cloudpickle

    from .. import session

    modules = [sys.modules[__name__], codec, schema, session]
    for m in modules:
        cloudpickle.register_pickle_by_value(m)
    try:
        spark.dataSource.register(LogSource)
    finally:
        for m in modules:
            cloudpickle.unregister_pickle_by_value(m)


def read_log(spark: SparkSession, folder: str, oldest: int = 1) -> DataFrame:
    """Operations of all log files of a folder."""
    _register(spark)
    return spark.read.format(NAME).option("oldest", str(oldest)).load(qualified(spark, folder))


def write_log(ops: DataFrame, folder: str, first: int = 1, files: int = 1) -> None:
    """Write (batch_seq, pos, op, key, value) rows; batches stay whole, in ``files`` files by ranges of their sequence."""
    _register(ops.sparkSession)
    rows = ops.select(F.lit(0).cast("bigint").alias("file"), F.lit(0).cast("bigint").alias("offset"), "batch_seq", (F.col("batch_seq") + F.col("pos")).alias("seq"),
                      F.col("pos").cast("int").alias("pos"), F.col("op").cast("tinyint").alias("op"), "key", "value")
    ordered = rows.repartitionByRange(files, "batch_seq").sortWithinPartitions("batch_seq", "pos")
    ordered.write.format(NAME).option("first", str(first)).mode("append").save(qualified(ops.sparkSession, folder))


def recover(spark: SparkSession, folder: str, after_seq: int = 0, oldest: int = 1) -> DataFrame:
    """Operations after ``after_seq`` in order; raises Corruption if sequences are not contiguous."""
    from ..operators import merge
    from ..schema import Corruption

    ops = read_log(spark, folder, oldest).filter(F.col("seq") > after_seq)
    gap = merge.sequence_gaps(ops, "seq").limit(1).collect()
    if gap:
        raise Corruption(f"log goes on with sequence {gap[0]['seq']} after {gap[0]['prev']}")
    first = ops.agg(F.min("seq")).first()[0]
    if first is not None and after_seq and first != after_seq + 1:
        raise Corruption(f"log begins with sequence {first} after {after_seq}")
    return ops
