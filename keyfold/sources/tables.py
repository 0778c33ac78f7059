"""Table and manifest files of a data folder as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..schema import MAX_SEQUENCE, TABLE_META
from ..session import broadcastable, materialise, ship_package

ROWS = "number bigint, key binary, seq bigint, op tinyint, value binary"


def read_tables(spark: SparkSession, folder: str, verify: bool = False, numbers: list[int] | None = None) -> DataFrame:
    """Rows of table files (number, key, seq, op, value); a file is one task's work.

    ``numbers`` restricts to files of a manifest. Corrupt files fail the query.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder).select("path", "content")
    number = F.regexp_extract("path", r"(\d+)\.sst$", 1).cast("bigint")
    files = files.select(number.alias("number"), "content")
    if numbers is not None:
        files = files.filter(F.col("number").isin(numbers))

    return decode_tables(files, verify)


def decode_tables(files: DataFrame, verify: bool = False) -> DataFrame:
    """Rows of encoded tables (number, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["number", "key", "seq", "op", "value"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int8(), pa.binary()]
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for row in codec.TableFile(raw, verify).rows():
                    rows.append((n, *row))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ship_package(files.sparkSession)
    return files.mapInArrow(decode, ROWS)


def encode_tables(split: DataFrame) -> DataFrame:
    """(file_no, content, entries, smallest, largest) of rows (file_no, key, seq, op, value) in internal order per partition.

    Takes what ``levels.split_outputs`` gives; a file's rows are consecutive in one partition.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def done():
            raw, meta = codec.table(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([raw], pa.binary()), pa.array([meta.entries], pa.int64()), pa.array([meta.smallest], pa.binary()), pa.array([meta.largest], pa.binary())],
                ["file_no", "content", "entries", "smallest", "largest"],
            )

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for file_no, key, seq, op, value in zip(*cols, strict=True):
                if rows and file_no != current:
                    yield done()
                    rows = []
                current = file_no
                rows.append((key, seq, op, value))
        if rows:
            yield done()

    ship_package(split.sparkSession)
    return split.select("file_no", "key", "seq", "op", "value").mapInArrow(
        encode, "file_no bigint, content binary, entries bigint, smallest binary, largest binary"
    )


def lookup_tables(files: DataFrame, asked: DataFrame, verify: bool = False) -> DataFrame:
    """(file_no, key, state, value) of asked (file_no, key, seq): what each table file answers, by filter, index and one block.

    Files (file_no, content) meet the keys asked of them in one task each; keys
    are distinct per file, so a key asked often costs nothing more. A NULL
    ``seq`` asks for the newest version.
    """

    def find(_key, file: pa.Table, keys: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if file.num_rows:
            t = codec.TableFile(file.column("content")[0].as_py(), verify)
            for n, k, seq in zip(*(keys.column(c).to_pylist() for c in ("file_no", "key", "seq")), strict=True):
                out.append((n, k, *t.get(k, MAX_SEQUENCE if seq is None else seq)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({"file_no": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.binary()), "state": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.binary())})

    ship_package(files.sparkSession)
    wanted = asked.select("file_no", "key", "seq").distinct()
    return files.select("file_no", "content").groupBy("file_no").cogroup(wanted.groupBy("file_no")).applyInArrow(
        find, "file_no bigint, key binary, state string, value binary"
    )


#: Keys of one Bloom filter, about.
FILTER_KEYS = 1 << 20


def _filter_of(key: Column, filters: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(filters)).cast("bigint")


def build_filters(keys: DataFrame, key_col: str) -> DataFrame:
    """(filter_no, filters, keys, filter): Bloom filters over the distinct keys, one for each of ``filters`` classes of their hash.

    NULL keys are left out; an empty table has no filter.
    """
    wanted = materialise(keys.select(F.col(key_col).alias("key")).filter(F.col("key").isNotNull()).distinct(), "filter-keys")
    n = max(1, -(-wanted.count() // FILTER_KEYS))

    def build(group: tuple, held: pa.Table) -> pa.Table:
        raw = codec.bloom_build(held.column("key").to_pylist())
        return pa.table({"filter_no": pa.array([group[0].as_py()], pa.int64()), "filters": pa.array([n], pa.int64()), "keys": pa.array([held.num_rows], pa.int64()), "filter": pa.array([raw], pa.binary())})

    ship_package(keys.sparkSession)
    return wanted.withColumn("filter_no", _filter_of(F.col("key"), n)).groupBy("filter_no").applyInArrow(build, "filter_no bigint, filters bigint, keys bigint, filter binary")


def may_contain(rows: DataFrame, key_col: str, filters: DataFrame) -> DataFrame:
    """Rows with ``may``: false where a key is surely in no filter, true where it may be; NULL for a NULL key.

    A stored table of filters up to the broadcast bound is sent to all tasks;
    beyond it the distinct keys meet the filter of their class, and the answers
    are joined to the rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    first = filters.select("filters").first()
    if first is None:
        return rows.withColumn("may", F.when(F.col(key_col).isNotNull(), F.lit(False)))
    n = first[0]
    if broadcastable(filters):
        sent = spark.sparkContext.broadcast({r.filter_no: bytes(r.filter) for r in filters.select("filter_no", "filter").collect()})
        tagged = rows.withColumn("__filter", _filter_of(F.col(key_col), n))
        at, schema = rows.columns.index(key_col), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, number = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                may = np.zeros(len(keys), bool)
                for f in np.unique(number):
                    where = np.flatnonzero(number == f)
                    where = where[[keys[i] is not None for i in where]]
                    raw = sent.value.get(int(f))
                    if raw is not None and where.size:
                        may[where] = codec.bloom_may_contain([keys[i] for i in where], raw)
                answers = pa.array(may, pa.bool_(), mask=np.array([k is None for k in keys], bool))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], answers], [*batch.schema.names[:-1], "may"])

        return tagged.mapInArrow(probe, f"{schema}, may boolean")

    def meet(_key, held: pa.Table, asked: pa.Table) -> pa.Table:
        keys = asked.column("key").to_pylist()
        may = codec.bloom_may_contain(keys, held.column("filter")[0].as_py()) if held.num_rows else np.zeros(len(keys), bool)
        return pa.table({"__key": pa.array(keys, pa.binary()), "__may": pa.array(may, pa.bool_())})

    asked = rows.select(F.col(key_col).alias("key")).filter(F.col("key").isNotNull()).distinct().withColumn("filter_no", _filter_of(F.col("key"), n))
    met = filters.select("filter_no", "filter").groupBy("filter_no").cogroup(asked.groupBy("filter_no")).applyInArrow(meet, "__key binary, __may boolean")
    return rows.join(met, F.col(key_col) == F.col("__key"), "left").withColumn("may", F.when(F.col(key_col).isNotNull(), F.coalesce("__may", F.lit(False)))).drop("__key", "__may")


def manifest_table(spark: SparkSession, manifest: codec.Manifest) -> DataFrame:
    """A decoded manifest as a table with user keys."""
    rows = [
        (level, i, t.number, t.file_size, bytearray(codec.parse_internal_key(t.smallest)[0]), bytearray(codec.parse_internal_key(t.largest)[0]))
        for level, tables in enumerate(manifest.levels) for i, t in enumerate(tables)
    ]
    return spark.createDataFrame(rows, TABLE_META)


def read_manifest(spark: SparkSession, path: str) -> codec.Manifest:
    """Decode a manifest file; NotFound if there is none."""
    from ..schema import NotFound

    Path = spark._jvm.org.apache.hadoop.fs.Path
    p = Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise NotFound(path)
    stream = fs.open(p)
    try:
        return codec.Manifest.decode(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def write_manifest(spark: SparkSession, path: str, manifest: codec.Manifest) -> None:
    """Write under a temporary name, then rename over the old one."""
    raw = manifest.encode()
    jvm = spark._jvm
    p, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(raw))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temp, p, options)
