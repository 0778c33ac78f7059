"""Session, shared-folder and sizing helpers used by all operators."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a lookup table is broadcast. Beyond either every caller
#: has a shuffled way, so nothing that grows with the data is ever broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


#: Shared paths of this process, until they are dropped.
_INTERMEDIATE: list[str] = []
#: Shared files that workers may ask for as long as this process runs.
_UNTIL_EXIT: list[str] = []


def build_session(app: str = "keyfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` only for local use."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; a cluster is
    refused, since no machine-local folder is visible to its executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="keyfold-")
    atexit.register(shutil.rmtree, folder, True)
    root = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted by ``drop_intermediate`` or when this process ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _INTERMEDIATE.append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, the default one of the cluster where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full if not full.startswith("file:/") or full.startswith("file:///") else "file://" + full[len("file:") :]


def write_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Write one file into the shared folder, where it stays until this process ends; returns its path."""
    _UNTIL_EXIT.append(f"{shared_root(spark)}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content))
    out.close()
    return str(path.toString())


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers wherever they run; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_keyfold_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(write_shared(spark, f"{root.name}-{uuid.uuid4().hex}.zip", buffer.getvalue()))
    sc._keyfold_shipped = True


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder: lost executors cost a re-read only."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def drop_intermediate(spark: SparkSession) -> int:
    """Delete what was written under shared paths so far (intermediate tables, states, stores of
    queries); results that were not stored can't be read after that. Returns how many there were."""
    dropped = 0
    while _INTERMEDIATE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_INTERMEDIATE.pop())
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


@atexit.register
def _drop_at_exit() -> None:
    """Delete what is left; without a session only what lies on a mounted file system can be."""
    _INTERMEDIATE.extend(_UNTIL_EXIT)
    spark = SparkSession._instantiatedSession
    try:
        if spark is not None and spark._jsc is not None and spark._jsc.sc() is not None and not spark._jsc.sc().isStopped():
            drop_intermediate(spark)
    except Exception:  # the JVM is gone
        pass
    for path in _INTERMEDIATE:
        if path.startswith("file:"):
            local = Path("/" + path[len("file:") :].lstrip("/"))
            shutil.rmtree(local, ignore_errors=True) if local.is_dir() else local.unlink(missing_ok=True)


def _field_bytes(col: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, (_field_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    if isinstance(kind, T.ArrayType | T.MapType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col.alias("x")))), F.lit(0)).cast("bigint") * 2 + 16
    return F.lit(16).cast("bigint")


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes in memory, about) of a stored table, by one pass over it."""
    size = reduce(lambda a, b: a + b, (_field_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("bigint"))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n, total


def broadcastable(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is small enough, by rows and by bytes, to be broadcast."""
    n, total = measured(df)
    return n <= max_rows and total <= max_bytes


def lookup(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Materialise a lookup table and say whether its measured size allows a broadcast."""
    table = materialise(df, label)
    small = broadcastable(table, max_rows, max_bytes)
    return (F.broadcast(table) if small else table), small
