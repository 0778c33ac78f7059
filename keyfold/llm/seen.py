"""Has this key been seen before? Exact answers from disk-backed keyed stream state."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcastable, materialise, qualified

#: Order of keys that were known before the first record.
KNOWN = -(2**63)
#: Partitions of the state, fixed when it is begun; a state for billions of keys takes some thousand.
STATE_PARTITIONS = 12
#: Spread of a file's records where the list of files itself is too long to broadcast.
SALTS = 64

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def _conf(spark: SparkSession, settings: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SeenKeys:
    """First occurrences of keys, held in RocksDB state partitioned by key, and answers emitted batch by batch.

    The state has one row per key: the smallest order number with which the key
    has come, the micro-batch that brought it and the first and last batch that
    named the key. Records of one key are combined before the shuffle, so a key
    with a third of all records costs one row per task; keys are on disk, not in
    memory, and never expire.

    Every micro-batch writes what it found into a folder of its own, which a
    repeated batch overwrites: the orders that are the first of their key,
    corrections (a key known before that now has an even smaller order, because
    files came out of order) and the files it read. A record of such a file is a
    *first* if its order was emitted and not corrected later, else a *repeat*; a
    record of a file that no batch has read is not answered. So answers cost a
    join with the emitted firsts, never a scan of the state.

    Orders must be unique and not NULL. Keys are tuples in which NULL is a value
    of its own; records whose last key column is NULL are neither counted nor
    answered. An empty table gives no answers.
    """

    def __init__(self, spark: SparkSession, path: str, key_cols: Sequence[str], partitions: int = STATE_PARTITIONS):
        self.spark, self.path, self.keys, self.partitions = spark, path.rstrip("/"), list(key_cols), partitions

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"

    def stream(self, table: str, order_col: str | None, where: str | None = None, batch_bytes: int = 64 << 30) -> DataFrame:
        """A stream of (keys, order) from a Parquet table; without ``order_col`` its keys are known before all.

        Beside the records there is one row per file that names it, so that the
        batch which reads a file says so. ``batch_bytes`` bounds a micro-batch; its
        records are combined by key and spill, so it may be many times a task's memory.
        """
        files = (
            self.spark.readStream.schema(self.spark.read.parquet(table).schema)
            .option("maxBytesPerTrigger", str(batch_bytes))
            .parquet(f"{table[:-1]}[{table[-1]}]")  # a pattern, so that a single file will do as well as a folder
        )
        order = F.col(order_col).cast("bigint") if order_col else F.lit(KNOWN).cast("bigint")
        rows = (files.filter(where) if where else files).filter(F.col(self.keys[-1]).isNotNull())
        records = rows.select(*self.keys, order.alias("__order"), F.lit(None).cast("bigint").alias("__file"))
        if not order_col:
            return records
        named = files.filter("_metadata.row_index = 0").select(
            *(F.lit(None).cast(files.schema[k].dataType).alias(k) for k in self.keys), F.lit(KNOWN).cast("bigint").alias("__order"), self.file_id().alias("__file")
        )
        return records.unionByName(named)

    @staticmethod
    def file_id() -> Column:
        """Number of the file that a row was read from: a hash of its path."""
        return F.xxhash64(F.col("_metadata.file_path"))

    def absorb(self, *streams: DataFrame) -> None:
        """Process all that the streams hold now, emitting the firsts of each batch; a later call goes on from the checkpoint."""
        rows = streams[0]
        for s in streams[1:]:
            rows = rows.unionByName(s)
        at = F.unix_micros(F.current_timestamp())  # the same for all rows of a micro-batch, also when it is repeated
        state = rows.withColumn("__at", at).groupBy("__file", *self.keys).agg(
            F.min("__order").alias("first_order"), F.min_by("__at", "__order").alias("first_at"), F.min("__at").alias("since"), F.max("__at").alias("at")
        )

        def emit(batch: DataFrame, number: int) -> None:
            new = batch.filter((F.col("first_at") == F.col("at")) & (F.col("__file").isNotNull() | (F.col("first_order") > F.lit(KNOWN))))
            new.select(*self.keys, "__file", "first_order", (F.col("since") < F.col("at")).alias("corrects")).write.mode("overwrite").parquet(f"{self.path}/emitted/batch={number}")

        # A folder without rows, so that there is something to read before the first batch.
        blank = self.spark.createDataFrame([], rows.select(*self.keys, "__file", F.col("__order").alias("first_order"), F.lit(False).alias("corrects")).schema)
        blank.write.mode("overwrite").parquet(f"{self.path}/emitted/batch=-1")
        with _conf(self.spark, _STATE_CONF | {"spark.sql.shuffle.partitions": str(self.partitions)}):
            state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _emitted(self) -> DataFrame:
        return self.spark.read.parquet(f"{qualified(self.spark, self.path)}/emitted")

    def firsts(self) -> DataFrame:
        """(first_order) of every first: what the batches have emitted, without what a later batch has corrected."""
        emitted = self._emitted().filter("__file IS NULL")
        corrections = emitted.filter("corrects").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)))
        if corrections.limit(1).isEmpty():
            return emitted.select("first_order")
        # Only keys that were corrected are looked at again: of their orders the smallest holds.
        changed = materialise(corrections.distinct(), "corrected-keys")
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        settled = emitted.join(changed, same, "left_semi").groupBy(*self.keys).agg(F.min("first_order").alias("first_order"))
        return emitted.join(changed, same, "left_anti").select("first_order").unionByName(settled.select("first_order"))

    def flagged(self, rows: DataFrame, order_col: str, file_col: str = "__file") -> DataFrame:
        """All records with ``seen``: false for a first, true for a repeat, NULL for a NULL key and where nothing is known yet.

        ``file_col`` holds ``file_id()`` of the record's file and is dropped. Both
        joins are on values that no key shares: the unique order and the file.
        """
        firsts = self.firsts().select(F.col("first_order").alias(order_col), F.lit(True).alias("__first"))
        done = materialise(self._emitted().filter("__file IS NOT NULL").select(F.col("__file").alias(file_col), F.lit(True).alias("__read")).distinct(), "read-files")
        if broadcastable(done):
            known = rows.join(F.broadcast(done), file_col, "left")
        else:
            salted = rows.withColumn("__salt", F.pmod(F.xxhash64(order_col), F.lit(SALTS)))
            copies = done.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            known = salted.join(copies, [file_col, "__salt"], "left").drop("__salt")
        asked = F.col(self.keys[-1]).isNotNull() & F.col("__read").isNotNull()
        return known.join(firsts, order_col, "left").withColumn("seen", F.when(asked, F.col("__first").isNull())).drop("__first", "__read", file_col)

    def repeats(self, rows: DataFrame, order_col: str, file_col: str = "__file") -> DataFrame:
        """The records whose key came before."""
        return self.flagged(rows, order_col, file_col).filter("seen").drop("seen")


def wrong_answers(flagged: DataFrame, history: DataFrame, key_cols: Sequence[str], order_col: str) -> DataFrame:
    """Counts of records, repeats and wrong answers, and their rate, against a batch computation.

    The truth is a plain minimum per key over all records and the history; an
    answer is wrong if it calls a first a repeat or a repeat a first.
    """
    keys = list(key_cols)
    asked = flagged.filter(F.col("seen").isNotNull())
    known = history.filter(F.col(keys[-1]).isNotNull()).select(*keys, F.lit(KNOWN).cast("bigint").alias("__o"))
    truth = (
        asked.select(*keys, F.col(order_col).alias("__o")).unionByName(known)
        .groupBy(*keys).agg(F.min("__o").alias(order_col))
        .select(order_col, F.lit(True).alias("__true_first"))
    )
    judged = asked.select(order_col, "seen").join(truth, order_col, "left")
    wrong = F.col("seen") == F.col("__true_first").isNotNull()
    return judged.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col("seen").cast("bigint")), F.lit(0)).alias("repeats"),
        F.coalesce(F.sum(wrong.cast("bigint")), F.lit(0)).alias("wrong"),
    ).withColumn("wrong_rate", F.when(F.col("records") > 0, F.col("wrong") / F.col("records")).otherwise(F.lit(0.0)))
