"""Structured Streaming: applying committed entries, the latest view, snapshot triggers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mvcc import newest
from ..operators.raftlog import SNAPSHOT_EVERY
from ..store import Store

CMD_PUT, CMD_DELETE = 2, 3


def to_mutations(entries: DataFrame) -> DataFrame:
    """Puts and deletes of decoded entries as operations; other commands change nothing."""
    return entries.filter(F.col("cmd_type").isin(CMD_PUT, CMD_DELETE) & F.col("key").isNotNull()).select(
        "region_id", "cf", "key", (F.col("cmd_type") == CMD_PUT).cast("tinyint").alias("op"),
        F.when(F.col("cmd_type") == CMD_PUT, F.coalesce("value", F.lit(bytearray(b"")))).alias("value"), "idx", "pos",
    )


def apply_to_store(store: Store, name: str = "apply") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each micro-batch is one atomic, idempotent write.

    Entries come as a log consumer gets them: each batch holds later indexes of a
    region than the batch before. Within a batch they are applied by index and
    position, repeated ones once. (A feed without that order is the matter of
    ``DeleteVectorTable``.) A failed batch fails the stream and is run again; one that was committed
    before the failure is recognised by its number and skipped.
    """

    def run(batch: DataFrame, number: int) -> None:
        store.write(to_mutations(batch.dropDuplicates(["region_id", "idx", "pos"])), ["region_id", "idx", "pos"], (name, number))

    return run


def apply_stream(entries: DataFrame, store: Store, checkpoint: str, name: str = "apply") -> StreamingQuery:
    """Apply all entries that are there, then stop; a later call goes on from the checkpoint."""
    return (
        entries.writeStream.foreachBatch(apply_to_store(store, name)).option("checkpointLocation", checkpoint)
        .queryName(name).trigger(availableNow=True).start()
    )


def latest_stream(versions: DataFrame, key_cols: Sequence[str], seq_col: str, value_cols: Sequence[str]) -> DataFrame:
    """A stream of the newest version per key, for update mode: state is one row per key."""
    return versions.groupBy(*key_cols).agg(F.max(seq_col).alias(seq_col), *(F.max_by(c, seq_col).alias(c) for c in value_cols))


def applied_watermarks(entries: DataFrame) -> DataFrame:
    """A stream of the highest applied index per region, for update mode; repeats and disorder don't matter."""
    return entries.groupBy("region_id").agg(F.max("idx").alias("applied"))


def applied_words(entries: DataFrame) -> DataFrame:
    """A stream (region_id, word, bits) of the applied indexes, 64 to a row, for update mode; repeats, disorder and holes don't matter."""
    bit = F.expr("shiftleft(1L, cast(pmod(idx, 64) as int))")
    return entries.filter(F.col("region_id").isNotNull() & F.col("idx").isNotNull()).groupBy("region_id", F.floor(F.col("idx") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def due_snapshots(words: DataFrame, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """(region_id, applied, due) from the last ``applied_words``: entries applied, and how many snapshots they called for.

    Every applied index counts once, delivered again or not; indexes that were
    never applied don't count.
    """
    per = words.groupBy("region_id").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("applied"))
    return per.select("region_id", "applied", F.floor(F.col("applied") / every).alias("due"))


def final_updates(updates: DataFrame, key_cols: Sequence[str], path: str) -> DataFrame:
    """Run an update-mode stream over all that is there and return the last update per key.

    Each micro-batch overwrites a folder of its own, so one that is run again
    after a failure counts once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/updates/batch={number}")

    (
        updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    spark = updates.sparkSession
    seen = spark.read.parquet(f"{path}/updates").drop("batch")
    return newest(seen, key_cols, "__batch").drop("__batch")
