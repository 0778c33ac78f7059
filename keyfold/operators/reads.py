"""Linearizable reads: the quorum that confirms a leader, and the wait until applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import next_at_or_after
from .raftlog import quorum

#: Indexes per bucket of the lookup; a bucket is one task's group at most.
INDEX_BUCKET = 1 << 16


def acknowledged(acks: DataFrame, read_cols: Sequence[str], voter_col: str, needed: int | Column) -> DataFrame:
    """Reads with at least ``needed`` distinct voters, and their number ``acks``."""
    n = acks.groupBy(*read_cols).agg(F.count_distinct(voter_col).alias("acks"))
    return n.filter(F.col("acks") >= needed)


def read_index_quorum(reads: DataFrame, acks: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads (region_id, read_id, term, leader) that a majority of current voters has confirmed.

    An ack counts if it names the read, has the read's term and comes from a
    peer of the region; the leader counts itself; a rejecting ack counts too. A
    read must not be asked before the leader has committed in its term:
    ``committed_term`` of the read, if there, must equal ``term``.
    """
    r = reads.filter(F.col("committed_term") == F.col("term")) if "committed_term" in reads.columns else reads
    r = r.join(regions.select("region_id", "peers"), "region_id")
    valid = r.join(acks.select("region_id", "read_id", "term", F.col("from_node").alias("__from")), ["region_id", "read_id", "term"], "left")
    counts = F.array_contains("peers", F.col("__from")) & (F.col("__from") != F.col("leader"))
    n = valid.groupBy("region_id", "read_id", "term").agg(
        F.count_distinct(F.when(counts, F.col("__from"))).alias("__n"),
        F.max(F.array_contains("peers", F.col("leader")).cast("int")).alias("__self"),
        F.max(F.size("peers")).alias("__members"),
    )
    total = F.col("__n") + F.coalesce("__self", F.lit(0))
    return n.filter(total >= quorum(F.col("__members"))).select("region_id", "read_id", "term", total.alias("acks"))


def wait_for_apply(reads: DataFrame, applied: DataFrame, read_idx: str, applied_idx: str, group: Sequence[str] = ()) -> DataFrame:
    """Reads with ``served_at``, the least applied index at or above theirs; those that still wait are left out."""
    keys = list(group)
    if not keys:
        reads, applied, keys = reads.withColumn("__g", F.lit(0)), applied.withColumn("__g", F.lit(0)), ["__g"]
    found = next_at_or_after(
        reads, applied, keys, read_idx, applied_idx, F.col(applied_idx), lambda c: F.floor(c / INDEX_BUCKET), name="served_at"
    )
    return found.filter(F.col("served_at").isNotNull()).drop("__g")


def lifecycle(reads: DataFrame, confirmed: DataFrame, applied: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Reads (region_id, read_id, read_idx, leads) with ``state``.

    'not leader' if the node that was asked doesn't lead (``leads`` false),
    'cancelled' if its caller gave up, 'unconfirmed' until a quorum has answered,
    'waiting' until the region's ``applied`` index reaches ``read_idx``, then 'served'.
    """
    keys = ["region_id", "read_id"]
    r = reads.join(confirmed.select(*keys, F.lit(True).alias("__ok")).distinct(), keys, "left")
    r = r.join(applied.select("region_id", F.col("applied").alias("__applied")), "region_id", "left")
    gone = F.lit(False)
    if cancelled is not None:
        r = r.join(cancelled.select(*keys, F.lit(True).alias("__gone")).distinct(), keys, "left")
        gone = F.col("__gone").isNotNull()
    state = (
        F.when(~F.coalesce("leads", F.lit(False)), "not leader").when(gone, "cancelled").when(F.col("__ok").isNull(), "unconfirmed")
        .when(F.coalesce("__applied", F.lit(0)) < F.col("read_idx"), "waiting").otherwise("served")
    )
    return r.select(*reads.columns, state.alias("state"))
