"""As-of lookups by bucketed scans: no range join and no unbounded window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_at_or_after(
    probes: DataFrame,
    events: DataFrame,
    group_cols: Sequence[str],
    probe_at: str,
    event_at: str,
    payload: Column,
    bucket_of: Callable[[Column], Column],
    salts: int = 1,
    salt: Column | None = None,
    name: str = "__next",
    best_of_all: bool = False,
) -> DataFrame:
    """Each probe with the payload of the first event of its group at or after it.

    ``bucket_of(column)`` must be a monotone bucket number. Inside a bucket a
    window carries the nearest later event backwards; what lies beyond comes from
    a scan over one row per (group, bucket). With ``salts`` a bucket's probes are
    spread over that many tasks, its events being copied to each.

    With ``best_of_all`` the least payload among all events at or after the
    probe is taken instead of the nearest event's.

    ``payload`` is an expression over ``events``; it must sort by event for equal
    times, the least one winning. Probes without such an event get NULL. Rows
    with a NULL time are left out on both sides.
    """
    group = list(group_cols)
    e = events.filter(F.col(event_at).isNotNull()).select(*group, F.col(event_at).alias("__at"), payload.alias("__payload"))
    e = e.groupBy(*group, "__at").agg(F.min("__payload").alias("__payload")).withColumn("__bucket", bucket_of(F.col("__at")))
    p = probes.filter(F.col(probe_at).isNotNull()).withColumns({"__at": F.col(probe_at), "__bucket": bucket_of(F.col(probe_at))})
    p = p.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int") if salts > 1 else F.lit(0))

    least = F.min("__payload") if best_of_all else F.min_by("__payload", "__at")
    per_bucket = e.groupBy(*group, "__bucket").agg(least.alias("__payload"), F.min("__at").alias("__at"))
    # One row per bucket that holds an event; the carry of a probe's bucket is found with the probes' buckets mixed in.
    marks = per_bucket.select(*group, "__bucket", "__payload").unionByName(
        p.select(*group, "__bucket").distinct().withColumn("__payload", F.lit(None).cast(per_bucket.schema["__payload"].dataType))
    ).groupBy(*group, "__bucket").agg(F.first("__payload", ignorenulls=True).alias("__payload"))
    back = Window.partitionBy(*group).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.min("__payload").over(back) if best_of_all else F.last("__payload", ignorenulls=True).over(back)
    carries = marks.select(*group, "__bucket", carry.alias("__carry"))

    copies = e.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    both = p.withColumns({"__payload": F.lit(None).cast(e.schema["__payload"].dataType), "__probe": F.lit(True)}).unionByName(
        copies.withColumn("__probe", F.lit(False)), allowMissingColumns=True
    )
    # From the latest time down; at equal times the event comes before the probe.
    down = (
        Window.partitionBy(*group, "__bucket", "__salt")
        .orderBy(F.col("__at").desc(), F.col("__probe").asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = F.min("__payload").over(down) if best_of_all else F.last("__payload", ignorenulls=True).over(down)
    found = both.withColumn("__near", near).filter("__probe").join(carries, [*group, "__bucket"], "left")
    take = F.least("__near", "__carry") if best_of_all else F.coalesce("__near", "__carry")
    return found.withColumn(name, take).select(*probes.columns, name)
