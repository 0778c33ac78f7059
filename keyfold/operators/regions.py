"""Range partitions: routing, batch checks, region snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fresh, in_range
from ..schema import InvalidArgument
from . import merge

#: The three regions of a default cluster: fixed values.
DEFAULT_REGIONS = ((1, "", "m"), (2, "m", "t"), (3, "t", ""))
#: Regions up to which routing is a chain of conditions without any join.
CHAIN = 64


def static_regions(spark: SparkSession, rows: Sequence[tuple] = DEFAULT_REGIONS, text: bool = True) -> DataFrame:
    """A small table (region_id, start_key, end_key) from literals."""
    kind = "string" if text else "binary"
    data = [(i, a, b) if text else (i, bytearray(a.encode()), bytearray(b.encode())) for i, a, b in rows]
    return spark.createDataFrame(data, f"region_id bigint, start_key {kind}, end_key {kind}")


def contains(key: Column, start: Column, end: Column) -> Column:
    return in_range(key, start, end)


def problems(regions: DataFrame) -> DataFrame:
    """(region_id, problem) of every region that can't be served: 'no id', 'no peer' or 'id twice'."""
    n = regions.groupBy("region_id").agg(F.count(F.lit(1)).alias("__n"))
    what = [F.when(F.col("region_id").isNull() | (F.col("region_id") == 0), "no id")]
    if "peers" in regions.columns:
        what.append(F.when(F.coalesce(F.size("peers"), F.lit(0)) < 1, "no peer"))
    own = regions.select("region_id", F.explode(F.array_compact(F.array(*what))).alias("problem"))
    return own.unionByName(n.filter("__n > 1 AND region_id IS NOT NULL").select("region_id", F.lit("id twice").alias("problem")))


def validate(regions: DataFrame) -> None:
    """Raise InvalidArgument unless there are regions, all with an id, a peer and a unique id, that share no key."""
    if regions.limit(1).isEmpty():
        raise InvalidArgument("no regions are configured")
    bad = problems(regions).limit(1).collect()
    if bad:
        raise InvalidArgument(f"region {bad[0]['region_id']}: {bad[0]['problem']}")
    require_disjoint(regions)


def add_regions(regions: DataFrame, more: DataFrame) -> DataFrame:
    """The table with more regions; raises InvalidArgument for one without id or peer, or whose id is there already."""
    both = regions.unionByName(more)
    validate(both)
    return both


def remove_regions(regions: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the regions whose ``region_id`` is in ``ids``; unknown ones change nothing."""
    return regions.join(ids.select("region_id").distinct(), "region_id", "left_anti").select(*regions.columns)


def _bounds(regions: DataFrame) -> DataFrame:
    """(region_id, start_key, end_key) of the ranges that hold a key, a NULL bound being an open one."""
    kind = dict(regions.dtypes)["start_key"]
    none = F.lit("" if kind == "string" else bytearray()).cast(kind)
    r = regions.select("region_id", F.coalesce("start_key", none).alias("start_key"), F.coalesce("end_key", none).alias("end_key"))
    return r.filter((F.length("end_key") == 0) | (F.col("start_key") < F.col("end_key")))


def require_disjoint(regions: DataFrame) -> None:
    """Raise InvalidArgument if two ranges share a key."""
    b = _bounds(regions)
    few = b.orderBy("start_key").limit(CHAIN + 1).collect()
    if len(few) <= CHAIN:
        # In order of their starts it suffices to look at neighbours, as long as none met another before.
        for one, other in zip(few, few[1:], strict=False):
            if not len(one.end_key) or one.end_key > other.start_key:
                raise InvalidArgument(f"regions {one.region_id} and {other.region_id} share keys")
        return
    unbounded = F.length("end_key") == 0
    # The greatest end before a range, an unbounded one being greater than all.
    spans = b.select("start_key", F.struct(unbounded.alias("open"), F.col("end_key").alias("end")).alias("reach"))
    met = merge.carried_max(spans, "start_key", "reach", "__before")
    if not met.filter(F.col("__before.open") | (F.col("__before.end") > F.col("start_key"))).limit(1).isEmpty():
        raise InvalidArgument("two regions share keys")


def route_expr(key: Column, regions: Sequence[tuple]) -> Column:
    """Region of a key as a chain of conditions; NULL if none holds it."""
    out = F.lit(None).cast("bigint")
    for region_id, start, end in reversed(list(regions)):
        hit = key >= F.lit(start)
        if len(end):
            hit = hit & (key < F.lit(end))
        out = F.when(hit, F.lit(region_id).cast("bigint")).otherwise(out)
    return out


def last_start(rows: DataFrame, starts: DataFrame, key_col: str, payload: str, name: str) -> DataFrame:
    """Distinct keys ``__k`` of ``rows`` with the greatest ``payload`` among the rows of ``starts`` (__k, payload) at or below them.

    Keys and starts are merged in key order: one shuffle into ranges, a carried
    value within and across them, and no loop over all starts. Works for any
    key that can be sorted. ``payload`` must not be NULL.
    """
    keys = rows.select(F.col(key_col).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    kind = starts.schema[payload].dataType
    both = keys.select("__k", F.lit(None).cast(kind).alias(payload), F.lit(True).alias("__key")).unionByName(
        starts.select("__k", payload, F.lit(False).alias("__key"))
    )
    return merge.carried_max(both, "__k", payload, name, inclusive=True).filter("__key").select("__k", name)


def route(rows: DataFrame, regions: DataFrame, key_col: str, name: str = "region_id") -> DataFrame:
    """Rows with the region that holds their key, NULL where none does.

    Ranges must not overlap, however many there are: ``InvalidArgument`` else, for
    then the answer would be a matter of order. Few regions become conditions;
    more are found by a merge of distinct keys and starts in key order. NULL
    bounds are open, ranges that end before they begin hold nothing, NULL keys
    have no region.
    """
    require_disjoint(regions)
    bounds = _bounds(regions)
    small = bounds.orderBy("start_key").limit(CHAIN + 1).collect()
    if len(small) <= CHAIN:
        return rows.withColumn(name, route_expr(F.col(key_col), [(r[0], r[1], r[2]) for r in small]))
    starts = bounds.select(
        F.col("start_key").alias("__k"), F.struct(F.col("start_key").alias("start"), F.col("end_key").alias("end"), F.col("region_id").cast("bigint").alias("id")).alias("__r")
    )
    k, r = fresh(rows, "__k"), fresh(rows, f"{name}_found")
    found = last_start(rows, starts, key_col, "__r", "__r").select(
        F.col("__k").alias(k), F.when((F.length("__r.end") == 0) | (F.col("__k") < F.col("__r.end")), F.col("__r.id")).alias(r)
    )
    # The keys found are distinct, so no key is multiplied; a hot one is a broadcast row or a split partition.
    return rows.join(found, F.col(key_col) == F.col(k), "left").withColumn(name, F.col(r)).drop(k, r)


def batch_spans(routed: DataFrame, batch_col: str, region_col: str = "region_id") -> DataFrame:
    """Batches whose keys lie in more than one region, with the number ``regions``."""
    return routed.groupBy(batch_col).agg(F.count_distinct(region_col).alias("regions")).filter("regions > 1")


def require_one_region(routed: DataFrame, batch_col: str, region_col: str = "region_id") -> None:
    """Raise InvalidArgument if a batch spans regions or a key has none."""
    if not routed.filter(F.col(region_col).isNull()).limit(1).isEmpty():
        raise InvalidArgument("a key belongs to no region")
    bad = batch_spans(routed, batch_col, region_col).limit(1).collect()
    if bad:
        raise InvalidArgument(f"batch {bad[0][0]} spans {bad[0]['regions']} regions")


def snapshot_create(visible_pairs: DataFrame, region_id: int) -> DataFrame:
    """All visible pairs (cf, key, value) of one region over all column families."""
    return visible_pairs.filter(F.col("region_id") == region_id).select("cf", "key", "value")


def snapshot_summary(routed: DataFrame, region_col: str, index_col: str) -> DataFrame:
    """Per region: pairs held ``kvs`` and the index ``snap_index`` that they reach."""
    return routed.filter(F.col(region_col).isNotNull()).groupBy(region_col).agg(
        F.count(F.lit(1)).alias("kvs"), F.max(index_col).alias("snap_index")
    )


def snapshot_replace(current: DataFrame, snapshot: DataFrame, in_region: Column) -> DataFrame:
    """State after a snapshot is applied: other regions' rows stay, the region's are the snapshot's."""
    return current.filter(~F.coalesce(in_region, F.lit(False))).unionByName(snapshot)


def snapshot_mutations(current: DataFrame, snapshot: DataFrame, region_id: int, first_seq: int) -> DataFrame:
    """One atomic batch of mutations: a tombstone for each current pair that the snapshot lacks, a put for each of its pairs.

    All get one position; the log entry that applies the snapshot is their sequence.
    """
    mine = current.filter(F.col("region_id") == region_id).select("cf", "key")
    gone = mine.join(snapshot.select("cf", "key"), ["cf", "key"], "left_anti")
    return (
        gone.select(F.lit(region_id).cast("bigint").alias("region_id"), "cf", "key", F.lit(first_seq).cast("bigint").alias("seq"), F.lit(0).cast("tinyint").alias("op"), F.lit(None).cast("binary").alias("value"))
        .unionByName(snapshot.select(F.lit(region_id).cast("bigint").alias("region_id"), "cf", "key", F.lit(first_seq).cast("bigint").alias("seq"), F.lit(1).cast("tinyint").alias("op"), "value"))
    )
