"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import digest
from ..session import lookup, materialise

#: When the snapshot list is too long to broadcast: rows up to which a group stays together, and groups that are split at
#: most (their list is broadcast).
PART_ROWS, MAX_SPLIT = 250_000, 50_000


def snapshot_changes(
    snapshots: DataFrame,
    group_cols: Sequence[str] = ("region_id",),
    index_col: str = "snap_index",
    key_col: str = "key",
    value_cols: Sequence[str] = ("value",),
) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before.

    Every row is tagged as the new side of its own snapshot and the old side of
    the following one; a single hash aggregation by (group, snapshot, key)
    compares the row hashes of both sides. The shuffle key holds the record key,
    so neither a large group nor a large snapshot lands in one task, and
    repeated rows collapse before the shuffle. A snapshot list that is too long
    to broadcast isn't joined: it goes with the rows into one shuffle by group
    (large groups split by key), and a running window hands it to them; the
    aggregation needs no further shuffle then. Only keys that a snapshot holds
    with several different values, which the aggregate detects, are decided by a
    second one over their distinct row hashes.

    Defined results: a row with a NULL key only states that its snapshot exists;
    a group's first snapshot gives nothing; NULL and empty values differ; NULL
    equals NULL; repeated rows count once; a NULL group or index gives nothing;
    a key that a snapshot holds with several different values is changed if the
    sets of its values differ; an empty table gives an empty result. Other
    columns are ignored.

    Returns group columns, ``index_col`` of the newer snapshot, ``key_col`` and
    ``change``.
    """
    group = list(group_cols)
    present = F.lit(True)
    for c in (*group, index_col):
        present = present & F.col(c).isNotNull()
    rows = snapshots.select(*group, index_col, key_col, *value_cols).filter(present)

    order = Window.partitionBy(*group).orderBy(index_col)
    steps = rows.groupBy(*group, index_col).agg(F.count(F.lit(1)).alias("__rows")).select(
        *group,
        index_col,
        F.lag(index_col).over(order).alias("__prev"),
        F.lead(index_col).over(order).alias("__next"),
        "__rows",
    )
    steps, small = lookup(steps, "snapshot-steps")

    h1, h2 = digest(*value_cols)
    pairs = rows.filter(F.col(key_col).isNotNull()).select(
        *group, index_col, F.col(key_col).alias("__key"), h1.alias("__h1"), h2.alias("__h2")
    )
    within = list(group)
    if small:
        pairs = pairs.join(steps, [*group, index_col])
    else:
        within.append("__part")
        pairs = _beside_steps(pairs, steps, group, index_col)
    sides = F.array(
        F.when(F.col("__prev").isNotNull(), F.struct(F.col(index_col).alias("at"), F.lit(True).alias("new"))),
        F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("at"), F.lit(False).alias("new"))),
    )
    tagged = (
        pairs.select(*within, "__key", "__h1", "__h2", F.explode(sides).alias("__side"))
        .filter(F.col("__side").isNotNull())
        .select(*within, F.col("__side.at").alias("__at"), F.col("__side.new").alias("__new"), "__key", "__h1", "__h2")
    )

    def side(new: bool, h: str):
        return F.when(F.col("__new") if new else ~F.col("__new"), F.col(h))

    def both(h: str):
        return [
            f(side(new, h)).alias(f"{name}_{h}_{'n' if new else 'o'}")
            for new in (True, False)
            for name, f in (("lo", F.min), ("hi", F.max))
        ]

    wide = tagged.groupBy(*within, "__at", "__key").agg(*both("__h1"), *both("__h2"))
    same, several = F.lit(True), F.lit(False)
    for h in ("__h1", "__h2"):
        same = same & F.col(f"lo_{h}_n").eqNullSafe(F.col(f"lo_{h}_o"))
        for s in ("n", "o"):
            several = several | (F.col(f"lo_{h}_{s}") != F.col(f"hi_{h}_{s}"))
    change = (
        F.when(F.col("lo___h1_o").isNull(), "added")
        .when(F.col("lo___h1_n").isNull(), "removed")
        .when(F.coalesce(several, F.lit(False)), "several")
        .when(~same, "changed")
    )
    found = materialise(wide.select(*group, "__at", "__key", change.alias("change")).filter(F.col("change").isNotNull()), "snapshot-changes")
    unsure = found.filter("change = 'several'").drop("change")
    if not unsure.limit(1).isEmpty():
        values = tagged.join(unsure, [*group, "__at", "__key"], "left_semi").groupBy(*group, "__at", "__key", "__h1", "__h2").agg(
            F.max(F.col("__new").cast("int")).alias("n"), F.max((~F.col("__new")).cast("int")).alias("o")
        )
        exact = values.groupBy(*group, "__at", "__key").agg(F.max((F.col("n") != F.col("o")).cast("int")).alias("d")).filter("d = 1")
        found = found.filter("change <> 'several'").unionByName(exact.drop("d").withColumn("change", F.lit("changed")))
    return found.select(*group, F.col("__at").alias(index_col), F.col("__key").alias(key_col), "change")


def _beside_steps(pairs: DataFrame, steps: DataFrame, group: list[str], index_col: str) -> DataFrame:
    """The pairs with ``__prev`` and ``__next`` of their snapshot and the ``__part`` of their group,
    a function of the key; partitioned by group and part."""
    total = steps.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    most = max(PART_ROWS, total // MAX_SPLIT)
    n, m = F.sum("__rows"), F.count(F.lit(1))
    parts = F.least(F.ceil(n / most), F.ceil(n / m)).cast("bigint")  # copies of the list don't outnumber the rows
    large = steps.groupBy(*group).agg(n.alias("__n"), parts.alias("__parts")).filter(F.col("__n") > most).drop("__n")
    large = F.broadcast(materialise(large, "snapshot-large-groups"))
    parts = F.coalesce("__parts", F.lit(1).cast("bigint"))

    listed = steps.join(large, group, "left").select(
        *group,
        index_col,
        F.struct("__prev", "__next").alias("__step"),
        *(F.lit(None).cast(kind).alias(c) for c, kind in pairs.select("__key", "__h1", "__h2").dtypes),
        F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("__part"),
    )
    held = pairs.join(large, group, "left").select(
        *pairs.columns, F.lit(None).cast(listed.schema["__step"].dataType).alias("__step"), F.pmod(F.xxhash64("__key"), parts).alias("__part")
    )
    first = F.col("__step").isNull()  # a snapshot's step before its pairs
    so_far = Window.partitionBy(*group, "__part").orderBy(index_col, first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beside = listed.unionByName(held).withColumn("__step", F.last("__step", ignorenulls=True).over(so_far))
    return beside.filter(F.col("__key").isNotNull()).select(*pairs.columns, "__part", "__step.__prev", "__step.__next")
