"""Mixing sources to target shares of a total size by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import lookup, materialise

#: Rows per block of the ranking: a block is one task's group at most.
BLOCK_ROWS = 200_000
#: Fractions are kept as numbers out of this, so that crossings are counted exactly.
UNIT = 1 << 31


def _plan(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """Per listed source: available size, ``wanted`` size and expected copies of each of its documents.

    Without ``total`` it is as large as the scarcest source allows: with all
    documents of every source used at most ``max_repeats`` times, it is the least of
    available * max_repeats / share. Sources that can't contribute (nothing
    there, no share, no repeats) leave their share to the others in proportion.
    With a larger ``total`` scarce sources stay at their most copies and fall short.
    """
    have = sizes.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("docs"))
    t = targets.join(have, "source", "left").withColumns(
        {"available": F.coalesce("available", F.lit(0)), "docs": F.coalesce("docs", F.lit(0))}
    )
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("usable", F.coalesce(usable, F.lit(False)))
    most, shares = t.filter("usable").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")), F.sum("target_share")).first()
    size = (most or 0.0) if total is None else total / (shares or 1.0)
    t = t.withColumn("wanted", F.when(F.col("usable"), F.lit(float(size)) * F.col("target_share")).otherwise(F.lit(0.0)))
    copies = F.least(F.col("wanted") / F.col("available"), F.col("max_repeats").cast("double"))
    return t.withColumn("expected", F.when(F.col("usable"), copies).otherwise(F.lit(0.0)))


def mix(
    sizes: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_tokens",
    seed: int = 1,
    total: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents with ``copies``, report of shares).

    ``total`` is the size of the mixture; by default what the scarcest source
    permits. A larger one is filled as far as ``max_repeats`` lets every source, and
    the report's ``shortfall`` says by how much each misses the size it should have.

    Within a source documents are ordered by size class, a hash, size and id; the
    expected copies are prefix-summed along that order, one random offset per
    source is added, and a document is used once for every whole number that its
    step crosses. Expected copies are equal within a source, so a document's
    prefix sum is its rank times them. The rank is the number of documents in
    lower classes, plus that in the class's blocks before, plus the place in a block:
    each a window over few rows, however large the source.

    Every input row comes out with all its columns (a ``copies`` of its own being
    replaced), with 0 copies if its size is 0 or NULL or its
    source is NULL, unlisted or unusable. ``sizes`` is read several times and
    should be a stored table. ``targets`` has one row per source. No row of any
    kind gives empty results.
    """
    t = targets.select(F.col(source_col).alias("source"), "target_share", "max_repeats")
    all_rows = sizes.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).alias("size"),
        F.struct(*(c for c in sizes.columns if c != "copies")).alias("row"),
    )
    plan, _ = lookup(_plan(all_rows.filter("size > 0"), t, total), "mix-plan")
    usable = plan.filter("expected > 0").select("source", "expected")
    used = all_rows.filter("size > 0").withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * 8)).join(usable, "source")
    lower = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # at most 504 classes
    classes, _ = lookup(
        used.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n")).select(
            "source", "class", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("below"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")
        ), "mix-classes",
    )
    # Rows without an id are told apart by their other columns.
    ident = F.xxhash64(F.lit(seed), F.col("id"), F.when(F.col("id").isNull(), F.xxhash64("row")))
    used = used.join(classes, ["source", "class"]).withColumn("hash", F.pmod(ident, F.col("blocks")))
    block = ["source", "class", "hash"]
    before = Window.partitionBy("source", "class").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of one class
    offsets = used.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(
        *block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy(*block).orderBy("size", "id"))
    ranked = used.withColumn("place", place).join(offsets, block).withColumn("rank", F.col("below") + F.col("offset") + F.col("place"))
    whole = F.floor("expected")
    step = F.round((F.col("expected") - whole) * UNIT).cast("bigint")
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(UNIT))
    crossed = F.pmod(F.col("rank") % UNIT * step + start, F.lit(UNIT)) < step
    chosen = ranked.select("row", "source", "size", (whole + crossed.cast("bigint")).alias("copies"))
    zero = F.lit(0).cast("bigint")
    sized = F.coalesce(F.col("size") > 0, F.lit(False))
    unused = all_rows.filter(~sized).select("row", "source", "size", zero.alias("copies")).unionByName(
        all_rows.filter(sized).join(usable.select("source"), "source", "left_anti").select("row", "source", "size", zero.alias("copies"))
    )
    taken = chosen.filter("copies > 0").groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("used_size"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("docs_used")
    )
    return chosen.unionByName(unused).select("row.*", "copies"), _report(plan, taken).withColumnRenamed("source", source_col)


def _report(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Shares of the mixed total per listed source."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    rows = plan.join(taken, "source", "left").withColumn("used_size", F.coalesce("used_size", zero))
    total = F.sum("used_size").over(everything)  # a row per source: as small as the table of targets
    return rows.select(
        "source",
        "target_share",
        "max_repeats",
        "docs",
        F.col("available").cast("bigint").alias("available_size"),
        F.round("wanted").cast("bigint").alias("wanted_size"),
        "expected",
        F.coalesce("docs_used", zero).alias("docs_used"),
        F.coalesce("most_copies", zero).alias("most_copies"),
        "used_size",
        F.when(total > 0, F.col("used_size") / total).otherwise(F.lit(0.0)).alias("reached_share"),
        F.greatest(F.round(F.col("wanted") - F.col("available") * F.col("expected")).cast("bigint"), zero).alias("shortfall"),
    )


def mixed(sizes: DataFrame, targets: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """``mix`` over a stored copy of the sizes."""
    return mix(materialise(sizes, "mix-sizes"), targets, **columns)
