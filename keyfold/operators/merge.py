"""Merging sorted sources, numbering of operations, duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Corruption
from ..session import lookup, materialise


def merge(sources: Sequence[DataFrame], key_cols: Sequence[str], seq_col: str, op_col: str | None = None, limit: int = 0) -> DataFrame:
    """Union of sources in internal order: key, newest first, puts before deletions, then source.

    The sort is range-partitioned; with ``limit`` it is a top-n. ``src`` is the
    place of the source in the list. Errors of a source fail the query.
    """
    tagged = [s.withColumn("src", F.lit(i)) for i, s in enumerate(sources)]
    order = [*(F.col(k).asc() for k in key_cols), F.col(seq_col).desc(), *([F.col(op_col).desc()] if op_col else []), F.col("src").asc()]
    out = reduce(DataFrame.unionByName, tagged).orderBy(*order)
    return out.limit(limit) if limit else out


def duplicates(versions: DataFrame, version_cols: Sequence[str]) -> DataFrame:
    """Internal keys that occur more than once, with their count ``n``."""
    return versions.groupBy(*version_cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(versions: DataFrame, version_cols: Sequence[str]) -> None:
    """Raise Corruption if an internal key occurs twice."""
    found = duplicates(versions, version_cols).limit(1).collect()
    if found:
        raise Corruption(f"internal key occurs {found[0]['n']} times: {found[0].asDict()}")


def ordered_blocks(rows: DataFrame, order_by: Sequence[Column | str], label: str, block_rows: int | None = None) -> DataFrame:
    """Rows range-partitioned by an order, each with the number ``__block`` of its partition, stored.

    Stored, so that a partition's number stays what it is however often a task is
    run again. With ``block_rows`` the rows are counted and there are as many
    blocks as hold about so many each, else as many as shuffle partitions.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if block_rows:
        parts = max(parts, -(-rows.count() // block_rows))
    return materialise(rows.repartitionByRange(parts, *order_by).withColumn("__block", F.spark_partition_id()), label)


#: A block of an order at most, about: the group of one window.
BLOCK_ROWS = 1_000_000


def _carried(per_block: DataFrame, carry: Column, label: str) -> DataFrame:
    """(__block, carried) for one row per block: a window over as many rows as blocks, sized before it is broadcast."""
    return lookup(per_block.select("__block", carry), label)[0]


def running_number(rows: DataFrame, order_by: Sequence[Column | str], first: int = 1, name: str = "seq") -> DataFrame:
    """Rows numbered ``first``, ``first + 1``, ... by a total order, without a single-task window.

    Rows are range-partitioned and stored, counted per partition, and numbered by
    the partition's offset and the place within it. The result for rows that are
    equal in all of ``order_by`` is one of the possible orders; NULLs come first.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    blocks = ordered_blocks(rows, order, "numbered", BLOCK_ROWS)
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = _carried(counts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), "numbered-offsets")
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*order))
    return (
        blocks.withColumn("__place", place).join(offsets, "__block")
        .withColumn(name, F.col("__offset") + F.col("__place") + F.lit(first - 1)).drop("__block", "__offset", "__place")
    )


def running_sum(rows: DataFrame, order_by: Sequence[Column | str], size_col: str, name: str = "running") -> DataFrame:
    """Running total of ``size_col`` by a total order, with block totals instead of one window."""
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    blocks = ordered_blocks(rows, order, "summed", BLOCK_ROWS)
    sums = blocks.groupBy("__block").agg(F.sum(size_col).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _carried(sums, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"), "summed-offsets")
    inside = F.sum(size_col).over(Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("__s", inside).join(offsets, "__block").withColumn(name, F.col("__offset") + F.col("__s")).drop(
        "__block", "__offset", "__s"
    )


def carried_max(rows: DataFrame, order_col: str, value_col: str, name: str, inclusive: bool = False) -> DataFrame:
    """Rows with ``name``, the greatest ``value_col`` of the rows before them by ``order_col``, NULL for none.

    With ``inclusive`` rows of the same order and the row itself count too. One
    shuffle into ranges; what earlier ranges hold is one carried value each.
    """
    blocks = ordered_blocks(rows, [F.col(order_col)], "carried", BLOCK_ROWS)
    most = blocks.groupBy("__block").agg(F.max(value_col).alias("__m"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(most, F.max("__m").over(before).alias("__carry"), "carried-values")
    own = Window.partitionBy("__block").orderBy(order_col)
    own = own.rangeBetween(Window.unboundedPreceding, Window.currentRow) if inclusive else own.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("__near", F.max(value_col).over(own)).join(carry, "__block").withColumn(
        name, F.greatest("__near", "__carry")
    ).drop("__near", "__carry", "__block")


def sequence_gaps(rows: DataFrame, seq_col: str) -> DataFrame:
    """Sequences whose predecessor in order is not one less, with that predecessor ``prev``.

    The predecessor of a distinct sequence is the greatest one before it.
    """
    seqs = rows.select(seq_col).filter(F.col(seq_col).isNotNull()).distinct()
    return carried_max(seqs, seq_col, seq_col, "prev").filter(F.col(seq_col) != F.col("prev") + 1).select(seq_col, "prev")


def valid_prefix(rows: DataFrame, seq_col: str, valid: Column) -> DataFrame:
    """One row: the last sequence before the first invalid row, NULL if there is none."""
    torn = rows.filter(~F.coalesce(valid, F.lit(False))).agg(F.min(seq_col)).first()[0]
    ok = rows if torn is None else rows.filter(F.col(seq_col) < F.lit(torn))
    return ok.agg(F.max(seq_col).alias("last_valid"))
