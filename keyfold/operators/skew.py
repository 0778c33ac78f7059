"""Per-key ordered results that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import digest
from . import merge

#: Rows of one key that one task handles at a time.
CHUNK_ROWS = 100_000


def ordered_blocks(rows: DataFrame, order_col: str, block_rows: int | None = None) -> DataFrame:
    """Rows range-partitioned by ``order_col``, each with the number of its partition.

    The rows are counted first, so a block holds about ``block_rows`` however many
    there are. The table is written to the shared folder: partition numbers then
    stay what they are however often a task is run again.
    """
    return merge.ordered_blocks(rows, [order_col], "blocks", block_rows or merge.BLOCK_ROWS)


def number_rows(blocks: DataFrame, key_col: str, order_col: str) -> DataFrame:
    """``row_no``, from 0, of each row within its key by ``order_col``: exact and balanced.

    Keys are counted per block, the counts are prefix-summed into offsets, and a
    row's number is its offset plus its place within (block, key). A group of
    the numbering is never larger than one block.
    """
    counts = blocks.groupBy("__block", key_col).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key_col).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__block", key_col, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = Window.partitionBy("__block", key_col).orderBy(order_col)
    numbered = blocks.withColumn("__place", F.row_number().over(place) - 1)
    return numbered.join(offsets, ["__block", key_col]).withColumn("row_no", F.col("__offset") + F.col("__place")).drop(
        "__place", "__offset", "__block"
    )


def running_max(rows: DataFrame, key_cols: Sequence[str], order_col: str, value_col: str, name: str) -> DataFrame:
    """Rows with ``name``, the greatest value of the rows before them with the same key, NULL for a first row.

    Rows are cut into stored blocks by ``order_col`` (unique, not NULL). A window
    sees one key within one block; what came in earlier blocks is carried by a
    scan over one row per key and block. NULL keys are keys of their own.
    """
    keys = list(key_cols)
    names = [f"__k{i}" for i in range(len(keys))]
    coded = rows.withColumns({n: F.struct(F.col(k)) for n, k in zip(names, keys, strict=True)})  # a struct is never NULL
    blocks = ordered_blocks(coded, order_col)
    per_block = blocks.groupBy("__block", *names).agg(F.max(value_col).alias("__max"))
    earlier = Window.partitionBy(*names).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select("__block", *names, F.max("__max").over(earlier).alias("__carry"))
    inside = Window.partitionBy("__block", *names).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.withColumn("__near", F.max(value_col).over(inside))
    return near.join(carry, ["__block", *names]).select(*rows.columns, F.greatest("__near", "__carry").alias(name))


def ordered_key_stats(
    rows: DataFrame, key_col: str, order_col: str, value_col: str, time_col: str, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per key, in order: rows, first and last order, value changes, longest pause.

    Rows are numbered within their key by exact offsets, cut into chunks of
    ``chunk_rows``, every chunk is reduced to a state with its first and last
    row, and the states of a key are merged in chunk order. A key that holds a
    third of the table is thus many equal chunks.

    ``order_col`` must be unique and not NULL; ``changes`` counts rows whose
    value differs, null-safely, from the row before; ``longest_pause_us`` is the
    largest rise of ``time_col`` from one row to the next, NULL where there is
    no pair of times. Rows with a NULL key or order are left out; an empty table
    gives an empty result.
    """
    v1, v2 = digest(value_col)
    narrow = rows.select(
        F.col(key_col).alias("__key"),
        F.col(order_col).alias("__order"),
        v1.alias("__v1"),
        v2.alias("__v2"),
        F.unix_micros(F.col(time_col).cast("timestamp")).alias("__t"),
    ).filter(F.col("__key").isNotNull() & F.col("__order").isNotNull())
    numbered = number_rows(ordered_blocks(narrow, "__order"), "__key", "__order")
    chunked = numbered.withColumn("__chunk", F.floor(F.col("row_no") / chunk_rows))

    inside = Window.partitionBy("__key", "__chunk").orderBy("row_no")
    first = F.col("row_no") % chunk_rows == 0
    stepped = chunked.select(
        "__key",
        "__chunk",
        "__order",
        "__v1",
        "__v2",
        "__t",
        first.alias("__first"),
        F.lead("row_no").over(inside).isNull().alias("__last"),
        (~first & ((F.lag("__v1").over(inside) != F.col("__v1")) | (F.lag("__v2").over(inside) != F.col("__v2")))).alias("__changed"),
        (F.col("__t") - F.lag("__t").over(inside)).alias("__pause"),
    )
    state = stepped.groupBy("__key", "__chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__order").alias("o0"),
        F.max("__order").alias("o1"),
        F.sum(F.col("__changed").cast("bigint")).alias("changes"),
        F.max("__pause").alias("pause"),
        *(F.max(F.when(F.col("__first"), F.col(c))).alias(f"{c}_a") for c in ("__v1", "__v2", "__t")),
        *(F.max(F.when(F.col("__last"), F.col(c))).alias(f"{c}_z") for c in ("__v1", "__v2", "__t")),
    )
    across = Window.partitionBy("__key").orderBy("__chunk")
    before = {c: F.lag(f"{c}_z").over(across) for c in ("__v1", "__v2", "__t")}
    merged = state.select(
        "__key",
        "n",
        "o0",
        "o1",
        (
            F.col("changes")
            + F.coalesce(((before["__v1"] != F.col("__v1_a")) | (before["__v2"] != F.col("__v2_a"))).cast("bigint"), F.lit(0))
        ).alias("changes"),
        F.greatest("pause", F.col("__t_a") - before["__t"]).alias("pause"),
    )
    return merged.groupBy("__key").agg(
        F.sum("n").alias("n_rows"),
        F.min("o0").alias("first_order"),
        F.max("o1").alias("last_order"),
        F.sum("changes").alias("changes"),
        F.max("pause").alias("longest_pause_us"),
    ).withColumnRenamed("__key", key_col)


def heavy_keys(stats: DataFrame, key_col: str, total: int, percent: int = 2) -> DataFrame:
    """Keys of ``ordered_key_stats`` with at least ``percent`` % of ``total`` rows."""
    return stats.filter(F.col("n_rows") * 100 >= F.lit(total) * percent).select(key_col, "n_rows")
