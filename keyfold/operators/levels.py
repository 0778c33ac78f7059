"""Layered storage: compaction picks, garbage collection of versions, splits and checks.

A manifest is a table with one row per file: ``level, ord, number, file_size,
smallest, largest`` (user keys). Windows over a manifest see one row per file,
never rows of data. Tables of versions are only aggregated with a combine or
range-partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fresh
from ..schema import Corruption
from ..session import ship_package
from . import merge, mvcc, regions

# Fixed values of the compaction rules.
L0_FILES = 4
L1_BYTES = 10 << 20
OUTPUT_BYTES = 2 << 20


@dataclass
class Pick:
    """A compaction: files of ``level`` to merge with overlapping files of the next."""

    level: int
    inputs: list[int]
    overlap: list[int]
    low: bytes
    high: bytes


def pick(manifest: DataFrame, l0_files: int = L0_FILES, l1_bytes: int = L1_BYTES) -> Pick | None:
    """The next compaction, or None: all of level 0 from ``l0_files`` files on, else the first of level 1 from ``l1_bytes`` on."""
    r = manifest.agg(
        F.count_if(F.col("level") == 0).alias("n0"), F.sum(F.when(F.col("level") == 1, F.col("file_size"))).alias("b1")
    ).first()
    if r.n0 >= l0_files:
        level, chosen = 0, manifest.filter("level = 0")
    elif (r.b1 or 0) >= l1_bytes:
        level, chosen = 1, manifest.filter("level = 1").orderBy("ord").limit(1)
    else:
        return None
    span = chosen.agg(F.min("smallest").alias("low"), F.max("largest").alias("high"), F.sort_array(F.collect_list("number")).alias("files")).first()
    low, high = span.low, span.high
    hit = manifest.filter((F.col("level") == level + 1) & (F.col("smallest") <= F.lit(high)) & (F.col("largest") >= F.lit(low)))
    return Pick(level, list(span.files), [x.number for x in hit.orderBy("ord").select("number").collect()], low, high)


def overlaps(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (source_file, target_file) of ranges that share a key; ``targets`` are disjoint.

    Inputs are (fn, lo, hi). The targets that a range meets follow each other, so
    the first and last are found by position in one merged order of range ends,
    and only actual pairs are made.
    """
    every = Window.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = targets.withColumn("ord", F.row_number().over(Window.orderBy("lo")))
    # Targets wholly before a range end before its lo; those that begin up to its hi are the rest.
    marks = t.select(F.col("hi").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("ends"), F.lit(0).alias("begins"), F.lit(None).cast("bigint").alias("fn")).unionByName(
        t.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("ends"), F.lit(1).alias("begins"), F.lit(None).cast("bigint").alias("fn"))
    )
    lows = sources.select(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("ends"), F.lit(0).alias("begins"), F.col("fn").cast("bigint").alias("fn"))
    highs = sources.select(F.col("hi").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("ends"), F.lit(0).alias("begins"), F.col("fn").cast("bigint").alias("fn"))
    first = marks.unionByName(lows).withColumn("n", F.sum("ends").over(every)).filter("fn IS NOT NULL").select("fn", (F.col("n") + 1).alias("first"))
    last = marks.unionByName(highs).withColumn("n", F.sum("begins").over(every)).filter("fn IS NOT NULL").select("fn", F.col("n").alias("last"))
    runs = first.join(last, "fn").filter(F.col("first") <= F.col("last"))
    pairs = runs.select("fn", F.explode(F.sequence("first", "last")).alias("ord"))
    return pairs.join(t.select(F.col("ord").cast("bigint").alias("ord"), F.col("fn").alias("target_file")), "ord").select(F.col("fn").alias("source_file"), "target_file")


def collect_garbage(
    versions: DataFrame,
    key_cols: Sequence[str],
    seq_col: str,
    op_col: str,
    is_delete: Column,
    oldest_snapshot: int,
    lower: DataFrame | None = None,
    unique: Sequence[str] | None = None,
) -> DataFrame:
    """Versions that a compaction keeps for readers at ``oldest_snapshot`` and later.

    Kept are all versions above it and the newest one up to it per key; the
    latter is dropped too if it is a deletion and no range (smallest, largest) of
    ``lower`` may hold its key. ``lower`` None means that any lower file may hold it;
    a table without rows, that none does. The two parts are separate branches:
    one is a filter, the other an aggregate with a combine (``unique`` as in ``mvcc.newest``).
    """
    above = versions.filter(F.col(seq_col) > oldest_snapshot)
    base = mvcc.newest(versions.filter(F.col(seq_col) <= oldest_snapshot), key_cols, seq_col, [op_col], unique)
    if lower is not None:
        held = covered(base, lower, key_cols[-1])
        base = held.filter(~(is_delete & ~F.col("__covered"))).drop("__covered")
    return above.unionByName(base)


def drop_base_tombstones(versions: DataFrame, deeper: DataFrame, key_cols: Sequence[str], droppable: Column) -> DataFrame:
    """Versions without those ``droppable`` deletions whose key no deeper level holds, decided by its keys themselves."""
    keep = ~F.coalesce(droppable, F.lit(False))
    held = deeper.select(*(F.col(k).alias(f"__d{i}") for i, k in enumerate(key_cols))).distinct()
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__d{i}")) for i, k in enumerate(key_cols)))
    return versions.filter(keep).unionByName(versions.filter(~keep).join(held, on, "left_semi"))


def covered(rows: DataFrame, ranges: DataFrame, key_col: str) -> DataFrame:
    """Rows with ``__covered``: whether a range (smallest, largest), both inclusive, may hold the key.

    However many ranges there are, and of whatever type: a key is covered if the
    greatest end among the ranges that begin at or below it is not below it.
    NULL keys are in no range, a range with a NULL bound holds nothing.
    """
    whole = ranges.filter(F.col("smallest").isNotNull() & F.col("largest").isNotNull())
    if whole.limit(1).isEmpty():
        return rows.withColumn("__covered", F.lit(False))
    found = regions.last_start(rows, whole.select(F.col("smallest").alias("__k"), "largest"), key_col, "largest", "__end")
    k = fresh(rows, "__k")
    inside = found.filter(F.col("__end") >= F.col("__k")).select(F.col("__k").alias(k), F.lit(True).alias("__covered"))
    held = rows.drop("__covered").join(inside, F.col(key_col) == F.col(k), "left").drop(k)
    return held.withColumn("__covered", F.col("__covered").isNotNull())


def split_outputs(versions: DataFrame, key_cols: Sequence[str], seq_col: str, op_col: str, size: Column, target: int = OUTPUT_BYTES, parts: int | None = None) -> DataFrame:
    """Versions in internal order with ``file_no``: a file ends at the first change of key after ``target`` bytes.

    Keys are range-partitioned; every partition begins a file of its own and is
    read as a stream, so one key with many versions needs no memory, but stays
    in one file as readers expect.
    """
    ship_package(versions.sparkSession)
    keys = list(key_cols)
    n = parts or max(1, int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key_hash = F.xxhash64(*(x for k in keys for x in (F.isnull(k), F.col(k))))
    ordered = (
        versions.withColumn("__size", F.coalesce(size.cast("bigint"), F.lit(0))).repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys, F.col(seq_col).desc(), F.col(op_col).desc())
        .withColumns({"__part": F.spark_partition_id(), "__hash": key_hash})
    )
    at = {c: i for i, c in enumerate(ordered.columns)}
    names = versions.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Neighbours in order have the same key if they have the same hash (64 bits, of two neighbours only).
        file_no, filled, before = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, sizes = batch.column(at["__hash"]).to_numpy(), batch.column(at["__size"]).to_numpy()
            changed = np.empty(h.size, bool)
            changed[0], changed[1:] = before is not None and h[0] != before, h[1:] != h[:-1]
            begins = np.flatnonzero(changed)  # rows that begin another key
            upto = np.concatenate(([0], np.cumsum(sizes))) + filled  # bytes of the open file before each row
            cuts, base = [], 0
            while True:  # as many steps as files end in this batch
                k = np.searchsorted(upto[begins], base + target)
                if k == begins.size:
                    break
                cuts.append(int(begins[k]))
                base = int(upto[begins[k]])
                begins = begins[k + 1 :]
            numbers = file_no + np.searchsorted(np.array(cuts, np.int64), np.arange(h.size), side="right")
            file_no, filled, before = file_no + len(cuts), int(upto[-1]) - base, h[-1]
            numbers = numbers + (np.int64(batch.column(at["__part"])[0].as_py()) << np.int64(32))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), pa.array(numbers, pa.int64())], [*names, "file_no"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in versions.schema) + ", file_no bigint"
    return ordered.mapInArrow(assign, schema)


def size_buckets(sizes: DataFrame, order_col: str, size_col: str, target: int) -> DataFrame:
    """``bucket`` of each row: the running total before it divided by ``target``."""
    total = merge.running_sum(sizes, [order_col], size_col)
    return total.withColumn("bucket", F.floor((F.col("running") - F.col(size_col)) / target)).drop("running")


def first_over_budget(files: DataFrame, order_col: str, size_col: str, budget: int) -> DataFrame:
    """One row ``first_at_limit``: the first file at which the running size reaches ``budget``."""
    return merge.running_sum(files, [order_col], size_col).filter(F.col("running") >= budget).agg(F.min(order_col).alias("first_at_limit"))


def overlapping_neighbours(ranges: DataFrame, low: str, high: str, group: Sequence[str] = ()) -> DataFrame:
    """Ranges that begin at or before the end of the one before them, in order of their beginning."""
    order = Window.partitionBy(*group).orderBy(low) if group else Window.orderBy(low)
    return ranges.withColumn("__ph", F.lag(high).over(order)).filter(F.col("__ph") >= F.col(low)).drop("__ph")


def validate(manifest: DataFrame) -> None:
    """Raise Corruption for a layout that readers can't trust.

    Numbers are positive and unique over all levels, sizes positive, ranges in
    order; in level 1 and 2 files are listed in key order and share no user key.
    """
    bad = manifest.filter((F.col("number") <= 0) | (F.col("file_size") <= 0) | (F.col("largest") < F.col("smallest")))
    if not bad.limit(1).isEmpty():
        raise Corruption("a table has no valid number, size or key range")
    if not manifest.groupBy("number").count().filter("count > 1").limit(1).isEmpty():
        raise Corruption("a table number occurs twice")
    order = Window.partitionBy("level").orderBy("ord")
    wrong = manifest.filter("level > 0").withColumn("__ph", F.lag("largest").over(order)).filter(F.col("__ph") >= F.col("smallest"))
    if not wrong.limit(1).isEmpty():
        raise Corruption("tables of a sorted level overlap or are out of order")


def wrong_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Tables of the manifest (number, file_size) that are not listed, or with another size ``actual``."""
    found = files.select("number", F.col("file_size").alias("actual"))
    return manifest.select("number", "file_size").join(found, "number", "left").filter(~F.col("actual").eqNullSafe(F.col("file_size")))


def check_files(manifest: DataFrame, files: DataFrame) -> None:
    """Raise Corruption unless every table of the manifest is listed (number, file_size) with its recorded size."""
    if not wrong_files(manifest, files).limit(1).isEmpty():
        raise Corruption("a table file is missing or has another size")


def obsolete_files(files: DataFrame, manifest: DataFrame, oldest_wal: int) -> DataFrame:
    """Files (number, kind) that no reader needs: tables not in the manifest, temporary ones, logs below the bound."""
    unlisted = files.filter("kind = 'sst'").join(manifest.select("number"), "number", "left_anti")
    return unlisted.unionByName(files.filter((F.col("kind") == "sst.tmp") | ((F.col("kind") == "log") & (F.col("number") < oldest_wal))))
