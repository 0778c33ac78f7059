"""Tables of the newest row per key, written in parts and merged by size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import mvcc


#: Parts that are left side by side before any are merged.
PARTS = 4


def to_merge(parts: Sequence[dict], new: dict) -> tuple[list[dict], list[dict]]:
    """(parts that stay, parts to merge with the new one, which is the last of them)."""
    kept, merged, size = list(parts), [new], new["rows"]
    while len(parts) >= PARTS and kept and (len(merged) == 1 or kept[-1]["rows"] <= 2 * size):
        size += kept[-1]["rows"]
        merged.insert(0, kept.pop())
    return kept, merged


def write_counted(rows: DataFrame, path: str) -> int:
    """Write a Parquet table and tell its number of rows, counted on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get.get("n") or 0  # nothing is observed of a plan that was found to be empty


class KeyedParts:
    """One row per key over immutable Parquet parts, of which the newest wins.

    ``write`` stores the rows of one version and ``append`` gives the list of parts
    that a commit should name; nothing changes until it does. Beyond a few parts the
    last ones are merged, as far back as the one before isn't more than twice their
    size, so there are about as many parts as the logarithm of the rows, and a row is
    rewritten about as often, however many versions there are. Parts that no commit names any
    more stay for readers of older versions.

    Key columns may be NULL. Value columns should be of fixed size: then finding
    the newest is a hash aggregate.
    """

    def __init__(self, spark: SparkSession, path: str, key_cols: Sequence[str], value_cols: Sequence[str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.values = list(key_cols), list(value_cols)

    def _rows(self, parts: Sequence[dict]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{p['name']}" for p in parts))

    def _newest(self, parts: Sequence[dict]) -> DataFrame:
        rows = self._rows(parts).select(*self.keys, *self.values, "__v")
        return rows if len(parts) == 1 else mvcc.newest(rows, self.keys, "__v")

    def read(self, parts: Sequence[dict]) -> DataFrame | None:
        """Keys and values; None if there are no parts."""
        return self._newest(parts).select(*self.keys, *self.values) if parts else None

    def write(self, rows: DataFrame, version: int) -> dict:
        """A part with the rows (one per key) of a version."""
        return self._write(rows.select(*self.keys, *self.values, F.lit(version).cast("bigint").alias("__v")))

    def rows(self, part: dict) -> DataFrame:
        """What was written as one part."""
        return self._rows([part]).select(*self.keys, *self.values)

    def append(self, parts: Sequence[dict], new: dict) -> list[dict]:
        """The list of parts with a new one, merged with those before it as their number and sizes ask for."""
        kept, merged = to_merge(parts, new)
        return [*kept, self._write(self._newest(merged)) if len(merged) > 1 else new]

    def _write(self, rows: DataFrame) -> dict:
        name = f"part-{uuid.uuid4().hex}"
        return {"name": name, "rows": write_counted(rows, f"{self.path}/{name}")}
