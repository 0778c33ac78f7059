"""Column expressions shared by operators (all evaluated in the JVM)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hex(col: Column | str) -> Column:
    """Upper-case hexadecimal of a BINARY key; the empty key gives ''."""
    return F.hex(col)


def digest(*cols: Column | str) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes; NULL fields are told from every value.

    A field that is NULL is skipped by the hash function, so its NULL flag is
    hashed beside it.
    """
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [F.isnull(c), c]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def prefix_end(prefix: bytes) -> bytes | None:
    """Smallest key above every key with this prefix; None if there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return None if not trimmed else trimmed[:-1] + bytes([trimmed[-1] + 1])


def in_range(key: Column, start: Column, end: Column) -> Column:
    """start <= key < end over unsigned bytes, an empty end being unbounded."""
    return (key >= start) & ((F.length(end) == 0) | (key < end))


def index_key(idx: Column) -> Column:
    """A log index as 8 big-endian bytes, so that byte order is number order."""
    return F.unhex(F.lpad(F.hex(idx.cast("bigint")), 16, "0"))


def index_of_key(raw: Column) -> Column:
    """The log index of 8 big-endian bytes; NULL for other lengths."""
    return F.when(F.length(raw) == 8, F.conv(F.hex(raw), 16, 10).cast("bigint"))


def bound_text(bound: Column, end: bool = False) -> Column:
    """A region bound for people: hexadecimal, '-inf' and '+inf' where it is open."""
    return F.when(F.length(bound) == 0, F.lit("+inf" if end else "-inf")).otherwise(F.hex(bound))


def physical_prefix(region_id: Column, cf: Column) -> Column:
    """What all keys of a region and family begin with in a flat key space."""
    return F.concat(F.lit("data/"), region_id.cast("string"), F.lit("/"), cf, F.lit("/")).cast("binary")


def physical_key(region_id: Column, cf: Column, key: Column) -> Column:
    return F.concat(physical_prefix(region_id, cf), key)


def user_key(raw: Column, region_id: Column, cf: Column) -> Column:
    """The user key of a physical one under the prefix of region and family; NULL if it lies elsewhere."""
    prefix = physical_prefix(region_id, cf)
    return F.when(F.substring(raw, F.lit(1), F.length(prefix)) == prefix, F.substring(raw, F.length(prefix) + 1, F.length(raw)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name
