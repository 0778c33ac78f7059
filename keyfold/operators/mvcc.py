"""Reads of versioned data: newest visible version, tombstones, snapshots, lookups.

A version is a row of key columns, a sequence, an operation and values. Every
operator works on any columns of these roles; ``is_delete`` is a condition on
the operation. NULL key columns are keys of their own, empty keys are legal, a
value may be NULL or empty and stays what it is; extra columns are carried
along; an empty table gives an empty result. Versions of one key with equal
sequence are ordered by ``ties``, the greatest winning.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import prefix_end
from ..session import lookup as sized_lookup


def visible(versions: DataFrame, seq_col: str, as_of: int | None) -> DataFrame:
    """Versions with sequence up to ``as_of``; all for None. The filter reaches the scan."""
    return versions if as_of is None else versions.filter(F.col(seq_col) <= as_of)


#: Types whose values a hash aggregate can update in place, and bits of those that can be packed.
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
_BITS = {T.BooleanType: 1, T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
#: Bits of a whole number that a DECIMAL(38) holds.
_DECIMAL_BITS = 126


def packed(df: DataFrame, order: Sequence[str]) -> Column | None:
    """One column that sorts as ``order`` does, NULLs first, and is updated in place; None if the types allow none.

    A single column stands for itself. Several whole numbers are the digits of
    one DECIMAL(38), each with an offset that makes it positive.
    """
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        return F.col(order[0]) if isinstance(kinds[0], _FIXED) else None
    bits = [_BITS.get(type(k)) for k in kinds]
    if None in bits or sum(bits) + len(bits) > _DECIMAL_BITS:
        return None
    out = F.col(order[0]).cast("decimal(38,0)")
    for c, n in zip(order[1:], bits[1:], strict=True):
        digit = F.coalesce(F.col(c).cast("int" if n == 1 else "bigint").cast("decimal(38,0)") + F.lit(1 + (1 << n >> 1)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
        out = (out * F.lit(1 << (n + 1)).cast("decimal(38,0)") + digit).cast("decimal(38,0)")
    return out


def newest(versions: DataFrame, key_cols: Sequence[str], seq_col: str, ties: Sequence[str] = (), unique: Sequence[str] | None = None) -> DataFrame:
    """The newest version per key, deletions included.

    An aggregate with a combine before the shuffle: a key with most of the
    versions costs one row per task. Columns of fixed size are carried in the
    buffer of a hash aggregate, nothing being sorted. Strings, bytes and nested
    columns don't fit there: if ``unique`` names columns that together identify a
    version (a sequence of its own, say), the hash aggregate finds the newest
    ones and a semi-join on these columns, which no key can skew, fetches the
    rows; otherwise the aggregate sorts by key.
    """
    keys = list(key_cols)
    # Where key and sequence identify a version, nothing else need be compared.
    order = [seq_col] if unique and set(unique) <= {*keys, seq_col} else [seq_col, *ties]
    there = versions.filter(F.col(seq_col).isNotNull())
    rest = [c for c in versions.columns if c not in (*keys, *order)]
    rank = packed(versions, order)
    fixed = [c for c in (*order, *rest) if isinstance(versions.schema[c].dataType, _FIXED)]
    if rank is not None and len(fixed) == len(order) + len(rest):
        best = there.withColumn("__rank", rank).groupBy(*keys).agg(*(F.max_by(c, "__rank").alias(c) for c in fixed))
        return best.select(*versions.columns)
    if rank is not None and unique and all(c in keys or c in fixed for c in unique):
        by = [c for c in unique if c not in keys]
        best = there.withColumn("__rank", rank).groupBy(*keys).agg(*(F.max_by(c, "__rank").alias(c) for c in by))
        best = best.select(*(F.col(c).alias(f"__u{i}") for i, c in enumerate(unique)))
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__u{i}")) if c in keys else F.col(c) == F.col(f"__u{i}") for i, c in enumerate(unique)))
        return there.join(best, same, "left_semi")
    best = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__best")
    named = there.groupBy(*keys).agg(best)
    return named.select(*(F.col(k) if k in keys else F.col("__best")[k].alias(k) for k in versions.columns))


def latest(
    versions: DataFrame, key_cols: Sequence[str], seq_col: str, is_delete: Column, as_of: int | None = None, ties: Sequence[str] = (),
    unique: Sequence[str] | None = None,
) -> DataFrame:
    """What a reader at ``as_of`` sees: newest visible versions that are no deletions.

    Deletions are masked after the newest version is chosen, never before.
    """
    return newest(visible(versions, seq_col, as_of), key_cols, seq_col, ties, unique).filter(~is_delete)


def seek(versions: DataFrame, key_col: str, start) -> DataFrame:
    """Versions of keys at or above ``start``; pushed down through the newest-version aggregate."""
    return versions.filter(F.col(key_col) >= F.lit(start))


def prefix(versions: DataFrame, key_col: str, start: bytes | str) -> DataFrame:
    """Versions of keys with a prefix, as a key range that the scan can prune by."""
    raw = start.encode() if isinstance(start, str) else bytes(start)
    end = prefix_end(raw)
    lit = (lambda b: F.lit(b.decode())) if isinstance(start, str) else (lambda b: F.lit(bytearray(b)))
    low = F.col(key_col) >= lit(raw)
    if end is None:
        return versions.filter(low)
    try:
        return versions.filter(low & (F.col(key_col) < lit(end)))
    except UnicodeDecodeError:  # the next prefix isn't text
        return versions.filter(F.col(key_col).startswith(start))


def scan(
    versions: DataFrame,
    key_cols: Sequence[str],
    seq_col: str,
    is_delete: Column,
    start=None,
    limit: int = 0,
    as_of: int | None = None,
    ties: Sequence[str] = (),
    unique: Sequence[str] | None = None,
) -> DataFrame:
    """Visible pairs in key order from an inclusive start; ``limit`` 0 is no limit.

    The order is that of the last key column; a limit becomes a top-n.
    """
    rows = versions if start is None else seek(versions, key_cols[-1], start)
    rows = latest(rows, key_cols, seq_col, is_delete, as_of, ties, unique).orderBy(*key_cols)
    return rows.limit(limit) if limit else rows


def get(versions: DataFrame, key_cols: Sequence[str], key: Iterable, seq_col: str, is_delete: Column, as_of: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Zero or one row: the visible version of one key."""
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(key_cols, key, strict=True)))
    return latest(versions.filter(same), key_cols, seq_col, is_delete, as_of, ties)


def lookup(
    versions: DataFrame, keys: DataFrame, key_cols: Sequence[str], seq_col: str, is_delete: Column, as_of: int | None = None, ties: Sequence[str] = (),
    unique: Sequence[str] | None = None,
) -> DataFrame:
    """Each distinct asked key with ``state`` 'absent', 'value' or 'deleted' and its newest version.

    Versions of other keys are dropped by a semi-join before the newest is chosen.
    """
    cols = list(key_cols)
    asked = keys.select(*cols).distinct()
    names = [f"__asked{i}" for i in range(len(cols))]
    asked = asked.toDF(*names)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(cols, names, strict=True)))
    wanted = newest(visible(versions, seq_col, as_of).join(asked, same, "left_semi"), cols, seq_col, ties, unique).withColumn("__hit", F.lit(True))
    state = F.when(F.col("__hit").isNull(), "absent").when(is_delete, "deleted").otherwise("value")
    found = asked.join(wanted, same, "left").withColumn("state", state)
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)), *(c for c in versions.columns if c not in cols), "state")


def multi_get(
    versions: DataFrame, keys: DataFrame, key_cols: Sequence[str], value_cols: Sequence[str], seq_col: str, is_delete: Column,
    as_of: int | None = None, ties: Sequence[str] = (), unique: Sequence[str] | None = None,
) -> DataFrame:
    """Each distinct asked key with its visible values, NULL where absent or deleted."""
    found = lookup(versions, keys, key_cols, seq_col, is_delete, as_of, ties, unique)
    return found.select(*key_cols, *(F.when(F.col("state") == "value", F.col(c)).alias(c) for c in value_cols))


def oldest_snapshot(snapshots: DataFrame, seq_col: str, last_sequence: int) -> DataFrame:
    """One row ``oldest``: the least live snapshot, else the last sequence."""
    return snapshots.agg(F.coalesce(F.min(seq_col), F.lit(last_sequence).cast("bigint")).alias("oldest"))


def bloom_prune(rows: DataFrame, keys: DataFrame, row_key: str, key: str) -> DataFrame:
    """Rows whose key is among ``keys``: a semi-join.

    Up to the broadcast bound, in rows and bytes, the stored distinct keys are
    broadcast; beyond it the join is shuffled and Spark may push its own runtime
    Bloom filter into the scan.
    """
    wanted, _ = sized_lookup(keys.select(F.col(key).alias("__k")).distinct(), "wanted-keys")
    return rows.join(wanted, F.col(row_key) == F.col("__k"), "left_semi")


def empty_if_absent(col: Column) -> Column:
    """Compatibility with clients that can't tell a missing value from an empty one."""
    return F.coalesce(col, F.lit(bytearray(b"")))
