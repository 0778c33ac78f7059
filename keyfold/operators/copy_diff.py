"""Differences between two copies of one dataset, field by field."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import digest
from ..session import materialise


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two fields are compared: their own, a wider number or time, else text."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
            return T.LongType()
        if isinstance(a, T.FractionalType) and isinstance(b, T.FractionalType) and not (isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType)):
            return T.DoubleType()
        if isinstance(a, T.FloatType | T.DoubleType) or isinstance(b, T.FloatType | T.DoubleType):
            return T.DoubleType()
        return T.DecimalType(38, max(getattr(x, "scale", 0) for x in (a, b)))
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType()
    return T.StringType()


def _normal(field: str, kind: T.DataType) -> Column:
    """A field in its common type; -0.0 becomes 0.0 (NaN equals NaN in Spark's comparison)."""
    c = F.col(field).cast(kind)
    return c + F.lit(0.0).cast(kind) if isinstance(kind, T.FloatType | T.DoubleType) else c


def _shown(value: Column, kind: T.DataType) -> Column:
    """A value as text: hexadecimal for bytes, else the SQL text."""
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _default(kind: T.DataType) -> Column:
    """What stands beside the flag of a NULL key."""
    if isinstance(kind, T.BinaryType):
        return F.lit(bytearray())
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit("1970-01-01").cast(kind)
    return F.lit("" if isinstance(kind, T.StringType) else False if isinstance(kind, T.BooleanType) else 0).cast(kind)


def compare_copies(left: DataFrame, right: DataFrame, key_cols: Sequence[str], field_cols: Sequence[str], equal: bool = True) -> DataFrame:
    """Null-safe full outer join of two copies with an array of differences.

    Every copy is reduced to one row per key, with a combine before its only
    shuffle, and the join reuses that partitioning. Repeated rows of one key
    therefore neither multiply nor gather in one task. Fields are brought to one
    type on both sides (equal numbers of different types or scales are equal, as
    are 0.0 and -0.0, and NaN and NaN) and are compared raw; only values that
    differ are turned into text.

    Defined results: NULL differs from every value, also from the empty one, and
    equals NULL; a NULL in a key column matches NULL; repeated rows count once;
    columns not named are ignored; empty copies are legal. A key that a copy
    holds with several different rows is compared by the sets of values that each
    field takes: a field differs if these sets do, ``left_value`` and
    ``right_value`` being the least value that only that side has (NULL if it has
    none of its own). Such keys are rare; they are taken apart in a second pass
    over their rows alone, so one row per key comes out, never all pairs.

    Returns the key columns, ``side`` ('both', 'left' or 'right': where the key
    is) and ``differences``, an array of (field, left_value, right_value) that is
    empty for equal rows. Without ``equal`` equal keys are left out.
    """
    keys, fields = list(key_cols), list(field_cols)
    kinds = {c: _common(left.schema[c].dataType, right.schema[c].dataType) for c in (*keys, *fields)}

    def narrowed(df: DataFrame) -> DataFrame:
        # NULL-safe keys as plain equal ones: a flag, and a default in place of NULL.
        return df.select(
            *(F.coalesce(_normal(k, kinds[k]), _default(kinds[k])).alias(f"__k{i}") for i, k in enumerate(keys)),
            *(F.isnull(k).alias(f"__n{i}") for i, k in enumerate(keys)),
            *(_normal(f, kinds[f]).alias(f"__f{i}") for i, f in enumerate(fields)),
        )

    by = [*(f"__k{i}" for i in range(len(keys))), *(f"__n{i}" for i in range(len(keys)))]
    values = [f"__f{i}" for i in range(len(fields))]

    def reduced(df: DataFrame, tag: str) -> DataFrame:
        h1, h2 = digest(*values)
        hashed = narrowed(df).withColumns({"__h1": h1, "__h2": h2})
        return hashed.groupBy(*by).agg(
            F.max(F.struct(*values)).alias(f"__{tag}"),
            ((F.min("__h1") != F.max("__h1")) | (F.min("__h2") != F.max("__h2"))).alias(f"__{tag}several"),
        )

    joined = reduced(left, "l").join(reduced(right, "r"), by, "full_outer")
    in_left, in_right = F.col("__lseveral").isNotNull(), F.col("__rseveral").isNotNull()
    several = F.coalesce("__lseveral", F.lit(False)) | F.coalesce("__rseveral", F.lit(False))
    side = F.when(in_left & in_right, "both").when(in_left, "left").otherwise("right")
    entry = "struct<field:string,left_value:string,right_value:string>"
    diffs = F.array(
        *(
            F.when(
                ~F.col(f"__l.{v}").eqNullSafe(F.col(f"__r.{v}")),
                F.struct(F.lit(f).alias("field"), _shown(F.col(f"__l.{v}"), kinds[f]).alias("left_value"), _shown(F.col(f"__r.{v}"), kinds[f]).alias("right_value")),
            )
            for v, f in zip(values, fields, strict=True)
        )
    ).cast(f"array<{entry}>")
    none = F.array().cast(f"array<{entry}>")
    compared = joined.select(
        *by, side.alias("side"), F.when(in_left & in_right, F.filter(diffs, lambda x: x.isNotNull())).otherwise(none).alias("differences"),
        (several & in_left & in_right).alias("__several"),
    )
    if not equal:
        compared = compared.filter((F.col("side") != "both") | (F.size("differences") > 0) | F.col("__several"))
    compared = materialise(compared, "compared")
    wanted = compared.filter("__several").select(*by)
    if not wanted.limit(1).isEmpty():
        exact = _by_sets(narrowed(left), narrowed(right), wanted, by, values, fields, kinds, entry)
        again = wanted.join(exact, by, "left").select(*by, F.lit("both").alias("side"), F.coalesce("differences", none).alias("differences"))
        if not equal:
            again = again.filter(F.size("differences") > 0)
        compared = compared.filter("NOT __several").drop("__several").unionByName(again)
    return compared.select(*(F.when(~F.col(f"__n{i}"), F.col(f"__k{i}")).alias(k) for i, k in enumerate(keys)), "side", "differences")


def _by_sets(left: DataFrame, right: DataFrame, wanted: DataFrame, by: list[str], values: list[str], fields: list[str], kinds: dict, entry: str) -> DataFrame:
    """Differences of the wanted keys by the sets of values that their fields take: aggregates by (key, field, value), then by key."""
    both = left.withColumn("__left", F.lit(True)).unionByName(right.withColumn("__left", F.lit(False))).join(wanted, by, "left_semi")
    cells = F.explode(
        F.array(*(F.struct(F.lit(i).alias("at"), F.isnull(v).alias("null"), F.coalesce(_shown(F.col(v), kinds[f]), F.lit("")).alias("text")) for i, (v, f) in enumerate(zip(values, fields, strict=True))))
    )
    per_value = both.select(*by, "__left", cells.alias("c")).groupBy(*by, F.col("c.at").alias("at"), F.col("c.null").alias("null"), F.col("c.text").alias("text")).agg(
        F.max(F.col("__left").cast("int")).alias("l"), F.max((~F.col("__left")).cast("int")).alias("r")
    )
    own = per_value.filter("l <> r").groupBy(*by, "at").agg(
        F.min(F.when((F.col("l") == 1) & ~F.col("null"), F.col("text"))).alias("lv"), F.min(F.when((F.col("r") == 1) & ~F.col("null"), F.col("text"))).alias("rv")
    )
    name = reduce(lambda out, x: F.when(F.col("at") == x[0], x[1]).otherwise(out), enumerate(fields), F.lit(None).cast("string"))
    one = F.struct("at", name.alias("field"), F.col("lv").alias("left_value"), F.col("rv").alias("right_value"))
    # At most one entry per field.
    return own.groupBy(*by).agg(F.sort_array(F.collect_list(one)).alias("d")).select(
        *by, F.transform("d", lambda x: F.struct(x["field"].alias("field"), x["left_value"].alias("left_value"), x["right_value"].alias("right_value"))).cast(f"array<{entry}>").alias("differences")
    )


def difference_rows(compared: DataFrame, missing_left: str, missing_right: str) -> DataFrame:
    """One row per difference of ``compare_copies``; equal pairs give none."""
    what = F.when(F.col("side") == "right", F.array(F.lit(missing_left))).when(
        F.col("side") == "left", F.array(F.lit(missing_right))
    ).otherwise(F.transform("differences", lambda d: d["field"]))
    keys = [c for c in compared.columns if c not in ("side", "differences")]
    return compared.select(*keys, F.explode(what).alias("diff"))
