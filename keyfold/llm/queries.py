"""Queries p1, p7, p8 and p9 over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import load, shared_path
from . import encoding, garbled, mixing, seen

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: The rows that ask for a key: Get and Put.
ASKS = "cmd_type IN (1, 2)"


def _seen(spark: SparkSession, d: str) -> tuple[seen.SeenKeys, DataFrame]:
    keys = seen.SeenKeys(spark, shared_path(spark, "seen-keys"), ["cf", "key"])
    keys.absorb(keys.stream(f"{d}/key_history.parquet", None), keys.stream(f"{d}/requests.parquet", "req_no", ASKS))
    return keys, load(spark, d, "requests").filter(ASKS).select("req_no", "cf", "key", keys.file_id().alias("__file"))


@query("""
WITH a AS (SELECT req_no, cf, key FROM requests WHERE cmd_type IN (1, 2) AND key IS NOT NULL),
h AS (SELECT DISTINCT cf, key FROM key_history WHERE key IS NOT NULL),
f AS (SELECT cf, key, min(req_no) AS first_req FROM a GROUP BY cf, key)
SELECT a.req_no FROM a JOIN f ON a.cf IS NOT DISTINCT FROM f.cf AND a.key = f.key
LEFT JOIN h ON a.cf IS NOT DISTINCT FROM h.cf AND a.key = h.key
WHERE a.req_no > f.first_req OR h.key IS NOT NULL
""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    keys, asked = _seen(spark, d)
    return keys.repeats(asked, "req_no").select("req_no")


@query("""
WITH a AS (SELECT req_no, cf, key FROM requests WHERE cmd_type IN (1, 2) AND key IS NOT NULL),
h AS (SELECT DISTINCT cf, key FROM key_history WHERE key IS NOT NULL),
f AS (SELECT cf, key, min(req_no) AS first_req FROM a GROUP BY cf, key),
s AS (SELECT a.req_no, a.req_no > f.first_req OR h.key IS NOT NULL AS seen FROM a JOIN f ON a.cf IS NOT DISTINCT FROM f.cf AND a.key = f.key
  LEFT JOIN h ON a.cf IS NOT DISTINCT FROM h.cf AND a.key = h.key)
SELECT count(*) AS records, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS wrong_rate FROM s
""")
def p1_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    keys, asked = _seen(spark, d)
    return seen.wrong_answers(keys.flagged(asked, "req_no"), load(spark, d, "key_history"), ["cf", "key"], "req_no")


@query()
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(load(spark, d, "documents"))


@query("SELECT count(*) AS documents, count(*) AS exact FROM documents")
def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are, and of how many the ids spell exactly the text."""
    docs = load(spark, d, "documents")
    same = encoding.decoded_equal(docs, encoding.encode(docs))
    return same.agg(F.count(F.lit(1)).alias("documents"), F.count_if("equal").alias("exact"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = encoding.token_counts(load(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mixed(sizes, load(spark, d, "mix_targets"))


@query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


#: How far a reached share may lie from its target where no source falls short: sizes differ within a class.
SHARE_ERROR = 0.02


@query("""
WITH n AS (SELECT source, count(*) AS docs FROM documents WHERE text <> '' GROUP BY source)
SELECT t.source, coalesce(n.docs, 0) AS docs, true AS rounded, true AS capped, true AS summed, true AS on_target FROM mix_targets t LEFT JOIN n ON t.source = n.source
""")
def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source what must hold of any mixture: every document used floor or ceiling of its expected copies, none
    more than the cap, uses adding up to the expected ones but for one, and the share reached."""
    docs, report = _mixed(spark, d)
    uses = docs.filter("n_tokens > 0").groupBy("source").agg(F.min("copies").alias("least"), F.max("copies").alias("most"), F.sum("copies").alias("uses"), F.count(F.lit(1)).alias("n"))
    r = report.join(uses, "source", "left")
    e = F.col("expected")
    able = F.sum(F.when(e > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row per source
    none = F.col("uses").isNull()
    return r.select(
        "source", "docs",
        (none | ((F.col("least") >= F.floor(e)) & (F.col("most") <= F.ceil(e)))).alias("rounded"),
        (none | (F.col("most") <= F.col("max_repeats"))).alias("capped"),
        (none | (F.abs(F.col("uses") - e * F.col("n")) <= 1.001)).alias("summed"),
        ((e == 0) & (F.col("reached_share") == 0) | (F.abs(F.col("reached_share") - F.col("target_share") / able) <= SHARE_ERROR)).alias("on_target"),
    )


@query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.find(load(spark, d, "documents")).records.select("doc_id")


@query()
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return garbled.restore(docs, garbled.find(docs))
