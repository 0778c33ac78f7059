"""Queries p2 to p6 over whole tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import key_hex
from ..operators import change_feed, copy_diff, incremental, skew, snapshot_diff
from ..session import load, shared_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("""
WITH s AS (SELECT region_id, snap_index, lag(snap_index) OVER (PARTITION BY region_id ORDER BY snap_index) AS prev
  FROM (SELECT DISTINCT region_id, snap_index FROM region_snapshots) d),
r AS (SELECT DISTINCT region_id, snap_index, key, value FROM region_snapshots WHERE key IS NOT NULL),
n AS (SELECT s.region_id, s.snap_index, r.key, r.value FROM s JOIN r ON r.region_id = s.region_id AND r.snap_index = s.snap_index WHERE s.prev IS NOT NULL),
o AS (SELECT s.region_id, s.snap_index, r.key, r.value FROM s JOIN r ON r.region_id = s.region_id AND r.snap_index = s.prev)
SELECT coalesce(n.region_id, o.region_id) AS region_id, coalesce(n.snap_index, o.snap_index) AS snap_index,
  hex(coalesce(n.key, o.key)) AS key_hex,
  CASE WHEN o.region_id IS NULL THEN 'added' WHEN n.region_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.region_id = o.region_id AND n.snap_index = o.snap_index AND n.key = o.key
WHERE o.region_id IS NULL OR n.region_id IS NULL OR n.value IS DISTINCT FROM o.value
""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    changes = snapshot_diff.snapshot_changes(load(spark, d, "region_snapshots"))
    return changes.select("region_id", "snap_index", key_hex("key").alias("key_hex"), "change")


def _put_stats(spark: SparkSession, d: str) -> DataFrame:
    puts = load(spark, d, "requests").filter("cmd_type = 2")
    return skew.ordered_key_stats(puts, "key", "req_no", "value", "arrived_at")


def _region_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.ordered_key_stats(load(spark, d, "raft_messages"), "region_id", "msg_no", "term", "received_at")


@query("""
SELECT 'put_key' AS field, hex(key) AS heavy_key FROM requests WHERE cmd_type = 2 AND key IS NOT NULL
GROUP BY key HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM requests WHERE cmd_type = 2)
UNION ALL
SELECT 'region_id', CAST(region_id AS VARCHAR) FROM raft_messages WHERE region_id IS NOT NULL
GROUP BY region_id HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM raft_messages)
""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    puts = load(spark, d, "requests").filter("cmd_type = 2").count()
    messages = load(spark, d, "raft_messages").count()
    keys = skew.heavy_keys(_put_stats(spark, d), "key", puts)
    regions = skew.heavy_keys(_region_stats(spark, d), "region_id", messages)
    return keys.select(F.lit("put_key").alias("field"), key_hex("key").alias("heavy_key")).unionByName(
        regions.select(F.lit("region_id").alias("field"), F.col("region_id").cast("string").alias("heavy_key"))
    )


def _stats_sql(table: str, where: str, key: str, shown: str, order: str, value: str, time: str) -> str:
    return f"""
SELECT {shown}, count(*) AS n_rows, min(o) AS first_order, max(o) AS last_order,
  CAST(sum(CASE WHEN rn > 1 AND v IS DISTINCT FROM pv THEN 1 ELSE 0 END) AS BIGINT) AS changes, max(t - pt) AS longest_pause_us
FROM (SELECT {key} AS k, {order} AS o, {value} AS v, epoch_us({time}) AS t,
    row_number() OVER w AS rn, lag({value}) OVER w AS pv, lag(epoch_us({time})) OVER w AS pt
  FROM {table} WHERE {where} AND {key} IS NOT NULL WINDOW w AS (PARTITION BY {key} ORDER BY {order})) x
GROUP BY k
"""


@query(_stats_sql("requests", "cmd_type = 2", "key", "hex(k) AS key_hex", "req_no", "value", "arrived_at"))
def p3_put_results(spark: SparkSession, d: str) -> DataFrame:
    return _put_stats(spark, d).withColumn("key", key_hex("key")).withColumnRenamed("key", "key_hex")


@query(_stats_sql("raft_messages", "true", "region_id", "k AS region_id", "msg_no", "term", "received_at"))
def p3_region_results(spark: SparkSession, d: str) -> DataFrame:
    return _region_stats(spark, d)


_COPIES = """
WITH l AS (SELECT DISTINCT cf, key, region_id, idx, value FROM copy_lsm),
b AS (SELECT DISTINCT cf, key, region_id, idx, value FROM copy_badger),
j AS (SELECT CASE WHEN l.x THEN l.cf ELSE b.cf END AS cf, hex(CASE WHEN l.x THEN l.key ELSE b.key END) AS key_hex,
  l.x IS NULL AS no_l, b.x IS NULL AS no_b, l.region_id AS lr, b.region_id AS br, l.idx AS li, b.idx AS bi, l.value AS lv, b.value AS bv
  FROM (SELECT *, true AS x FROM l) l FULL JOIN (SELECT *, true AS x FROM b) b
  ON l.cf IS NOT DISTINCT FROM b.cf AND l.key IS NOT DISTINCT FROM b.key)
"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.compare_copies(
        load(spark, d, "copy_lsm"), load(spark, d, "copy_badger"), ["cf", "key"], ["region_id", "idx", "value"], equal=False
    )


@query(f"""{_COPIES}
SELECT cf, key_hex, 'missing_lsm' AS diff FROM j WHERE no_l
UNION ALL SELECT cf, key_hex, 'missing_badger' FROM j WHERE no_b
UNION ALL SELECT cf, key_hex, 'region_id' FROM j WHERE NOT no_l AND NOT no_b AND lr IS DISTINCT FROM br
UNION ALL SELECT cf, key_hex, 'idx' FROM j WHERE NOT no_l AND NOT no_b AND li IS DISTINCT FROM bi
UNION ALL SELECT cf, key_hex, 'value' FROM j WHERE NOT no_l AND NOT no_b AND lv IS DISTINCT FROM bv
""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = copy_diff.difference_rows(_compared(spark, d), "missing_lsm", "missing_badger")
    return rows.select("cf", key_hex("key").alias("key_hex"), "diff")


@query(f"""{_COPIES}
SELECT cf, key_hex, 'region_id' AS field, CAST(lr AS VARCHAR) AS lsm_value, CAST(br AS VARCHAR) AS badger_value FROM j WHERE NOT no_l AND NOT no_b AND lr IS DISTINCT FROM br
UNION ALL SELECT cf, key_hex, 'idx', CAST(li AS VARCHAR), CAST(bi AS VARCHAR) FROM j WHERE NOT no_l AND NOT no_b AND li IS DISTINCT FROM bi
UNION ALL SELECT cf, key_hex, 'value', hex(lv), hex(bv) FROM j WHERE NOT no_l AND NOT no_b AND lv IS DISTINCT FROM bv
""")
def p4_field_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _compared(spark, d).select("cf", key_hex("key").alias("key_hex"), F.explode("differences").alias("x"))
    return rows.select(
        "cf", "key_hex", "x.field", F.col("x.left_value").alias("lsm_value"), F.col("x.right_value").alias("badger_value")
    )


#: Batches in which the change feed is applied, by time of receipt.
FEED_BATCHES = 2


@query("""
WITH t AS (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx),
e AS (SELECT DISTINCT r.region_id, r.cf, r.key, r.idx, r.pos, r.cmd_type FROM raft_log r
  JOIN t ON r.region_id = t.region_id AND r.idx = t.idx AND r.term = t.term WHERE r.cmd_type IN (2, 3) AND r.key IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY region_id, cf, key ORDER BY idx DESC, pos DESC) AS rn FROM e)
SELECT region_id, cf, hex(key) AS key_hex, idx, pos FROM w WHERE rn = 1 AND cmd_type = 2
""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    table = change_feed.rebuild(
        load(spark, d, "raft_log"), shared_path(spark, "change-feed"), slice_col="received_at", slices=FEED_BATCHES
    )
    return table.read().select("region_id", "cf", key_hex("key").alias("key_hex"), "idx", "pos")


@query("""
WITH t AS (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx),
e AS (SELECT r.region_id, r.idx, min(r.received_at) AS first_received FROM raft_log r
  JOIN t ON r.region_id = t.region_id AND r.idx = t.idx AND r.term = t.term GROUP BY r.region_id, r.idx),
m AS (SELECT region_id, commit_index, min(received_at) AS told FROM raft_messages WHERE commit_index IS NOT NULL AND received_at IS NOT NULL GROUP BY region_id, commit_index),
m2 AS (SELECT region_id, commit_index, min(told) OVER (PARTITION BY region_id ORDER BY commit_index DESC) AS told FROM m),
c AS (SELECT e.*, m2.told FROM e ASOF JOIN m2 ON e.region_id = m2.region_id AND e.idx <= m2.commit_index),
d AS (SELECT region_id, idx, greatest(first_received, told) AS due FROM c WHERE first_received IS NOT NULL),
s AS (SELECT region_id, run_id, min(started_at) AS started_at FROM apply_runs
  WHERE run_id IN (SELECT run_id FROM apply_runs WHERE status = 'succeeded') AND started_at IS NOT NULL GROUP BY region_id, run_id),
s1 AS (SELECT region_id, started_at, min(run_id) AS run_id FROM s GROUP BY region_id, started_at)
SELECT s1.run_id, d.region_id, d.idx FROM d ASOF JOIN s1 ON d.region_id = s1.region_id AND d.due <= s1.started_at
""")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.due_once(_ran(spark, d), load(spark, d, "raft_log"))


#: Waves of starting time in which the runs are replayed.
RUN_WAVES = 2


def _ran(spark: SparkSession, d: str) -> DataFrame:
    return incremental.process_runs(
        load(spark, d, "raft_log"), load(spark, d, "raft_messages"), load(spark, d, "apply_runs"), shared_path(spark, "run-state"), RUN_WAVES
    )


@query("""
WITH l AS (SELECT DISTINCT cf, key, region_id, idx, value FROM copy_lsm), b AS (SELECT DISTINCT cf, key, region_id, idx, value FROM copy_badger)
SELECT b.cf, hex(b.key) AS key_hex, CASE WHEN l.key IS NULL THEN 'new' ELSE 'changed' END AS change FROM b LEFT JOIN l ON l.cf IS NOT DISTINCT FROM b.cf AND l.key = b.key
WHERE l.key IS NULL OR l.region_id IS DISTINCT FROM b.region_id OR l.idx IS DISTINCT FROM b.idx OR l.value IS DISTINCT FROM b.value
""")
def p6_changed(spark: SparkSession, d: str) -> DataFrame:
    """What a second run has to process: the table as copy_badger holds it, after a run over what copy_lsm holds.

    (A committed entry of a log is never replaced, so p6_found alone brings nothing back as changed.)
    """
    state = incremental.IncrementalState(spark, shared_path(spark, "copy-state"), ["cf", "key"], ["region_id", "idx", "value"])
    columns = ["cf", "key", "region_id", "idx", "value"]
    state.commit(state.pending(load(spark, d, "copy_lsm").select(*columns)))
    return state.pending(load(spark, d, "copy_badger").select(*columns)).select("cf", key_hex("key").alias("key_hex"), "change")
