"""Queries over the model's operators on the driver tables, and their SQL counterparts.

``events`` is a mutation log (key ``user_id``, sequence ``event_id``, deletion where
``event_type`` is 'error') and a set of routed keys (``event_type``); ``orders`` is a
replicated log (``idx`` o_orderkey, ``term`` its hundreds); ``nation`` is voter
progress; ``lineitem`` holds write batches.

Some SQL of SURVEY asks for a few ids or every n-th row; beside each such query
stands one named ``..._all`` that does the same over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import levels, merge, mvcc, raftlog, reads, regions
from ..operators.asof import next_at_or_after
from ..session import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _deleted() -> Column:
    return F.col("deleted")


KEY, SEQ = ["user_id"], "event_id"

_NEWEST = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events"
_ROUTE = "(VALUES (1, '', 'm'), (2, 'm', 't'), (3, 't', '')) AS r(region_id, lo, hi) ON e.event_type >= r.lo AND (r.hi = '' OR e.event_type < r.hi)"
_LOG = "(SELECT o_orderkey AS idx, CAST(floor(o_orderkey / 100) AS bigint) AS term FROM orders)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The mutation log with columns of fixed size only: newest versions are then found by hashing alone."""
    return load(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("user_id", "event_id", "event_type", "value")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(
        F.lit(1).cast("bigint").alias("region_id"), F.col("o_orderkey").alias("idx"), F.floor(F.col("o_orderkey") / 100).alias("term")
    )


def _routed(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", "user_id", "event_type")
    return regions.route(e, regions.static_regions(spark), "event_type").filter("region_id IS NOT NULL")


# -- reads ------------------------------------------------------------------------
@query(f"SELECT user_id, value FROM ({_NEWEST} WHERE user_id IN (3, 7, 11, 99999)) t WHERE rn = 1 AND event_type <> 'error'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    wanted = _events(spark, d).filter(F.col("user_id").isin(3, 7, 11, 99999))
    return mvcc.latest(wanted, KEY, SEQ, _deleted()).select("user_id", "value")


@query(f"SELECT user_id, event_id, value FROM ({_NEWEST} WHERE event_id <= 8000) t WHERE rn = 1 AND event_type <> 'error'")
def kv_get_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return mvcc.latest(_events(spark, d), KEY, SEQ, _deleted(), as_of=8000).select("user_id", "event_id", "value")


_ASKED = f"""LEFT JOIN (SELECT * FROM ({_NEWEST} WHERE event_id <= 300) t WHERE rn = 1) m ON k.user_id = m.user_id"""


@query(f"SELECT k.user_id, CASE WHEN m.event_type = 'error' THEN NULL ELSE m.value END AS value FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 = 0) k {_ASKED}")
def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return mvcc.multi_get(e, e.filter("user_id % 7 = 0"), KEY, ["value"], SEQ, _deleted(), as_of=300)


@query(f"SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM ({_NEWEST}) t WHERE rn = 1")
def kv_multi_get_all(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return mvcc.multi_get(e, e, KEY, ["value"], SEQ, _deleted())


@query(f"SELECT user_id, value FROM ({_NEWEST} WHERE user_id >= 5) t WHERE rn = 1 AND event_type <> 'error'")
def kv_scan(spark: SparkSession, d: str) -> DataFrame:
    return mvcc.scan(_events(spark, d), KEY, SEQ, _deleted(), start=5).select("user_id", "value")


@query(f"SELECT user_id, value FROM ({_NEWEST} WHERE user_id >= 5) t WHERE rn = 1 AND event_type <> 'error' ORDER BY user_id LIMIT 10")
def kv_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return mvcc.scan(_events(spark, d), KEY, SEQ, _deleted(), start=5, limit=10).select("user_id", "value")


@query(f"SELECT k.user_id, CASE WHEN m.user_id IS NULL THEN 'absent' WHEN m.event_type = 'error' THEN 'deleted' ELSE 'value' END AS state FROM (SELECT DISTINCT user_id FROM events) k {_ASKED}")
def kv_lookup_state(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return mvcc.lookup(e, e, KEY, SEQ, _deleted(), as_of=300).select("user_id", "state")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1000 AS bigint) AS seq FROM lineitem WHERE l_orderkey < 50")
def kv_batch_sequence(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    ops = load(spark, d, "lineitem").select(*cols).filter("l_orderkey < 50")
    return merge.running_number(ops, cols, first=1001).select("l_orderkey", "l_linenumber", "l_partkey", "seq")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1000 AS bigint) AS seq FROM lineitem")
def kv_batch_sequence_all(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return merge.running_number(load(spark, d, "lineitem").select(*cols), cols, first=1001).select("l_orderkey", "l_linenumber", "l_partkey", "seq")


@query(f"SELECT count(*) AS hidden FROM ({_NEWEST}) t WHERE rn = 1 AND event_type = 'error'")
def kv_delete_visibility(spark: SparkSession, d: str) -> DataFrame:
    return mvcc.newest(_events(spark, d), KEY, SEQ).filter(_deleted()).agg(F.count(F.lit(1)).alias("hidden"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type >= 's' AND event_type < 't' GROUP BY event_type")
def key_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return mvcc.prefix(load(spark, d, "events").select("event_type"), "event_type", "s").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(min(event_id), 9999) AS oldest FROM events WHERE event_type = 'signup' AND event_id > 500")
def oldest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    live = load(spark, d, "events").filter("event_type = 'signup' AND event_id > 500")
    return mvcc.oldest_snapshot(live, "event_id", 9999)


@query("SELECT count(*) AS n FROM events e WHERE EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey = e.user_id AND k.c_mktsegment = 'BUILDING')")
def bloom_prune(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return mvcc.bloom_prune(load(spark, d, "events").select("user_id"), keys, "user_id", "c_custkey").agg(F.count(F.lit(1)).alias("n"))


# -- regions ------------------------------------------------------------------------
@query(f"SELECT e.event_type, CAST(r.region_id AS bigint) AS region_id, count(*) AS n FROM events e JOIN {_ROUTE} GROUP BY e.event_type, r.region_id")
def region_route(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).groupBy("event_type", "region_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT e.user_id, count(DISTINCT r.region_id) AS regions FROM events e JOIN {_ROUTE} WHERE e.event_id % 50 < 3 GROUP BY e.user_id HAVING count(DISTINCT r.region_id) > 1")
def region_batch_span_check(spark: SparkSession, d: str) -> DataFrame:
    return regions.batch_spans(_routed(spark, d).filter("event_id % 50 < 3"), "user_id")


@query(f"SELECT e.user_id, count(DISTINCT r.region_id) AS regions FROM events e JOIN {_ROUTE} GROUP BY e.user_id HAVING count(DISTINCT r.region_id) > 1")
def region_batch_span_check_all(spark: SparkSession, d: str) -> DataFrame:
    return regions.batch_spans(_routed(spark, d), "user_id")


@query(f"SELECT CAST(r.region_id AS bigint) AS region_id, e.event_id, e.event_type FROM events e JOIN {_ROUTE} WHERE r.region_id = 2 AND e.event_type >= 'p' ORDER BY e.event_type, e.event_id LIMIT 25")
def region_scan_bounded(spark: SparkSession, d: str) -> DataFrame:
    rows = mvcc.seek(_routed(spark, d).filter("region_id = 2"), "event_type", "p")
    return rows.orderBy("event_type", "event_id").limit(25).select("region_id", "event_id", "event_type")


@query(f"SELECT CAST(r.region_id AS bigint) AS region_id, count(*) AS kvs, max(e.event_id) AS snap_index FROM events e JOIN {_ROUTE} GROUP BY r.region_id")
def region_snapshot_create(spark: SparkSession, d: str) -> DataFrame:
    return regions.snapshot_summary(_routed(spark, d), "region_id", "event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type >= 'm' AND event_id > 9900 UNION ALL SELECT event_id, event_type FROM events WHERE event_type < 'm' AND event_id BETWEEN 1 AND 90")
def region_snapshot_apply(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", "event_type")
    first = F.col("event_type") < "m"
    snapshot = e.filter(first & F.col("event_id").between(1, 90))
    return regions.snapshot_replace(e.filter("event_id > 9900"), snapshot, first)


@query("""
SELECT r.req_no, m.region_id FROM requests r LEFT JOIN region_map m ON r.key >= m.start_key AND (octet_length(m.end_key) = 0 OR r.key < m.end_key)
WHERE r.cmd_type IN (1, 2, 3)
""")
def region_route_requests(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "requests").filter("cmd_type IN (1, 2, 3)").select("req_no", "key")
    return regions.route(asked, load(spark, d, "region_map"), "key").select("req_no", "region_id")


# -- merge, compaction, checks --------------------------------------------------------
@query("SELECT user_id, event_id, src FROM (SELECT user_id, event_id, 0 AS src FROM events WHERE event_id >= 6000 UNION ALL SELECT user_id, event_id, 1 FROM events WHERE event_id BETWEEN 3000 AND 5999 UNION ALL SELECT user_id, event_id, 2 FROM events WHERE event_id < 3000) t ORDER BY user_id, event_id DESC, src LIMIT 100")
def merge_iterator(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id")
    layers = [e.filter("event_id >= 6000"), e.filter("event_id BETWEEN 3000 AND 5999"), e.filter("event_id < 3000")]
    return merge.merge(layers, KEY, SEQ, limit=100)


@query("SELECT user_id, event_id, count(*) AS n FROM (SELECT user_id, event_id FROM events UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 400 = 0) t GROUP BY user_id, event_id HAVING count(*) > 1")
def duplicate_internal_key(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id")
    return merge.duplicates(e.unionByName(e.filter("event_id % 400 = 0")), ["user_id", "event_id"])


_PREV = "SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS prev FROM events"


@query(f"SELECT user_id, event_id, event_type FROM ({_PREV}) t WHERE (prev IS NULL OR prev > 8000) AND NOT (event_type = 'error' AND event_id <= 8000)")
def compaction_base_level(spark: SparkSession, d: str) -> DataFrame:
    nothing = spark.createDataFrame([], "smallest bigint, largest bigint")
    kept = levels.collect_garbage(_typed(spark, d), KEY, SEQ, "event_type", F.col("event_type") == "error", 8000, nothing, [SEQ])
    return kept.select("user_id", "event_id", "event_type")


@query(f"SELECT user_id, event_id, event_type FROM ({_PREV}) t WHERE prev IS NULL OR prev > 8000")
def compaction_keep_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return levels.collect_garbage(_typed(spark, d), KEY, SEQ, "event_type", F.col("event_type") == "error", 8000, unique=[SEQ]).select("user_id", "event_id", "event_type")


def _files(rows: DataFrame, number) -> DataFrame:
    return rows.groupBy(number.alias("fn")).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))


@query("SELECT a.fn AS source_file, b.fn AS target_file FROM (SELECT CAST(floor(event_id / 500) AS bigint) AS fn, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY CAST(floor(event_id / 500) AS bigint)) a JOIN (SELECT CAST(floor(user_id / 20) AS bigint) AS fn, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY CAST(floor(user_id / 20) AS bigint)) b ON a.lo <= b.hi AND b.lo <= a.hi")
def compaction_pick_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_id")
    return levels.overlaps(_files(e, F.floor(F.col("event_id") / 500)), _files(e, F.floor(F.col("user_id") / 20)))


@query("SELECT user_id, CAST(floor((sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n) / 1000) AS bigint) AS bucket FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) t")
def compaction_output_split(spark: SparkSession, d: str) -> DataFrame:
    sizes = load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return levels.size_buckets(sizes, "user_id", "n", 1000).select("user_id", "bucket")


@query("SELECT min(fn) AS first_at_limit FROM (SELECT fn, sum(sz) OVER (ORDER BY fn) AS cs FROM (SELECT CAST(floor(user_id / 10) AS bigint) AS fn, count(*) AS sz FROM events GROUP BY CAST(floor(user_id / 10) AS bigint)) f) t WHERE cs >= 3000")
def level_size_budget(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "events").groupBy(F.floor(F.col("user_id") / 10).alias("fn")).agg(F.count(F.lit(1)).alias("sz"))
    return levels.first_over_budget(files, "fn", "sz", 3000)


@query("SELECT count(*) AS violations FROM (SELECT lo, lag(hi) OVER (ORDER BY lo) AS ph FROM (SELECT min(user_id) AS lo, max(user_id) + (fn % 3) AS hi, fn FROM (SELECT user_id, CAST(floor(user_id / 10) AS bigint) AS fn FROM events) x GROUP BY fn) f) t WHERE ph >= lo")
def level_nonoverlap_check(spark: SparkSession, d: str) -> DataFrame:
    files = _files(load(spark, d, "events").select("user_id"), F.floor(F.col("user_id") / 10)).withColumn("hi", F.col("hi") + F.col("fn") % 3)
    return levels.overlapping_neighbours(files, "lo", "hi").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT event_id, prev FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS prev FROM events WHERE event_id % 10 <> 3) t WHERE prev IS NOT NULL AND event_id <> prev + 1")
def wal_sequence_gap(spark: SparkSession, d: str) -> DataFrame:
    return merge.sequence_gaps(load(spark, d, "events").filter("event_id % 10 <> 3"), "event_id")


@query("SELECT max(event_id) AS last_valid FROM (SELECT event_id, min(CASE WHEN event_id % 4321 = 4000 THEN 0 ELSE 1 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM events) t WHERE ok = 1")
def wal_valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    return merge.valid_prefix(load(spark, d, "events").select("event_id"), "event_id", F.col("event_id") % 4321 != 4000)


# -- replicated log -------------------------------------------------------------------
@query(f"SELECT idx, term FROM {_LOG} l WHERE idx >= 150 AND idx < 420")
def raft_load_entries(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.load_entries(_log(spark, d), 150, 420).select("idx", "term")


@query(f"SELECT count(*) AS kept, min(idx) AS first_idx FROM {_LOG} l WHERE idx >= 5000")
def raft_compact(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.compact(_log(spark, d), 5000).agg(F.count(F.lit(1)).alias("kept"), F.min("idx").alias("first_idx"))


@query(f"SELECT count(*) AS kept, max(idx) AS last_idx FROM {_LOG} l WHERE idx < 5000")
def raft_truncate_from(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.truncate_from(_log(spark, d), 5000).agg(F.count(F.lit(1)).alias("kept"), F.max("idx").alias("last_idx"))


@query(f"SELECT term, max(idx) AS last_idx FROM {_LOG} l GROUP BY term")
def raft_last_index_of_term(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.last_index_of_term(_log(spark, d), ())


@query(f"SELECT p.idx, p.term, min(q.idx) AS first_idx FROM {_LOG} p JOIN {_LOG} q ON p.term = q.term AND q.idx <= p.idx WHERE p.idx % 777 = 0 GROUP BY p.idx, p.term")
def raft_conflict_first_index(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("idx", "term")
    return raftlog.conflict_first_index(log, log.filter("idx % 777 = 0"), ())


@query(f"SELECT idx, term, min(idx) OVER (PARTITION BY term) AS first_idx FROM {_LOG} l")
def raft_conflict_first_index_all(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("idx", "term")
    return raftlog.conflict_first_index(log, log, ())


@query("SELECT g, match_idx AS commit_idx FROM (SELECT n_regionkey AS g, n_nationkey AS match_idx, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS rn, count(*) OVER (PARTITION BY n_regionkey) AS voters FROM nation) t WHERE rn = CAST(floor(voters / 2) AS bigint) + 1")
def raft_quorum_commit(spark: SparkSession, d: str) -> DataFrame:
    progress = load(spark, d, "nation").select(F.col("n_regionkey").alias("g"), "n_nationkey")
    return raftlog.quorum_commit(progress, ["g"], "n_nationkey")


@query("SELECT term, CASE WHEN g >= q THEN 'Leader' WHEN rj >= q THEN 'Follower' ELSE 'Candidate' END AS state FROM (SELECT o_custkey AS term, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS g, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS rj, CAST(floor(count(*) / 2) AS bigint) + 1 AS q FROM orders GROUP BY o_custkey) t")
def raft_vote_tally(spark: SparkSession, d: str) -> DataFrame:
    votes = load(spark, d, "orders").select(F.col("o_custkey").alias("term"), "o_orderstatus")
    return raftlog.vote_tally(votes, ["term"], F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")


@query("SELECT a.s_suppkey AS candidate, b.s_suppkey AS voter FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND NOT (b.s_nationkey > a.s_nationkey OR (b.s_nationkey = a.s_nationkey AND b.s_suppkey > a.s_suppkey)) WHERE a.s_suppkey < 10")
def raft_log_freshness(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier")
    # A candidate asks every voter: the requests of few candidates, sent to each voter of the table.
    candidates = [(r[0], r[1]) for r in s.filter("s_suppkey < 10").select("s_suppkey", "s_nationkey").collect()]
    asked = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("candidate"), F.lit(t).alias("t")) for k, t in candidates)))
    requests = s.select(F.col("s_suppkey").alias("voter"), F.col("s_nationkey").alias("mine"), asked.alias("c"))
    fresh = raftlog.log_is_fresh(F.col("mine"), F.col("voter"), F.col("c.t"), F.col("c.candidate"))
    return requests.filter((F.col("c.candidate") != F.col("voter")) & fresh).select("c.candidate", "voter")


#: Messages per bucket of the lookup of a voter's log; a bucket is one task's group at most.
MESSAGE_BUCKET = 4096


@query("""
WITH v AS (SELECT msg_no, region_id, from_node, to_node, log_term, log_index FROM raft_messages
  WHERE msg_type = 'MsgVote' AND region_id IS NOT NULL AND to_node IS NOT NULL AND log_term IS NOT NULL AND log_index IS NOT NULL),
a AS (SELECT msg_no, region_id, from_node, log_term, log_index FROM raft_messages
  WHERE msg_type = 'MsgAppResp' AND NOT reject AND log_term IS NOT NULL AND log_index IS NOT NULL),
k AS (SELECT v.msg_no, a.log_term, a.log_index, row_number() OVER (PARTITION BY v.msg_no ORDER BY a.log_term DESC, a.log_index DESC) AS rn
  FROM v JOIN a ON a.region_id = v.region_id AND a.from_node = v.to_node AND a.msg_no < v.msg_no)
SELECT v.msg_no, v.region_id, v.from_node AS candidate, v.to_node AS voter,
  NOT (coalesce(k.log_term, 0) > v.log_term OR (coalesce(k.log_term, 0) = v.log_term AND coalesce(k.log_index, 0) > v.log_index)) AS fresh
FROM v LEFT JOIN k ON k.msg_no = v.msg_no AND k.rn = 1
""")
def raft_log_freshness_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vote request against the newest entry that its voter had acknowledged before it."""
    m = load(spark, d, "raft_messages").filter("log_term IS NOT NULL AND log_index IS NOT NULL")
    asked = m.filter("msg_type = 'MsgVote' AND region_id IS NOT NULL AND to_node IS NOT NULL").select(
        "msg_no", "region_id", F.col("from_node").alias("candidate"), F.col("to_node").alias("voter"), "log_term", "log_index", (-F.col("msg_no")).alias("back")
    )
    acks = m.filter("msg_type = 'MsgAppResp' AND NOT reject").select("region_id", F.col("from_node").alias("voter"), "log_term", "log_index", (-F.col("msg_no")).alias("back"))
    newest = F.struct((-F.col("log_term")).alias("term"), (-F.col("log_index")).alias("index"))
    known = next_at_or_after(
        asked, acks, ["region_id", "voter"], "back", "back", newest, lambda c: F.floor(c / MESSAGE_BUCKET), name="mine", best_of_all=True
    )
    zero = F.lit(0).cast("bigint")
    fresh = raftlog.log_is_fresh(F.coalesce(-F.col("mine.term"), zero), F.coalesce(-F.col("mine.index"), zero), F.col("log_term"), F.col("log_index"))
    return known.select("msg_no", "region_id", "candidate", "voter", fresh.alias("fresh"))


@query("SELECT user_id AS read_id, count(DISTINCT event_type) AS acks FROM events WHERE event_id < 1500 AND event_type <> 'view' GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def read_index_quorum(spark: SparkSession, d: str) -> DataFrame:
    acks = load(spark, d, "events").filter("event_id < 1500 AND event_type <> 'view'").select(F.col("user_id").alias("read_id"), "event_type")
    return reads.acknowledged(acks, ["read_id"], "event_type", 3)


@query("SELECT user_id AS read_id, count(DISTINCT event_type) AS acks FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def read_index_quorum_all(spark: SparkSession, d: str) -> DataFrame:
    acks = load(spark, d, "events").filter("event_type <> 'view'").select(F.col("user_id").alias("read_id"), "event_type")
    return reads.acknowledged(acks, ["read_id"], "event_type", 3)


@query("SELECT r.read_id, min(e.event_id) AS served_at FROM (SELECT event_id AS read_id, event_id + 25 AS idx FROM events WHERE event_id % 1000 = 0) r JOIN events e ON e.event_id >= r.idx GROUP BY r.read_id")
def read_index_wait_apply(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id")
    asked = e.filter("event_id % 1000 = 0").select(F.col("event_id").alias("read_id"), (F.col("event_id") + 25).alias("idx"))
    return reads.wait_for_apply(asked, e, "idx", "event_id").select("read_id", "served_at")


@query("SELECT read_id, served_at FROM (SELECT event_id AS read_id, min(event_id) OVER (ORDER BY event_id RANGE BETWEEN 25 FOLLOWING AND UNBOUNDED FOLLOWING) AS served_at FROM events) t WHERE served_at IS NOT NULL")
def read_index_wait_apply_all(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id")
    asked = e.select(F.col("event_id").alias("read_id"), (F.col("event_id") + 25).alias("idx"))
    return reads.wait_for_apply(asked, e, "idx", "event_id").select("read_id", "served_at")


@query("SELECT event_id, CAST(floor(rn / 5) AS bigint) AS snap FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE user_id = 3) t WHERE rn % 5 = 0")
def snapshot_trigger(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.snapshot_triggers(load(spark, d, "events").filter("user_id = 3").select("event_id"), "event_id")


# -- the model's own tables -----------------------------------------------------------
@query("""
SELECT r.region_id, r.idx, r.term, r.pos FROM (SELECT DISTINCT region_id, idx, term, pos FROM raft_log) r
JOIN (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx) t ON r.region_id = t.region_id AND r.idx = t.idx AND r.term = t.term
""")
def raft_effective_log(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "raft_log").select("region_id", "idx", "term", "pos").distinct()
    return raftlog.highest_term(log)


@query("""
WITH c AS (SELECT region_id, max(commit_index) AS commit_index FROM raft_messages GROUP BY region_id)
SELECT DISTINCT l.region_id, l.idx FROM raft_log l JOIN c ON l.region_id = c.region_id WHERE l.idx > 0 AND l.idx <= c.commit_index
""")
def raft_committed_entries(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "raft_messages").groupBy("region_id").agg(F.max("commit_index").alias("commit_index"))
    log = load(spark, d, "raft_log").select("region_id", "idx").distinct()
    return raftlog.committed(log, known.withColumn("cursor", F.lit(0).cast("bigint")))


@query("""
WITH a AS (SELECT region_id, from_node, log_index, reject, row_number() OVER (PARTITION BY region_id, from_node ORDER BY msg_no DESC) AS rn
  FROM raft_messages WHERE msg_type = 'MsgAppResp' AND NOT reject AND log_index IS NOT NULL AND from_node IS NOT NULL),
m AS (SELECT region_id, log_index, row_number() OVER (PARTITION BY region_id ORDER BY log_index DESC) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM a WHERE rn = 1)
SELECT region_id, log_index AS commit_idx FROM m WHERE rn = CAST(floor(n / 2) AS bigint) + 1
""")
def raft_quorum_of_acks(spark: SparkSession, d: str) -> DataFrame:
    acks = load(spark, d, "raft_messages").filter("msg_type = 'MsgAppResp' AND NOT reject AND log_index IS NOT NULL AND from_node IS NOT NULL")
    newest = mvcc.newest(acks.select("region_id", "from_node", "msg_no", "log_index"), ["region_id", "from_node"], "msg_no")
    return raftlog.quorum_commit(newest, ["region_id"], "log_index")


@query("""
SELECT p.region_id, p.peer, CASE WHEN p.next_idx <= f.first_idx THEN 'snapshot' ELSE 'entries' END AS send
FROM (SELECT region_id, from_node AS peer, max(log_index) + 1 AS next_idx FROM raft_messages WHERE msg_type = 'MsgAppResp' AND NOT reject AND from_node IS NOT NULL AND log_index IS NOT NULL GROUP BY region_id, from_node) p
JOIN (SELECT region_id, min(idx) AS first_idx FROM raft_log GROUP BY region_id) f ON p.region_id = f.region_id
""")
def raft_send_choice(spark: SparkSession, d: str) -> DataFrame:
    acks = load(spark, d, "raft_messages").filter("msg_type = 'MsgAppResp' AND NOT reject AND from_node IS NOT NULL AND log_index IS NOT NULL")
    progress = acks.groupBy("region_id", F.col("from_node").alias("peer")).agg((F.max("log_index") + 1).alias("next_idx"))
    firsts = load(spark, d, "raft_log").groupBy("region_id").agg(F.min("idx").alias("first_idx"))
    return raftlog.send_choice(progress, firsts)


@query("""
WITH s AS (SELECT req_no, cf, key, cmd_type, value FROM requests WHERE cmd_type IN (2, 3) AND key IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY req_no DESC) AS rn FROM s)
SELECT cf, hex(key) AS key_hex, req_no AS seq, octet_length(value) AS value_bytes FROM n WHERE rn = 1 AND cmd_type = 2
""")
def kv_view_of_requests(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "requests").filter("cmd_type IN (2, 3) AND key IS NOT NULL").select("cf", "key", "req_no", "cmd_type", F.length("value").cast("bigint").alias("value_bytes"))
    seen = mvcc.latest(r, ["cf", "key"], "req_no", F.col("cmd_type") == 3)
    return seen.select("cf", F.hex("key").alias("key_hex"), F.col("req_no").alias("seq"), "value_bytes")
