"""Queries that run whole paths: store, log files, streams, and the log rules over the model's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import levels, merge, mvcc, raftlog, reads, regions
from ..session import load, materialise, shared_path
from ..sources import tables, wal
from ..store import Store
from ..streaming import apply

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Region of requests that name none.
NO_REGION = 0

_WRITES = "SELECT coalesce(region_id, 0) AS region_id, cf, key, req_no, cmd_type, value FROM requests WHERE cmd_type IN (2, 3) AND key IS NOT NULL"


def _writes(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "requests").filter("cmd_type IN (2, 3) AND key IS NOT NULL")
    put = F.col("cmd_type") == 2
    return r.select(
        F.coalesce("region_id", F.lit(NO_REGION)).alias("region_id"), "cf", "key", put.cast("tinyint").alias("op"),
        F.when(put, F.coalesce("value", F.lit(bytearray(b"")))).alias("value"), "req_no",
    )


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY region_id, cf, key ORDER BY req_no DESC) AS rn FROM ({_WRITES}) w)
SELECT region_id, cf, hex(key) AS key_hex, hex(coalesce(value, ''::BLOB)) AS value_hex FROM n WHERE rn = 1 AND cmd_type = 2
""")
def store_view(spark: SparkSession, d: str) -> DataFrame:
    """All writes in two batches, compacted into the last level, then read."""
    store = Store(spark, shared_path(spark, "store"), "create")
    ops = _writes(spark, d)
    middle = ops.agg(F.floor((F.min("req_no") + F.max("req_no")) / 2)).first()[0] or 0
    store.write(ops.filter(F.col("req_no") <= middle), ["req_no"])
    store.write(ops.filter(F.col("req_no") > middle), ["req_no"])
    store.compact(force=True)
    store.compact(force=True)
    return store.view().select("region_id", "cf", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query(f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY req_no) AS seq FROM ({_WRITES}) w),
k AS (SELECT *, lag(seq) OVER (PARTITION BY region_id, cf, key ORDER BY seq DESC) AS prev, (SELECT count(*) // 2 FROM s) AS snap FROM s)
SELECT region_id, cf, hex(key) AS key_hex, seq FROM k WHERE (prev IS NULL OR prev > snap) AND NOT (cmd_type = 3 AND seq <= snap)
""")
def store_versions_kept(spark: SparkSession, d: str) -> DataFrame:
    """Versions that survive a compaction into the base level while a snapshot at half of the sequences is read."""
    ops = merge.running_number(_writes(spark, d), ["req_no"])
    half = ops.count() // 2
    nothing = spark.createDataFrame([], "smallest binary, largest binary")
    kept = levels.collect_garbage(ops, ["region_id", "cf", "key"], "seq", "op", F.col("op") == 0, half, nothing)
    return kept.select("region_id", "cf", F.hex("key").alias("key_hex"), "seq")


@query("SELECT req_no AS batch_seq, CASE WHEN cmd_type = 2 THEN 1 ELSE 0 END AS op, hex(key) AS key_hex, CASE WHEN cmd_type = 2 THEN hex(coalesce(value, ''::BLOB)) END AS value_hex FROM requests WHERE cmd_type IN (2, 3) AND key IS NOT NULL")
def log_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes as checksummed log records, read back from the files."""
    folder = shared_path(spark, "log")
    ops = _writes(spark, d).select(F.col("req_no").alias("batch_seq"), F.lit(0).alias("pos"), "op", "key", "value")
    wal.write_log(ops, folder, files=max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    back = wal.read_log(spark, folder)
    return back.select("batch_seq", F.col("op").cast("int").alias("op"), F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query("SELECT hex(key) AS key_hex, req_no AS seq, CASE WHEN cmd_type = 2 THEN 1 ELSE 0 END AS op FROM requests WHERE cmd_type IN (2, 3) AND key IS NOT NULL")
def table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Writes as table files of about 2 MiB in internal order, read back from their blocks."""
    ops = _writes(spark, d).select("key", F.col("req_no").alias("seq"), "op", "value")
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 8
    split = levels.split_outputs(ops, ["key"], "seq", "op", size)
    files = materialise(tables.encode_tables(split), "tables")
    return tables.decode_tables(files.select(F.col("file_no").alias("number"), "content"), True).select(
        F.hex("key").alias("key_hex"), "seq", F.col("op").cast("int").alias("op")
    )


_HELD = """
WITH t AS (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx),
e AS (SELECT DISTINCT r.region_id, r.cf, r.key, r.idx, r.pos, r.cmd_type, r.value FROM raft_log r
  JOIN t ON r.region_id = t.region_id AND r.idx = t.idx AND r.term = t.term WHERE r.cmd_type IN (2, 3) AND r.key IS NOT NULL)
"""


@query(f"""{_HELD}, w AS (SELECT *, row_number() OVER (PARTITION BY region_id, cf, key ORDER BY idx DESC, pos DESC) AS rn FROM e)
SELECT region_id, cf, hex(key) AS key_hex, hex(coalesce(value, ''::BLOB)) AS value_hex FROM w WHERE rn = 1 AND cmd_type = 2
""")
def stream_apply_log(spark: SparkSession, d: str) -> DataFrame:
    """The effective log as a stream that is applied to a store, micro-batch by micro-batch."""
    folder = shared_path(spark, "effective-log")
    log = load(spark, d, "raft_log").select("region_id", "idx", "term", "pos", "cmd_type", "cf", "key", "value")
    held = raftlog.highest_term(log).dropDuplicates(["region_id", "idx", "pos"])
    held.write.parquet(folder)
    store = Store(spark, shared_path(spark, "applied"), "create")
    entries = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    apply.apply_stream(entries, store, shared_path(spark, "apply-checkpoint")).awaitTermination()
    return store.view().select("region_id", "cf", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query("SELECT region_id, max(idx) AS applied FROM raft_log GROUP BY region_id")
def stream_applied_watermarks(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/raft_log.parquet"
    entries = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return apply.final_updates(apply.applied_watermarks(entries), ["region_id"], shared_path(spark, "watermarks"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) t WHERE rn = 1")
def stream_latest_view(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return apply.final_updates(apply.latest_stream(events, ["user_id"], "event_id", ["value"]), ["user_id"], shared_path(spark, "latest"))


# -- rules of the log over its messages -------------------------------------------------
@query("""
WITH l AS (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx),
b AS (SELECT region_id, max(idx) AS last FROM l GROUP BY region_id), r AS (SELECT region_id, term, min(idx) AS run FROM l GROUP BY region_id, term),
q AS (SELECT msg_no, region_id, log_index, log_term FROM raft_messages WHERE msg_type = 'MsgApp' AND log_index IS NOT NULL AND log_term IS NOT NULL),
j AS (SELECT q.*, coalesce(b.last, 0) AS last, coalesce(l.term, 0) AS mine, r.run FROM q LEFT JOIN b ON q.region_id = b.region_id
  LEFT JOIN l ON q.region_id = l.region_id AND q.log_index = l.idx LEFT JOIN r ON l.region_id = r.region_id AND l.term = r.term)
SELECT msg_no, log_index > last OR mine <> log_term AS reject, CASE WHEN log_index <= last AND mine <> log_term THEN mine ELSE 0 END AS hint_term,
  CASE WHEN log_index > last THEN last + 1 WHEN mine <> log_term THEN coalesce(run, log_index) END AS hint_index FROM j
""")
def raft_append_check(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "raft_log").groupBy("region_id", "idx").agg(F.max("term").alias("term"))
    asked = load(spark, d, "raft_messages").filter("msg_type = 'MsgApp' AND log_index IS NOT NULL AND log_term IS NOT NULL")
    checked = raftlog.append_check(asked.select("msg_no", "region_id", "log_index", "log_term"), log)
    return checked.select("msg_no", "reject", F.col("hint_term").cast("bigint").alias("hint_term"), "hint_index")


@query("""
WITH s AS (SELECT DISTINCT region_id, snap_index AS idx, snap_term AS term FROM region_snapshots),
f AS (SELECT region_id, min(idx) AS first_idx, max(idx) AS commit_index FROM raft_log GROUP BY region_id)
SELECT s.region_id, s.idx, s.term, s.idx > f.first_idx AS installed, CASE WHEN s.idx > f.first_idx THEN greatest(f.commit_index, s.idx) ELSE f.commit_index END AS commit_index
FROM s JOIN f ON s.region_id = f.region_id
""")
def raft_snapshot_install(spark: SparkSession, d: str) -> DataFrame:
    snaps = load(spark, d, "region_snapshots").select("region_id", F.col("snap_index").alias("idx"), F.col("snap_term").alias("term")).distinct()
    firsts = load(spark, d, "raft_log").groupBy("region_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("commit_index"))
    return raftlog.install_snapshot(snaps, firsts)


@query("""
SELECT region_id, term, read_id, count(DISTINCT to_node) AS acks FROM raft_messages
WHERE read_id > 0 AND to_node IS NOT NULL GROUP BY region_id, term, read_id HAVING count(DISTINCT to_node) >= 1
""")
def read_index_probes(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the messages and how many nodes were asked to confirm them."""
    probes = load(spark, d, "raft_messages").filter("read_id > 0 AND to_node IS NOT NULL")
    return reads.acknowledged(probes, ["region_id", "term", "read_id"], "to_node", 1)


@query("""
WITH v AS (SELECT region_id, term, from_node, reject, row_number() OVER (PARTITION BY region_id, term, from_node ORDER BY msg_no DESC) AS rn
  FROM raft_messages WHERE msg_type = 'MsgVoteResp' AND from_node IS NOT NULL AND reject IS NOT NULL),
t AS (SELECT v.region_id, v.term, sum(CASE WHEN NOT reject THEN 1 ELSE 0 END) AS g, sum(CASE WHEN reject THEN 1 ELSE 0 END) AS r, max(len(m.peers)) AS n
  FROM v JOIN region_map m ON v.region_id = m.region_id WHERE rn = 1 GROUP BY v.region_id, v.term)
SELECT region_id, term, CASE WHEN g >= n // 2 + 1 THEN 'Leader' WHEN r >= n // 2 + 1 THEN 'Follower' ELSE 'Candidate' END AS state FROM t
""")
def raft_votes_of_messages(spark: SparkSession, d: str) -> DataFrame:
    votes = load(spark, d, "raft_messages").filter("msg_type = 'MsgVoteResp' AND from_node IS NOT NULL AND reject IS NOT NULL")
    newest = mvcc.newest(votes.select("region_id", "term", "from_node", "msg_no", "reject"), ["region_id", "term", "from_node"], "msg_no")
    members = load(spark, d, "region_map").select("region_id", F.size("peers").alias("members"))
    return raftlog.vote_tally(newest.join(members, "region_id"), ["region_id", "term"], ~F.col("reject"), F.col("reject"), F.col("members"))


_LEADER = "msg_type IN ('MsgApp', 'MsgBeat', 'MsgSnap')"


@query("""
WITH k AS (SELECT msg_no, to_node, term, max(term) OVER (PARTITION BY region_id, to_node ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM raft_messages)
SELECT msg_no, CASE WHEN to_node IS NULL OR term IS NULL THEN NULL WHEN term < known THEN 'stale' WHEN term = known THEN 'current' ELSE 'newer' END AS step FROM k
""")
def raft_step_check(spark: SparkSession, d: str) -> DataFrame:
    messages = load(spark, d, "raft_messages").select("msg_no", "region_id", "to_node", "term")
    return raftlog.step_check(messages).select("msg_no", "step")


@query(f"""
WITH h AS (SELECT msg_no, region_id, to_node, epoch_us(received_at) AS at_us FROM raft_messages WHERE {_LEADER} AND to_node IS NOT NULL),
p AS (SELECT *, at_us - max(at_us) OVER (PARTITION BY region_id, to_node ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pause_us FROM h)
SELECT msg_no, region_id, to_node, pause_us FROM p WHERE pause_us > 150000
""")
def raft_election_timeouts(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.election_timeouts(load(spark, d, "raft_messages"))


@query(f"""
WITH t AS (SELECT region_id, from_node AS node, term, max(CASE WHEN {_LEADER} THEN 1 ELSE 0 END) AS leads, max(CASE WHEN msg_type = 'MsgVote' THEN 1 ELSE 0 END) AS asks
  FROM raft_messages WHERE from_node IS NOT NULL AND term IS NOT NULL GROUP BY region_id, from_node, term),
n AS (SELECT *, row_number() OVER (PARTITION BY region_id, node ORDER BY term DESC) AS rn FROM t)
SELECT region_id, node, term, CASE WHEN leads = 1 THEN 'Leader' WHEN asks = 1 THEN 'Candidate' ELSE 'Follower' END AS role FROM n WHERE rn = 1
""")
def raft_roles(spark: SparkSession, d: str) -> DataFrame:
    return raftlog.roles(load(spark, d, "raft_messages"))


@query("""
SELECT r.region_id AS named, m.region_id AS routed, count(*) AS n FROM requests r LEFT JOIN region_map m ON r.key >= m.start_key AND (octet_length(m.end_key) = 0 OR r.key < m.end_key)
WHERE r.cmd_type IN (1, 2, 3) AND r.region_id IS DISTINCT FROM m.region_id GROUP BY r.region_id, m.region_id
""")
def region_stale_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests that name another region than the one that holds their key."""
    asked = load(spark, d, "requests").filter("cmd_type IN (1, 2, 3)").select("key", F.col("region_id").alias("named"))
    routed = regions.route(asked, load(spark, d, "region_map"), "key", "routed")
    return routed.filter(~F.col("named").eqNullSafe(F.col("routed"))).groupBy("named", "routed").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT req_no, hex(encode('data/' || region_id || '/' || cf || '/') || key) AS physical_hex FROM requests WHERE region_id IS NOT NULL AND cf IS NOT NULL AND key IS NOT NULL")
def kv_physical_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys as the flat key space stores them (read for compatibility only)."""
    r = load(spark, d, "requests").filter("region_id IS NOT NULL AND cf IS NOT NULL AND key IS NOT NULL")
    prefix = F.concat(F.lit("data/"), F.col("region_id").cast("string"), F.lit("/"), F.col("cf"), F.lit("/")).cast("binary")
    return r.select("req_no", F.hex(F.concat(prefix, F.col("key"))).alias("physical_hex"))
