"""Queries of the rules themselves over whole tables of the model: log, votes, reads, regions, requests, files, and their SQL.

Where a rule needs a state that the tables don't hold (a voter's, a follower's), it is
derived from the messages in one stated way, the same in the query and in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import dispatch, levels, merge, mvcc, raftlog, reads, regions
from ..session import load, shared_path
from ..streaming import apply

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _messages(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return load(spark, d, "raft_messages").filter(where)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """(region_id, idx, term): the entry that holds at each index."""
    return load(spark, d, "raft_log").groupBy("region_id", "idx").agg(F.max("term").alias("term"))


_L = "l AS (SELECT region_id, idx, max(term) AS term FROM raft_log GROUP BY region_id, idx)"
_ACKED = "msg_type = 'MsgAppResp' AND NOT reject AND from_node IS NOT NULL AND log_index IS NOT NULL"


# -- commit and progress -----------------------------------------------------------------
@query(f"""
WITH {_L}, p AS (SELECT region_id, from_node, max_by(log_index, msg_no) AS match_idx FROM raft_messages WHERE {_ACKED} GROUP BY region_id, from_node),
q AS (SELECT region_id, match_idx, row_number() OVER (PARTITION BY region_id ORDER BY match_idx DESC) AS rn, count(*) OVER (PARTITION BY region_id) AS n FROM p),
h AS (SELECT region_id, max(term) AS term, coalesce(max(commit_index), 0) AS commit_index FROM raft_messages WHERE region_id IS NOT NULL GROUP BY region_id)
SELECT h.region_id, CASE WHEN l.term = h.term THEN greatest(h.commit_index, q.match_idx) ELSE h.commit_index END AS commit_index
FROM h LEFT JOIN q ON q.region_id = h.region_id AND q.rn = q.n // 2 + 1 LEFT JOIN l ON l.region_id = q.region_id AND l.idx = q.match_idx
""")
def raft_advance_commit(spark: SparkSession, d: str) -> DataFrame:
    """The index that a majority has reached, taken over only if its entry has the region's current term."""
    acks = _messages(spark, d, _ACKED).select("region_id", "from_node", "msg_no", F.col("log_index").alias("match_idx"))
    progress = mvcc.newest(acks, ["region_id", "from_node"], "msg_no")
    state = _messages(spark, d, "region_id IS NOT NULL").groupBy("region_id").agg(F.max("term").alias("term"), F.coalesce(F.max("commit_index"), F.lit(0)).alias("commit_index"))
    return raftlog.advance_commit(progress, _log(spark, d), state)


_RESPONSES = "msg_type = 'MsgAppResp' AND from_node IS NOT NULL AND log_index IS NOT NULL AND region_id IS NOT NULL"


@query(f"""
WITH {_L}, a AS (SELECT *, row_number() OVER (PARTITION BY region_id, from_node ORDER BY msg_no DESC) AS rn FROM raft_messages WHERE {_RESPONSES}),
e AS (SELECT region_id, max(idx) AS last_idx FROM l GROUP BY region_id), t AS (SELECT region_id, term, max(idx) AS last FROM l GROUP BY region_id, term),
r AS (SELECT a.region_id, a.from_node AS peer, a.reject, a.log_index, a.log_term, t.last AS conflict_last, e.last_idx FROM a
  LEFT JOIN e ON e.region_id = a.region_id LEFT JOIN t ON t.region_id = a.region_id AND t.term = a.log_term WHERE rn = 1),
n AS (SELECT *, CASE WHEN reject THEN CASE WHEN coalesce(log_term, 0) = 0 THEN greatest(log_index, 1) ELSE coalesce(conflict_last + 1, log_index) END
  ELSE least(log_index + 1, last_idx + 1) END AS next_idx FROM r)
SELECT region_id, peer, least(CASE WHEN reject THEN 0 ELSE log_index END, next_idx - 1) AS match_idx, next_idx FROM n
""")
def raft_update_progress(spark: SparkSession, d: str) -> DataFrame:
    """Match and next index of every peer after its newest response, backing off where it refused."""
    log = _log(spark, d)
    acks = _messages(spark, d, _RESPONSES).join(raftlog.last_index_of_term(log).withColumnRenamed("term", "log_term"), ["region_id", "log_term"], "left").select(
        "region_id", F.col("from_node").alias("peer"), "msg_no", "reject", "log_index", "log_term", F.col("last_idx").alias("conflict_last")
    )
    zero = F.lit(0).cast("bigint")
    progress = acks.select("region_id", "peer").distinct().withColumns({"match_idx": zero, "next_idx": zero + 1})
    return raftlog.update_progress(progress, acks, log.groupBy("region_id").agg(F.max("idx").alias("last_idx")), "msg_no")


# -- votes ---------------------------------------------------------------------------------
_VOTERS = """
k AS (SELECT region_id, to_node AS node, max(term) AS current_term FROM raft_messages WHERE to_node IS NOT NULL AND region_id IS NOT NULL AND msg_type <> 'MsgVote' GROUP BY region_id, to_node),
g AS (SELECT region_id, from_node AS node, max(log_term) AS last_term, max(log_index) AS last_index FROM raft_messages
  WHERE msg_type = 'MsgAppResp' AND NOT reject AND from_node IS NOT NULL AND region_id IS NOT NULL GROUP BY region_id, from_node),
d AS (SELECT region_id, to_node AS node, term, min_by(from_node, msg_no) AS vote FROM raft_messages WHERE msg_type = 'MsgVote' AND to_node IS NOT NULL AND from_node IS NOT NULL GROUP BY region_id, to_node, term),
v AS (SELECT k.region_id, k.node, k.current_term, coalesce(d.vote, 0) AS vote, coalesce(g.last_term, 0) AS last_term, coalesce(g.last_index, 0) AS last_index
  FROM k LEFT JOIN g ON g.region_id = k.region_id AND g.node = k.node LEFT JOIN d ON d.region_id = k.region_id AND d.node = k.node AND d.term = k.current_term)
"""


@query(f"""
WITH {_VOTERS}
SELECT m.msg_no, m.region_id, m.from_node, m.to_node, v.current_term <= m.term AND (v.vote = 0 OR v.vote = m.from_node OR m.term > v.current_term)
  AND NOT (v.last_term > m.log_term OR (v.last_term = m.log_term AND v.last_index > m.log_index)) AS granted
FROM raft_messages m JOIN v ON v.region_id = m.region_id AND v.node = m.to_node
WHERE m.msg_type = 'MsgVote' AND m.from_node IS NOT NULL AND m.term IS NOT NULL AND m.log_term IS NOT NULL AND m.log_index IS NOT NULL
""")
def raft_votes_granted(spark: SparkSession, d: str) -> DataFrame:
    """Vote requests judged by what their voters know in the end: term, vote of that term, last entry acknowledged."""
    known = _messages(spark, d, "to_node IS NOT NULL AND region_id IS NOT NULL AND msg_type <> 'MsgVote'").groupBy("region_id", F.col("to_node").alias("node")).agg(F.max("term").alias("current_term"))
    last = _messages(spark, d, "msg_type = 'MsgAppResp' AND NOT reject AND from_node IS NOT NULL AND region_id IS NOT NULL").groupBy("region_id", F.col("from_node").alias("node")).agg(
        F.max("log_term").alias("last_term"), F.max("log_index").alias("last_index")
    )
    asked = _messages(spark, d, "msg_type = 'MsgVote' AND from_node IS NOT NULL")
    voted = asked.filter("to_node IS NOT NULL").groupBy("region_id", F.col("to_node").alias("node"), F.col("term").alias("current_term")).agg(F.min_by("from_node", "msg_no").alias("vote"))
    voters = known.join(last, ["region_id", "node"], "left").join(voted, ["region_id", "node", "current_term"], "left").na.fill(0, ["vote", "last_term", "last_index"])
    requests = asked.filter("term IS NOT NULL AND log_term IS NOT NULL AND log_index IS NOT NULL").select("msg_no", "region_id", "from_node", "to_node", "term", "log_term", "log_index")
    return raftlog.votes_granted(requests, voters).select("msg_no", "region_id", "from_node", "to_node", "granted")


_VOTES = "msg_type = 'MsgVoteResp' AND from_node IS NOT NULL AND reject IS NOT NULL AND term IS NOT NULL"


@query(f"""
WITH r AS (SELECT region_id, term, msg_no, from_node, CASE WHEN reject THEN 0 ELSE 1 END AS g FROM raft_messages WHERE {_VOTES}),
x AS (SELECT *, g - coalesce(lag(g) OVER w, 0) AS dg, (1 - g) - coalesce(lag(1 - g) OVER w, 0) AS dr FROM r WINDOW w AS (PARTITION BY region_id, term, from_node ORDER BY msg_no)),
s AS (SELECT region_id, term, msg_no, sum(dg) OVER w AS gs, sum(dr) OVER w AS rs FROM x WINDOW w AS (PARTITION BY region_id, term ORDER BY msg_no)),
j AS (SELECT s.*, len(m.peers) // 2 + 1 AS q FROM s JOIN region_map m ON m.region_id = s.region_id),
c AS (SELECT region_id, term, msg_no, CASE WHEN gs >= q THEN 'Leader' WHEN rs >= q THEN 'Follower' END AS state FROM j)
SELECT region_id, term, coalesce(arg_min(state, msg_no) FILTER (WHERE state IS NOT NULL), 'Candidate') AS state FROM c GROUP BY region_id, term
""")
def raft_elections(spark: SparkSession, d: str) -> DataFrame:
    """Elections decided as responses came in, the first decision holding."""
    members = load(spark, d, "region_map").select("region_id", F.size("peers").alias("members"))
    return raftlog.election(_messages(spark, d, _VOTES).select("region_id", "term", "msg_no", "from_node", "reject"), members, "msg_no")


@query("""
WITH h AS (SELECT msg_no, region_id, to_node, epoch_us(received_at) AS at_us FROM raft_messages WHERE msg_type IN ('MsgApp', 'MsgBeat', 'MsgSnap') AND to_node IS NOT NULL),
p AS (SELECT *, at_us - max(at_us) OVER (PARTITION BY region_id, to_node ORDER BY msg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pause_us FROM h)
SELECT msg_no, region_id, to_node, pause_us FROM p WHERE pause_us > 150000 + (region_id * 7 + to_node) % 15 * 10000
""")
def raft_drawn_timeouts(spark: SparkSession, d: str) -> DataFrame:
    """Pauses longer than the timeout that each node has drawn."""
    return raftlog.election_timeouts(load(spark, d, "raft_messages"), raftlog.election_timeout_us(F.col("region_id") * 7 + F.col("to_node")))


_LEADS = "msg_type IN ('MsgApp', 'MsgBeat', 'MsgSnap')"


@query(f"""
WITH t AS (SELECT region_id, from_node AS node, term, max(CASE WHEN {_LEADS} THEN 1 ELSE 0 END) AS leads, max(CASE WHEN msg_type = 'MsgVote' THEN 1 ELSE 0 END) AS asks
  FROM raft_messages WHERE from_node IS NOT NULL AND term IS NOT NULL GROUP BY region_id, from_node, term),
r AS (SELECT region_id, node, CASE WHEN leads = 1 THEN 'Leader' WHEN asks = 1 THEN 'Candidate' ELSE 'Follower' END AS role FROM t QUALIFY row_number() OVER (PARTITION BY region_id, node ORDER BY term DESC) = 1),
m AS (SELECT m.msg_type, coalesce(r.role, 'Follower') AS role FROM raft_messages m LEFT JOIN r ON r.region_id = m.region_id AND r.node = m.to_node WHERE m.to_node IS NOT NULL)
SELECT role, msg_type, CASE WHEN msg_type = 'MsgVote' THEN 'vote' WHEN msg_type = 'MsgVoteResp' AND role = 'Candidate' THEN 'tally'
  WHEN role = 'Leader' AND msg_type IN ('MsgAppResp', 'MsgSnapResp') THEN 'progress' WHEN role = 'Leader' AND msg_type = 'MsgBeatResp' THEN 'confirm read'
  WHEN role <> 'Leader' AND msg_type = 'MsgApp' THEN 'append' WHEN role <> 'Leader' AND msg_type = 'MsgBeat' THEN 'follow' WHEN role <> 'Leader' AND msg_type = 'MsgSnap' THEN 'install' ELSE 'ignore' END AS action,
  CASE WHEN msg_type IN ('MsgHup', 'MsgTick', 'MsgPropose') THEN 'local' WHEN msg_type LIKE '%Resp' THEN 'response' ELSE 'request' END AS kind, count(*) AS n
FROM m GROUP BY ALL
""")
def raft_actions(spark: SparkSession, d: str) -> DataFrame:
    """What receivers do with their messages, by their role."""
    m = load(spark, d, "raft_messages")
    role = raftlog.roles(m).select("region_id", F.col("node").alias("to_node"), "role")
    got = m.filter("to_node IS NOT NULL").join(role, ["region_id", "to_node"], "left").withColumn("role", F.coalesce("role", F.lit("Follower")))
    return got.groupBy("role", "msg_type", raftlog.action(F.col("role"), F.col("msg_type")).alias("action"), raftlog.classify(F.col("msg_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT msg_type, CASE WHEN to_node IS NULL OR received_at IS NULL THEN 'no receiver' WHEN epoch_us(received_at) - epoch_us(sent_at) > 100000 THEN 'late' ELSE 'delivered' END AS delivery, count(*) AS n
FROM raft_messages GROUP BY ALL
""")
def raft_delivery(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "raft_messages")
    return m.groupBy("msg_type", raftlog.delivery(F.col("sent_at"), F.col("received_at"), F.col("to_node")).alias("delivery")).agg(F.count(F.lit(1)).alias("n"))


# -- the log ---------------------------------------------------------------------------------
_EARLY = "o AS (SELECT region_id, idx, min(term) AS term FROM raft_log WHERE received_at < (SELECT min(received_at) + (max(received_at) - min(received_at)) / 2 FROM raft_log) GROUP BY region_id, idx)"


@query(f"""
WITH {_L}, {_EARLY}, c AS (SELECT o.region_id, min(o.idx) AS cut FROM o JOIN l ON l.region_id = o.region_id AND l.idx = o.idx AND l.term <> o.term GROUP BY o.region_id),
k AS (SELECT o.* FROM o LEFT JOIN c ON c.region_id = o.region_id WHERE c.cut IS NULL OR o.idx < c.cut)
SELECT region_id, idx, term FROM k UNION ALL SELECT l.region_id, l.idx, l.term FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.region_id = l.region_id AND k.idx = l.idx)
""")
def raft_append_entries(spark: SparkSession, d: str) -> DataFrame:
    """Followers' logs of the first half (lowest terms) after the entries that hold in the end are taken over."""
    return raftlog.LogStorage(_early(spark, d)).append(_log(spark, d)).rows.select("region_id", "idx", "term")


def _early(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "raft_log")
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    low, high = log.agg(F.min(at), F.max(at)).first()
    return log.filter(at < F.lit(((low or 0) + (high or 0) + 1) // 2)).groupBy("region_id", "idx").agg(F.min("term").alias("term"))


@query(f"""
WITH {_L} SELECT region_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS entries FROM l WHERE idx >= 20 AND idx < 1000000 GROUP BY region_id
""")
def raft_log_storage(spark: SparkSession, d: str) -> DataFrame:
    """Logs compacted up to index 20 and loaded from there."""
    storage = raftlog.LogStorage(_log(spark, d)).compact(20)
    held = storage.entries(20, 1_000_000).groupBy("region_id").agg(F.count(F.lit(1)).alias("entries"))
    return storage.bounds().join(held, "region_id").select("region_id", "first_idx", "last_idx", "entries")


@query("""
WITH n AS (SELECT region_id, max_by(term, msg_no) AS term, coalesce(max_by(from_node, msg_no), 0) AS vote, coalesce(max_by(commit_index, msg_no), 0) AS commit_index
  FROM (SELECT region_id, msg_no, term, coalesce(from_node, 0) AS from_node, coalesce(commit_index, 0) AS commit_index FROM raft_messages WHERE region_id IS NOT NULL AND term IS NOT NULL) GROUP BY region_id)
SELECT region_id, term, vote, commit_index, printf('%016X%016X%016X', term, vote, commit_index) AS state_hex FROM n
""")
def raft_hard_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest state of each region, saved in two steps, encoded and read back."""
    zero = F.lit(0).cast("bigint")
    m = _messages(spark, d, "region_id IS NOT NULL AND term IS NOT NULL").select(
        "region_id", "msg_no", "term", F.coalesce("from_node", zero).alias("vote"), F.coalesce("commit_index", zero).alias("commit_index")
    )
    middle = m.agg(F.floor((F.min("msg_no") + F.max("msg_no")) / 2)).first()[0] or 0
    storage = raftlog.LogStorage(_log(spark, d)).save(m.filter(F.col("msg_no") <= middle), "msg_no").save(m.filter(F.col("msg_no") > middle), "msg_no")
    saved = storage.hard_states.select("region_id", F.concat(*(exprs.index_key(F.col(c)) for c in ("term", "vote", "commit_index"))).alias("raw"))
    back = [exprs.index_of_key(F.substring("raw", 8 * i + 1, 8)).alias(c) for i, c in enumerate(("term", "vote", "commit_index"))]
    return saved.select("region_id", *back, F.hex("raw").alias("state_hex"))


@query(f"""
WITH {_L}, a AS (SELECT region_id, max(commit_index) AS applied FROM raft_messages GROUP BY region_id), p AS (SELECT DISTINCT region_id, idx, term FROM raft_log)
SELECT p.region_id, p.idx, p.term, CASE WHEN coalesce(a.applied, 0) < p.idx THEN 'waiting' WHEN l.term = p.term THEN 'done' ELSE 'superseded' END AS outcome
FROM p LEFT JOIN l ON l.region_id = p.region_id AND l.idx = p.idx LEFT JOIN a ON a.region_id = p.region_id
""")
def raft_proposals(spark: SparkSession, d: str) -> DataFrame:
    """What became of every entry that was ever proposed."""
    applied = load(spark, d, "raft_messages").groupBy("region_id").agg(F.max("commit_index").alias("applied"))
    return raftlog.proposal_results(load(spark, d, "raft_log").select("region_id", "idx", "term").distinct(), _log(spark, d), applied)


@query(f"""
WITH {_L}, s AS (SELECT region_id, max(snap_index) AS snap FROM region_snapshots GROUP BY region_id), c AS (SELECT region_id, max(commit_index) AS c FROM raft_messages WHERE commit_index IS NOT NULL GROUP BY region_id)
SELECT l.region_id, l.idx, l.term FROM l JOIN c ON c.region_id = l.region_id LEFT JOIN s ON s.region_id = l.region_id WHERE l.idx > coalesce(s.snap, 0) AND l.idx <= c.c
""")
def raft_restore(spark: SparkSession, d: str) -> DataFrame:
    """Entries that restarted nodes apply after their newest snapshot."""
    saved = _messages(spark, d, "commit_index IS NOT NULL").groupBy("region_id").agg(F.max("commit_index").alias("commit_index"))
    return raftlog.restore(load(spark, d, "region_snapshots").select("region_id", "snap_index"), saved, _log(spark, d))


@query("SELECT DISTINCT region_id, idx, printf('%016X', idx) AS key_hex FROM raft_log WHERE idx >= 0")
def raft_index_keys(spark: SparkSession, d: str) -> DataFrame:
    """Log indexes as big-endian keys, and back."""
    raw = load(spark, d, "raft_log").filter("idx >= 0").select("region_id", exprs.index_key(F.col("idx")).alias("raw")).distinct()
    return raw.select("region_id", exprs.index_of_key(F.col("raw")).alias("idx"), F.hex("raw").alias("key_hex"))


@query("SELECT region_id, count(DISTINCT idx) AS applied, count(DISTINCT idx) // 5 AS due FROM raft_log WHERE region_id IS NOT NULL GROUP BY region_id")
def stream_due_snapshots(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/raft_log.parquet"
    entries = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    words = apply.final_updates(apply.applied_words(entries), ["region_id", "word"], shared_path(spark, "applied-words"))
    return apply.due_snapshots(words)


# -- reads -------------------------------------------------------------------------------------
_BEATS = "msg_type = 'MsgBeat' AND read_id > 0 AND from_node IS NOT NULL AND region_id IS NOT NULL AND commit_index IS NOT NULL"
_CONFIRMED = f"""
{_L}, r AS (SELECT DISTINCT m.region_id, m.read_id, m.term, m.from_node AS leader, m.commit_index FROM raft_messages m WHERE {_BEATS}),
v AS (SELECT r.region_id, r.read_id, r.term, count(DISTINCT CASE WHEN list_contains(g.peers, a.to_node) AND a.to_node <> r.leader THEN a.to_node END) AS n,
    max(CASE WHEN list_contains(g.peers, r.leader) THEN 1 ELSE 0 END) AS self, max(len(g.peers)) AS members
  FROM r JOIN l ON l.region_id = r.region_id AND l.idx = r.commit_index AND l.term <= r.term JOIN region_map g ON g.region_id = r.region_id
  LEFT JOIN (SELECT region_id, read_id, term, to_node FROM raft_messages WHERE to_node IS NOT NULL) a ON a.region_id = r.region_id AND a.read_id = r.read_id AND a.term = r.term GROUP BY r.region_id, r.read_id, r.term),
q AS (SELECT region_id, read_id, term, n + self AS acks FROM v WHERE n + self >= members // 2 + 1)
"""


def _confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Reads confirmed by the nodes that their probes reached; the leader's commit must hold an entry of a term it may have."""
    log = _log(spark, d).select("region_id", F.col("idx").alias("commit_index"), F.col("term").alias("__t"))
    asked = _messages(spark, d, _BEATS).select("region_id", "read_id", "term", F.col("from_node").alias("leader"), "commit_index").distinct()
    begun = asked.join(log, ["region_id", "commit_index"]).withColumn("committed_term", F.when(F.col("__t") <= F.col("term"), F.col("term")))
    acks = _messages(spark, d, "to_node IS NOT NULL").select("region_id", "read_id", "term", F.col("to_node").alias("from_node"))
    return reads.read_index_quorum(begun.select("region_id", "read_id", "term", "leader", "committed_term"), acks, load(spark, d, "region_map"))


@query(f"WITH {_CONFIRMED} SELECT region_id, read_id, term, acks FROM q")
def read_index_confirmed(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a quorum of current voters of their term confirms, the leader among them."""
    return _confirmed(spark, d)


@query(f"""
WITH {_CONFIRMED}, a AS (SELECT region_id, max(idx) AS applied FROM l GROUP BY region_id),
f AS (SELECT region_id, max(term) AS term FROM raft_messages GROUP BY region_id),
e AS (SELECT region_id, read_id, min(commit_index) AS read_idx, min(term) AS term FROM r GROUP BY region_id, read_id)
SELECT e.region_id, e.read_id, e.read_idx, CASE WHEN e.term < f.term THEN 'not leader' WHEN e.read_id % 10 = 3 THEN 'cancelled'
  WHEN NOT EXISTS (SELECT 1 FROM q WHERE q.region_id = e.region_id AND q.read_id = e.read_id) THEN 'unconfirmed'
  WHEN coalesce(a.applied, 0) < e.read_idx THEN 'waiting' ELSE 'served' END AS state
FROM e JOIN f ON f.region_id = e.region_id LEFT JOIN a ON a.region_id = e.region_id
""")
def read_index_states(spark: SparkSession, d: str) -> DataFrame:
    """What became of every read: a leader of an older term lost it, every tenth caller or so gave up."""
    top = load(spark, d, "raft_messages").groupBy("region_id").agg(F.max("term").alias("__top"))
    asked = _messages(spark, d, _BEATS).groupBy("region_id", "read_id").agg(F.min("commit_index").alias("read_idx"), F.min("term").alias("term"))
    asked = asked.join(top, "region_id").select("region_id", "read_id", "read_idx", (F.col("term") >= F.col("__top")).alias("leads"))
    applied = _log(spark, d).groupBy("region_id").agg(F.max("idx").alias("applied"))
    return reads.lifecycle(asked, _confirmed(spark, d), applied, asked.filter("read_id % 10 = 3")).drop("leads")


# -- regions and requests ------------------------------------------------------------------------
@query("""
WITH r AS (SELECT region_id, start_key, end_key, peers FROM region_map UNION ALL SELECT region_id, start_key, end_key, CAST([] AS BIGINT[]) FROM region_map WHERE region_id < 3
  UNION ALL SELECT CASE WHEN region_id = 4 THEN 0 END, start_key, end_key, peers FROM region_map WHERE region_id IN (4, 5))
SELECT region_id, CASE WHEN region_id IS NULL OR region_id = 0 THEN 'no id' END AS problem FROM r WHERE region_id IS NULL OR region_id = 0
UNION ALL SELECT region_id, 'no peer' FROM r WHERE len(peers) < 1 UNION ALL SELECT region_id, 'id twice' FROM r WHERE region_id IS NOT NULL GROUP BY region_id HAVING count(*) > 1
""")
def region_problems(spark: SparkSession, d: str) -> DataFrame:
    """The map of regions with some spoilt copies added."""
    r = load(spark, d, "region_map").select("region_id", "start_key", "end_key", "peers")
    lonely = r.filter("region_id < 3").withColumn("peers", F.array().cast("array<bigint>"))
    nameless = r.filter("region_id IN (4, 5)").withColumn("region_id", F.when(F.col("region_id") == 4, F.lit(0).cast("bigint")))
    return regions.problems(r.unionByName(lonely).unionByName(nameless))


@query("""
WITH r AS (SELECT region_id FROM region_map WHERE region_id NOT IN (2, 3)), n AS (SELECT CAST(900000001 AS BIGINT) AS region_id UNION ALL SELECT 2)
SELECT count(*) AS regions, CAST(sum(region_id) AS BIGINT) AS ids FROM (SELECT * FROM r UNION ALL SELECT * FROM n)
""")
def region_edits(spark: SparkSession, d: str) -> DataFrame:
    """Regions 2 and 3 removed, then 2 put back with the range of both but for its end, and one more with the rest."""
    table = load(spark, d, "region_map").select("region_id", "start_key", "end_key", "peers")
    gone = table.filter("region_id IN (2, 3)")
    left = regions.remove_regions(table, gone)
    more = gone.withColumn("region_id", F.when(F.col("region_id") == 3, F.lit(900_000_001).cast("bigint")).otherwise(F.col("region_id")))
    return regions.add_regions(left, more).agg(F.count(F.lit(1)).alias("regions"), F.sum("region_id").alias("ids"))


@query("SELECT region_id, CASE WHEN octet_length(start_key) = 0 THEN '-inf' ELSE hex(start_key) END AS low, CASE WHEN octet_length(end_key) = 0 THEN '+inf' ELSE hex(end_key) END AS high FROM region_map")
def region_bounds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "region_map").select("region_id", exprs.bound_text(F.col("start_key")).alias("low"), exprs.bound_text(F.col("end_key"), True).alias("high"))


@query("""
WITH x AS (SELECT region_id, snap_index, key, any_value(value) AS value FROM region_snapshots WHERE key IS NOT NULL GROUP BY region_id, snap_index, key),
b AS (SELECT region_id, min(snap_index) AS a, max(snap_index) AS z FROM region_snapshots GROUP BY region_id),
o AS (SELECT x.region_id, x.key FROM x JOIN b ON b.region_id = x.region_id AND x.snap_index = b.a), n AS (SELECT x.region_id, x.key, x.value FROM x JOIN b ON b.region_id = x.region_id AND x.snap_index = b.z)
SELECT region_id, hex(key) AS key_hex, 1 AS op, hex(value) AS value_hex FROM n WHERE region_id = (SELECT max(region_id) FROM b)
UNION ALL SELECT region_id, hex(key), 0, NULL FROM o WHERE region_id = (SELECT max(region_id) FROM b) AND NOT EXISTS (SELECT 1 FROM n WHERE n.region_id = o.region_id AND n.key = o.key)
""")
def region_snapshot_mutations(spark: SparkSession, d: str) -> DataFrame:
    """The batch that brings the last region from its first snapshot to its last: tombstones and puts."""
    s = load(spark, d, "region_snapshots")
    last = s.agg(F.max("region_id")).first()[0] or 0
    mine = s.filter(F.col("region_id") == last)
    a, z = mine.agg(F.min("snap_index"), F.max("snap_index")).first()
    pairs = mine.filter("key IS NOT NULL").select("region_id", F.lit("default").alias("cf"), "key", "value", "snap_index").dropDuplicates(["snap_index", "key"])
    out = regions.snapshot_mutations(pairs.filter(F.col("snap_index") == a), pairs.filter(F.col("snap_index") == z).select("cf", "key", "value"), last, 1)
    return out.select("region_id", F.hex("key").alias("key_hex"), F.col("op").cast("int").alias("op"), F.hex("value").alias("value_hex"))


@query("SELECT req_no, hex(CASE WHEN cmd_type = 4 THEN start_key WHEN cmd_type IN (1, 2, 3) THEN key END) AS key_hex FROM requests")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key by which each command is routed."""
    r = load(spark, d, "requests")
    return r.select("req_no", F.hex(dispatch.request_key(F.col("cmd_type"), F.col("key"), F.col("start_key"))).alias("key_hex"))


@query("""
WITH c AS (SELECT batch_id, cmd_type, cf, key, value, start_key, scan_limit, min(req_no) AS req_no, CASE cmd_type WHEN 4 THEN start_key WHEN 1 THEN key WHEN 2 THEN key WHEN 3 THEN key END AS k FROM requests WHERE batch_id IS NOT NULL GROUP BY ALL),
r AS (SELECT c.*, m.region_id AS region FROM c LEFT JOIN region_map m ON c.k >= m.start_key AND (octet_length(m.end_key) = 0 OR c.k < m.end_key)),
p AS (SELECT batch_id, arg_min(cmd_type, req_no) AS first, arg_min(k IS NULL, req_no) AS nokey, min(region) FILTER (WHERE region IS NOT NULL) AS low, max(region) AS high, count(*) AS n,
  min(req_no) AS at, sum(CASE WHEN cmd_type IN (2, 3) THEN 0 ELSE 1 END) AS others, max(CASE WHEN k IS NULL OR (cmd_type = 2 AND value IS NULL) THEN 1 ELSE 0 END) AS lacking,
  max(CASE WHEN region IS NULL AND k IS NOT NULL THEN 1 ELSE 0 END) AS outside FROM r GROUP BY batch_id),
f AS (SELECT p.*, r.region AS region_id FROM p JOIN r ON r.batch_id = p.batch_id AND r.req_no = p.at),
j AS (SELECT *, CASE WHEN nokey THEN 'a command lacks its key' WHEN region_id IS NULL THEN 'no region holds the key' WHEN first NOT IN (1, 2, 3, 4) THEN 'unknown command'
  WHEN first IN (1, 4) AND n > 1 THEN 'a read is a request of its own' WHEN first IN (2, 3) AND others > 0 THEN 'a batch holds puts and deletes only'
  WHEN first IN (2, 3) AND lacking = 1 THEN 'a command lacks its key or value' WHEN first IN (2, 3) AND (low <> high OR outside = 1) THEN 'a batch must stay in one region' END AS error FROM f)
SELECT j.batch_id, CASE WHEN j.error IS NULL THEN j.n ELSE 0 END AS results, j.error, j.region_id, hex(m.start_key) AS start_hex, hex(m.end_key) AS end_hex, m.leader FROM j LEFT JOIN region_map m ON m.region_id = j.region_id
""")
def request_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every request dispatched: its number of results or its error, and the region with bounds and leader."""
    a = dispatch.answers(load(spark, d, "requests"), load(spark, d, "region_map"))
    return a.select("batch_id", "results", "error", "region_id", F.hex("start_key").alias("start_hex"), F.hex("end_key").alias("end_hex"), "leader")


@query("""
WITH m AS (SELECT r.req_no, r.region_id, g.region_id AS routed, g.leader, r.node_id FROM requests r LEFT JOIN region_map g ON CASE WHEN r.cmd_type = 4 THEN r.start_key WHEN r.cmd_type IN (1, 2, 3) THEN r.key END >= g.start_key
  AND (octet_length(g.end_key) = 0 OR CASE WHEN r.cmd_type = 4 THEN r.start_key WHEN r.cmd_type IN (1, 2, 3) THEN r.key END < g.end_key))
SELECT coalesce(leader, 0) <> 0 OR node_id IS DISTINCT FROM leader AS retryable, count(*) AS n FROM m GROUP BY 1
""")
def request_retries(spark: SparkSession, d: str) -> DataFrame:
    """How many requests another node may answer better, if one that doesn't lead refuses."""
    r = load(spark, d, "requests").withColumn("k", dispatch.request_key(F.col("cmd_type"), F.col("key"), F.col("start_key"))).select("req_no", "k", "node_id")
    leaders = load(spark, d, "region_map").select(F.col("region_id").alias("routed"), "leader")
    routed = regions.route(r, load(spark, d, "region_map"), "k", "routed").join(leaders, "routed", "left")
    error = F.when(~F.col("node_id").eqNullSafe(F.col("leader")), "not leader")
    return routed.groupBy(dispatch.retryable(F.col("leader"), error).alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT req_no, hex(key) AS key_hex FROM requests WHERE region_id IS NOT NULL AND cf IS NOT NULL AND key IS NOT NULL")
def kv_user_keys(spark: SparkSession, d: str) -> DataFrame:
    """Physical keys taken apart again."""
    r = load(spark, d, "requests").filter("region_id IS NOT NULL AND cf IS NOT NULL AND key IS NOT NULL")
    raw = r.select("req_no", "region_id", "cf", exprs.physical_key(F.col("region_id"), F.col("cf"), F.col("key")).alias("raw"))
    return raw.select("req_no", F.hex(exprs.user_key(F.col("raw"), F.col("region_id"), F.col("cf"))).alias("key_hex"))


# -- merge, levels, files --------------------------------------------------------------------------
@query("SELECT user_id, event_id, CASE WHEN event_id >= 6000 THEN 0 WHEN event_id >= 3000 THEN 1 ELSE 2 END AS src, row_number() OVER (ORDER BY user_id, event_id DESC) AS place FROM events")
def merge_iterator_all(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the merge with its place in it."""
    e = load(spark, d, "events").select("user_id", "event_id")
    layers = [e.filter("event_id >= 6000"), e.filter("event_id BETWEEN 3000 AND 5999"), e.filter("event_id < 3000")]
    merged = merge.merge(layers, ["user_id"], "event_id")
    return merge.running_number(merged, [F.col("user_id"), F.col("event_id").desc()], name="place")


@query("""
WITH u AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT user_id, event_id, CAST(rn // 5 AS BIGINT) AS snap FROM u WHERE rn % 5 = 0
""")
def snapshot_trigger_all(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth applied entry of every user."""
    return raftlog.snapshot_triggers(load(spark, d, "events").select("user_id", "event_id"), "event_id", group_col="user_id")


@query("SELECT req_no, prev FROM (SELECT req_no, lag(req_no) OVER (ORDER BY req_no) AS prev FROM (SELECT DISTINCT req_no FROM requests WHERE cmd_type IN (2, 3) AND key IS NOT NULL)) t WHERE prev IS NOT NULL AND req_no <> prev + 1")
def wal_sequence_gap_all(spark: SparkSession, d: str) -> DataFrame:
    """Where the numbers of writes leave others out."""
    return merge.sequence_gaps(load(spark, d, "requests").filter("cmd_type IN (2, 3) AND key IS NOT NULL"), "req_no")


_LOWER = "f AS (SELECT min(user_id) AS lo, max(user_id) AS hi FROM events WHERE user_id % 10 < 4 GROUP BY user_id // 10)"


@query(f"""
WITH {_LOWER}, v AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS prev FROM events),
c AS (SELECT v.*, f.lo IS NOT NULL AS covered FROM v LEFT JOIN f ON v.user_id BETWEEN f.lo AND f.hi)
SELECT user_id, event_id, event_type FROM c WHERE (prev IS NULL OR prev > 8000) AND NOT (event_type = 'error' AND event_id <= 8000 AND NOT covered)
""")
def compaction_lower_level(spark: SparkSession, d: str) -> DataFrame:
    """Versions kept by a compaction over a lower level of many files with gaps: a deletion goes only where none may hold its key."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    lower = e.filter("user_id % 10 < 4").groupBy(F.floor(F.col("user_id") / 10)).agg(F.min("user_id").alias("smallest"), F.max("user_id").alias("largest"))
    kept = levels.collect_garbage(e, ["user_id"], "event_id", "event_type", F.col("event_type") == "error", 8000, lower.select("smallest", "largest"), ["event_id"])
    return kept.select("user_id", "event_id", "event_type")


@query("""
WITH m AS (SELECT user_id // 10 AS number, count(*) AS file_size FROM events GROUP BY 1), a AS (SELECT number, file_size + CASE WHEN number % 7 = 3 THEN 1 ELSE 0 END AS file_size FROM m WHERE number % 11 <> 5)
SELECT m.number, m.file_size, a.file_size AS actual FROM m LEFT JOIN a ON a.number = m.number WHERE a.file_size IS DISTINCT FROM m.file_size
""")
def level_wrong_files(spark: SparkSession, d: str) -> DataFrame:
    """A manifest against a listing in which files are missing or have another size."""
    m = load(spark, d, "events").groupBy(F.floor(F.col("user_id") / 10).alias("number")).agg(F.count(F.lit(1)).alias("file_size"))
    listed = m.filter("number % 11 <> 5").withColumn("file_size", F.col("file_size") + F.when(F.col("number") % 7 == 3, 1).otherwise(0))
    return levels.wrong_files(m, listed)


@query("""
WITH f AS (SELECT DISTINCT user_id AS number, CASE user_id % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'sst.tmp' ELSE 'sst' END AS kind FROM events)
SELECT number, kind FROM f WHERE kind = 'sst.tmp' OR (kind = 'log' AND number < 50) OR (kind = 'sst' AND number % 3 = 0)
""")
def level_obsolete_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that no reader needs, of a listing of all kinds."""
    kind = F.when(F.col("user_id") % 4 == 0, "log").when(F.col("user_id") % 4 == 1, "sst.tmp").otherwise("sst")
    files = load(spark, d, "events").select(F.col("user_id").alias("number"), kind.alias("kind")).distinct()
    return levels.obsolete_files(files, files.filter("number % 3 <> 0").select("number"), 50).select("number", "kind")

