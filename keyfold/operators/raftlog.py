"""Computations over replicated logs, votes and acknowledgements as tables.

Tables have one row per log entry (region_id, idx, term, ...), voter or message.
Rows of different regions never meet; ``group`` names the columns of a region.
Windows see the peers of one region only, entries are aggregated with a combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import InvalidArgument
from . import merge, mvcc, skew

SNAPSHOT_EVERY = 5


def quorum(n: Column) -> Column:
    return F.floor(n / 2) + 1


def quorum_commit(progress: DataFrame, group: Sequence[str], match_col: str) -> DataFrame:
    """Per region the index ``commit_idx`` that a majority of its peers has reached."""
    order = Window.partitionBy(*group).orderBy(F.col(match_col).desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    ranked = progress.select(*group, F.col(match_col).alias("commit_idx"), F.row_number().over(order).alias("__rn"), n.alias("__n"))
    return ranked.filter(F.col("__rn") == quorum(F.col("__n"))).select(*group, "commit_idx")


def advance_commit(progress: DataFrame, log: DataFrame, hard_state: DataFrame, match_col: str = "match_idx") -> DataFrame:
    """(region_id, commit_index): the majority index if its entry has the current term, else the old commit."""
    found = quorum_commit(progress, ["region_id"], match_col).withColumnRenamed("commit_idx", "idx")
    of_term = found.join(log.select("region_id", "idx", F.col("term").alias("__t")), ["region_id", "idx"], "left")
    new = F.when(F.col("__t") == F.col("term"), F.greatest("commit_index", "idx")).otherwise(F.col("commit_index"))
    return hard_state.join(of_term, "region_id", "left").select("region_id", F.coalesce(new, "commit_index").alias("commit_index"))


def update_progress(progress: DataFrame, acks: DataFrame, last_index: DataFrame, order_col: str) -> DataFrame:
    """Progress (match_idx, next_idx) after the newest ack of each peer in the current term.

    An accepted ack sets match to its index. A rejected one moves next back to
    the entry after the last one of the conflicting term (``conflict_last``,
    NULL if the leader has none) or to the hinted index.
    """
    keys = ["region_id", "peer"]
    newest = mvcc.newest(acks, keys, order_col).select(*keys, "reject", "log_index", "log_term", "conflict_last", F.lit(True).alias("__ack"))
    r = progress.join(newest, keys, "left").join(last_index.select("region_id", F.col("last_idx").alias("__last")), "region_id", "left")
    back = F.when(F.coalesce("log_term", F.lit(0)) == 0, F.greatest("log_index", F.lit(1))).otherwise(F.coalesce(F.col("conflict_last") + 1, "log_index"))
    nxt = F.when(F.col("__ack").isNull(), F.col("next_idx")).when(F.col("reject"), back).otherwise(F.least(F.col("log_index") + 1, F.col("__last") + 1))
    match = F.when(F.col("__ack").isNotNull() & ~F.col("reject"), F.col("log_index")).otherwise(F.col("match_idx"))
    return r.select(*keys, F.least(match, nxt - 1).alias("match_idx"), nxt.alias("next_idx"))


def vote_tally(votes: DataFrame, group: Sequence[str], granted: Column, rejected: Column, voters: Column | None = None) -> DataFrame:
    """Per election 'Leader', 'Follower' or 'Candidate' from all its votes.

    ``votes`` has one row per voter; ``voters`` is the number of members, by
    default the number of rows.
    """
    n = F.count(F.lit(1)) if voters is None else F.max(voters)
    g, r, q = (F.sum(granted.cast("int")), F.sum(rejected.cast("int")), quorum(n))
    state = F.when(g >= q, "Leader").when(r >= q, "Follower").otherwise("Candidate")
    return votes.groupBy(*group).agg(state.alias("state"))


def election(responses: DataFrame, voters: DataFrame, order_col: str) -> DataFrame:
    """(region_id, term, state): the outcome as responses come in, the first decision holding.

    A voter's later response replaces its earlier one; the candidate's own vote
    is a response of its own. ``voters`` is (region_id, members).
    """
    keys = ["region_id", "term"]
    grant = (~F.col("reject")).cast("int")
    mine = Window.partitionBy(*keys, "from_node").orderBy(order_col)
    delta = responses.select(
        *keys, order_col,
        (grant - F.coalesce(F.lag(grant).over(mine), F.lit(0))).alias("__g"),
        ((1 - grant) - F.coalesce(F.lag(1 - grant).over(mine), F.lit(0))).alias("__r"),
    )
    so_far = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = delta.withColumns({"__G": F.sum("__g").over(so_far), "__R": F.sum("__r").over(so_far)}).join(voters, "region_id")
    q = quorum(F.col("members"))
    now = F.when(F.col("__G") >= q, "Leader").when(F.col("__R") >= q, "Follower")
    decided = run.withColumn("__s", now).groupBy(*keys).agg(F.min(F.when(F.col("__s").isNotNull(), F.struct(order_col, "__s"))).alias("__d"))
    return decided.select(*keys, F.coalesce("__d.__s", F.lit("Candidate")).alias("state"))


def log_is_fresh(my_term: Column, my_index: Column, their_term: Column, their_index: Column) -> Column:
    """Whether a candidate's log is at least as new as a voter's."""
    return ~((my_term > their_term) | ((my_term == their_term) & (my_index > their_index)))


def votes_granted(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """Vote requests (region_id, from_node, to_node, term, log_term, log_index) with ``granted``.

    ``voters`` is (region_id, node, current_term, vote, last_term, last_index); a
    request with an older term, or to a voter that chose another, is refused.
    """
    v = voters.withColumnRenamed("node", "to_node")
    free = (F.coalesce("vote", F.lit(0)) == 0) | (F.col("vote") == F.col("from_node")) | (F.col("term") > F.col("current_term"))
    ok = (F.col("current_term") <= F.col("term")) & free & log_is_fresh(F.col("last_term"), F.col("last_index"), F.col("log_term"), F.col("log_index"))
    return requests.join(v, ["region_id", "to_node"]).select(*requests.columns, ok.alias("granted"))


def last_index_of_term(log: DataFrame, group: Sequence[str] = ("region_id",)) -> DataFrame:
    return log.groupBy(*group, "term").agg(F.max("idx").alias("last_idx"))


def conflict_first_index(log: DataFrame, probes: DataFrame, group: Sequence[str] = ("region_id",)) -> DataFrame:
    """Each probed entry (idx, term) with ``first_idx``, the first index of its term's run.

    Terms never decrease along a log, so a run is all of a term: one aggregate.
    """
    runs = log.groupBy(*group, "term").agg(F.min("idx").alias("first_idx"))
    return probes.join(runs, [*group, "term"]).select(*group, "idx", "term", "first_idx")


def append_check(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Append requests (region_id, log_index, log_term) with the follower's answer.

    ``reject``, and the hint (hint_term, hint_index): beyond the log its next
    index; at another term that term and the first index of its run, from which
    the follower cuts its log (``truncate_from``).
    """
    last = log.groupBy("region_id").agg(F.max("idx").alias("__last"), F.min("idx").alias("__first"))
    at = log.select("region_id", F.col("idx").alias("log_index"), F.col("term").alias("__term"))
    runs = log.groupBy("region_id", F.col("term").alias("__term")).agg(F.min("idx").alias("__run"))
    r = requests.join(last, "region_id", "left").join(at, ["region_id", "log_index"], "left").join(runs, ["region_id", "__term"], "left")
    beyond = F.col("log_index") > F.coalesce("__last", F.lit(0))
    mine = F.coalesce("__term", F.lit(0))
    differs = ~beyond & (mine != F.col("log_term"))
    return r.select(
        *requests.columns,
        (beyond | differs).alias("reject"),
        F.when(differs, mine).otherwise(F.lit(0)).alias("hint_term"),
        F.when(beyond, F.coalesce("__last", F.lit(0)) + 1).when(differs, F.coalesce("__run", "log_index")).alias("hint_index"),
        F.when(differs, F.coalesce("__run", "log_index")).alias("truncate_from"),
    )


def append_entries(log: DataFrame, entries: DataFrame, prev: int | None = None) -> DataFrame:
    """The log after a leader's entries are taken over.

    With ``prev`` everything after it is replaced. Without it entries are compared
    index by index: the log is cut only from the first entry that differs in
    term, so that an old request that comes late removes nothing.
    """
    if prev is not None:
        return log.filter(F.col("idx") <= prev).unionByName(entries)
    mine = log.select("region_id", "idx", F.col("term").alias("__mine"))
    cut = (
        entries.join(mine, ["region_id", "idx"]).filter(F.col("term") != F.col("__mine"))
        .groupBy("region_id").agg(F.min("idx").alias("__cut"))
    )
    kept = log.join(cut, "region_id", "left").filter(F.col("__cut").isNull() | (F.col("idx") < F.col("__cut"))).drop("__cut")
    new = entries.join(kept.select("region_id", "idx"), ["region_id", "idx"], "left_anti")
    return kept.unionByName(new)


def load_entries(log: DataFrame, low: int, high: int) -> DataFrame:
    """Entries with low <= idx < high in order; the range reaches the scan."""
    return log.filter((F.col("idx") >= low) & (F.col("idx") < high)).orderBy("idx")


def compact(log: DataFrame, first: int, region_id: int | None = None) -> DataFrame:
    """Entries from ``first`` on; other regions whole."""
    keep = F.col("idx") >= first
    return log.filter(keep if region_id is None else keep | (F.col("region_id") != region_id))


def truncate_from(log: DataFrame, idx: int, region_id: int | None = None) -> DataFrame:
    """Entries before ``idx``; other regions whole."""
    keep = F.col("idx") < idx
    return log.filter(keep if region_id is None else keep | (F.col("region_id") != region_id))


def committed(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Entries with cursor < idx <= commit_index of (region_id, cursor, commit_index), in order; compacted ones are missing."""
    c = cursors.select("region_id", "cursor", "commit_index")
    return log.join(c, "region_id").filter((F.col("idx") > F.col("cursor")) & (F.col("idx") <= F.col("commit_index"))).select(*log.columns)


def highest_term(log: DataFrame) -> DataFrame:
    """Of the rows of an index only those of its highest term."""
    top = log.groupBy("region_id", "idx").agg(F.max("term").alias("term"))
    return log.join(top, ["region_id", "idx", "term"], "left_semi")


def save_hard_state(states: DataFrame, changes: DataFrame, order_col: str) -> DataFrame:
    """The newest state of each region; ``order_col`` of the changes is a whole number."""
    both = states.withColumn(order_col, F.lit(-(2**63)).cast("bigint")).unionByName(changes.withColumn(order_col, F.col(order_col).cast("bigint")))
    return mvcc.newest(both, ["region_id"], order_col).drop(order_col)


def install_snapshot(snapshots: DataFrame, firsts: DataFrame) -> DataFrame:
    """Snapshots (region_id, idx, term) with ``installed``: only those above the log's first index, and then
    ``commit_index`` is the greater of both."""
    r = snapshots.join(firsts.select("region_id", "first_idx", F.col("commit_index").alias("__c")), "region_id")
    ok = F.col("idx") > F.col("first_idx")
    return r.select(*snapshots.columns, ok.alias("installed"), F.when(ok, F.greatest("__c", "idx")).otherwise(F.col("__c")).alias("commit_index"))


def send_choice(progress: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per peer what a leader sends: 'snapshot' if the next entry was compacted away, else 'entries'."""
    r = progress.join(firsts.select("region_id", "first_idx"), "region_id")
    return r.select("region_id", "peer", F.when(F.col("next_idx") <= F.col("first_idx"), "snapshot").otherwise("entries").alias("send"))


def snapshot_triggers(applied: DataFrame, order_col: str, every: int = SNAPSHOT_EVERY, group_col: str | None = None) -> DataFrame:
    """Applied entries after which a snapshot is due, with its number ``snap``: each ``every``-th, of each group if one is named.

    Numbers come from offsets of stored blocks, so neither all entries nor a
    large group are one task's work.
    """
    if group_col is None:
        numbered = merge.running_number(applied, [order_col], name="__n")
    else:
        kept = skew.number_rows(skew.ordered_blocks(applied.filter(F.col(group_col).isNotNull()), order_col), group_col, order_col)
        numbered = kept.withColumn("__n", F.col("row_no") + 1).drop("row_no")
    return numbered.filter(F.col("__n") % every == 0).withColumn("snap", F.floor(F.col("__n") / every)).drop("__n")


#: Election timeout: 15 ticks of 10 ms, fixed values.
TICK_US = 10_000
ELECTION_US = 15 * TICK_US
#: A message that takes longer to its receiver is lost: a fixed value.
SEND_US = 100_000

_LEADER_SENDS = ("MsgApp", "MsgBeat", "MsgSnap")


def step_check(messages: DataFrame) -> DataFrame:
    """Messages with ``step``, how their receiver takes their term: 'stale', 'current' or 'newer'.

    The receiver's term is the greatest it has got in an earlier message (by
    ``msg_no``) of its region; it refuses stale ones and follows newer ones. A
    message without receiver or term gives NULL.
    """
    known = skew.running_max(messages, ["region_id", "to_node"], "msg_no", "term", "__known")
    step = F.when(F.col("term") < F.col("__known"), "stale").when(F.col("term") == F.col("__known"), "current").otherwise("newer")
    return known.withColumn("step", F.when(F.col("to_node").isNotNull() & F.col("term").isNotNull(), step)).drop("__known")


def election_timeout_us(draw: Column) -> Column:
    """A timeout of its own for each node and term: T and a share of T that ``draw``, a whole number, picks by the tick."""
    return F.lit(ELECTION_US) + F.pmod(draw, F.lit(ELECTION_US // TICK_US)) * TICK_US


def election_timeouts(messages: DataFrame, timeout_us: int | Column = ELECTION_US) -> DataFrame:
    """Messages of a leader that came longer than the timeout after the one before, with the pause.

    At these points the receiver (``to_node``) had cause to campaign. A timeout
    may differ by ``region_id``, ``to_node`` and ``msg_no``.
    """
    heard = messages.filter(F.col("msg_type").isin(*_LEADER_SENDS) & F.col("to_node").isNotNull()).select(
        "msg_no", "region_id", "to_node", F.unix_micros(F.col("received_at").cast("timestamp")).alias("__at")
    )
    last = skew.running_max(heard, ["region_id", "to_node"], "msg_no", "__at", "__last")
    pause = F.col("__at") - F.col("__last")
    return last.withColumn("pause_us", pause).filter(F.col("pause_us") > timeout_us).drop("__at", "__last")


def roles(messages: DataFrame) -> DataFrame:
    """(region_id, node, term, role) of every node that sent something, at the newest term it sent.

    Who sent entries, heartbeats or a snapshot in a term was its leader; who
    asked for votes only was a candidate; all others followed.
    """
    sent = messages.filter(F.col("from_node").isNotNull() & F.col("term").isNotNull())
    per_term = sent.groupBy("region_id", F.col("from_node").alias("node"), "term").agg(
        F.max(F.col("msg_type").isin(*_LEADER_SENDS).cast("int")).alias("__leads"),
        F.max((F.col("msg_type") == "MsgVote").cast("int")).alias("__asks"),
    )
    role = F.when(F.col("__leads") == 1, "Leader").when(F.col("__asks") == 1, "Candidate").otherwise("Follower")
    return mvcc.newest(per_term, ["region_id", "node"], "term").select("region_id", "node", "term", role.alias("role"))


def action(role: Column, msg_type: Column) -> Column:
    """What a node in a role does with a message of the current term; 'ignore' for what is not for it."""
    leads = role == "Leader"
    return (
        F.when(msg_type == "MsgVote", "vote")
        .when(msg_type == "MsgHup", F.when(leads, "ignore").otherwise("campaign"))
        .when(msg_type == "MsgPropose", F.when(leads, "append and send").otherwise("refuse"))
        .when((msg_type == "MsgVoteResp") & (role == "Candidate"), "tally")
        .when(leads & (msg_type == "MsgAppResp"), "progress").when(leads & (msg_type == "MsgBeatResp"), "confirm read").when(leads & (msg_type == "MsgSnapResp"), "progress")
        .when(~leads & (msg_type == "MsgApp"), "append").when(~leads & (msg_type == "MsgBeat"), "follow").when(~leads & (msg_type == "MsgSnap"), "install")
        .otherwise("ignore")
    )


def delivery(sent_at: Column, received_at: Column, to_node: Column, timeout_us: int = SEND_US) -> Column:
    """What became of a sent message: 'delivered', 'late' beyond the timeout (its sender took it for lost), or 'no receiver'."""
    took = F.unix_micros(received_at.cast("timestamp")) - F.unix_micros(sent_at.cast("timestamp"))
    return F.when(to_node.isNull() | received_at.isNull(), "no receiver").when(took > timeout_us, "late").otherwise("delivered")


def proposal_results(proposals: DataFrame, log: DataFrame, applied: DataFrame) -> DataFrame:
    """Proposals (region_id, idx, term) with ``outcome`` once their index is applied.

    'done' if the entry that holds there is the proposed one, 'superseded' if its
    term is another, 'waiting' as long as the region's ``applied`` index is lower.
    """
    held = log.select("region_id", "idx", F.col("term").alias("__held"))
    r = proposals.join(held, ["region_id", "idx"], "left").join(applied.select("region_id", F.col("applied").alias("__applied")), "region_id", "left")
    outcome = F.when(F.coalesce("__applied", F.lit(0)) < F.col("idx"), "waiting").when(F.col("__held").eqNullSafe(F.col("term")), "done").otherwise("superseded")
    return r.select(*proposals.columns, outcome.alias("outcome"))


def restore(snapshots: DataFrame, hard_states: DataFrame, log: DataFrame) -> DataFrame:
    """What a restarted node applies: the log's entries after its snapshot up to the saved commit, per region.

    ``snapshots`` is (region_id, snap_index), ``hard_states`` (region_id, commit_index);
    a region without a snapshot begins at its first entry, one without a saved
    state applies nothing.
    """
    s = snapshots.groupBy("region_id").agg(F.max("snap_index").alias("__snap"))
    r = log.join(hard_states.select("region_id", F.col("commit_index").alias("__c")), "region_id").join(s, "region_id", "left")
    return r.filter((F.col("idx") > F.coalesce("__snap", F.lit(0))) & (F.col("idx") <= F.col("__c"))).select(*log.columns)


class LogStorage:
    """The log of one region or many, with its hard state, as tables that are replaced and never changed.

    ``append`` takes entries over (``append_entries``), ``compact`` drops those
    before an index and remembers it, so that ``first_index`` stays known.
    """

    def __init__(self, entries: DataFrame, hard_states: DataFrame | None = None, first: int = 1):
        self.rows, self.hard_states, self.first = entries, hard_states, first

    def append(self, entries: DataFrame) -> LogStorage:
        return LogStorage(append_entries(self.rows, entries), self.hard_states, self.first)

    def compact(self, first: int) -> LogStorage:
        return LogStorage(compact(self.rows, first), self.hard_states, max(self.first, first))

    def save(self, changes: DataFrame, order_col: str) -> LogStorage:
        states = changes.drop(order_col).limit(0) if self.hard_states is None else self.hard_states
        return LogStorage(self.rows, save_hard_state(states, changes, order_col), self.first)

    def entries(self, low: int, high: int) -> DataFrame:
        """Entries with low <= idx < high; those that were compacted away can't be had."""
        if low < self.first:
            raise InvalidArgument(f"entries before {self.first} were compacted away")
        return load_entries(self.rows, low, high)

    def bounds(self) -> DataFrame:
        """(region_id, first_idx, last_idx) of the entries held."""
        return self.rows.groupBy("region_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def classify(msg_type: Column) -> Column:
    """'local' for messages a node sends itself, 'response' or 'request'."""
    return F.when(msg_type.isin("MsgHup", "MsgTick", "MsgPropose"), "local").when(msg_type.endswith("Resp"), "response").otherwise("request")
