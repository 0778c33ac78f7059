"""Log, vote and acknowledgement computations."""

import pytest
from pyspark.sql import functions as F

from keyfold.operators import raftlog, reads

from .conftest import rows

LOG = "region_id bigint, idx bigint, term bigint"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 3), (2, 2, 3)], LOG)


def test_load_compact_truncate(log):
    assert rows(raftlog.compact(log, 3, 1)) == [(1, 3, 2), (2, 1, 3), (2, 2, 3)]
    assert rows(raftlog.truncate_from(log, 2, 2)) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 1, 3)]
    assert [r.idx for r in raftlog.load_entries(log.filter("region_id = 1"), 2, 4).collect()] == [2, 3]
    assert rows(raftlog.last_index_of_term(log)) == [(1, 1, 2), (1, 2, 3), (2, 3, 2)]


@pytest.mark.parametrize("live, total, want", [(3, 3, "Leader"), (2, 3, "Leader"), (1, 3, "Candidate"), (2, 4, "Candidate"), (3, 5, "Leader")])
def test_votes(spark, live, total, want):
    votes = spark.createDataFrame([(1, i < live) for i in range(total)], "term bigint, ok boolean")
    assert rows(raftlog.vote_tally(votes, ["term"], F.col("ok"), F.lit(False))) == [(1, want)]


def test_election_takes_first_decision(spark):
    r = spark.createDataFrame(
        [(1, 5, 1, 1, False), (1, 5, 2, 2, True), (1, 5, 2, 3, False), (1, 5, 3, 4, True), (2, 5, 1, 1, False), (2, 5, 2, 2, True), (2, 5, 3, 3, True), (3, 5, 1, 1, False)],
        "region_id bigint, term bigint, from_node bigint, at bigint, reject boolean",
    )
    voters = spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "region_id bigint, members int")
    assert rows(raftlog.election(r, voters, "at")) == [(1, 5, "Leader"), (2, 5, "Follower"), (3, 5, "Candidate")]


def test_commit_needs_current_term(spark, log):
    p = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 2, 2), (2, 3, 0), (2, 4, 0)], "region_id bigint, peer bigint, match_idx bigint")
    assert rows(raftlog.quorum_commit(p, ["region_id"], "match_idx")) == [(1, 3), (2, 0)]
    for term, want in ((2, 3), (3, 1)):
        hs = spark.createDataFrame([(1, term, 1)], "region_id bigint, term bigint, commit_index bigint")
        assert rows(raftlog.advance_commit(p, log, hs)) == [(1, want)]


def test_append_check(spark, log):
    q = spark.createDataFrame([(1, 3, 2), (1, 4, 2), (1, 2, 2), (1, 3, 9)], "region_id bigint, log_index bigint, log_term bigint")
    got = {(r.log_index, r.log_term): (r.reject, r.hint_term, r.hint_index, r.truncate_from) for r in raftlog.append_check(q, log).collect()}
    assert got == {(3, 2): (False, 0, None, None), (4, 2): (True, 0, 4, None), (2, 2): (True, 1, 1, 1), (3, 9): (True, 2, 3, 3)}


def test_append_entries(spark, log):
    new = spark.createDataFrame([(1, 2, 5), (1, 3, 5)], LOG)
    one = log.filter("region_id = 1")
    assert rows(raftlog.append_entries(one, new, 1)) == [(1, 1, 1), (1, 2, 5), (1, 3, 5)]
    assert rows(raftlog.append_entries(log, new)) == [(1, 1, 1), (1, 2, 5), (1, 3, 5), (2, 1, 3), (2, 2, 3)]
    late = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], LOG)
    assert rows(raftlog.append_entries(one, late)) == rows(one)


def test_conflict_committed_highest(spark, log):
    assert rows(raftlog.conflict_first_index(log, log.filter("idx = 2"))) == [(1, 2, 1, 1), (2, 2, 3, 1)]
    c = spark.createDataFrame([(1, 1, 3), (2, 2, 9)], "region_id bigint, cursor bigint, commit_index bigint")
    assert rows(raftlog.committed(log, c)) == [(1, 2, 1), (1, 3, 2)]
    both = log.unionByName(spark.createDataFrame([(1, 3, 7)], LOG))
    assert (1, 3, 2) not in rows(raftlog.highest_term(both)) and (1, 3, 7) in rows(raftlog.highest_term(both))


def test_snapshot_rules(spark):
    s = spark.createDataFrame([(1, 1, 1), (2, 9, 2)], "region_id bigint, idx bigint, term bigint")
    f = spark.createDataFrame([(1, 1, 3), (2, 4, 3)], "region_id bigint, first_idx bigint, commit_index bigint")
    assert rows(raftlog.install_snapshot(s, f)) == [(1, 1, 1, False, 3), (2, 9, 2, True, 9)]
    p = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "region_id bigint, peer bigint, next_idx bigint")
    assert rows(raftlog.send_choice(p, f)) == [(1, 1, "snapshot"), (1, 2, "entries")]
    applied = spark.range(1, 13).withColumnRenamed("id", "idx")
    assert rows(raftlog.snapshot_triggers(applied, "idx")) == [(10, 2), (5, 1)]


def test_progress(spark):
    p = spark.createDataFrame([(1, 1, 3, 4), (1, 2, 3, 9), (1, 3, 0, 9), (1, 4, 2, 3)], "region_id bigint, peer bigint, match_idx bigint, next_idx bigint")
    a = spark.createDataFrame(
        [(1, 1, 1, False, 7, 0, None), (1, 1, 2, False, 8, 0, None), (1, 2, 1, True, 5, 2, 6), (1, 3, 1, True, 0, 0, None)],
        "region_id bigint, peer bigint, at bigint, reject boolean, log_index bigint, log_term bigint, conflict_last bigint",
    )
    last = spark.createDataFrame([(1, 8)], "region_id bigint, last_idx bigint")
    assert rows(raftlog.update_progress(p, a, last, "at")) == [(1, 1, 8, 9), (1, 2, 3, 7), (1, 3, 0, 1), (1, 4, 2, 3)]


def test_votes_granted_and_hard_state(spark):
    q = spark.createDataFrame([(1, 1, 2, 5, 2, 9), (1, 1, 3, 5, 2, 9), (1, 1, 4, 5, 2, 9)], "region_id bigint, from_node bigint, to_node bigint, term bigint, log_term bigint, log_index bigint")
    v = spark.createDataFrame([(1, 2, 5, 0, 2, 9), (1, 3, 5, 4, 1, 1), (1, 4, 5, 0, 2, 10)], "region_id bigint, node bigint, current_term bigint, vote bigint, last_term bigint, last_index bigint")
    assert [(r.to_node, r.granted) for r in raftlog.votes_granted(q, v).orderBy("to_node").collect()] == [(2, True), (3, False), (4, False)]
    s = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1)], "region_id bigint, term bigint, vote bigint, commit_index bigint")
    c = spark.createDataFrame([(1, 2, 1, 1, 10), (1, 3, 2, 4, 20)], "region_id bigint, term bigint, vote bigint, commit_index bigint, at bigint")
    assert rows(raftlog.save_hard_state(s, c, "at")) == [(1, 3, 2, 4), (2, 1, 1, 1)]


def test_read_index(spark):
    r = spark.createDataFrame([(1, 7, 4, 1)], "region_id bigint, read_id bigint, term bigint, leader bigint")
    regs = spark.createDataFrame([(1, [1, 2, 3, 4, 5])], "region_id bigint, peers array<bigint>")
    steps = [(2, 4, 7), (2, 4, 7), (6, 4, 7), (3, 3, 7), (3, 4, 8), (3, 4, 7)]
    for n in range(len(steps) + 1):
        a = spark.createDataFrame([(1, i, t, f) for f, t, i in steps[:n]], "region_id bigint, read_id bigint, term bigint, from_node bigint")
        assert rows(reads.read_index_quorum(r, a, regs)) == ([(1, 7, 4, 3)] if n == 6 else [])
    early = r.withColumn("committed_term", F.lit(3))
    assert reads.read_index_quorum(early, a, regs).count() == 0


def test_wait_for_apply(spark):
    asked = spark.createDataFrame([(1, 1), (2, 5000), (3, 90001)], "read_id bigint, idx bigint")
    applied = spark.createDataFrame([(0,), (1,), (9000,), (90000,)], "applied bigint")
    assert rows(reads.wait_for_apply(asked, applied, "idx", "applied"), "read_id", "served_at") == [(1, 1), (2, 9000)]
    assert reads.wait_for_apply(asked, applied.limit(0), "idx", "applied").count() == 0


def test_steps_timeouts_and_roles(spark):
    from keyfold.operators import skew

    m = spark.createDataFrame(
        [
            (1, 1, 1, 2, 5, "MsgApp", 0), (2, 1, 3, 2, 4, "MsgVote", 10), (3, 1, 1, 2, 5, "MsgBeat", 100), (4, 1, 3, 2, 6, "MsgVote", 200),
            (5, 1, 1, None, 9, "MsgApp", 300), (6, 2, 1, 2, 1, "MsgApp", 0), (7, 1, 2, 1, 5, "MsgAppResp", 400), (8, 1, 1, 2, None, "MsgBeat", 300),
        ],
        "msg_no bigint, region_id bigint, from_node bigint, to_node bigint, term bigint, msg_type string, ms bigint",
    ).selectExpr("*", "timestamp_millis(ms) AS received_at", "1 AS __block0")
    got = {r.msg_no: r.step for r in raftlog.step_check(m).collect()}
    assert got == {1: "newer", 2: "stale", 3: "current", 4: "newer", 5: None, 6: "newer", 7: "newer", 8: None}
    assert rows(raftlog.election_timeouts(m), "msg_no", "pause_us") == [(8, 200_000)]
    assert rows(raftlog.roles(m)) == [(1, 1, 9, "Leader"), (1, 2, 5, "Follower"), (1, 3, 6, "Candidate"), (2, 1, 1, "Leader")]
    assert raftlog.step_check(m.limit(0)).count() == 0
    data = [(i, None if i % 5 == 0 else i % 3, (i * 37) % 101 if i % 7 else None) for i in range(500)]
    df = spark.createDataFrame(data, "o bigint, k bigint, v bigint")
    want = {}
    for i, k, _ in data:
        before = [v for j, q, v in data if j < i and q == k and v is not None]
        want[i] = max(before, default=None)
    assert {r.o: r.m for r in skew.running_max(df, ["k"], "o", "v", "m").collect()} == want
