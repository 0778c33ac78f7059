"""Incremental runs: nothing skipped, nothing repeated, failures repeated whole."""

import datetime
import random

import pytest

from keyfold.operators import incremental
from keyfold.session import shared_path
from keyfold.sources.commits import CommitLog, VersionConflict

from .conftest import rows

T0 = datetime.datetime(2026, 1, 1)


def make(spark, data):
    return spark.createDataFrame([(k, v, "x") for k, v in data], "k string, v binary, change string").drop("change")


def test_new_changed_and_failure(spark):
    s = incremental.IncrementalState(spark, shared_path(spark, "inc"), ["k"], ["v"])
    first = make(spark, [("a", bytearray(b"1")), ("b", None), (None, bytearray(b""))])
    p = s.pending(first)
    assert rows(p, "k", "change") == sorted([("a", "new"), ("b", "new"), (None, "new")], key=repr)
    assert rows(s.pending(first), "k") == rows(p, "k")  # a run that failed before its commit
    s.commit(p)
    assert s.pending(first).count() == 0
    second = make(spark, [("a", bytearray(b"2")), ("b", bytearray(b"")), (None, bytearray(b"")), ("c", None), ("c", None)])
    p = s.pending(second)
    assert sorted({(r.k, r.change) for r in p.collect()}) == [("a", "changed"), ("b", "changed"), ("c", "new")]
    s.commit(p)
    assert s.pending(second).count() == 0
    assert rows(s.pending(first), "k", "change") == [("a", "changed"), ("b", "changed")]
    assert s.pending(first.limit(0)).count() == 0
    s.commit(s.pending(first.limit(0)))
    assert s.pending(second).count() == 0


def test_one_commit_wins(spark):
    log = CommitLog(spark, shared_path(spark, "log"))
    log.commit(1, {"a": 1})
    with pytest.raises(VersionConflict):
        log.commit(1, {"a": 2})
    assert (log.current(), log.read(1), log.versions()) == (1, {"a": 1}, [1])


def brute(log, messages, reports):
    top, got, out = {}, {}, []
    for g, i, t, at in log:
        top[g, i] = max(t, top.get((g, i), t))
    for g, i, t, at in log:
        if t == top[g, i]:
            got[g, i] = min(at, got.get((g, i), at))
    runs = {}
    for run, g, started, status in reports:
        r = runs.setdefault(run, [g, started, False])
        r[2] |= status == "succeeded"
    for (g, i), at in got.items():
        told = [m[2] for m in messages if m[0] == g and m[1] is not None and m[1] >= i]
        if told:
            due = max(at, min(told))
            fit = sorted((r[1], run) for run, r in runs.items() if r[0] == g and r[2] and r[1] >= due)
            if fit:
                out.append((fit[0][1], g, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, waves", [(1, 1), (2, 2), (3, 5)])
def test_runs_against_brute_force(spark, seed, waves, monkeypatch):
    monkeypatch.setattr(incremental, "INDEX_BUCKET", 16)
    rng = random.Random(seed)
    when = lambda: T0 + datetime.timedelta(minutes=rng.randint(0, 3000))
    log = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 80), rng.choice([1, 1, 2]), when()) for _ in range(300)]
    messages = [(rng.choice([1, 1, 2, 3]), rng.choice([None, 0, rng.randint(1, 100)]), when()) for _ in range(60)]
    reports = []
    for run in range(60):
        g, started = rng.choice([1, 1, 2, 3]), when()
        reports += [(run, g, started, rng.choice(["running", "failed", None, "succeeded"])) for _ in range(rng.randint(1, 3))]
    ldf = spark.createDataFrame([(g, i, t, 0, 2, "c", bytearray(b"k"), None, at) for g, i, t, at in log], "region_id bigint, idx bigint, term bigint, pos int, cmd_type int, cf string, key binary, value binary, received_at timestamp_ntz")
    mdf = spark.createDataFrame(messages, "region_id bigint, commit_index bigint, received_at timestamp_ntz")
    rdf = spark.createDataFrame([(*r, r[2]) for r in reports], "run_id bigint, region_id bigint, started_at timestamp_ntz, status string, reported_at timestamp_ntz")
    ran = incremental.process_runs(ldf, mdf, rdf, shared_path(spark, "runs"), waves)
    assert rows(incremental.due_once(ran, ldf)) == brute(log, messages, reports)
    assert rows(ran, "run_id", "region_id", "idx", "term", "change", "was_term") == replay(log, messages, reports, waves)


def replay(log, messages, reports, waves):
    """The waves one after another, over what had come in by the end of each."""
    us = lambda at: (at - T0) // datetime.timedelta(microseconds=1)
    runs = {}
    for run, g, started, status in reports:
        r = runs.setdefault(run, [g, us(started), False])
        r[2] |= status == "succeeded"
    runs = {k: (g, s) for k, (g, s, ok) in runs.items() if ok}
    low, high = min(s for _, s in runs.values()), max(s for _, s in runs.values())
    step = (high - low) // waves + 1
    told, first, state, out = {}, {}, {}, []
    for g, i, t, at in log:
        first[g, i, t] = min(us(at), first.get((g, i, t), us(at)))
        seen = [us(m[2]) for m in messages if m[0] == g and m[1] is not None and m[1] >= i]
        told[g, i] = min(seen, default=None)
    for w in range(waves):
        until, top = low + step * (w + 1) - 1, {}
        for (g, i, t), at in first.items():
            if at <= until and told[g, i] is not None and told[g, i] <= until:
                top[g, i] = max(t, top.get((g, i), t))
        for (g, i), t in top.items():
            if state.get((g, i)) == t:
                continue
            due = max(first[g, i, t], told[g, i])
            fit = sorted((s, run) for run, (rg, s) in runs.items() if rg == g and s >= due and (s - low) // step == w)
            if fit:
                was = state.get((g, i))
                out.append((fit[0][1], g, i, t, "new" if was is None else "changed", was))
                state[g, i] = t
    return sorted(out, key=repr)


LOG = "region_id bigint, idx bigint, term bigint, pos int, cmd_type int, cf string, key binary, value binary, received_at timestamp_ntz"


def small(spark):
    """Index 1 is processed, then replaced by term 2; index 2 gets a second command late; index 3 stays."""
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    k = bytearray(b"k")
    log = [(1, 1, 1, 0, 2, "c", k, k, at(0)), (1, 2, 1, 0, 2, "c", k, k, at(0)), (1, 3, 1, 0, 2, "c", k, k, at(0)), (1, 1, 2, 0, 2, "c", k, k, at(60)), (1, 2, 1, 1, 3, "c", k, None, at(61))]
    messages = [(1, 3, at(1))]
    reports = [(7, 1, at(5), "succeeded", at(6)), (8, 1, at(100), "failed", at(101)), (9, 1, at(110), "succeeded", at(111))]
    return (
        spark.createDataFrame(log, LOG), spark.createDataFrame(messages, "region_id bigint, commit_index bigint, received_at timestamp_ntz"),
        spark.createDataFrame(reports, "run_id bigint, region_id bigint, started_at timestamp_ntz, status string, reported_at timestamp_ntz"),
    )


WANT = [(7, 1, 1, 1, "new", None), (7, 1, 2, 1, "new", None), (7, 1, 3, 1, "new", None), (9, 1, 1, 2, "changed", 1), (9, 1, 2, 1, "changed", 1)]


def test_replaced_and_completed_entries_come_back(spark):
    log, messages, reports = small(spark)
    ran = incremental.process_runs(log, messages, reports, shared_path(spark, "runs"))
    assert rows(ran) == WANT
    assert rows(incremental.due_once(ran, log)) == [(7, 1, 2), (7, 1, 3), (9, 1, 1)]


def test_state_decides(spark, monkeypatch):
    monkeypatch.setattr(incremental.IncrementalState, "known", lambda self: None)
    log, messages, reports = small(spark)
    ran = incremental.process_runs(log, messages, reports, shared_path(spark, "runs"))
    assert len(rows(ran)) > len(WANT)  # without a state everything would come again


def test_failed_switch_is_repeated_exactly(spark, monkeypatch):
    log, messages, reports = small(spark)
    path, commit, calls = shared_path(spark, "runs"), CommitLog.commit, []

    def failing(self, version, content):
        calls.append(version)
        if len(calls) == 2:  # the second wave has written its assignment
            raise OSError("lost")
        commit(self, version, content)

    monkeypatch.setattr(CommitLog, "commit", failing)
    with pytest.raises(OSError):
        incremental.process_runs(log, messages, reports, path)
    assert rows(incremental.process_runs(log, messages, reports, path)) == WANT
    assert calls == [1, 2, 2]


def test_repeated_keys_settle(spark):
    s = incremental.IncrementalState(spark, shared_path(spark, "inc"), ["k"], ["v"])
    table = make(spark, [("a", bytearray(b"1")), ("a", bytearray(b"2")), ("b", bytearray(b"1"))])
    p = s.pending(table)
    assert rows(p, "k", "change") == [("a", "new"), ("b", "new")]
    s.commit(p)
    assert s.pending(table).count() == 0


def test_parts_are_merged(spark):
    s = incremental.IncrementalState(spark, shared_path(spark, "inc"), ["k"], ["v"])
    for i in range(9):
        s.commit(s.pending(make(spark, [(f"k{j}", bytearray([j])) for j in range(i + 1)])))
    assert len(s.committed()["parts"]) <= 4
    assert sum(p["rows"] for p in s.committed()["parts"]) == 9 == s.known().count()


def test_no_runs(spark):
    log = spark.createDataFrame([], "region_id bigint, idx bigint, term bigint, pos int, cmd_type int, cf string, key binary, value binary, received_at timestamp")
    messages = spark.createDataFrame([], "region_id bigint, commit_index bigint, received_at timestamp")
    reports = spark.createDataFrame([], "run_id bigint, region_id bigint, started_at timestamp, status string")
    assert incremental.process_runs(log, messages, reports, shared_path(spark, "runs")).count() == 0
