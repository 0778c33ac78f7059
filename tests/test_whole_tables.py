"""Queries named ..._all take every row of a table, whatever its ids."""

import pytest

from keyfold.plans import registry

from .conftest import rows

EVENTS = [(1, "error"), (1, "view"), (2, "signup"), (2, "view"), (1, "click"), (1, "signup")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    events = [(2003 + 30 * i, u, t, float(i)) for i, (u, t) in enumerate(EVENTS)]  # outside the filters of the queries without _all
    spark.createDataFrame(events, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{d}/events.parquet")
    lines = [(k, 1, 7, 8, 9.0) for k in (50, 900, 51)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(101,), (102,), (205,)], "o_orderkey bigint").write.parquet(f"{d}/orders.parquet")
    messages = [
        (1, "MsgVote", 2, 3, 1, 5, False), (2, "MsgAppResp", 3, 2, 2, 9, False), (3, "MsgVote", 2, 3, 2, 8, False), (4, "MsgAppResp", 3, 2, 4, 1, True),
        (5, "MsgVote", 2, 3, 2, 9, False), (6, "MsgAppResp", 3, 2, 2, 10, False), (7, "MsgVote", 2, None, 2, 9, False), (8, "MsgVote", 2, 4, 0, 0, False),
        (9, "MsgVote", 2, 3, 1, 99, False),
    ]
    spark.createDataFrame(
        [(*m, 7) for m in messages], "msg_no bigint, msg_type string, from_node bigint, to_node bigint, log_term bigint, log_index bigint, reject boolean, region_id bigint"
    ).write.parquet(f"{d}/raft_messages.parquet")
    return d


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("kv_batch_sequence_all", [(50, 1, 7, 1001), (51, 1, 7, 1002), (900, 1, 7, 1003)]),
        ("kv_multi_get_all", [(1, 5.0), (2, 3.0)]),
        ("region_batch_span_check_all", [(1, 3), (2, 2)]),
        ("raft_conflict_first_index_all", [(101, 1, 101), (102, 1, 101), (205, 2, 205)]),
        ("raft_log_freshness_all", [(1, 7, 2, 3, True), (3, 7, 2, 3, False), (5, 7, 2, 3, True), (8, 7, 2, 4, True), (9, 7, 2, 3, False)]),
        ("read_index_quorum_all", [(1, 3)]),
        ("read_index_wait_apply_all", [(2003, 2033), (2033, 2063), (2063, 2093), (2093, 2123), (2123, 2153)]),
    ],
)
def test_whole_table(spark, folder, name, want):
    columns = {"kv_batch_sequence_all": ["l_orderkey", "l_linenumber", "l_partkey", "seq"], "raft_conflict_first_index_all": ["idx", "term", "first_idx"]}
    df = registry.queries()[name](spark, folder)
    assert rows(df, *columns.get(name, df.columns)) == want
