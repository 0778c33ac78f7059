"""Requests as tables: routing keys, dispatch, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup
from . import regions

GET, PUT, DELETE, SCAN = 1, 2, 3, 4

# Texts of refusals, in the order in which they are checked.
NO_KEY = "a command lacks its key"
NO_REGION = "no region holds the key"
UNKNOWN = "unknown command"
NOT_ALONE = "a read is a request of its own"
NOT_WRITES = "a batch holds puts and deletes only"
NO_VALUE = "a command lacks its key or value"
SPANS = "a batch must stay in one region"


def request_key(cmd_type: Column, key: Column, start_key: Column) -> Column:
    """The key by which a command is routed: the start of a scan, else its key; NULL for a command that has none."""
    return F.when(cmd_type == SCAN, start_key).when(cmd_type.isin(GET, PUT, DELETE), key)


def retryable(leader: Column, error: Column) -> Column:
    """Whether another node may answer better: a leader is hinted at, or the node says that it isn't one."""
    return (F.coalesce(leader, F.lit(0)) != 0) | F.coalesce(error.contains("not leader"), F.lit(False))


def answers(commands: DataFrame, region_map: DataFrame, request_col: str = "batch_id", order_col: str = "req_no") -> DataFrame:
    """One answer per request: ``results`` (their number), ``error`` (NULL for success), and the region with bounds and leader.

    A request is the commands with one ``request_col``, in the order of
    ``order_col``; a command delivered again counts once. It is dispatched by its
    first command: one Get, one Scan, or a batch of Puts and Deletes whose keys
    lie in one region; a write has one (empty) result per command. Requests
    without number are left out. Aggregates combine before the shuffle, so a
    request with most of the commands is no burden.
    """
    cmd = F.col("cmd_type")
    same = F.xxhash64(*(x for c in ("cmd_type", "cf", "key", "value", "start_key", "scan_limit") for x in (F.isnull(c), F.col(c))))
    rows = commands.filter(F.col(request_col).isNotNull()).withColumn("__k", request_key(cmd, F.col("key"), F.col("start_key")))
    bounds = region_map.select("region_id", "start_key", "end_key", "leader")
    routed = regions.route(
        rows.select(request_col, order_col, cmd.alias("__cmd"), "__k", same.alias("__same"), (cmd == PUT).__and__(F.col("value").isNull()).alias("__empty")), region_map, "__k", "__region"
    )
    fixed = [request_col, "__same"]
    once = routed.groupBy(*fixed).agg(
        F.min(order_col).alias("__at"), F.max("__cmd").alias("__cmd"), F.max("__region").alias("__region"),
        F.max(F.isnull("__k").cast("int")).alias("__nokey"), F.max(F.coalesce(F.col("__empty"), F.lit(False)).cast("int")).alias("__empty"),
    )
    per = once.groupBy(request_col).agg(
        F.min_by("__cmd", "__at").alias("first"), F.min_by("__nokey", "__at").alias("nokey"), F.min_by("__region", "__at").alias("region_id"),
        F.count(F.lit(1)).alias("n"), F.sum((~F.coalesce(F.col("__cmd").isin(PUT, DELETE), F.lit(False))).cast("int")).alias("others"),
        F.max(F.greatest("__nokey", "__empty")).alias("lacking"), F.min("__region").alias("low"), F.max("__region").alias("high"),
        F.max((F.isnull("__region") & (F.col("__nokey") == 0)).cast("int")).alias("outside"),
    )
    write = F.col("first").isin(PUT, DELETE)
    error = (
        F.when(F.col("nokey") == 1, NO_KEY).when(F.col("region_id").isNull(), NO_REGION).when(~F.col("first").isin(GET, PUT, DELETE, SCAN), UNKNOWN)
        .when(~write & (F.col("n") > 1), NOT_ALONE).when(write & (F.col("others") > 0), NOT_WRITES).when(write & (F.col("lacking") == 1), NO_VALUE)
        .when(write & ((F.col("low") != F.col("high")) | (F.col("outside") == 1)), SPANS)
    )
    judged = per.select(request_col, "region_id", error.alias("error"), F.when(error.isNull(), F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("results"))
    table, _ = lookup(bounds, "region-bounds")
    return judged.join(table, "region_id", "left").select(request_col, "results", "error", "region_id", "start_key", "end_key", "leader")
