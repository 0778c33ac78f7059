"""Processing only new or changed records, with state that switches atomically."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import digest
from ..session import materialise
from ..sources.commits import CommitLog
from ..sources.parts import KeyedParts
from . import mvcc
from .asof import next_at_or_after


class IncrementalState:
    """Keys and content hashes of everything processed so far, version by version.

    A run calls ``pending`` and processes what it returns, then ``commit``. A
    run that fails before its commit leaves the state as it was, so the next
    one sees the same records again; a committed record comes back only if its
    content hash has changed. State is written per version (only keys that a
    run processed) in parts that are merged by size.

    Of the rows with one key ``pending`` returns one, the one with the largest
    hash, and ``commit`` records the same one, so rows that repeat a key with
    differing contents settle after one commit. NULL keys are keys of their own,
    unless ``null_keys`` is False: then rows with a NULL key must not occur and
    joins keep the partitioning of the keys. NULL and empty contents differ; an
    empty table gives nothing and can be committed. ``carried`` columns (of
    fixed size) are remembered with the hash and come back as ``was_...``.
    """

    def __init__(
        self, spark: SparkSession, path: str, key_cols: Sequence[str], content_cols: Sequence[str], carried: Sequence[str] = (), null_keys: bool = True
    ):
        self.spark, self.path = spark, path
        self.keys, self.content, self.carried, self.null_keys = list(key_cols), list(content_cols), list(carried), null_keys
        self.log = CommitLog(spark, path)
        self.parts = KeyedParts(spark, f"{path}/state", self.keys, ["__h1", "__h2", *self.carried])

    def _hashed(self, rows: DataFrame) -> DataFrame:
        h1, h2 = digest(*self.content)
        return mvcc.newest(rows.withColumns({"__h1": h1, "__h2": h2}), self.keys, "__h1")

    def committed(self) -> dict:
        """What the newest commit says."""
        version = self.log.current()
        return self.log.read(version) if version else {"parts": []}

    def known(self) -> DataFrame | None:
        return self.parts.read(self.committed()["parts"])

    def pending(self, current: DataFrame) -> DataFrame:
        """One row per key of ``current`` that is new or changed, with ``change`` saying which."""
        rows = self._hashed(current)
        state = self.known()
        was = [f"was_{c}" for c in self.carried]
        if state is None:
            return rows.withColumns({"change": F.lit("new")} | {w: F.lit(None).cast(current.schema[c].dataType) for w, c in zip(was, self.carried, strict=True)})
        names = {k: f"__k{i}" for i, k in enumerate(self.keys)}
        state = state.select(
            *(F.col(k).alias(n) for k, n in names.items()), F.col("__h1").alias("__s1"), F.col("__h2").alias("__s2"),
            *(F.col(c).alias(w) for c, w in zip(self.carried, was, strict=True)),
        )
        same = [F.col(k).eqNullSafe(F.col(n)) if self.null_keys else F.col(k) == F.col(n) for k, n in names.items()]
        change = F.when(F.col("__s1").isNull(), "new").when(
            (F.col("__s1") != F.col("__h1")) | (F.col("__s2") != F.col("__h2")), "changed"
        )
        return rows.join(state, reduce(lambda a, b: a & b, same), "left").withColumn("change", change).filter(F.col("change").isNotNull()).drop(
            *names.values(), "__s1", "__s2"
        )

    def commit(self, processed: DataFrame, note: dict | None = None) -> int:
        """Record rows that came from ``pending`` as processed; returns the new version.

        ``note`` is committed with it: results that it names and the state that
        accounts for them become visible at once.
        """
        version = self.log.current() + 1
        rows = mvcc.newest(processed, self.keys, "__h1") if "__h1" in processed.columns else self._hashed(processed)
        parts = self.parts.append(self.committed()["parts"], self.parts.write(rows, version))
        self.log.commit(version, (note or {}) | {"parts": parts})
        return version


#: Log indexes per bucket of the commit lookup and microseconds per bucket of the run lookup.
INDEX_BUCKET = 1 << 16
TIME_BUCKET_US = 3_600_000_000
#: Tasks over which the entries of one region and hour are spread: one per so many arrivals of the
#: whole log, within these bounds.
SALTS, MOST_SALTS, SALT_ROWS = 8, 1024, 4_000_000


def arrivals(log: DataFrame, messages: DataFrame) -> DataFrame:
    """What came in of each entry and when: (region_id, idx, term, us, a, b) with ``committed_us``.

    ``a`` and ``b`` are sums of the row hashes of those distinct commands of the
    entry that were received first at ``us``; an entry that came whole is one
    row. ``committed_us`` is when first a message told a commit index that covers
    the index, NULL if none did. Rows with a NULL region, index or term are left
    out; a NULL time is never.
    """
    h1, h2 = digest("pos", "cmd_type", "cf", "key", "value")
    rows = log.select(
        "region_id", "idx", "term", F.unix_micros(F.col("received_at").cast("timestamp")).alias("us"), h1.alias("a"), h2.alias("b")
    ).filter("region_id IS NOT NULL AND idx IS NOT NULL AND term IS NOT NULL")
    # One partitioning, by the entry's place in the log, for both aggregates and the lookup's probes.
    commands = rows.repartition("region_id", "idx").groupBy("region_id", "idx", "term", "a", "b").agg(F.min("us").alias("us"))
    came = commands.groupBy("region_id", "idx", "term", "us").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    commits = messages.select(
        "region_id", "commit_index", F.unix_micros(F.col("received_at").cast("timestamp")).alias("told_us")
    ).filter("region_id IS NOT NULL AND commit_index IS NOT NULL AND told_us IS NOT NULL")
    return next_at_or_after(
        materialise(came, "came"),
        commits,
        ["region_id"],
        "idx",
        "commit_index",
        F.col("told_us"),
        lambda c: F.floor(c / INDEX_BUCKET),
        name="committed_us",
        best_of_all=True,
    )


def entries_at(came: DataFrame, until_us: int) -> DataFrame:
    """The log as it stood at ``until_us``: per index received and committed by then its entry of the highest term.

    ``content_a`` and ``content_b`` are sums of the hashes of its distinct
    commands. ``due_us`` is when the entry was received first and known to be
    committed, ``whole_us`` when the last of its commands was.
    """
    seen = came.filter((F.col("us") <= until_us) & (F.col("committed_us") <= until_us))
    # Both aggregates use this one partitioning.
    per_term = seen.repartition("region_id", "idx").groupBy("region_id", "idx", "term").agg(
        F.min("us").alias("us"), F.max("us").alias("last_us"), F.bit_xor("a").alias("content_a"), F.bit_xor("b").alias("content_b"),
        F.min("committed_us").alias("committed_us"),
    )
    top = mvcc.newest(per_term, ["region_id", "idx"], "term")
    return top.select(
        "region_id", "idx", "term", "content_a", "content_b",
        F.greatest("us", "committed_us").alias("due_us"), F.greatest("last_us", "committed_us").alias("whole_us"),
    )


def succeeded_runs(reports: DataFrame) -> DataFrame:
    """One row (run_id, region_id, started_us) per run that any report calls succeeded."""
    started = F.unix_micros(F.col("started_at").cast("timestamp"))
    return (
        reports.filter("run_id IS NOT NULL AND region_id IS NOT NULL")
        .groupBy("run_id", "region_id")
        .agg(F.min(started).alias("started_us"), F.max((F.col("status") == "succeeded").cast("int")).alias("ok"))
        .filter("ok = 1 AND started_us IS NOT NULL")
        .drop("ok")
    )


def assign_to_runs(entries: DataFrame, runs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each due entry with the first run of its region started no earlier than ``due_us``."""
    return next_at_or_after(
        entries,
        runs,
        ["region_id"],
        "due_us",
        "started_us",
        F.col("run_id"),
        lambda c: F.floor(c / TIME_BUCKET_US),
        salts=salts,
        salt=F.xxhash64("idx"),
        name="run_id",
    ).filter(F.col("run_id").isNotNull())


_RAN = "run_id bigint, region_id bigint, idx bigint, term bigint, change string, was_term bigint"


def process_runs(log: DataFrame, messages: DataFrame, reports: DataFrame, path: str, waves: int = 2) -> DataFrame:
    """What every successful run processed: (run_id, region_id, idx, term, change, was_term).

    Runs are taken in ``waves`` of starting time. A wave looks at the log as it
    stood at its end, hashes the entries, joins them with the committed state and
    so selects those that are new or whose content has changed since a run
    processed them: replaced by an entry of a higher term, or completed by a
    command that came late. Each goes to its first successful run (a changed one of the
    same term once it is whole). The assignment is written, and state and
    assignment become visible in one commit. A wave that failed is repeated
    as a whole, and a call over the same path goes on after the last committed
    one. A failed run gets nothing: its entries stay pending for the next.
    """
    spark = log.sparkSession
    came = materialise(arrivals(log, messages), "arrivals")
    runs = materialise(succeeded_runs(reports), "runs")
    low, high = runs.agg(F.min("started_us"), F.max("started_us")).first()
    state = IncrementalState(spark, path, ["region_id", "idx"], ["term", "content_a", "content_b"], carried=["term"], null_keys=False)
    outputs = state.committed().get("outputs", [])
    if low is None:
        return spark.createDataFrame([], _RAN)
    step = (high - low) // waves + 1
    salts = min(MOST_SALTS, max(SALTS, came.count() // SALT_ROWS))
    for w in range(len(outputs), waves):
        of_wave = runs.filter(F.floor((F.col("started_us") - F.lit(low)) / F.lit(step)) == w)
        pending = state.pending(entries_at(came, low + step * (w + 1) - 1))
        late = (F.col("change") == "changed") & (F.col("was_term") == F.col("term"))
        pending = pending.withColumn("due_us", F.when(late, F.col("whole_us")).otherwise(F.col("due_us")))
        pending = materialise(pending, "pending")  # the lookup reads it twice
        name = f"{path}/runs/{uuid.uuid4().hex}"
        assign_to_runs(pending, of_wave, salts).write.parquet(name)
        outputs = [*outputs, name]
        state.commit(spark.read.parquet(name), {"outputs": outputs})
    return spark.read.parquet(*outputs).select("run_id", "region_id", "idx", "term", "change", "was_term")


def due_once(ran: DataFrame, log: DataFrame) -> DataFrame:
    """(run_id, region_id, idx): of what runs processed the first time of each entry that holds in the end.

    Left out are entries that a higher term has replaced by the end of the log,
    and returns of an entry whose commands came late.
    """
    first = ran.filter((F.col("change") == "new") | (F.col("was_term") < F.col("term")))
    top = log.filter("region_id IS NOT NULL AND idx IS NOT NULL").groupBy("region_id", "idx").agg(F.max("term").alias("term"))
    return first.join(top, ["region_id", "idx", "term"], "left_semi").select("run_id", "region_id", "idx")
