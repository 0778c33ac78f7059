"""Rebuilding a table from a feed of inserts, updates and deletes with delete vectors."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcastable, materialise
from ..sources.commits import CommitLog
from ..sources.parts import KeyedParts, to_merge, write_counted
from . import mvcc

PUT, DELETE = 2, 3

#: What the index tells of a key's newest change.
_WINNER = ["order", "place", "rank", "op", "file", "row"]


class DeleteVectorTable:
    """A keyed table of immutable image files plus one bitmap of dead rows per file.

    ``apply`` appends the images of a batch of changes, finds the rows they
    supersede through the index from key to (file, position), sets those bits
    and commits images, index and bitmaps as one new version. ``read`` filters
    the set positions while it scans the files. No image is ever rewritten.

    A change is (group, order, rank, place, op, key...): entries of a group are
    applied by ``order`` and then ``place``; of the entries with one order only
    those with the highest ``rank`` hold. Batches may bring changes late,
    repeatedly and in any order.

    What a batch costs follows its own size: beside the images there are two
    tables of the newest row per key, kept in parts that are merged by size: the
    highest rank of each entry, and for each key its newest change with the
    position of its image. A batch is compared with these two by one aggregate
    each. Bitmaps are written for the words of 64 rows that a batch touches, as
    masks over what was there. Only if a batch outranks an entry whose change
    was a key's newest one, older images of that key (and of no other) are read
    again, since one of them comes back.

    Defined results: operations other than put and delete change no key but
    still replace entries of lower rank; changes with a NULL key are treated so
    too; a NULL cf is a cf of its own; a NULL group, order, rank or place is refused by
    leaving the row out; an empty batch commits nothing; other columns of the
    feed are ignored unless named as ``value_cols``.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        group_col: str = "region_id",
        order_col: str = "idx",
        rank_col: str = "term",
        place_col: str = "pos",
        op_col: str = "cmd_type",
        key_cols: Sequence[str] = ("cf", "key"),
        value_cols: Sequence[str] = ("value",),
    ):
        self.spark, self.path = spark, path
        self.group, self.order, self.rank, self.place, self.op = group_col, order_col, rank_col, place_col, op_col
        self.keys, self.values = list(key_cols), list(value_cols)
        self.log = CommitLog(spark, path)
        self.ranks = KeyedParts(spark, f"{path}/ranks", ["group", "order"], ["top", "low", "was"])
        self.index = KeyedParts(spark, f"{path}/index", ["group", *self.keys], [*_WINNER, "was_file", "was_row"])

    # -- layout ---------------------------------------------------------------
    @property
    def _identity(self) -> list[str]:
        return [self.group, self.order, self.rank, self.place, self.op, *self.keys]

    def _images(self, names: Sequence[str]) -> DataFrame:
        """Images with their position; file names are unique over all batches."""
        return self.spark.read.parquet(*(f"{self.path}/images/{n}" for n in names)).select(
            *self._identity, *self.values, F.xxhash64(F.col("_metadata.file_name")).alias("__file"), F.col("_metadata.row_index").alias("__row")
        )

    def _changes(self, names: Sequence[str]) -> DataFrame:
        """The images without their values, under the names of the index."""
        return self._images(names).select(
            F.col(self.group).alias("group"), F.col(self.order).cast("bigint").alias("order"), F.col(self.rank).cast("bigint").alias("rank"),
            F.col(self.place).cast("int").alias("place"), F.col(self.op).alias("op"), *self.keys, F.col("__file").alias("file"), F.col("__row").alias("row"),
        )

    def _effective(self) -> Column:
        """Whether a row is a put or delete of a key."""
        return F.col("op").isin(PUT, DELETE) & F.col(self.keys[-1]).isNotNull()

    def _best(self, changes: DataFrame) -> DataFrame:
        """The newest change per key: a hash aggregate with a combine, so one key with most changes stays harmless."""
        ranked = changes.withColumn("__at", mvcc.packed(changes, ["order", "place"]))
        return ranked.groupBy("group", *self.keys).agg(*(F.max_by(c, "__at").alias(c) for c in _WINNER))

    def _same_key(self, prefix: str) -> Column:
        return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(["group", *self.keys])))

    def _key_as(self, rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select(*(F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(["group", *self.keys])))

    # -- write ----------------------------------------------------------------
    def apply(self, changes: DataFrame) -> int:
        """Apply one batch; returns the version that holds it."""
        version = self.log.current() + 1
        before = self.log.read(version - 1) if version > 1 else {"batches": [], "ranks": [], "index": [], "vectors": []}
        name = f"v{version}-{uuid.uuid4().hex}"  # a batch that failed leaves files that no version names
        need = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (self.group, self.order, self.rank, self.place)))
        # Repeated deliveries are appended too: all but one of them are dead rows.
        changes.select(*self._identity, *self.values).filter(need).write.parquet(f"{self.path}/images/{name}")
        new = self._changes([name])
        first, last = new.agg(F.min("order"), F.max("order")).first()
        if first is None:
            return version - 1

        ranked = self.ranks.write(self._ranked(new, before["ranks"], first, last), version)
        ranks = self.ranks.append(before["ranks"], ranked)
        entries = self.ranks.rows(ranked)
        # Entries of which the batch holds several ranks, or a lower one than was known, and those
        # that it outranks: mostly few, counted before they are broadcast (three numbers a row).
        several, outranked = entries.agg(F.count_if(F.col("low") < F.col("top")), F.count_if(F.col("was") < F.col("top"))).first()
        best = new.filter(self._effective())
        if several:
            best = self._holding(best, self._few(entries.filter("low < top"), several))
        best = self._best(best)
        again = self._outranked(self._few(entries.filter("was < top"), outranked), before["index"]) if outranked else None
        winners = self.index.write(self._winners(best, again, before, [*before["batches"], name], ranks), version)
        vector = self._vector(new, self.index.rows(winners), name)
        self.log.commit(
            version,
            {"batches": [*before["batches"], name], "ranks": ranks, "index": self.index.append(before["index"], winners), "vectors": self._append(before["vectors"], vector)},
        )
        return version

    @staticmethod
    def _few(entries: DataFrame, n: int) -> DataFrame:
        rows = entries.select("group", "order", "top")
        return F.broadcast(rows) if n <= BROADCAST_ROWS else rows

    def _ranked(self, new: DataFrame, parts: list[dict], first: int, last: int) -> DataFrame:
        """Per entry of the batch its highest rank ``top``, the lowest of the batch ``low`` and the highest before ``was``."""
        mine = new.groupBy("group", "order").agg(F.max("rank").alias("high"), F.min("rank").alias("low"))
        if not parts:
            return mine.select("group", "order", F.col("high").alias("top"), "low", F.lit(None).cast("bigint").alias("was"))
        none = F.lit(None).cast("bigint")
        known = self.ranks.read(parts).filter(F.col("order").between(first, last))
        both = mine.withColumn("was", none).unionByName(known.select("group", "order", none.alias("high"), none.alias("low"), F.col("top").alias("was")))
        merged = both.groupBy("group", "order").agg(F.max("high").alias("high"), F.max("low").alias("low"), F.max("was").alias("was"))
        return merged.filter("high IS NOT NULL").select("group", "order", F.greatest("high", "was").alias("top"), "low", "was")

    def _holding(self, rows: DataFrame, tops: DataFrame) -> DataFrame:
        """Rows whose entry is not among ``tops`` (group, order, top) or has the highest rank there."""
        joined = rows.join(tops, ["group", "order"], "left")
        return joined.filter(F.col("top").isNull() | (F.col("rank") == F.col("top"))).drop("top")

    def _outranked(self, raised: DataFrame, parts: list[dict]) -> DataFrame | None:
        """Keys whose newest change belonged to an entry that the batch has outranked; None if there are none."""
        keys = self.index.read(parts).join(raised, ["group", "order"]).filter(F.col("rank") < F.col("top"))
        keys = materialise(keys.select("group", *self.keys, F.col("file").alias("was_file"), F.col("row").alias("was_row")), "outranked")
        return None if keys.isEmpty() else keys

    def _winners(self, best: DataFrame, again: DataFrame | None, before: dict, batches: list[str], ranks: list[dict]) -> DataFrame:
        """Index rows that change: the newest change of a key and the position of the one before it."""
        long = F.lit(None).cast("bigint")
        if not before["index"]:
            return best.select("group", *self.keys, *_WINNER, long.alias("was_file"), long.alias("was_row"))
        known = self.index.read(before["index"])
        kinds = dict(best.dtypes)
        sides = best.select("group", *self.keys, *(F.col(c).alias(f"n_{c}") for c in _WINNER), *(F.lit(None).cast(kinds[c]).alias(f"o_{c}") for c in _WINNER)).unionByName(
            known.select("group", *self.keys, *(F.lit(None).cast(kinds[c]).alias(f"n_{c}") for c in _WINNER), *(F.col(c).alias(f"o_{c}") for c in _WINNER))
        )
        # Each side has one row per key: max only brings them together.
        both = sides.groupBy("group", *self.keys).agg(*(F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in "no" for c in _WINNER)).filter("n_order IS NOT NULL")
        later = F.col("o_order").isNull() | (F.col("n_order") > F.col("o_order")) | ((F.col("n_order") == F.col("o_order")) & (F.col("n_place") > F.col("o_place")))
        won = both.filter(later).select(
            "group", *self.keys, *(F.col(f"n_{c}").alias(c) for c in _WINNER), F.col("o_file").alias("was_file"), F.col("o_row").alias("was_row")
        )
        if again is None:
            return won
        asked = self._key_as(again, "__a")
        rows = self._changes(batches).filter(self._effective()).join(asked, self._same_key("__a"), "left_semi")
        found = self._best(self._holding(rows, self.ranks.read(ranks).select("group", "order", "top")))
        found = found.select(*(F.col(k).alias(f"__f{i}") for i, k in enumerate(["group", *self.keys])), *_WINNER)
        redone = again.join(found, self._same_key("__f"), "left").select("group", *self.keys, *_WINNER, "was_file", "was_row")
        return won.join(asked, self._same_key("__a"), "left_anti").unionByName(redone)

    # -- bitmaps ----------------------------------------------------------------
    def _vector(self, new: DataFrame, winners: DataFrame, name: str) -> dict:
        """Masks (file, word, judged, alive) of the batch: all its rows and the former newest ones are judged, the new ones live."""
        zero = F.lit(0).cast("bigint")

        def bits(rows: DataFrame, file: str, row: str, alive: Column) -> DataFrame:
            r = rows.filter(F.col(file).isNotNull()).select(F.col(file).alias("file"), F.col(row).alias("row"), alive.alias("lives"))
            mask = F.expr("shiftleft(1L, cast(row % 64 as int))")
            return r.select("file", F.expr("row div 64").alias("word"), mask.alias("judged"), F.when(F.col("lives"), mask).otherwise(zero).alias("alive"))

        no = F.lit(False)
        parts = [bits(new, "file", "row", no), bits(winners, "was_file", "was_row", no), bits(winners, "file", "row", F.col("op") == PUT)]
        masks = reduce(DataFrame.unionByName, parts).groupBy("file", "word").agg(F.bit_or("judged").alias("judged"), F.bit_or("alive").alias("alive"))
        return self._write_masks(masks, name)

    def _write_masks(self, masks: DataFrame, name: str) -> dict:
        return {"name": name, "rows": write_counted(masks, f"{self.path}/vectors/{name}")}

    def _folded(self, parts: list[dict]) -> DataFrame:
        """One mask per word from those of several versions: what a later one judges, it decides."""
        scans = [self.spark.read.parquet(f"{self.path}/vectors/{p['name']}") for p in parts]
        if len(scans) == 1:
            return scans[0]
        tagged = reduce(DataFrame.unionByName, [s.withColumn("part", F.lit(i)) for i, s in enumerate(scans)])
        # A word occurs once in a part; the parts are as many as the logarithm of the words.
        wide = tagged.groupBy("file", "word").agg(
            *(F.coalesce(F.bit_or(F.when(F.col("part") == i, F.col(c))), F.lit(0).cast("bigint")).alias(f"{c}{i}") for i in range(len(scans)) for c in ("judged", "alive"))
        )
        judged, alive = F.col("judged0"), F.col("alive0")
        for i in range(1, len(scans)):
            alive = alive.bitwiseAND(F.bitwise_not(F.col(f"judged{i}"))).bitwiseOR(F.col(f"alive{i}"))
            judged = judged.bitwiseOR(F.col(f"judged{i}"))
        return wide.select("file", "word", judged.alias("judged"), alive.alias("alive"))

    def _append(self, parts: list[dict], new: dict) -> list[dict]:
        kept, merged = to_merge(parts, new)
        return [*kept, self._write_masks(self._folded(merged), f"merged-{uuid.uuid4().hex}") if len(merged) > 1 else new]

    # -- read -----------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        """Present pairs of a version (default: newest): images whose bit is not set."""
        version = self.log.current() if version is None else version
        if version == 0:
            raise LookupError("nothing was applied yet")
        content = self.log.read(version)
        vectors = self._folded(content["vectors"])
        dead = F.expr("judged & ~alive")
        if len(content["vectors"]) > 1:
            vectors = materialise(vectors, "vectors")
        vectors = vectors.select(F.col("file").alias("__file"), F.col("word").alias("__word"), dead.alias("__dead")).filter("__dead <> 0")
        if broadcastable(vectors):
            vectors = F.broadcast(vectors)
        images = self._images(content["batches"]).withColumn("__word", F.expr("__row div 64"))
        bit = F.expr("shiftright(__dead, cast(__row % 64 as int)) & 1")
        return images.join(vectors, ["__file", "__word"], "left").filter(F.col("__dead").isNull() | (bit == 0)).select(
            self.group, *self.keys, *self.values, self.order, self.rank, self.place
        )


def rebuild(feed: DataFrame, path: str, slice_col: str | None = None, slices: int = 1, **columns) -> DeleteVectorTable:
    """Apply a whole feed in ``slices`` equal steps of ``slice_col`` and return the table."""
    table = DeleteVectorTable(feed.sparkSession, path, **columns)
    if slices <= 1 or slice_col is None:
        table.apply(feed)
        return table
    at = F.unix_micros(F.col(slice_col).cast("timestamp"))
    low, high = feed.agg(F.min(at), F.max(at)).first()
    low, high = low or 0, high or 0
    step = (high - low) // slices + 1
    part = F.coalesce(F.floor((at - F.lit(low)) / F.lit(step)), F.lit(slices - 1))
    for i in range(slices):
        table.apply(feed.filter(part == i))
    return table
