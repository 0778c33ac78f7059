"""A versioned key-value store on Parquet: atomic batches, snapshots, levels."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import levels, merge, mvcc
from .operators import regions as region_ops
from .schema import DELETE, LEVELS, MUTATION, PUT, AlreadyExists, Busy, Corruption, InvalidArgument, NotFound, StorageIOError
from .sources.commits import CommitLog, Leases, VersionConflict

KEYS = ["region_id", "cf", "key"]
#: What a batch of rows must have.
OPS = ["region_id", "cf", "key", "op", "value"]


@dataclass(frozen=True, eq=False)
class Snapshot:
    """A pinned sequence of one store; it is live as long as someone holds it, in whatever process."""

    store: str
    seq: int


class WriteBatch:
    """Puts and deletes in order, written as one commit."""

    def __init__(self):
        self.ops: list[tuple[int, str, bytearray, int, bytearray | None]] = []

    def put(self, region_id: int, cf: str, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((region_id, cf, bytearray(key), PUT, bytearray(value)))
        return self

    def delete(self, region_id: int, cf: str, key: bytes) -> WriteBatch:
        self.ops.append((region_id, cf, bytearray(key), DELETE, None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)


class Reads:
    """The reading side of a store, over ``_files_of`` (versions that may hold a range of keys) and ``versions``."""

    id: str
    #: What identifies a version, and what orders versions of equal sequence: a store numbers all of them.
    _unique, _ties = ("seq",), ()

    def versions(self) -> DataFrame:
        """All versions."""
        raise NotImplementedError

    @property
    def last_sequence(self) -> int:
        raise NotImplementedError

    def _of(self, region_id: int, cf: str | None, start: bytes = b"", end: bytes | None = None) -> DataFrame:
        return self.versions().filter((F.col("region_id") == region_id) & F.col("cf").eqNullSafe(F.lit(cf)))

    def snapshot(self) -> Snapshot:
        """Pin the current sequence."""
        return Snapshot(self.id, self.last_sequence)

    def _as_of(self, snapshot: Snapshot | int | None) -> int | None:
        if isinstance(snapshot, Snapshot):
            if snapshot.store != self.id:
                raise InvalidArgument("the snapshot belongs to another store")
            return snapshot.seq
        return snapshot

    def view(self, snapshot: Snapshot | int | None = None) -> DataFrame:
        """Visible pairs (region_id, cf, key, seq, op, value)."""
        return mvcc.latest(self.versions(), KEYS, "seq", F.col("op") == DELETE, self._as_of(snapshot), self._ties, self._unique)

    def get(self, region_id: int, cf: str, key: bytes, snapshot: Snapshot | int | None = None) -> bytes | None:
        """The value, or None for an absent or deleted key (an empty value is b'')."""
        row = mvcc.get(self._of(region_id, cf, key, key), KEYS, (region_id, cf, bytearray(key)), "seq", F.col("op") == DELETE, self._as_of(snapshot), ["op"]).first()
        return None if row is None else bytes(row.value)

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | int | None = None) -> DataFrame:
        """Asked (region_id, cf, key) rows with their value, NULL where absent."""
        return mvcc.multi_get(self.versions(), keys, KEYS, ["value"], "seq", F.col("op") == DELETE, self._as_of(snapshot), self._ties, self._unique)

    def scan(self, region_id: int, cf: str, start: bytes = b"", limit: int = 0, snapshot: Snapshot | int | None = None) -> DataFrame:
        """(key, value) of one region and family in key order from an inclusive start."""
        if limit < 0:
            raise InvalidArgument("limit must not be negative")
        rows = mvcc.scan(self._of(region_id, cf, start), KEYS, "seq", F.col("op") == DELETE, bytearray(start), limit, self._as_of(snapshot), self._ties, self._unique)
        return rows.select("key", "value")

    def region_snapshot(self, region_id: int, snapshot: Snapshot | int | None = None) -> DataFrame:
        return region_ops.snapshot_create(self.view(snapshot), region_id)

    def put(self, region_id: int, cf: str, key: bytes, value: bytes) -> int:
        return self.write(WriteBatch().put(region_id, cf, key, value))

    def delete(self, region_id: int, cf: str, key: bytes) -> int:
        return self.write(WriteBatch().delete(region_id, cf, key))

    def apply_region_snapshot(self, region_id: int, pairs: DataFrame) -> int:
        """Replace all pairs of a region by (cf, key, value) rows in one commit."""
        current = self.view().select("region_id", "cf", "key")
        rows = region_ops.snapshot_mutations(current, pairs, region_id, 0)
        return self.write(rows.drop("seq"), ["op", "cf", "key"])

    def write(self, batch: WriteBatch | DataFrame, order_by: list[str] | None = None) -> int:
        raise NotImplementedError

    def _numbered(self, batch: WriteBatch | DataFrame, order_by: list[str] | None, last: int) -> DataFrame | None:
        """Mutations of a batch with their sequences after ``last``; None for an empty batch of operations."""
        if isinstance(batch, WriteBatch):
            rows = [(*op[:3], i + 1 + last, op[3], op[4]) for i, op in enumerate(batch.ops)]
            return self.spark.createDataFrame(rows, MUTATION) if rows else None
        if not order_by:
            raise InvalidArgument("a table of operations needs an order")
        kept = list(dict.fromkeys([*OPS, *order_by]))
        numbered = merge.running_number(batch.select(*kept), order_by, first=last + 1)
        bad = numbered.filter(~F.coalesce(F.col("op").isin(PUT, DELETE), F.lit(False)) | F.col("key").isNull() | F.col("region_id").isNull())
        if not bad.limit(1).isEmpty():
            raise InvalidArgument("an operation is unknown or has no key or region")
        return numbered.select(*(F.col(f.name).cast(f.dataType) for f in MUTATION))


#: Bytes of rows that a data file is cut at, about; versions from one full list of files to the next.
FILE_BYTES = 128 << 20
FULL_EVERY = 16
#: Seconds that a snapshot or a writer's lock lives without being renewed.
SNAPSHOT_SECONDS, LOCK_SECONDS = 86_400.0, 600.0


class Store(Reads):
    """Sorted Parquet files in three levels, and a log of numbered manifests.

    A manifest says which files a version adds and removes, every sixteenth one
    lists all; each file has an entry with its range of keys, so that reads and
    compactions touch overlapping files only.

    A write appends files to level 0 and commits a manifest that names them; a
    reader works on the immutable files of one manifest up to one sequence. A
    failed job commits nothing. There is one writer at a time: of two that
    commit the same version one fails, and ``lock`` keeps others out from the start.
    Snapshots are leases in a folder of the store, so compactions and
    clean-ups of any process heed them. ``region_id`` and ``cf`` are columns, so no
    key of one family is ever taken for another's.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "either", lock: bool = False, file_bytes: int = FILE_BYTES):
        """``mode``: 'create' a new store, 'open' one that is there, or 'either'. ``lock``: raise Busy if another holds it."""
        if mode not in ("create", "open", "either"):
            raise InvalidArgument(f"no such mode: {mode}")
        self.spark, self.path, self.file_bytes = spark, path.rstrip("/"), file_bytes
        if not self.path:
            raise InvalidArgument("a store needs a path")
        self.log = CommitLog(spark, self.path)
        self.snapshots, self.locks = Leases(spark, f"{self.path}/_snapshots"), Leases(spark, f"{self.path}/_lock")
        self._failed: Exception | None = None
        self._closed = False
        self._held: weakref.WeakValueDictionary = weakref.WeakValueDictionary()
        self._full: tuple[int, dict[str, dict]] | None = None
        there = self.log.current() > 0
        if mode == "create" and there:
            raise AlreadyExists(self.path)
        if mode == "open" and not there:
            raise NotFound(self.path)
        if not there:
            if self._listed():
                raise Corruption("there are files but no manifest")
            self.log.commit(1, {"id": str(uuid.uuid4()), "last_seq": 0, "next_file": 1, "files": [], "applied": {}}, sync=True)
        self.id = self.log.read(self.log.current())["id"]
        self.locked = lock
        if lock and not self.locks.take("writer", {"store": self.id}, LOCK_SECONDS, overwrite=False):
            raise Busy(f"another writer holds {self.path}")
        try:
            self._verify()
        except Corruption:
            self.close()
            raise

    # -- files ------------------------------------------------------------------
    def _manifest(self, version: int) -> dict:
        """The manifest of a version with its whole list of ``files``."""
        out = self.log.read(version)
        if "files" in out:
            files = {f["name"]: f for f in out["files"]}
        else:
            steps, at = [out], version - 1
            while not (self._full and self._full[0] == at) and "files" not in (m := self.log.read(at)):
                steps.append(m)
                at -= 1
            files = dict(self._full[1]) if self._full and self._full[0] == at else {f["name"]: f for f in m["files"]}
            for m in reversed(steps):
                for n in m["removed"]:
                    files.pop(n, None)
                files |= {f["name"]: f for f in m["added"]}
        if self._full is None or self._full[0] <= version:
            self._full = (version, files)
        return out | {"files": list(files.values())}

    @property
    def manifest(self) -> dict:
        return self._manifest(self.log.current())

    @property
    def last_sequence(self) -> int:
        return self.log.read(self.log.current())["last_seq"]

    def close(self) -> None:
        """Give the lock and the snapshots back; nothing can be written after that. A job that runs ends by itself."""
        self._closed = True
        for name in list(self._held):
            self.snapshots.release(name)
        if self.locked:
            self.locks.release("writer")
            self.locked = False

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> dict[str, int]:
        """Size of every data file, by its name within ``data``."""
        root, fs = self._fs()
        out: dict[str, int] = {}
        if fs.exists(root):
            files = fs.listFiles(root, True)
            while files.hasNext():
                f = files.next()
                if f.getPath().getName().endswith(".parquet"):
                    out[f"{f.getPath().getParent().getName()}/{f.getPath().getName()}"] = f.getLen()
        return out

    def _verify(self) -> None:
        """All files of the manifest are there with the recorded size."""
        listed = self._listed()
        wrong = [f["name"] for f in self.manifest["files"] if listed.get(f["name"]) != f["file_size"]]
        if wrong:
            raise Corruption(f"files are missing or have another size: {wrong[:5]}")

    def _rows(self, files: Iterable[dict]) -> DataFrame:
        paths = [f"{self.path}/data/{f['name']}" for f in files]
        if not paths:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).parquet(*paths)

    def _write_files(self, rows: DataFrame, number: int, level: int) -> list[dict]:
        """Sorted Parquet files of about ``file_bytes`` with a Bloom filter on the key, and what the manifest tells of each.

        Rows are range-partitioned by key. In level 0, where files may share keys, the
        sequence takes part, so that a key with most of the writes is cut too;
        below it a file ends between keys only, as its readers expect.
        """
        folder = f"{number:06d}.sst"
        size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + F.length(F.coalesce("cf", F.lit(""))) + 24
        files = max(1, -(-(rows.agg(F.sum(size)).first()[0] or 0) // self.file_bytes))
        cut = [*KEYS, F.col("seq").desc()] if level == 0 else KEYS
        (
            rows.select(*MUTATION.fieldNames()).repartitionByRange(files, *cut)
            .sortWithinPartitions(*KEYS, F.col("seq").desc())
            .write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/data/{folder}")
        )
        key = F.struct(*KEYS)
        stats = self.spark.read.schema(MUTATION).parquet(f"{self.path}/data/{folder}").groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("file_size")).agg(
            F.count(F.lit(1)).alias("rows"), F.max("seq").alias("high"), F.min(key).alias("smallest"), F.max(key).alias("largest")
        )
        return sorted(
            ({"name": f"{folder}/{r.name}", "file_size": r.file_size, "level": level, "rows": r.rows, "high": r.high, "smallest": _bound(r.smallest), "largest": _bound(r.largest)} for r in stats.toLocalIterator()),
            key=lambda f: f["smallest"],
        )

    def _commit(self, version: int, manifest: dict, added: list[dict], removed: set[str], sync: bool = False) -> None:
        """Commit what a version changes, or all files each ``FULL_EVERY`` versions."""
        head = {k: v for k, v in manifest.items() if k not in ("files", "added", "removed")}
        files = [f for f in manifest["files"] if f["name"] not in removed] + added
        body = {"files": files} if version % FULL_EVERY == 0 else {"added": added, "removed": sorted(removed)}
        if self._closed:
            raise StorageIOError("the store is closed")
        if self.locked:
            self.locks.take("writer", {"store": self.id}, LOCK_SECONDS)
        try:
            self.log.commit(version, head | body, sync)
        except VersionConflict as e:
            raise StorageIOError(f"another writer committed to {self.path}") from e
        self._full = (version, {f["name"]: f for f in files})

    def _guarded(self, work):
        """Run a maintenance job; its first failure stops all later writes."""
        if self._failed:
            raise StorageIOError("an earlier job failed") from self._failed
        try:
            return work()
        except Exception as e:
            self._failed = e
            raise

    # -- writes -------------------------------------------------------------------
    def write(self, batch: WriteBatch | DataFrame, order_by: list[str] | None = None, txn: tuple[str, int] | None = None, sync: bool = False) -> int:
        """Write a batch atomically; its i-th operation gets the sequence after the i-1-th. Returns the last sequence.

        A table has columns region_id, cf, key, op, value, in the order of
        ``order_by``. ``txn`` (name, number) makes a repeated write of a number up to
        the last one a no-op. ``sync`` forces the commit to disk before it counts.
        An empty batch changes nothing.
        """
        if self._failed:
            raise StorageIOError("an earlier job failed") from self._failed
        if self._closed:
            raise StorageIOError("the store is closed")
        version = self.log.current()
        m = self._manifest(version)
        if txn and m["applied"].get(txn[0], -1) >= txn[1]:
            return m["last_seq"]
        numbered = self._numbered(batch, order_by, m["last_seq"])
        if numbered is None:
            return m["last_seq"]
        new = self._write_files(numbered, m["next_file"], 0)
        m["next_file"] += 1
        m["last_seq"] = max([m["last_seq"], *(f["high"] for f in new)])
        if txn:
            m["applied"][txn[0]] = txn[1]
        self._commit(version + 1, m, new, set(), sync)
        return m["last_seq"]

    def apply_region_snapshot(self, region_id: int, pairs: DataFrame) -> int:
        """Replace all pairs of a region by (cf, key, value) rows in one commit that is forced to disk."""
        current = self.view().select("region_id", "cf", "key")
        rows = region_ops.snapshot_mutations(current, pairs, region_id, 0)
        return self.write(rows.drop("seq"), ["op", "cf", "key"], sync=True)

    # -- reads ----------------------------------------------------------------------
    def snapshot(self, seconds: float = SNAPSHOT_SECONDS) -> Snapshot:
        """Pin the current sequence; compactions and clean-ups of any process keep what it sees.

        It lives while it is referenced, and ``seconds`` at most if its process is lost.
        """
        version = self.log.current()
        s, name = Snapshot(self.id, self.log.read(version)["last_seq"]), uuid.uuid4().hex
        self.snapshots.take(name, {"seq": s.seq, "version": version}, seconds)
        self._held[name] = s
        weakref.finalize(s, _released, self.snapshots, name)
        return s

    def versions(self) -> DataFrame:
        """All versions of the current manifest."""
        return self._rows(self.manifest["files"])

    def _of(self, region_id: int, cf: str | None, start: bytes = b"", end: bytes | None = None) -> DataFrame:
        """Versions of one region and family from the files whose range may hold keys from start to end (inclusive)."""
        low, high = _bound((region_id, cf, start)), None if end is None else _bound((region_id, cf, end))
        top = _bound((region_id, cf, b""))[:3]
        files = [
            f for f in self.manifest["files"]
            if f["largest"] >= low and (f["smallest"] <= high if high is not None else f["smallest"][:3] <= top)
        ]
        return self._rows(files).filter((F.col("region_id") == region_id) & F.col("cf").eqNullSafe(F.lit(cf)))

    # -- maintenance ------------------------------------------------------------------
    def oldest_snapshot(self) -> int:
        """The least sequence of all live snapshots, else the last one."""
        return min((s["seq"] for s in self.snapshots.live().values()), default=self.last_sequence)

    def _pick(self, files: list[dict], force: bool, l0_files: int, l1_bytes: int) -> tuple[int, list[dict], list[dict]] | None:
        """(level, its inputs, files of the next level that they overlap), or None if nothing is due."""
        by = {lv: sorted((f for f in files if f["level"] == lv), key=lambda f: f["smallest"]) for lv in range(LEVELS)}
        writes = {f["name"].split("/")[0] for f in by[0]}
        if len(writes) >= l0_files or (force and by[0]):
            level, inputs = 0, by[0]
        elif sum(f["file_size"] for f in by[1]) >= l1_bytes or (force and by[1]):
            level, inputs = 1, by[1][:1]
        else:
            return None
        low, high = min(f["smallest"] for f in inputs), max(f["largest"] for f in inputs)
        return level, inputs, [f for f in by[level + 1] if f["smallest"] <= high and low <= f["largest"]]

    def compact(self, force: bool = False, l0_files: int = levels.L0_FILES, l1_bytes: int = levels.L1_BYTES) -> int | None:
        """Merge what is due into the next level (or the first there is, with ``force``); returns the level merged.

        Due are all writes of level 0 from ``l0_files`` on, else the first file of
        level 1 from ``l1_bytes`` on; only files of the next level that overlap are
        rewritten. Versions that no snapshot sees go, and so do deletions whose
        key no deeper level holds.
        """

        def work() -> int | None:
            version = self.log.current()
            m = self._manifest(version)
            picked = self._pick(m["files"], force, l0_files, l1_bytes)
            if picked is None:
                return None
            level, inputs, overlap = picked
            rows = self._rows(inputs + overlap)
            merge.require_unique(rows, [*KEYS, "seq", "op"])
            low, high = min(f["smallest"] for f in inputs + overlap), max(f["largest"] for f in inputs + overlap)
            deeper = self._rows(f for f in m["files"] if f["level"] > level + 1 and f["smallest"] <= high and low <= f["largest"])
            oldest, deleted = self.oldest_snapshot(), F.col("op") == DELETE
            kept = levels.collect_garbage(rows, KEYS, "seq", "op", deleted, oldest, unique=["seq"])
            kept = levels.drop_base_tombstones(kept, deeper, KEYS, deleted & (F.col("seq") <= oldest))
            new = self._write_files(kept, m["next_file"], level + 1)
            m["next_file"] += 1
            self._commit(version + 1, m, new, {f["name"] for f in inputs + overlap}, sync=True)
            return level

        return self._guarded(work)

    def clean(self, keep_versions: int = 1) -> list[str]:
        """Delete data files that none of the newest ``keep_versions`` manifests names, nor one that a live snapshot reads; returns their names."""
        versions = self.log.versions()[-max(1, keep_versions) :]
        read = {s["version"] for s in self.snapshots.live().values()}
        needed = {f["name"] for v in {*versions, *read} for f in self._manifest(v)["files"]}
        gone = sorted(n for n in self._listed() if n not in needed)
        _, fs = self._fs()
        for n in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{n}"), False)
        return gone


def _released(leases: Leases, name: str) -> None:
    try:
        leases.release(name)
    except Exception:  # the session is gone; the lease expires
        pass


def _bound(key) -> list:
    """A key (region, family, bytes) as a JSON list that sorts like the rows: NULL family first, bytes as hexadecimal."""
    region_id, cf, raw = key
    return [region_id, cf is not None, cf or "", bytes(raw).hex()]


class MemoryStore(Reads):
    """The same store over tables of mutations that are not kept: for tests and small states.

    Writes have the semantics of ``Store``: batches are atomic and numbered, a
    snapshot is a sequence. ``mutations`` may hold versions to begin with.
    """

    _unique, _ties = (*KEYS, "seq", "op"), ("op",)

    def __init__(self, spark: SparkSession, mutations: DataFrame | None = None):
        self.spark, self.id = spark, str(uuid.uuid4())
        self._parts = [] if mutations is None else [mutations.select(*MUTATION.fieldNames())]
        self._last = 0 if mutations is None else mutations.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    @property
    def last_sequence(self) -> int:
        return self._last

    def versions(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._parts) if self._parts else self.spark.createDataFrame([], MUTATION)

    def write(self, batch: WriteBatch | DataFrame, order_by: list[str] | None = None) -> int:
        numbered = self._numbered(batch, order_by, self._last)
        if numbered is not None:
            last = numbered.agg(F.max("seq")).first()[0]
            if last is not None:
                self._parts.append(numbered)
                self._last = last
        return self._last
