"""Queries that run whole paths of store, files and client, and what must come out of them as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import client
from ..functions import codec
from ..operators import levels, merge, raftlog, regions
from ..schema import StoreError
from ..session import load, materialise, shared_path
from ..sources import tables, wal
from ..store import KEYS, MemoryStore, Store, WriteBatch
from ..streaming import apply
from . import store_queries
from .store_queries import _WRITES, _writes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_NEWEST = f"n AS (SELECT *, row_number() OVER (PARTITION BY region_id, cf, key ORDER BY req_no DESC) AS rn FROM ({_WRITES}) w)"


def _slices(ops: DataFrame, n: int) -> list[DataFrame]:
    """A table of operations in ``n`` ranges of its order."""
    low, high = ops.agg(F.min("req_no"), F.max("req_no")).first()
    step = ((high or 0) - (low or 0)) // n + 1
    return [ops.filter(F.floor((F.col("req_no") - F.lit(low or 0)) / F.lit(step)) == i) for i in range(n)]


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("region_id", "cf", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


# -- stores ----------------------------------------------------------------------------------
@query(store_queries.SQL["store_view"])
def memory_store_view(spark: SparkSession, d: str) -> DataFrame:
    """The second backend after the same writes in two batches."""
    store = MemoryStore(spark)
    for part in _slices(_writes(spark, d), 2):
        store.write(part, ["req_no"])
    return _shown(store.view())


@query(f"WITH {_NEWEST} SELECT hex(key) AS key_hex, hex(coalesce(value, ''::BLOB)) AS value_hex FROM n WHERE rn = 1 AND cmd_type = 2 AND region_id = 1 AND cf = 'default' AND key >= 'b'::BLOB")
def store_region_scan(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one region and family from a start key on, in a store of three writes, one of them compacted."""
    store = Store(spark, shared_path(spark, "store"), "create")
    for i, part in enumerate(_slices(_writes(spark, d), 3)):
        store.write(part, ["req_no"])
        if i == 1:
            store.compact(force=True)
    return store.scan(1, "default", b"b").select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"))


@query(f"""
WITH {_NEWEST}, a AS (SELECT DISTINCT coalesce(region_id, 0) AS region_id, cf, key FROM requests WHERE cmd_type = 1 AND key IS NOT NULL)
SELECT a.region_id, a.cf, hex(a.key) AS key_hex, CASE WHEN n.cmd_type = 2 THEN hex(coalesce(n.value, ''::BLOB)) END AS value_hex
FROM a LEFT JOIN n ON n.rn = 1 AND n.region_id = a.region_id AND n.cf IS NOT DISTINCT FROM a.cf AND n.key = a.key
""")
def store_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """The values of all keys that Gets ask for."""
    store = Store(spark, shared_path(spark, "store"), "create")
    store.write(_writes(spark, d), ["req_no"])
    asked = load(spark, d, "requests").filter("cmd_type = 1 AND key IS NOT NULL").select(F.coalesce("region_id", F.lit(store_queries.NO_REGION)).alias("region_id"), "cf", "key")
    return _shown(store.multi_get(asked))


@query("SELECT * FROM (VALUES (1, -1, 1), (2, -1, 2), (3, -1, 3), (4, 0, 0), (5, -1, 1), (6, 1, 1)) t(step, picked, writes)")
def store_picks(spark: SparkSession, d: str) -> DataFrame:
    """What the store picks after each of five writes (all of level 0 with the fourth), and then under a budget that level 1 exceeds."""
    store, out = Store(spark, shared_path(spark, "store"), "create"), []
    writes = lambda: len({f["name"].split("/")[0] for f in store.manifest["files"] if f["level"] == 0})
    for i, part in enumerate(_slices(_writes(spark, d), 5)):
        store.write(part, ["req_no"])
        picked = store.compact()
        out.append((i + 1, -1 if picked is None else picked, writes()))
    picked = store.compact(l1_bytes=1)
    out.append((6, -1 if picked is None else picked, writes()))
    return spark.createDataFrame(out, "step int, picked int, writes int")


#: Target of a data file, and how far the number of files may stay behind the ideal one.
CUT_BYTES, CUT_SLACK = 8 << 10, 4


@query(f"WITH {_NEWEST} SELECT count(*) AS pairs, true AS cut, true AS disjoint, true AS hot_key_cut FROM n WHERE rn = 1 AND cmd_type = 2")
def store_files_cut(spark: SparkSession, d: str) -> DataFrame:
    """Files of about a target size: in level 0 also within the key that has most writes, below it between keys only."""
    store = Store(spark, shared_path(spark, "store"), "create", file_bytes=CUT_BYTES)
    ops = materialise(_writes(spark, d), "writes")
    store.write(ops, ["req_no"])
    top = ops.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("value"), F.lit(0)) + F.length("key") + 24).alias("bytes")).orderBy(F.desc("n")).first()
    spans = store.manifest["files"]
    at = [top.region_id, top.cf is not None, top.cf or "", bytes(top.key).hex()] if top else None
    hot = sum(f["smallest"] <= at <= f["largest"] for f in spans) if at else 0
    store.compact(force=True)
    files = sorted(store.manifest["files"], key=lambda f: f["smallest"])
    rows = store.versions()
    size = rows.agg(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 24)).first()[0] or 0
    disjoint = all(a["largest"] < b["smallest"] for a, b in zip(files, files[1:], strict=False))
    return store.view().agg(F.count(F.lit(1)).alias("pairs")).select(
        "pairs", F.lit(len(files) >= size // (CUT_BYTES * CUT_SLACK)).alias("cut"), F.lit(disjoint).alias("disjoint"),
        F.lit(top is None or hot >= max(1, top.bytes // (CUT_BYTES * CUT_SLACK))).alias("hot_key_cut"),
    )


_STEPS = (
    ("create twice", "already_exists"), ("open nothing", "not_found"), ("lock held", "busy"), ("foreign snapshot", "invalid_argument"),
    ("missing file", "corruption"), ("job failed", "io_error"), ("write after failure", "io_error"), ("reopened", "1"), ("write after close", "io_error"),
    ("synced write", "2"), ("repeated transaction", "3"), ("two writers", "io_error"), ("files without manifest", "corruption"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _STEPS) + ") t(step, outcome)")
def store_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What opening, locking, failing, closing and reopening a store end in."""
    path, out = shared_path(spark, "store"), []

    def step(name, work):
        try:
            out.append((name, str(work())))
        except StoreError as e:
            out.append((name, e.code))

    store = Store(spark, path, "create", lock=True)
    step("create twice", lambda: Store(spark, path, "create"))
    step("open nothing", lambda: Store(spark, shared_path(spark, "store"), "open"))
    step("lock held", lambda: Store(spark, path, "open", lock=True))
    other = Store(spark, shared_path(spark, "store"), "create")
    step("foreign snapshot", lambda: store.get(1, "c", b"k", other.snapshot()))
    other.put(1, "c", b"k", b"v")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{other.path}/data")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    step("missing file", lambda: Store(spark, other.path))
    store.put(1, "c", b"k", b"v")
    store._rows, kept = (lambda files: (_ for _ in ()).throw(StorageIOFailure("disk"))), store._rows
    step("job failed", lambda: store.compact(force=True))
    store._rows = kept
    step("write after failure", lambda: store.put(1, "c", b"k", b"w"))
    store.close()
    again = Store(spark, path, "open", lock=True)
    step("reopened", lambda: again.last_sequence)
    again.close()
    step("write after close", lambda: again.put(1, "c", b"k", b"w"))
    third = Store(spark, path, "open")
    step("synced write", lambda: third.write(WriteBatch().put(1, "c", b"k", b"x"), sync=True))
    third.write(WriteBatch().delete(1, "c", b"k"), txn=("feed", 7))
    step("repeated transaction", lambda: third.write(WriteBatch().delete(1, "c", b"k"), txn=("feed", 7)))
    late = Store(spark, path, "open")
    version = late.log.current()
    third.put(1, "c", b"k", b"y")
    step("two writers", lambda: late._commit(version + 1, late._manifest(version), [], set()))
    bare = shared_path(spark, "store")
    spark.range(1).write.parquet(f"{bare}/data/000001.sst")
    step("files without manifest", lambda: Store(spark, bare))
    return spark.createDataFrame(out, "step string, outcome string")


class StorageIOFailure(StoreError):
    code = "io_error"


# -- files --------------------------------------------------------------------------------------
@query(f"WITH s AS (SELECT *, row_number() OVER (ORDER BY req_no) AS seq FROM ({_WRITES}) w) SELECT seq, CASE WHEN cmd_type = 2 THEN 1 ELSE 0 END AS op, hex(key) AS key_hex FROM s WHERE seq > (SELECT count(*) // 3 FROM s)")
def wal_recover(spark: SparkSession, d: str) -> DataFrame:
    """Operations after a flushed sequence, replayed from log files whose sequences are checked to be contiguous."""
    folder = shared_path(spark, "log")
    ops = merge.running_number(_writes(spark, d), ["req_no"])
    third = ops.count() // 3
    # Batches of up to eight operations; the sequence of the first is that of the batch.
    batch = F.col("seq") - F.pmod(F.col("seq") - 1, F.lit(8))
    wal.write_log(ops.select(batch.alias("batch_seq"), (F.col("seq") - batch).alias("pos"), "op", "key", "value"), folder, files=4)
    return wal.recover(spark, folder, third).select("seq", F.col("op").cast("int").alias("op"), F.hex("key").alias("key_hex"))


@query("""
WITH f AS (SELECT user_id // 10 AS fn, count(*) AS n, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY 1)
SELECT 1 AS level, row_number() OVER (ORDER BY fn) - 1 AS ord, fn + 1 AS number, n AS file_size, printf('%016X', lo) AS low_hex, printf('%016X', hi) AS high_hex FROM f
""")
def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of files of events, written, replaced and read back."""
    f = load(spark, d, "events").groupBy(F.floor(F.col("user_id") / 10).alias("fn")).agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    key = lambda k: codec.internal_key(codec.index_key(k), 1, 1)
    metas = [codec.TableMeta(r.fn + 1, r.n, key(r.lo), key(r.hi)) for r in f.orderBy("fn").toLocalIterator()]  # a row per file
    path = shared_path(spark, "MANIFEST")
    tables.write_manifest(spark, path, codec.Manifest())
    tables.write_manifest(spark, path, codec.Manifest(7, 2, [[], metas, []]))
    back = tables.manifest_table(spark, tables.read_manifest(spark, path))
    return back.select("level", "ord", "number", "file_size", F.hex("smallest").alias("low_hex"), F.hex("largest").alias("high_hex"))


def _table_files(spark: SparkSession, d: str) -> DataFrame:
    """All writes as table files of about 64 KiB, with their range of keys."""
    ops = _writes(spark, d).select("key", F.col("req_no").alias("seq"), "op", "value")
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0)) + 8
    files = tables.encode_tables(levels.split_outputs(ops, ["key"], "seq", "op", size, target=64 << 10))
    return materialise(files, "tables")


@query(f"""
WITH n AS (SELECT key, cmd_type, value FROM ({_WRITES}) w QUALIFY row_number() OVER (PARTITION BY key ORDER BY req_no DESC) = 1), a AS (SELECT DISTINCT key FROM requests WHERE cmd_type IN (1, 3) AND key IS NOT NULL)
SELECT hex(a.key) AS key_hex, CASE WHEN n.key IS NULL THEN 'absent' WHEN n.cmd_type = 2 THEN 'value' ELSE 'deleted' END AS state, CASE WHEN n.cmd_type = 2 THEN hex(coalesce(n.value, ''::BLOB)) END AS value_hex
FROM a LEFT JOIN n ON n.key = a.key
""")
def table_point_get(spark: SparkSession, d: str) -> DataFrame:
    """All keys that Gets and Deletes name, looked up in the table file whose range may hold them."""
    files = _table_files(spark, d)
    user = lambda c: F.substring(c, F.lit(1), F.length(c) - 8)
    starts = files.select(user("smallest").alias("__k"), F.struct(user("smallest").alias("start"), "file_no").alias("at"))
    asked = load(spark, d, "requests").filter("cmd_type IN (1, 3) AND key IS NOT NULL").select("key")
    placed = regions.last_start(asked, starts, "key", "at", "at").select(F.col("__k").alias("key"), F.col("at.file_no").alias("file_no"), F.lit(None).cast("bigint").alias("seq"))
    found = tables.lookup_tables(files, placed.filter("file_no IS NOT NULL"), verify=True)
    before = placed.filter("file_no IS NULL").select("file_no", "key", F.lit("absent").alias("state"), F.lit(None).cast("binary").alias("value"))
    return found.unionByName(before).select(F.hex("key").alias("key_hex"), "state", F.hex("value").alias("value_hex"))


@query("SELECT count(DISTINCT key) AS keys, CAST(0 AS BIGINT) AS missed, true AS few_false FROM requests WHERE cmd_type = 2 AND key IS NOT NULL")
def bloom_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters over all keys that were put: none of them is missed, and of as many keys that never were few pass."""
    keys = load(spark, d, "requests").filter("cmd_type = 2 AND key IS NOT NULL").select("key").distinct()
    filters = materialise(tables.build_filters(keys, "key"), "filters")
    absent = keys.select(F.concat("key", F.lit(bytearray(b"\xff\x00never"))).alias("key"))
    there, gone = tables.may_contain(keys, "key", filters), tables.may_contain(absent, "key", filters)
    all_ = there.select("may", F.lit(True).alias("there")).unionByName(gone.select("may", F.lit(False).alias("there")))
    # 2 % of the keys, and a few where there are few.
    return all_.agg(
        F.count_if("there").alias("keys"), F.count_if(F.col("there") & ~F.col("may")).alias("missed"),
        (F.count_if(~F.col("there") & F.col("may")) <= F.count_if("there") * 0.02 + 5).alias("few_false"),
    )


# -- streams and client ------------------------------------------------------------------------------
@query(store_queries.SQL["stream_apply_log"])
def stream_restart(spark: SparkSession, d: str) -> DataFrame:
    """The effective log applied by two runs of a stream, the second one going on from the first one's checkpoint."""
    folder, path = shared_path(spark, "effective-log"), shared_path(spark, "applied")
    log = load(spark, d, "raft_log").select("region_id", "idx", "term", "pos", "cmd_type", "cf", "key", "value")
    held = materialise(raftlog.highest_term(log).dropDuplicates(["region_id", "idx", "pos"]), "held")
    half = held.groupBy("region_id").agg(F.expr("percentile_approx(idx, 0.5)").alias("__half"))
    parts = held.join(half, "region_id")
    checkpoint = shared_path(spark, "apply-checkpoint")
    for part in (parts.filter("idx <= __half"), parts.filter("idx > __half")):
        part.drop("__half").write.mode("append").parquet(folder)
        store = Store(spark, path)  # as after a restart
        entries = spark.readStream.schema(held.schema).parquet(folder)
        apply.apply_stream(entries, store, checkpoint).awaitTermination()
    return _shown(store.view())


_ASKED = (
    ("addresses", "2"), ("put two", "2 results, region 1, leader 2"), ("get", "v1"), ("get missing", "empty"), ("scan", "a b"), ("delete", "1 results, region 1, leader 2"),
    ("get deleted", "empty"), ("mixed batch", "invalid_argument"), ("two regions", "invalid_argument"), ("two gets", "invalid_argument"), ("no command", "invalid_argument"),
    ("other cluster", "invalid_argument"), ("known leader", "2"), ("asked nodes", "1 2 2"), ("not applied", "busy"), ("bounds", "''..'m' 'm'..+inf"), ("after close", "0"),
)


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in _ASKED) + ") t(step, outcome)")
def client_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests through a client to two nodes, of which the second leads: routing, dispatch, retries, refusals."""
    table = [client.Region(1, b"", b"m", (1, 2), 2), client.Region(2, b"m", b"", (1, 2), 2)]
    store, out, asked = Store(spark, shared_path(spark, "store"), "create"), [], []
    applied = {"n": 5}
    gate = client.ReadGate(lambda r: 5, lambda r: applied["n"], timeout=0.05)
    leader = client.Node(store, client.Router(table), 2, gate=gate)
    follower = client.Node(store, client.Router(table), 1, gate=client.ReadGate(lambda r: None, lambda r: 0))

    def node(number, n):
        def propose(request):
            asked.append(number)
            return n.propose(request)

        return propose

    addresses = client.parse_addresses("1@a:1,2@b:2")
    out.append(("addresses", str(len(addresses))))
    c = client.Client({1: node(1, follower), 2: node(2, leader)})
    C, K = client.Command, client.Cmd
    ask = lambda *commands, **kw: c.propose(client.Request(commands, **kw), deadline=30)
    wrote = lambda r: f"{len(r.results)} results, region {r.region_id}, leader {r.leader}"
    value = lambda r: r.results[0].decode() or "empty"
    refused = lambda r: r.error.split(":")[0]
    steps = [
        ("put two", lambda: wrote(leader.propose(client.Request((C(K.PUT, key=b"a", value=b"v1"), C(K.PUT, key=b"b", value=b"v2")))))),
        ("get", lambda: value(ask(C(K.GET, key=b"a")))),
        ("get missing", lambda: value(ask(C(K.GET, key=b"c")))),
    ]
    for name, work in steps:
        out.append((name, work()))
    seen = list(asked)
    out.append(("scan", " ".join(bytes(r.key).decode() for r in ask(C(K.SCAN, start_key=b"a", limit=5)).results[0].collect())))
    out.append(("delete", wrote(ask(C(K.DELETE, key=b"a")))))
    out.append(("get deleted", value(ask(C(K.GET, key=b"a")))))
    out.append(("mixed batch", refused(ask(C(K.PUT, key=b"a", value=b""), C(K.GET, key=b"a")))))
    out.append(("two regions", refused(ask(C(K.PUT, key=b"a", value=b""), C(K.PUT, key=b"z", value=b"")))))
    out.append(("two gets", refused(ask(C(K.GET, key=b"a"), C(K.GET, key=b"b")))))
    out.append(("no command", refused(leader.propose(client.Request(())))))
    out.append(("other cluster", refused(ask(C(K.GET, key=b"a"), cluster_id=9))))
    out.append(("known leader", str(c.known_leader(b"a"))))
    out.append(("asked nodes", " ".join(map(str, seen))))
    applied["n"] = 4
    out.append(("not applied", refused(leader.propose(client.Request((C(K.GET, key=b"a"),))))))
    out.append(("bounds", " ".join(f"{client.bound_text(r.start_key)}..{client.bound_text(r.end_key, True)}" for r in table)))
    c.close()
    out.append(("after close", str(c.known_leader(b"a"))))
    return spark.createDataFrame(out, "step string, outcome string")
