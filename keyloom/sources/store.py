"""Named databases in a folder: change-log files, a manifest swapped atomically, transactions in two phases, recovery.

    store = Store(spark, path)
    db = store.open("orders")                       # kinds: plain, replicated, confluence, confluence_replicated
    with db.begin() as t:
        t.put(df)                                   # key BINARY, value BINARY
        t.delete(keys)
    db.snapshot()

Layout of a database: `log/<source>-<txn>-<n>/` Parquet of one committed or prepared transaction, `snapshot/<tag>/`
compacted rows, `deletions/<tag>/` markers, `manifest/<version>.json`. The newest manifest names everything that readers
see; creating the next version is the commit. A version is created only where it does not exist, so of two writers that
start from one version exactly one succeeds, and the other repeats its change on the newer manifest: no commit is lost,
whatever number of handles, threads or drivers write. Data files are written and read by Spark only and never change; the
small manifest goes through Hadoop's file system, whose rename must refuse an existing target (HDFS does; locally a hard
link does).

A handle reads the manifest that it loaded last (`update` moves on), so it sees one version until then. Compaction, purge,
merges and replication work on one pinned version; they name the transactions that they took, and what others commit
meanwhile stays in the log. Base rows keep the transaction they come from, so reads give the same before and after any
compaction, of some sources or all.

An open transaction holds a lease, renewed by each of its writes. Recovery (`open`, `sanitize`) drops open transactions
only after their lease; a dropped one's commit raises, it never vanishes silently.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import Conflict, KeyTooBig, NotSupported, NoValidPosition, TransactionActive, TransactionLost, TypeMismatch, WalError, WrongValue
from keyloom.functions.aspects import Aspect
from keyloom.functions.codec import MAX_NAME_BYTES, checked, is_big
from keyloom.operators import history, merging, reads, replication
from keyloom.sources.shared import shared_folder

KINDS = {"plain": 0, "replicated": 1, "confluence": 4, "confluence_replicated": 5}
LOG = T.StructType(
    [
        T.StructField("db", T.StringType()), T.StructField("source", T.StringType()), T.StructField("txn_id", T.LongType()), T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("ts", T.TimestampType()), T.StructField("meta", T.BinaryType()),
    ]
)
BASE = T.StructType([LOG[c] for c in ("txn_id", "source", "seq", "op", "key", "value")])
KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
DELETIONS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("deleted_at", T.TimestampType()), T.StructField("meta", T.BinaryType())])
TXN = T.StructType([T.StructField(n, k) for n, k in (("db", T.StringType()), ("source", T.StringType()), ("txn_id", T.LongType()), ("state", T.StringType()), ("origin", T.StringType()), ("started", T.DoubleType()), ("ended", T.DoubleType()))])
LEASE_SECONDS = 600.0
TEXT_FORMATS = ("csv", "json")
#: Manifest versions that stay for slow readers and writers.
KEPT_VERSIONS = 100


class Files:
    """Small-file operations through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create_new(self, path: str, text: str) -> bool:
        """Create a file with its whole text, unless it exists; of several callers one succeeds."""
        fs, p = self._at(path)
        _, fresh = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                paths = [Path(x.toUri().getPath()) for x in (fs.makeQualified(fresh), fs.makeQualified(p))]
                os.link(*paths)
                return True
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            array = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            self.jvm.java.lang.reflect.Array.set(array, 0, none)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), self.conf).rename(fs.makeQualified(fresh), fs.makeQualified(p), array)
            return True
        except Exception:
            if fs.exists(p):
                return False
            raise
        finally:
            fs.delete(fresh, False)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str = "") -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Store:
    def __init__(self, spark: SparkSession, path: str, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.path, self.lease_seconds = spark, path.rstrip("/"), lease_seconds
        self.files = Files(spark, self.path)

    @classmethod
    def in_memory(cls, spark: SparkSession) -> Store:
        """A store in a folder of its own under the session's shared folder, deleted when the application ends."""
        store = cls(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        fs, path = store.files._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        return store

    def open(self, name: str, kind: str = "plain", aspect: Aspect | None = None) -> Db:
        if kind not in KINDS:
            raise WrongValue(f"no such kind: {kind}")
        if len(name.encode()) >= MAX_NAME_BYTES:
            raise KeyTooBig("database name")
        if self.files.exists(f"{name}/manifest"):
            db = Db(self, name, aspect)
            if db.manifest["kind"] != kind:
                raise TypeMismatch(f"{name} is {db.manifest['kind']}")
            db.sanitize()
            return db
        fresh = {"kind": kind, "version": 0, "next_txn": 1, "base": None, "base_txn": 0, "deletions": None, "retention": replication.RETENTION_SECONDS, "txns": []}
        if not self.files.create_new(f"{name}/manifest/{_version_file(0)}", json.dumps(fresh)):
            return self.open(name, kind, aspect)  # another handle was first
        return Db(self, name, aspect)

    def drop(self, name: str, kind: str = "plain") -> None:
        if not self.files.exists(f"{name}/manifest"):
            raise WrongValue("database does not exist.")
        db = Db(self, name)
        if db.manifest["kind"] != kind:
            raise TypeMismatch(f"{name} is {db.manifest['kind']}")
        if db.transaction_active():
            raise TransactionActive(name)
        self.files.delete(name)

    def list_dbs(self) -> DataFrame:
        rows = [(n, KINDS[Db(self, n).manifest["kind"]]) for n in self.files.names("") if self.files.exists(f"{n}/manifest")]
        return self.spark.createDataFrame(rows, "name string, type_id int")

    def filename(self) -> str:
        return self.path

    def file_size(self) -> int:
        return self.files.size()

    def export_db(self, name: str, path: str, fmt: str = "parquet") -> None:
        """Newest records as a table of any format that Spark writes; text formats get base64."""
        rows = Db(self, name).snapshot()
        if fmt in TEXT_FORMATS:
            rows = rows.select(F.base64("key").alias("key"), F.base64("value").alias("value"))
        rows.write.mode("overwrite").format(fmt).save(path)

    def import_db(self, name: str, path: str, kind: str = "plain", fmt: str = "parquet") -> Db:
        """A table of columns key and value as records; text formats hold base64."""
        if fmt in TEXT_FORMATS:
            # an empty value is an empty field, which readers may take for null
            rows = self.spark.read.schema("key string, value string").format(fmt).load(path)
            rows = rows.select(F.unbase64(F.coalesce("key", F.lit(""))).alias("key"), F.unbase64(F.coalesce("value", F.lit(""))).alias("value"))
        else:
            rows = self.spark.read.format(fmt).load(path)
        if not {"key", "value"} <= set(rows.columns):
            raise WrongValue("no key and value columns")
        db = self.open(name, kind)
        db.put(rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))
        return db


def _active(m: dict, source: str = "main") -> bool:
    return any(t["state"] in ("open", "prepared") and t["source"] == source for t in m["txns"])


def _version_file(version: int) -> str:
    return f"{version:012d}.json"


class Db:
    def __init__(self, store: Store, name: str, aspect: Aspect | None = None):
        self.store, self.name, self.spark, self.files = store, name, store.spark, store.files
        self.aspect = aspect or Aspect()
        self.manifest = self._load()
        self.merge_error: Exception | None = None
        self.write_threshold, self.max_age_ms = 50_000, 1000

    # manifest ------------------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.name}/manifest") if n.endswith(".json")]

    def _load(self) -> dict:
        for _ in range(5):
            version = max(self._versions(), default=None)
            if version is None:
                raise WrongValue(f"{self.name}: database does not exist.")
            try:
                return json.loads(self.files.read(f"{self.name}/manifest/{_version_file(version)}"))
            except ValueError as e:
                raise WalError(f"{self.name}: {e}") from e
            except Exception:  # version was cleaned up between listing and reading
                if version in self._versions():
                    raise
        raise WalError(f"{self.name}: no readable manifest")

    def _change(self, change: Callable[[dict], object]) -> object:
        """Compare and swap: change edits the newest manifest (and may raise); the result becomes the next version, or, if another writer was first, the change is repeated on that writer's. Returns what change returned."""
        while True:
            m = self._load()
            result = change(m)
            m["version"] += 1
            if not self.files.create_new(f"{self.name}/manifest/{_version_file(m['version'])}", json.dumps(m)):
                continue
            # versions are cleaned up in ascending order: while our parent is there, ours never was created before
            if not self.files.exists(f"{self.name}/manifest/{_version_file(m['version'] - 1)}"):
                self.files.delete(f"{self.name}/manifest/{_version_file(m['version'])}")
                continue
            self.manifest = m
            for old in sorted(v for v in self._versions() if v < m["version"] - KEPT_VERSIONS) if m["version"] % 10 == 0 else ():
                self.files.delete(f"{self.name}/manifest/{_version_file(old)}")
            return result

    def update(self) -> None:
        """Move to the newest commit."""
        self.manifest = self._load()

    @property
    def multi(self) -> bool:
        return self.manifest["kind"].startswith("confluence")

    @property
    def replicated(self) -> bool:
        return self.manifest["kind"].endswith("replicated")

    def txn_id(self) -> int:
        """The newest committed transaction that reads see."""
        done = [t["txn_id"] for t in self.manifest["txns"] if t["state"] == "committed"]
        return max([self.manifest["base_txn"], *done])

    def txns(self) -> DataFrame:
        return self.spark.createDataFrame([(self.name, t["source"], t["txn_id"], t["state"], t["origin"], t["started"], t["ended"]) for t in self.manifest["txns"]], TXN)

    def transaction_active(self, source: str = "main") -> bool:
        self.update()
        return _active(self.manifest, source)

    def path(self, part: str) -> str:
        return f"{self.store.path}/{self.name}/{part}"

    # transactions --------------------------------------------------------------------------------------------------

    def begin(self, source: str = "main", origin: str = "user", non_blocking: bool = True, wait_seconds: float = 60.0) -> Txn:
        """One open transaction a database, or a source where the kind has many writers. While there is one: an error, or (blocking) a wait of up to wait_seconds."""
        if source != "main" and not self.multi:
            raise NotSupported("one writer only")
        if not self.aspect.before_start_transaction():
            raise TransactionActive("vetoed")

        def start(m: dict) -> int:
            if _active(m, source):
                raise TransactionActive(f"{self.name} {source}")
            return self._new_txn(m, source, "open", origin)

        until = time.monotonic() + wait_seconds
        while True:
            try:
                txn_id = self._change(start)
                break
            except TransactionActive:
                if non_blocking or time.monotonic() >= until:
                    raise
                time.sleep(0.05)
        self.aspect.on_start_transaction(txn_id)
        return Txn(self, txn_id, source)

    def _new_txn(self, m: dict, source: str, state: str, origin: str) -> int:
        now = time.time()
        t = {"txn_id": m["next_txn"], "source": source, "state": state, "origin": origin, "started": now, "ended": None, "paths": [], "rows": None, "lease": now + self.store.lease_seconds}
        m["next_txn"] += 1
        m["txns"].append(t)
        return t["txn_id"]

    def _entry(self, m: dict, txn_id: int) -> dict:
        """The entry of a transaction that is still open, prepared or folding."""
        for t in m["txns"]:
            if t["txn_id"] == txn_id and t["state"] in ("open", "prepared", "folding"):
                return t
        raise TransactionLost(f"{self.name}: transaction {txn_id} was ended by another handle")

    def _renew(self, txn_id: int) -> None:
        def renew(m: dict) -> None:
            self._entry(m, txn_id)["lease"] = time.time() + self.store.lease_seconds

        self._change(renew)

    def resolve_prepared(self, commit: bool) -> bool:
        """Settle the transaction that a crash left prepared."""
        self.update()
        for t in self.manifest["txns"]:
            if t["state"] == "prepared":
                txn = Txn(self, t["txn_id"], t["source"], paths=t["paths"])
                return txn.commit() if commit else txn.rollback()
        return False

    def put(self, kv: DataFrame, source: str = "main") -> int:
        with self.begin(source) as t:
            t.put(kv)
        return t.txn_id

    def delete(self, keys: DataFrame, strict: bool = False, source: str = "main") -> int:
        with self.begin(source) as t:
            t.delete(keys, strict)
        return t.txn_id

    # reads ---------------------------------------------------------------------------------------------------------

    def base(self) -> DataFrame:
        """Compacted changes, one a key: (txn_id, source, seq, op, key, value). A deletion stays while an older transaction is still to be folded."""
        at = self.manifest["base"]
        return self.spark.read.schema(BASE).parquet(self.path(at)) if at else self.spark.createDataFrame([], BASE)

    def log(self, states: tuple[str, ...] = ("committed",), source: str | None = None) -> DataFrame:
        paths = [self.path(p) for t in self.manifest["txns"] if t["state"] in states and (source is None or t["source"] == source) for p in t["paths"]]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def all_changes(self) -> DataFrame:
        """The compacted base and the committed log."""
        return self._based(self.log())

    def _based(self, log: DataFrame) -> DataFrame:
        return self.base().unionByName(log, allowMissingColumns=True).select(*LOG.fieldNames())

    def snapshot(self, txn_id: int | None = None) -> DataFrame:
        """(key, value) as of a transaction, through the read hook."""
        if txn_id is not None and txn_id < self.manifest["base_txn"]:
            raise WrongValue(f"versions before {self.manifest['base_txn']} were vacuumed")
        raw = self._raw(txn_id)
        return raw.select("key", self.aspect.on_read(F.col("key"), F.col("value")).alias("value"))

    def _raw(self, txn_id: int | None = None) -> DataFrame:
        if txn_id is None and self._plain_merges() and not any(t["paths"] for t in self.manifest["txns"] if t["state"] == "committed"):
            # all is compacted: a row a key, sorted by key, so that scans prune and nothing is shuffled
            return self.base().filter("op = 'put'").select("key", "value")
        changes = self.all_changes()
        if txn_id is not None:
            changes = changes.filter(F.col("txn_id") <= txn_id)
        return history.snapshot(changes) if self._plain_merges() else merging.fold(changes, self._policy())

    def _plain_merges(self) -> bool:
        """Whether no merge hook can change what the last change leaves."""
        a = type(self.aspect)
        return not self.multi or a.may_merge_overwrite is Aspect.may_merge_overwrite and a.may_merge_add is Aspect.may_merge_add and a.may_merge_delete is Aspect.may_merge_delete

    def _policy(self) -> merging.Policy:
        return merging.Policy(self.aspect.may_merge_overwrite, self.aspect.may_merge_add, self.aspect.may_merge_delete)

    def find(self, probes: DataFrame) -> DataFrame:
        """probes with value; probes that the hook vetoes find nothing."""
        allowed = probes.filter(self.aspect.before_find(F.col("key")))
        found = reads.get_many(self.snapshot(), allowed)
        out = probes.join(found.select("key", "value").distinct(), "key", "left")
        if type(self.aspect).on_find is not Aspect.on_find:
            n, hits, size = found.agg(F.count(F.lit(1)), F.count("value"), F.sum(F.octet_length("value"))).first()
            self.aspect.on_find(n, hits)
            self._add(reads=hits, bytes_read=size)
        return out

    def seek_next(self, probes: DataFrame) -> DataFrame:
        """For each probe the record with the least key above it: near_key, near_value."""
        return self._near(reads.seek_next(self.snapshot(), probes), "on_next")

    def seek_prev(self, probes: DataFrame) -> DataFrame:
        """For each probe the record with the greatest key below it."""
        return self._near(reads.seek_prev(self.snapshot(), probes), "on_prev")

    def _near(self, out: DataFrame, hook: str) -> DataFrame:
        """A step for each probe, a read for each record found."""
        if any(getattr(type(self.aspect), h) is not getattr(Aspect, h) for h in (hook, "on_navigate")):
            n, hits, size = out.agg(F.count(F.lit(1)), F.count("near_key"), F.sum(F.octet_length("near_value"))).first()
            getattr(self.aspect, hook)(n, hits)
            self._add(reads=hits, bytes_read=size)
        return out

    def _add(self, **more: int | None) -> None:
        """More to the aspect's counters, if it has any."""
        add = getattr(self.aspect, "add", None)
        if add:
            add(**more)

    def __getitem__(self, key: bytes) -> bytes:
        row = reads.get(self.snapshot(), bytearray(key)).first()
        self.aspect.on_find(1, int(row is not None))
        if row is None:
            raise KeyError(key)
        self._add(reads=1, bytes_read=len(row["value"]))
        return bytes(row["value"])

    def __contains__(self, key: bytes) -> bool:
        found = reads.get(self.snapshot(), bytearray(key)).first() is not None
        self.aspect.on_find(1, int(found))
        return found

    def __len__(self) -> int:
        return self.snapshot().count()

    def __setitem__(self, key: bytes, value: bytes) -> None:
        self.put(self.spark.createDataFrame([(bytearray(key), bytearray(value))], KV))

    def __delitem__(self, key: bytes) -> None:
        self.delete(self.spark.createDataFrame([(bytearray(key),)], "key binary"), strict=True)

    def __iter__(self):
        return self._walk(self.snapshot().select("key").orderBy("key").toLocalIterator())

    def _walk(self, ordered) -> Iterator[bytes]:
        for r in ordered:
            yield bytes(r["key"])
            self.aspect.on_next(1, 1)

    def setdefault(self, key: bytes, value: bytes) -> bytes:
        if key not in self:
            self[key] = value
        return self[key]

    # deletions -----------------------------------------------------------------------------------------------------

    def deletions(self) -> DataFrame:
        """Retained markers of a replicated database: those stored, and deletes committed since."""
        if not self.replicated:
            raise NotSupported("not replicated")
        at = self.manifest["deletions"]
        kept = self.spark.read.schema(DELETIONS).parquet(self.path(at)) if at else self.spark.createDataFrame([], DELETIONS)
        fresh = self.log().filter("op = 'del'").groupBy("key").agg(F.max_by(F.struct(F.col("ts").alias("deleted_at"), "meta"), F.struct("txn_id", "seq")).alias("m")).select("key", "m.deleted_at", "m.meta")
        return kept.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)

    def set_retention(self, seconds: int) -> None:
        self._change(lambda m: m.update(retention=seconds))

    def purge(self, now=None) -> tuple[int, object]:
        """Drop markers older than the retention; (purged, oldest that remains)."""
        now = F.current_timestamp() if now is None else now
        seen = []

        def build(_: int):
            old = self.deletions()
            seen[:] = replication.purge_stats(old, now, self.manifest["retention"]).first()
            return self._last(), replication.purge(old, now, self.manifest["retention"])

        self._fold(build, "defrag")
        return tuple(seen)

    def next_purge(self):
        """When the oldest marker comes to its retention, or None without markers."""
        oldest = self.deletions().agg(F.min("deleted_at")).first()[0]
        return None if oldest is None else oldest + timedelta(seconds=self.manifest["retention"])

    def replica(self) -> replication.Replica:
        return replication.Replica(self._raw(), self.deletions())

    def receive(self, src: Db, mode: str = "sticky") -> dict:
        """Replicate from src in one commit."""
        if not self.replicated or not src.replicated:
            raise NotSupported("not replicated")
        if self.transaction_active():
            raise TransactionActive(self.name)
        n: dict[str, int] = {}

        def build(txn: int):
            before = self._raw()
            out = replication.apply(src.replica(), replication.Replica(before, self.deletions()), self._policy(), mode)
            n.clear()
            n.update({r["change"]: r["count"] for r in replication.hashing.diff(before, out.main).groupBy("change").count().collect()})
            return self._decided(out.main, txn), out.deletions

        self._fold(build, "merge")
        self._add(adds=n.get("added"), overwrites=n.get("changed"), merge_deletes=n.get("removed"))
        return {"state": "idle", "error": None, "keys_added": n.get("added", 0), "overwritten": n.get("changed", 0), "deleted": n.get("removed", 0)}

    # maintenance ---------------------------------------------------------------------------------------------------

    def _last(self, sources: list[str] | None = None) -> DataFrame:
        """The last change of each key, of the base and of some sources' committed log, as base rows."""
        log = self.log() if sources is None else self.log().filter(F.col("source").isin(sources))
        return history.latest(self._based(log), "txn_id", "source", "seq").select(*BASE.fieldNames())

    def _decided(self, main: DataFrame, txn: int, sources: list[str] | None = None) -> DataFrame:
        """Base rows for records that a merge decided on: what it left as it was keeps its transaction, all else is the merge's."""
        old = self._last(sources).select("key", F.struct("txn_id", "source", "seq", "op", "value").alias("old"))
        new = main.select("key", F.col("value").alias("new"), F.lit("put").alias("put"))
        both = old.join(new, "key", "full_outer")
        op = F.coalesce("put", F.lit("del"))
        kept = F.col("old").isNotNull() & (F.col("old.op") == op) & (F.col("put").isNull() | F.col("old.value").eqNullSafe(F.col("new")))
        return both.select(
            F.when(kept, F.col("old.txn_id")).otherwise(F.lit(txn)).cast("long").alias("txn_id"), F.when(kept, F.col("old.source")).otherwise(F.lit("main")).alias("source"),
            F.when(kept, F.col("old.seq")).otherwise(F.lit(0)).cast("long").alias("seq"), op.alias("op"), "key", F.col("new").alias("value"),
        )

    def _fold(self, build: Callable[[int], tuple[DataFrame, DataFrame | None]], origin: str, sources: list[str] | None = None) -> None:
        """Write a new base (and markers) and drop the log behind it, in one manifest change. build(txn) gives the base rows and the markers, or None for those there are, of the manifest that self.manifest then is.

        If another handle replaced the base or ended one of the transactions taken meanwhile, all is done again from the new
        manifest. Keys are range-partitioned and sorted, so scans prune.
        """
        while True:
            tag = uuid.uuid4().hex

            def reserve(m: dict, tag: str = tag) -> int:
                txn = self._new_txn(m, "main", "folding", origin)
                self._entry(m, txn)["paths"] = [f"snapshot/{tag}", f"deletions/{tag}"]
                return txn

            txn = self._change(reserve)
            pinned = self.manifest
            taken = {t["txn_id"] for t in pinned["txns"] if t["state"] == "committed" and (sources is None or t["source"] in sources)}
            try:
                rows, marks = build(txn)
                left = [t["txn_id"] for t in pinned["txns"] if t["txn_id"] not in taken and t["txn_id"] != txn and t["state"] in ("open", "prepared", "committed", "folding")]
                gone = F.col("op") == "del"
                rows = rows.filter(~gone | (F.col("txn_id") > min(left))) if left else rows.filter(~gone)
                if marks is None and self.replicated:
                    marks = self.deletions()
                rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(self.path(f"snapshot/{tag}"))
                if marks is not None:
                    marks.write.parquet(self.path(f"deletions/{tag}"))

                def swap(m: dict, txn: int = txn, pinned: dict = pinned, taken: set = taken, tag: str = tag, marked: bool = marks is not None) -> None:
                    self._entry(m, txn)
                    if (m["base"], m["deletions"]) != (pinned["base"], pinned["deletions"]) or not taken <= {t["txn_id"] for t in m["txns"] if t["state"] == "committed"}:
                        raise Conflict(self.name)
                    m["base"], m["base_txn"] = f"snapshot/{tag}", txn
                    if marked:
                        m["deletions"] = f"deletions/{tag}"
                    m["txns"] = [t for t in m["txns"] if t["txn_id"] not in taken and t["state"] != "aborted" and t["txn_id"] != txn]
                    now = time.time()
                    m["txns"].append({"txn_id": txn, "source": "main", "state": "committed", "origin": origin, "started": now, "ended": now, "paths": [], "rows": 0})
                    m["txns"].sort(key=lambda t: t["txn_id"])

                self._change(swap)
            except BaseException as e:
                def forget(m: dict, txn: int = txn) -> None:
                    m["txns"] = [t for t in m["txns"] if t["txn_id"] != txn or t["state"] != "folding"]

                self._change(forget)
                for kind in ("snapshot", "deletions"):
                    self.files.delete(f"{self.name}/{kind}/{tag}")
                if isinstance(e, (Conflict, TransactionLost)):
                    continue
                raise
            self.aspect.on_commit(txn, origin)
            return

    def compact(self) -> bool:
        """Rewrite the log into a sorted base; content stays the same."""
        if not self.aspect.before_defrag():
            return False
        if self.transaction_active():
            raise TransactionActive(self.name)

        def build(txn: int):
            return (self._last() if self._plain_merges() else self._decided(self._raw(), txn)), None

        self._fold(build, "defrag")
        self.aspect.on_defrag()
        return True

    def truncate(self) -> bool:
        if not self.aspect.before_reset():
            return False

        def clear(m: dict) -> None:
            if any(t["state"] in ("open", "prepared") for t in m["txns"]):
                raise TransactionActive(self.name)
            m |= {"base": None, "base_txn": m["next_txn"], "deletions": None, "txns": []}
            m["next_txn"] += 1

        self._change(clear)
        self.aspect.on_reset()
        return True

    def vacuum(self) -> list[str]:
        """Delete files that neither the manifest nor an open transaction needs. Handles that still read an older version lose theirs: call it when none does."""
        # files first: what is begun or committed after the listing is not in it
        there = [f"{d}/{n}" for d in ("snapshot", "deletions", "log") for n in self.files.names(f"{self.name}/{d}")]
        m = self._load()
        named = {m["base"], m["deletions"], *(p for t in m["txns"] for p in t["paths"])}
        staged = tuple(f"log/{t['source']}-{t['txn_id']}-" for t in m["txns"] if t["state"] in ("open", "prepared"))
        gone = [p for p in there if p not in named and not p.startswith(staged)]
        for g in gone:
            self.files.delete(f"{self.name}/{g}")
        return gone

    def sanitize(self) -> None:
        """After a crash: open transactions whose lease is over are dropped, prepared ones stay pending, committed ones count."""

        def over(t: dict) -> bool:
            return t["state"] in ("open", "folding") and t.get("lease", 0) <= time.time()

        def drop(m: dict) -> None:
            m["txns"] = [t for t in m["txns"] if not over(t)]

        if any(over(t) for t in self._load()["txns"]):
            self._change(drop)
        self.aspect.on_sanitize()

    def repair(self) -> list[int]:
        """Drop the first transaction whose files cannot be read back whole, and all after it; their ids are returned."""
        self.update()
        bad = None
        for t in sorted(self.manifest["txns"], key=lambda t: t["txn_id"]):
            if t["state"] != "committed" or t["rows"] is None:
                continue
            try:
                n = sum(self.spark.read.schema(LOG).parquet(self.path(p)).count() for p in t["paths"])
            except Exception:
                n = -1
            if n != t["rows"]:
                bad = t["txn_id"]
                break
        if bad is None:
            return []

        def cut(m: dict) -> list[int]:
            lost = [t["txn_id"] for t in m["txns"] if t["txn_id"] >= bad]
            m["txns"] = [t for t in m["txns"] if t["txn_id"] < bad]
            return lost

        return self._change(cut)

    def statistics(self) -> DataFrame:
        from keyloom.operators.trie import node_counts

        return node_counts(self._raw())

    def check(self) -> dict[str, bool]:
        """Invariants: one row a key, ascending transaction ids, named files present."""
        rows = self._raw()
        n, keys = rows.count(), rows.select("key").distinct().count()
        ids = [t["txn_id"] for t in self.manifest["txns"]]
        return {"unique_keys": n == keys, "ascending": ids == sorted(ids), "files": all(self.files.exists(f"{self.name}/{p}") for t in self.manifest["txns"] for p in t["paths"])}

    # many writers --------------------------------------------------------------------------------------------------

    def set_merge_write_threshold(self, n: int) -> None:
        self.write_threshold = n

    def set_max_attached_age_ms(self, ms: int) -> None:
        self.max_age_ms = ms

    def due(self, now=None) -> list[str]:
        """Sources due for merging; at most one row a writer reaches the driver."""
        self.update()
        return sorted(r["source"] for r in merging.eligible(self.log().filter("source != 'main'"), self.write_threshold, self.max_age_ms, now).select("source").collect())

    def merge_now(self, now=None) -> list[str]:
        return self._merge(self.due(now))

    def merge_all(self) -> list[str]:
        self.update()
        return self._merge(sorted({t["source"] for t in self.manifest["txns"] if t["source"] != "main" and t["state"] == "committed"}))

    def _merge(self, sources: list[str]) -> list[str]:
        """Compact sources into the base; on an error the data stay pending and the error is kept. Where hooks judge, a source's tombstones come first, then its data."""
        if not self.multi:
            raise NotSupported("one writer only")
        if not sources:
            return []
        n: dict[str, int] = {}
        own = [*sources, "main"]

        def build(txn: int):
            before = history.snapshot(self._based(self.log(source="main")))
            side = self.log().filter(F.col("source").isin(sources))
            if hasattr(self.aspect, "add"):
                n.update(merging.compact_stats(before, side, self._policy()).first().asDict())
            return (self._last(own) if self._plain_merges() else self._decided(merging.compact(before, side, self._policy()), txn, own)), None

        try:
            self._fold(build, "merge", own)
            self._add(**n)
            return sources
        except Exception as e:
            self.merge_error = self.merge_error or e
            return []

    def get_merge_error(self) -> Exception | None:
        """The first error since the last call."""
        e, self.merge_error = self.merge_error, None
        return e


class Txn:
    """A write transaction. Leaving the `with` block commits; an exception rolls back."""

    def __init__(self, db: Db, txn_id: int, source: str, paths: list[str] | None = None):
        self.db, self.txn_id, self.source, self.paths, self.seq = db, txn_id, source, list(paths or []), len(paths or [])
        self.done = self.prepared = False

    def __enter__(self) -> Txn:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.rollback()
        elif not self.done:
            self.commit()

    def _stage(self, rows: DataFrame) -> None:
        path = f"log/{self.source}-{self.txn_id}-{self.seq}"
        self.db._renew(self.txn_id)
        rows.withColumn("seq", F.lit(self.seq)).select(*[F.col(f.name).cast(f.dataType) for f in LOG]).write.mode("overwrite").parquet(self.db.path(path))
        self.paths.append(path)
        self.seq += 1

    def put(self, kv: DataFrame) -> None:
        """Rows (key, value); a later put of the same transaction wins."""
        a = self.db.aspect
        kv = checked(kv.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")))
        out = kv.select("key", F.coalesce(a.on_write(F.col("key"), F.col("value")), F.lit(b"")).alias("value"))
        rows = history.puts(out, self.txn_id, self.source, self.db.name)
        self._stage(rows.withColumn("meta", F.when(is_big(F.col("value")), a.big_meta(F.col("key"), F.col("value")))))
        self._count("writes", "bytes_written")

    def _count(self, n: str, size: str | None = None) -> None:
        add = getattr(self.db.aspect, "add", None)
        if add:
            rows, total = self.db.spark.read.schema(LOG).parquet(self.db.path(self.paths[-1])).agg(F.count(F.lit(1)), F.sum(F.octet_length("value"))).first()
            add(**({n: rows} | ({size: total} if size else {})))

    def view(self) -> DataFrame:
        """Committed rows and this transaction's own."""
        own = self.db.spark.read.schema(LOG).parquet(*[self.db.path(p) for p in self.paths]) if self.paths else self.db.spark.createDataFrame([], LOG)
        return history.own_view(self.db.all_changes(), own)

    def delete(self, keys: DataFrame, strict: bool = False) -> None:
        """Rows (key[, meta]). Keys that are absent or that the hook vetoes raise if strict, else stay as they are."""
        keys = keys.withColumn("key", F.col("key").cast("binary"))
        if not self.db.multi or strict:
            hit = self.view().join(keys.select("key").distinct(), "key", "left_semi").filter(self.db.aspect.may_delete(F.col("key"), F.col("value")))
            if strict and hit.count() != keys.select("key").distinct().count():
                raise NoValidPosition("absent or vetoed keys")
            keys = keys.join(hit.select("key"), "key", "left_semi")
        meta = F.col("meta") if "meta" in keys.columns else None
        self._stage(history.dels(keys, self.txn_id, self.source, self.db.name, meta))
        self._count("deletes")

    def prepare(self) -> int:
        """Phase one: durable, but invisible. Returns the id; again without effect. Raises if another handle ended the transaction."""
        if self.prepared:
            return self.txn_id
        rows = self.db.spark.read.schema(LOG).parquet(*[self.db.path(p) for p in self.paths]).count() if self.paths else 0

        def ready(m: dict) -> None:
            t = self.db._entry(m, self.txn_id)
            if t["state"] == "open":
                t |= {"state": "prepared", "paths": self.paths, "rows": rows}

        self.db._change(ready)
        self.prepared = True
        return self.txn_id

    def commit(self) -> bool:
        """Phase two: one manifest change makes the transaction visible. False if it was ended before or the hook vetoes; raises if another handle ended it."""
        if self.done or not self.db.aspect.before_commit(self.txn_id):
            return False
        self.prepare()

        def publish(m: dict) -> str:
            t = self.db._entry(m, self.txn_id)
            t |= {"state": "committed", "ended": time.time()}
            return t["origin"]

        origin = self.db._change(publish)
        self.done = True
        self.db.aspect.on_commit(self.txn_id, origin)
        return True

    def rollback(self) -> bool:
        if self.done or not self.db.aspect.before_rollback(self.txn_id):
            return False

        def abort(m: dict) -> None:
            self.db._entry(m, self.txn_id).update(state="aborted", paths=[], ended=time.time())

        try:
            self.db._change(abort)
        except TransactionLost:
            return False
        self.done = True
        for p in self.paths:
            with suppress(Exception):
                self.db.files.delete(f"{self.db.name}/{p}")
        self.db.aspect.on_rollback(self.txn_id)
        return True
