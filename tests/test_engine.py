"""The engine against models: neighbours by bisect, stores by dict, merges and replication by plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from keyloom.errors import KeyTooBig, NotSupported, NoValidPosition, ReplicationFailed, TransactionActive, TransactionLost, TypeMismatch, WrongValue
from keyloom.functions import codec
from keyloom.functions.aspects import Aspect, Metrics
from keyloom.operators import hashing, history, merging, reads, replication, trie
from keyloom.sources.store import Store

KV = "key binary, value binary"


def frame(spark, d):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in d.items()], KV)


def rows(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.select("key", "value").collect()}


def keys(spark, ks):
    return spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")


def prefix_chain(seed, steps):
    """Keys that each extend an earlier one, all padded to lengths over 500."""
    r, stems = random.Random(seed), [b""]
    for _ in range(steps):
        stems.append(r.choice(stems[-3:]) + bytes(r.choices(b"mnopq", k=r.randrange(1, 3))))
    return [s + b"7" * 510 for s in sorted(set(stems))]


SETS = {
    "chain": prefix_chain(11, 9),
    "backward": [b"abca", b"abcb", b"adea", b"adeb"],
    "high": [b"\x00", b"\x7f", b"\x80", b"\xff", b"\xff\xff", b"", b"a\xff", b"b"],
    "even": [b"%06d" % i for i in range(0, 600, 2)],
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("cut", [False, True])
def test_movement(spark, name, cut):
    ks = sorted(SETS[name])
    kv = frame(spark, {k: k for k in ks})
    bounds = [bytearray(k) for k in ks[1::3]] if cut else []
    probes = sorted({*ks, *(k + b"!" for k in ks), *(k[:-1] for k in ks)})
    for forward, got in ((True, reads.seek_next(kv, keys(spark, probes), bounds)), (False, reads.seek_prev(kv, keys(spark, probes), bounds))):
        found = {bytes(r["key"]): r["near_key"] and bytes(r["near_key"]) if r["near_key"] is not None else None for r in got.collect()}
        for p in probes:
            i = bisect.bisect_right(ks, p) if forward else bisect.bisect_left(ks, p) - 1
            want = ks[i] if 0 <= i < len(ks) else None
            assert found[p] == want, (p, forward)
    assert [bytes(r["key"]) for r in reads.scan(kv).collect()] == ks
    assert [bytes(r["key"]) for r in reads.scan(kv, reverse=True).collect()] == ks[::-1]
    assert bytes(reads.first_kv(kv).first()["key"]) == ks[0] and bytes(reads.last_kv(kv).first()["key"]) == ks[-1]


def test_a_null_value_is_a_record(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "key string, value string")
    probes = spark.createDataFrame([("a",), ("aa",), ("b",), ("bb",), ("d",)], "key string")
    assert {r.key: (r.near_key, r.near_value) for r in reads.lower_bound(kv, probes).collect()} == {"a": ("a", "1"), "aa": ("b", None), "b": ("b", None), "bb": ("c", "3"), "d": (None, None)}
    assert {r.key: r.near_key for r in reads.seek_prev(kv, probes, ["b"]).collect()} == {"a": None, "aa": "a", "b": "a", "bb": "b", "d": "c"}


@pytest.mark.parametrize("borders", [7, 90])
def test_ranges_follow_the_bytes(spark, borders):
    """More bytes give more ranges, and any number of borders gives the same neighbours."""
    kv = spark.range(3000).select(F.format_string("%06d", F.col("id") * 7).alias("key"), F.col("id").cast("string").alias("value"))
    few, many = (reads.range_bounds(kv.select("key"), range_bytes=b) for b in (100_000, 1000))
    assert len(few) < 8 and len(many) > 20 * max(len(few), 1) and many == sorted(many)
    cut = many[:: max(1, len(many) // borders)]
    probes = spark.range(0, 21_100, 13).select(F.format_string("%06d", "id").alias("key"), "id")
    for strict, f in ((True, reads.seek_next), (False, reads.lower_bound)):
        for r in f(kv, probes, cut).collect():
            want = r.id // 7 * 7 + 7 if strict or r.id % 7 else r.id
            assert r.near_key == (f"{want:06d}" if want < 21_000 else None)


def test_probes_of_one_key_are_asked_once(spark, monkeypatch):
    kv = spark.createDataFrame([(f"k{i:03d}", str(i)) for i in range(0, 200, 2)], "key string, value string")
    probes = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "k101").otherwise(F.format_string("k%03d", F.col("id") % 200)).alias("key"), "id")
    bounds = reads.range_bounds
    monkeypatch.setattr(reads, "range_bounds", lambda keys: bounds(keys, range_bytes=20_000))
    out = reads.seek_next(kv, probes)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(4000)) and set(out.columns) == {"key", "id", "near_key", "near_value"}
    assert all(r.near_key == ("k102" if r.key == "k101" else f"k{int(r.key[1:]) // 2 * 2 + 2:03d}" if int(r.key[1:]) < 198 else None) for r in got)


def test_one_probe_after_a_miss(spark):
    kv = frame(spark, {k: k for k in SETS["backward"]})
    assert bytes(reads.prev_one(kv, bytearray(b"ad")).first()["key"]) == b"abcb"
    assert bytes(reads.prev_one(kv, bytearray(b"abd")).first()["key"]) == b"abcb"
    assert bytes(reads.next_one(kv, bytearray(b"ad")).first()["key"]) == b"adea"
    assert reads.next_one(kv, bytearray(b"adeb")).first() is None


def test_prefix_successor():
    assert codec.prefix_succ(b"a\xff\xff") == b"b"
    assert codec.prefix_succ(b"\xff") is None and codec.prefix_succ(b"") is None
    assert codec.prefix_succ("ab") == "ac"


def test_codec_order_and_serials(spark):
    vals = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(v, s) for v in vals for s in ("", "a", "a\0", "a\0b", "b", "é")], "v long, s string")
    got = df.orderBy(codec.encode_key((F.col("v"), "long"), (F.col("s"), "string"))).collect()
    assert [(r.v, r.s) for r in got] == sorted(((r.v, r.s) for r in got), key=lambda x: (x[0], x[1].encode()))
    one = spark.range(1)
    assert one.select(codec.serial_add(F.lit(0xFFFFFFFE), 3)).first()[0] == 2
    assert one.select(codec.serial_less(F.lit(0xFFFFFFFE), F.lit(1))).first()[0]


def test_merge_cases(spark):
    cases = [({}, {}), ({b"a": b"1"}, {}), ({}, {b"a": b"1"}), ({b"a": b"1"}, {b"a": b"2"}), ({b"": b"0", b"a": b""}, {b"": b"1", b"ab": b"2"}), ({b"\xf0": b"x"}, {b"\xf0\x00": b"y"})]
    for d, s in cases:
        x, y = frame(spark, d), frame(spark, s)
        assert rows(merging.merge(x, y)) == d | s
        assert rows(merging.merge(x, y, merging.KEEP_DST)) == s | d
        assert rows(merging.merge(merging.merge(x, y), y)) == d | s
        none = merging.Policy(lambda k, a, b: F.lit(False), lambda k, b: F.lit(False))
        assert rows(merging.merge(x, y, none)) == d


def test_fold_is_replay(spark):
    r = random.Random(1)
    log = [(str(r.randrange(3)), i, r.choice(["put", "put", "del"]), b"%d" % r.randrange(6), b"%03d" % r.randrange(100)) for i in range(120)]
    df = spark.createDataFrame([(s, i, 0, o, bytearray(k), bytearray(v) if o == "put" else None) for s, i, o, k, v in log], "source string, txn_id long, seq long, op string, key binary, value binary")
    last = {}
    for s, i, o, k, v in log:
        last[k, s] = (i, o, v)
    state: dict[bytes, bytes] = {}
    for (k, _), (_, o, v) in sorted(last.items(), key=lambda x: x[1][0]):
        if o == "del":
            state.pop(k, None)
        elif k not in state or v > state[k]:
            state[k] = v
    assert rows(merging.fold(df, merging.Policy(may_overwrite=lambda k, a, b: b > a))) == state


def test_diff_and_hashes(spark):
    a = frame(spark, {b"%03d" % i: b"v" for i in range(50)})
    assert hashing.diff(a, a).count() == 0 and hashing.diff(a, a, 2).count() == 0
    b = history.upsert(a, frame(spark, {b"007": b"w", b"x": b""}))
    assert {(bytes(r["key"]), r["change"]) for r in hashing.diff(a, b, 2).collect()} == {(b"007", "changed"), (b"x", "added")}
    # the boundary between key and value is part of the hash
    h = hashing.record_hashes(frame(spark, {b"ab": b"c", b"a": b"bc"})).select("hash").distinct()
    assert h.count() == 2
    assert {r["n"] for r in hashing.lookup(hashing.levels(a, [2, 1]), bytearray(b"0")).collect()} == {50}


NOW = "2024-01-02 00:00:00"


def replica(spark, main, marks=()):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return replication.Replica(frame(spark, main), keys(spark, marks).select("key", ts.alias("deleted_at"), F.lit(None).cast("binary").alias("meta")))


def test_replication(spark):
    # deletions come before data: a re-inserted key survives where the receiver had no marker
    src, dst = replica(spark, {b"k0": b"new", b"k1": b"1"}, [b"k0"]), replica(spark, {b"k0": b"old", b"k2": b"2"})
    out = replication.apply(src, dst)
    assert rows(out.main) == {b"k0": b"new", b"k1": b"1", b"k2": b"2"}
    # a marker on the receiver holds against a re-insert, until last-writer-wins or a purge
    held = replica(spark, {}, [b"k1"])
    assert rows(replication.apply(replica(spark, {b"k1": b"1"}), held).main) == {}
    lww = replication.apply(replica(spark, {b"k1": b"1"}), held, mode="lww")
    assert rows(lww.main) == {b"k1": b"1"} and lww.deletions.count() == 0
    # re-inserted with the same value
    assert rows(replication.apply(replica(spark, {b"k": b"v"}, [b"k"]), replica(spark, {b"k": b"v"})).main) == {b"k": b"v"}
    once = replication.apply(src, dst)
    assert rows(replication.apply(src, once).main) == rows(once.main)
    x, report = replication.session(src, dst)
    assert (report["keys_added"], report["overwritten"], report["state"]) == (1, 1, "idle")


def test_three_clients_converge(spark):
    n = 60
    main = [{b"c%d/%03d" % (c, i): b"%d" % i for i in range(n)} for c in range(3)]
    reps = []
    for c in range(3):
        r = replica(spark, main[c])
        gone = keys(spark, [b"c%d/%03d" % (c, i) for i in range(0, n, 2)])
        r = replication.tracked_delete(r, gone, F.lit(NOW).cast("timestamp"))
        reps.append(replication.Replica(r.main, r.deletions))
    server = replica(spark, {})
    for _ in range(2):
        for c in range(3):
            reps[c], server = replication.sync(reps[c], server)
            reps[c] = replication.Replica(frame(spark, rows(reps[c].main)), keep(spark, reps[c].deletions))
            server = replication.Replica(frame(spark, rows(server.main)), keep(spark, server.deletions))
    want = {k: v for m in main for k, v in m.items() if int(k[3:]) % 2}
    assert all(rows(r.main) == want for r in [*reps, server])


def keep(spark, deletions):
    return spark.createDataFrame(deletions.collect(), deletions.schema)


def test_purge_boundary(spark):
    at = ["2024-01-01 00:00:00", "2023-12-31 23:59:59", "2024-01-01 00:00:01"]
    marks = spark.createDataFrame([(bytearray(b"%d" % i), t) for i, t in enumerate(at)], "key binary, t string").select("key", F.col("t").cast("timestamp").alias("deleted_at"))
    now = F.lit(NOW).cast("timestamp")
    assert [bytes(r["key"]) for r in replication.purge(marks, now).collect()] == [b"2"]
    assert replication.purge_stats(marks, now).first()[0] == 2


def test_trie(spark):
    kv = frame(spark, {k: k for k in (b"ab", b"abc", b"abd", b"x")})
    got = {(bytes(r["prefix"]), r["fanout"]) for r in trie.branch_nodes(kv).collect()}
    assert got == {(b"", 2), (b"ab", 3)}
    assert [r["lcp"] for r in trie.neighbour_lcp(kv).orderBy("key").collect()] == [None, 2, 2, 0]


# store -----------------------------------------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_random_transactions_against_a_dict(spark, store):
    r = random.Random(3)
    db = store.open("d")
    model: dict[bytes, bytes] = {}
    versions = {}
    for step in range(7):
        store.lease_seconds = 0 if step == 2 else 600
        t = db.begin()
        mine = dict(model)
        put = {b"%02d" % r.randrange(30): b"%d" % r.randrange(1000) for _ in range(8)}
        t.put(frame(spark, put))
        mine |= put
        gone = r.sample(sorted(mine), min(3, len(mine)))
        t.delete(keys(spark, gone))
        for g in gone:
            mine.pop(g)
        assert rows(t.view()) == mine
        end = ("commit", "rollback", "crash", "prepare", "commit", "commit", "commit")[step]
        if end == "commit":
            t.commit()
            model = mine
        elif end == "rollback":
            t.rollback()
        elif end == "crash":
            db = store.open("d")  # recovery drops the open transaction, whose lease is over
            with pytest.raises(TransactionLost):
                t.commit()
        else:
            t.prepare()
            assert t.prepare() == t.txn_id
            db = store.open("d")  # recovery keeps it pending
            assert rows(db.snapshot()) == model
            with pytest.raises(TransactionActive):
                db.begin()
            assert db.resolve_prepared(commit=True)
            model = mine
        assert rows(db.snapshot()) == model
        versions[db.txn_id()] = dict(model)
    for v, want in versions.items():
        assert rows(db.snapshot(v)) == want
    assert db.compact() and rows(db.snapshot()) == model and len(db) == len(model)
    assert db.vacuum() and rows(db.snapshot()) == model
    assert all(db.check().values())
    with pytest.raises(WrongValue):
        db.snapshot(1)


def test_mapping_surface_and_errors(spark, store):
    db = store.open("m")
    db[b"a"] = b"1"
    db[b"b"] = b""
    assert db[b"a"] == b"1" and db[b"b"] == b"" and b"c" not in db and list(db) == [b"a", b"b"]
    assert db.setdefault(b"a", b"9") == b"1"
    del db[b"a"]
    with pytest.raises(NoValidPosition):
        del db[b"a"]
    with pytest.raises(KeyError):
        db[b"a"]
    with pytest.raises(TypeMismatch):
        store.open("m", "replicated")
    with pytest.raises(KeyTooBig):
        store.open("x" * 56)
    with pytest.raises(WrongValue):
        store.drop("nothing")
    with pytest.raises(NotSupported):
        db.begin("other")
    with pytest.raises(Exception, match="KeyTooBig"):
        db.put(frame(spark, {b"k" * ((1 << 20) + 1): b""}))
    t = db.begin()
    with pytest.raises(TransactionActive):
        store.drop("m")
    t.rollback()
    store.export_db("m", f"{store.path}-out")
    assert rows(store.import_db("n", f"{store.path}-out").snapshot()) == {b"b": b""}
    assert {(r["name"], r["type_id"]) for r in store.list_dbs().collect()} == {("m", 0), ("n", 0)}
    db.truncate()
    assert len(db) == 0 and store.file_size() > 0
    store.drop("m")
    assert [r["name"] for r in store.list_dbs().collect()] == ["n"]


def test_repair(spark, store):
    db = store.open("r")
    db.put(frame(spark, {b"a": b"1"}))
    second = db.put(frame(spark, {b"b": b"2"}))
    db.put(frame(spark, {b"c": b"3"}))
    db.files.delete(f"r/log/main-{second}-0")
    assert db.repair() == [second, second + 1]
    assert rows(db.snapshot()) == {b"a": b"1"}


def test_confluence(spark, store):
    db = store.open("c", "confluence")
    db.put(frame(spark, {b"m": b"0", b"k": b"0"}))
    one, two = db.begin("w1"), db.begin("w2")
    one.put(frame(spark, {b"a": b"1"}))
    two.put(frame(spark, {b"b": b"2"}))
    two.delete(keys(spark, [b"m"]))
    assert rows(db.snapshot()) == {b"m": b"0", b"k": b"0"}
    one.commit()
    two.commit()
    want = {b"a": b"1", b"b": b"2", b"k": b"0"}
    db.update()
    assert rows(db.snapshot()) == want
    db.set_merge_write_threshold(2)
    db.set_max_attached_age_ms(3_600_000)
    assert db.merge_now() == ["w2"]
    assert rows(db.snapshot()) == want
    assert db.merge_all() == ["w1"] and rows(db.snapshot()) == want and db.get_merge_error() is None
    assert {r["origin"] for r in db.txns().collect()} >= {"merge"}


def test_two_handles_lose_nothing(spark, store):
    a = store.open("p", "replicated")
    b = store.open("p", "replicated")
    a.put(frame(spark, {b"k1": b"1", b"x": b"1"}))
    b.update()
    b.put(frame(spark, {b"k2": b"2"}))
    b.delete(keys(spark, [b"x"]))
    assert a.purge()[0] == 0
    b.put(frame(spark, {b"k3": b"3"}))
    assert a.compact()
    want = {b"k1": b"1", b"k2": b"2", b"k3": b"3"}
    assert rows(a.snapshot()) == want
    b.update()
    assert rows(b.snapshot()) == want and [bytes(r["key"]) for r in b.deletions().collect()] == [b"x"]


def interrupted(db, action, times=1):
    """Runs action after the first steps of db's next folds, which have read and not yet written by then."""
    last, left = db._last, [times]

    def then(*args):
        out = last(*args)
        if left[0]:
            left[0] -= 1
            action()
        return out

    db._last = then


@pytest.mark.parametrize("way", ["compact", "purge", "merge_all"])
def test_commits_beside_a_fold_stay(spark, store, way):
    kind = "confluence_replicated"
    a, b = store.open("f", kind), store.open("f", kind)
    a.put(frame(spark, {b"m": b"0", b"k": b"0"}))
    a.put(frame(spark, {b"w": b"1"}), "w1")
    interrupted(a, lambda: (b.put(frame(spark, {b"k": b"2"}), "w2"), b.delete(keys(spark, [b"m"]), source="w3")))
    getattr(a, way)()
    assert a.get_merge_error() is None
    want = {b"k": b"2", b"w": b"1"}
    assert rows(a.snapshot()) == want
    b.update()
    assert rows(b.snapshot()) == want and b.merge_all() == ["w2", "w3"] and rows(b.snapshot()) == want


def test_fold_beside_a_fold_starts_again(spark, store):
    a, b = store.open("g"), store.open("g")
    a.put(frame(spark, {b"a": b"1"}))
    interrupted(a, lambda: (b.put(frame(spark, {b"b": b"2"})), b.compact()))
    a.compact()
    assert rows(a.snapshot()) == {b"a": b"1", b"b": b"2"} and all(a.check().values())
    before = set(a.files.names("g/snapshot"))
    interrupted(a, b.truncate)
    a.compact()
    assert rows(a.snapshot()) == {}
    assert not a.vacuum() or before - set(a.files.names("g/snapshot"))


def test_open_and_vacuum_spare_a_live_transaction(spark, store):
    db = store.open("l")
    t = db.begin()
    t.put(frame(spark, {b"a": b"1"}))
    other = store.open("l")
    assert other.vacuum() == [] and t.commit() is True
    assert t.commit() is False
    other.update()
    assert rows(other.snapshot()) == {b"a": b"1"}


def test_merging_one_source_keeps_the_order_of_changes(spark, store):
    db = store.open("o", "confluence")
    db.put(frame(spark, {b"k": b"0", b"d": b"0", b"e": b"0"}))
    one, two = db.begin("w1"), db.begin("w2")
    one.put(frame(spark, {b"k": b"1", b"d": b"1", b"e": b"1"}))
    two.put(frame(spark, {b"k": b"2"}))
    two.delete(keys(spark, [b"d"]))
    two.commit()
    want = {b"k": b"2", b"e": b"0"}
    assert rows(db.snapshot()) == want
    db.set_merge_write_threshold(0)
    assert db.merge_now() == ["w2"] and rows(db.snapshot()) == want
    one.commit()
    assert rows(db.snapshot()) == {b"k": b"2", b"e": b"1"}
    assert db.merge_all() == ["w1"] and rows(db.snapshot()) == {b"k": b"2", b"e": b"1"}
    assert db.base().filter("op = 'del'").count() == 0


def test_writers_in_threads_get_unique_transactions(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    store.open("t", "confluence")

    def work(w):
        db = store.open("t", "confluence")
        return [db.put(frame(spark, {b"%d/%d" % (w, i): b"v"}), f"w{w}") for i in range(3)]

    with ThreadPoolExecutor(4) as pool:
        ids = [x for got in pool.map(work, range(4)) for x in got]
    db = store.open("t", "confluence")
    assert len(set(ids)) == 12 and len(db) == 12 and all(db.check().values())


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_export_and_import(spark, store, fmt):
    db = store.open("e")
    db.put(frame(spark, {b"": b"", b"a\xff\n": b"x,\"y\"", b"b": b""}))
    store.export_db("e", f"{store.path}-{fmt}", fmt)
    assert rows(store.import_db("i", f"{store.path}-{fmt}", fmt=fmt).snapshot()) == rows(db.snapshot()) and store.filename() == store.path


def test_begin_waits_for_the_other_writer(spark, store):
    import threading

    db, other = store.open("w"), store.open("w")
    t = db.begin()
    with pytest.raises(TransactionActive):
        other.begin()
    with pytest.raises(TransactionActive):
        other.begin(non_blocking=False, wait_seconds=0.2)
    threading.Timer(0.5, t.rollback).start()
    assert other.begin(non_blocking=False, wait_seconds=20).rollback()


def test_session_phases_and_codes(spark):
    src, dst = replica(spark, {b"k0": b"new", b"k1": b"1"}, [b"k9"]), replica(spark, {b"k0": b"old", b"k9": b"2"})
    seen, done, failed = [], [], []
    _, report = replication.session(src, dst, on_progress=seen.append, on_complete=done.append)
    assert [r["phase"] for r in seen] == ["deletions", "difference", "data"] and [r["records"] for r in seen] == [1, 1, 3] and seen[-1]["bytes"] == 2 + 4 + 4
    assert (report["state"], report["code"], report["deleted"]) == ("idle", 0, 1) and done
    for how, code in (({"mode": "none"}, "INVALID_STATE"), ({"max_bytes": 3}, "PAYLOAD_TOO_LARGE")):
        with pytest.raises(ReplicationFailed) as e:
            replication.session(src, dst, on_error=failed.append, **how)
        assert e.value.code == code and failed[-1]["code"] == replication.ERRORS[code] and failed[-1]["state"] == "error"
    with pytest.raises(ReplicationFailed, match="INVALID_MESSAGE"):
        replication.session(replication.Replica(src.main.drop("value"), src.deletions), dst)


def test_hooks_of_steps(spark, store):
    class Steps(Aspect):
        def __init__(self):
            self.seen = []

        def on_next(self, steps, hits):
            self.seen.append(("next", steps, hits))

        def on_prev(self, steps, hits):
            self.seen.append(("prev", steps, hits))

    a = Steps()
    db = store.open("s", aspect=a)
    db.put(frame(spark, {b"a": b"1", b"c": b"3"}))
    db.seek_next(keys(spark, [b"a", b"b", b"c"]))
    db.seek_prev(keys(spark, [b"a", b"b"]))
    assert a.seen == [("next", 3, 2), ("prev", 2, 1)] and list(db) == [b"a", b"c"] and a.seen[2:] == [("next", 1, 1)] * 2


def test_next_purge(spark, store):
    db = store.open("np", "replicated")
    db.put(frame(spark, {b"a": b"1"}))
    assert db.next_purge() is None
    db.delete(keys(spark, [b"a"]))
    marked = db.deletions().first()["deleted_at"]
    assert (db.next_purge() - marked).total_seconds() == replication.RETENTION_SECONDS


def test_old_manifest_versions_go(spark, store):
    db = store.open("v")
    for i in range(130):
        db.set_retention(i)
    assert 100 <= len(db._versions()) <= 111 and db._load()["retention"] == 129


class Tagged(Metrics):
    def on_write(self, key, value):
        return F.concat(F.lit(b"#"), value)

    def on_read(self, key, value):
        return F.substring(value, 2, 1 << 30)

    def may_delete(self, key, value):
        return key != F.lit(bytearray(b"pinned"))

    def before_find(self, key):
        return key != F.lit(bytearray(b"secret"))


def test_aspects_and_metrics(spark, store):
    a = Tagged()
    db = store.open("a", "replicated", a)
    db.put(frame(spark, {b"pinned": b"1", b"x": b"22", b"secret": b"s"}))
    assert rows(db.snapshot())[b"x"] == b"22" and rows(db._raw())[b"x"] == b"#22"
    db.delete(keys(spark, [b"pinned", b"x"]))
    assert set(rows(db.snapshot())) == {b"pinned", b"secret"}
    with pytest.raises(NoValidPosition):
        db.delete(keys(spark, [b"pinned"]), strict=True)
    found = {bytes(r["key"]): r["value"] for r in db.find(keys(spark, [b"pinned", b"secret", b"none"])).collect()}
    assert found[b"secret"] is None and found[b"none"] is None and bytes(found[b"pinned"]) == b"1"
    assert [bytes(r["key"]) for r in db.deletions().collect()] == [b"x"]
    assert a.ops_snapshot()["writes"] == 3 and a.ops_snapshot()["deletes"] == 1
    assert a.nav_snapshot() == {"finds": 2, "finds_hit": 1, "navigations": 0}
    assert a.txn_snapshot()["user_rolled_back"] == 1
    db.set_retention(0)
    assert db.purge(F.current_timestamp() + F.expr("interval 1 day"))[0] == 1 and db.deletions().count() == 0
    assert a.maintenance_snapshot()["sanitize"] == 0


class NoCommit(Aspect):
    def before_commit(self, txn_id):
        return False


def test_vetoed_commit(spark, store):
    db = store.open("v", aspect=NoCommit())
    t = db.begin()
    t.put(frame(spark, {b"a": b"1"}))
    assert t.commit() is False and len(db) == 0
    assert t.rollback()


def test_replicated_stores(spark, store):
    a, b = store.open("ra", "replicated"), store.open("rb", "replicated")
    a.put(frame(spark, {b"%d" % i: b"a" for i in range(6)}))
    b.put(frame(spark, {b"5": b"b", b"z": b"b"}))
    a.delete(keys(spark, [b"0"]))
    report = b.receive(a)
    assert (report["keys_added"], report["overwritten"]) == (4, 1)
    assert set(rows(b.snapshot())) == {b"1", b"2", b"3", b"4", b"5", b"z"}
    assert [bytes(r["key"]) for r in b.deletions().collect()] == [b"0"]


def test_stream_keeps_current(spark, tmp_path):
    from keyloom.streaming import changes

    src = str(tmp_path / "log")
    schema = "source string, txn_id long, seq long, op string, key string, value string"
    table = changes.CurrentTable(spark, f"file://{tmp_path}/t", schema)
    assert table.read().count() == 0
    batches = ([("s", 1, 0, "put", "a", "1"), ("s", 2, 0, "put", "b", "2")], [("s", 3, 0, "del", "a", None), ("s", 4, 0, "put", "c", "3")], [("s", 0, 0, "put", "a", "late"), ("s", 5, 0, "put", "b", "5")])
    want = ({"a": "1", "b": "2"}, {"b": "2", "c": "3"}, {"b": "5", "c": "3"})
    for batch, rows_now in zip(batches, want):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        table.follow(changes.stream_log(spark, src, schema), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert {r["key"]: r["value"] for r in table.read().collect()} == rows_now
        if batch is batches[1]:
            table.compact()
            assert {r["key"]: r["value"] for r in table.read().collect()} == rows_now


def test_windowed_stream(spark, tmp_path, sf_dir):
    from keyloom.sources import tables
    from keyloom.streaming import changes

    log = tables.change_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "log")
    log.orderBy("ts").coalesce(1).write.parquet(src)
    q = changes.activity(changes.stream_log(spark, src, log.schema)).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("act").collect()}
    assert got == {tuple(r) for r in changes.activity(log).collect()}


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("kind", ["binary", "string"])
def test_trie_of_long_keys(spark, kind, cut):
    r = random.Random(5)
    stems = ["s" * 70, "u" * 63, "é" * 90, ""]
    ks = sorted({s + "".join(r.choice("ab") for _ in range(r.randrange(9))) for s in stems for _ in range(20)}, key=str.encode)
    if kind == "binary":
        ks = sorted({*(k.encode() for k in ks), b"\xff" * 80, b"\xff" * 81, b"\xff" * 80 + b"\x00", b"\xff\xff"})
    kv = spark.createDataFrame([(bytearray(k) if kind == "binary" else k, bytearray(b"v")) for k in ks], f"key {kind}, value binary")
    want = {}
    for k in ks:
        for d in range(len(k) + 1):
            want.setdefault(k[:d], []).append(k[d : d + 1])
    want = {(p, len(p), len(set(n)), len(n)) for p, n in want.items()}
    plain = lambda df: {tuple(bytes(c) if isinstance(c, bytearray) else c for c in x) for x in df.collect()}
    assert plain(trie.fanout(kv)) == want
    branches = {x for x in want if x[2] > 1}
    assert max(d for _, d, _, _ in branches) > 64
    bounds = [bytearray(k) if kind == "binary" else k for k in ks[1::7]] if cut else []
    assert plain(trie.branch_nodes(kv, bounds)) == branches
    size = lambda p: len(p if kind == "binary" else p.encode())
    assert {(x["n"], x["bytes"]) for x in trie.node_counts(kv).collect() if x["kind"] == "branch"} == {(len(branches), sum(size(p) for p, *_ in branches))}
    assert plain(trie.dump(kv).filter("kind = 'branch'").select("prefix", "fanout")) == {(p, f) for p, _, f, _ in branches}


def test_branches_of_the_longest_keys(spark):
    n = (1 << 20) - 1
    kv = frame(spark, {b"k" * n + c: b"" for c in (b"a", b"b")})
    assert [(len(x["prefix"]), x["depth"], x["fanout"], x["keys"]) for x in trie.branch_nodes(kv).collect()] == [(n, n, 2, 2)]


def test_counters_of_reads_and_merges(spark, store):
    m = Metrics()
    db = store.open("n", aspect=m)
    db.put(frame(spark, {b"a": b"11", b"b": b"2", b"c": b"333"}))
    assert db[b"a"] == b"11" and b"z" not in db
    db.find(keys(spark, [b"c", b"none"]))
    assert m.ops_snapshot() == {"writes": 3, "bytes_written": 6, "reads": 2, "bytes_read": 5, "deletes": 0}
    near = {bytes(r["key"]): r["near_key"] and bytes(r["near_key"]) for r in db.seek_next(keys(spark, [b"a", b"c"])).collect()}
    assert near == {b"a": b"b", b"c": None}
    assert {bytes(r["near_value"]) for r in db.seek_prev(keys(spark, [b"b"])).collect()} == {b"11"}
    assert list(db) == [b"a", b"b", b"c"]
    assert m.nav_snapshot() == {"finds": 4, "finds_hit": 2, "navigations": 6}
    assert (m.ops_snapshot()["reads"], m.ops_snapshot()["bytes_read"]) == (4, 8)

    m = Metrics()
    c = store.open("nc", "confluence", m)
    c.put(frame(spark, {b"k": b"0", b"m": b"0", b"s": b"0"}))
    with c.begin("w1") as t:
        t.put(frame(spark, {b"k": b"1", b"s": b"0", b"new": b"1"}))
        t.delete(keys(spark, [b"m", b"absent"]))
    assert c.merge_all() == ["w1"] and rows(c.snapshot()) == {b"k": b"1", b"s": b"0", b"new": b"1"}
    assert c.get_merge_error() is None and m.merge_snapshot() == {"overwrites": 2, "adds": 1, "merge_deletes": 1}

    m = Metrics()
    x, y = store.open("nx", "replicated"), store.open("ny", "replicated", m)
    x.put(frame(spark, {b"%d" % i: b"a" for i in range(4)}))
    y.put(frame(spark, {b"0": b"a", b"3": b"b"}))
    x.delete(keys(spark, [b"0"]))
    y.receive(x)
    assert m.merge_snapshot() == {"overwrites": 1, "adds": 2, "merge_deletes": 1}
