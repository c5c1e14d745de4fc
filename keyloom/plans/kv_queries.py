"""Every key-value operator as a query over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import codec
from keyloom.functions.aspects import Aspect, Metrics
from keyloom.operators import hashing, history, merging, reads, replication, trie
from keyloom.sources import tables as t
from keyloom.sources.store import Db, Store
from keyloom.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

# SQL of the key-value tables
ORDERS = "(SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS value, o_orderkey AS k FROM orders)"
CUSTOMERS = "(SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, c_mktsegment AS value, c_custkey AS k FROM customer)"
BALANCES = "(SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key, CAST(c_acctbal AS DECIMAL(18,2)) AS value, c_custkey AS k FROM customer)"
SUPPLIERS = "(SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS key, s_name AS value, s_suppkey AS k FROM supplier)"
PARTS = "(SELECT p_brand || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key, p_name AS value FROM part)"
LINES = (
    "(SELECT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') "
    "|| strftime(l_shipdate, '%Y%m%d') AS key, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS value FROM lineitem)"
)
NAMES = "(SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name NOT IN (SELECT n_name FROM nation))"
LOG = "(SELECT CAST(user_id % 8 AS VARCHAR) AS source, event_id AS txn_id, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_type AS value, ts FROM events)"
STATE = "CASE event_id % 10 WHEN 3 THEN 'aborted' WHEN 5 THEN 'prepared' WHEN 7 THEN 'open' ELSE 'committed' END"
HASH = "sha256(CAST(strlen({0}.key) AS VARCHAR) || ':' || {0}.key || {0}.value)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _numbered(kv: DataFrame) -> DataFrame:
    return kv.withColumn("k", F.col("key").cast("long"))


# point reads -----------------------------------------------------------------------------------------------------------


@query(f"SELECT key, value FROM {ORDERS} WHERE k = 17")
def get_one(spark, sf_dir):
    return reads.get(t.orders(spark, sf_dir), "000000000017")


def _probes(spark, sf_dir):
    """Every third order key, and as many that are absent."""
    k = t.read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 100_000_000)).alias("k"))
    return k.select(codec.padded(F.col("k"), 12).alias("key"))


PROBES = "(SELECT lpad(CAST(unnest([o_orderkey, o_orderkey + 100000000]) AS VARCHAR), 12, '0') AS key FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"SELECT p.key, o.value FROM {PROBES} p LEFT JOIN {ORDERS} o USING (key)")
def get_many(spark, sf_dir):
    return reads.get_many(t.orders(spark, sf_dir), _probes(spark, sf_dir))


@query(f"SELECT p.key, o.key IS NOT NULL AS found FROM {PROBES} p LEFT JOIN {ORDERS} o ON o.key = p.key")
def contains_many(spark, sf_dir):
    return reads.contains_many(t.orders(spark, sf_dir), _probes(spark, sf_dir))


@query(f"SELECT key, value FROM {ORDERS} ORDER BY key LIMIT 1")
def first_kv(spark, sf_dir):
    return reads.first_kv(t.orders(spark, sf_dir))


@query(f"SELECT key, value FROM {ORDERS} ORDER BY key DESC LIMIT 1")
def last_kv(spark, sf_dir):
    return reads.last_kv(t.orders(spark, sf_dir))


@query(f"SELECT count(*) AS n FROM {ORDERS}")
def count_kv(spark, sf_dir):
    return reads.count_kv(t.orders(spark, sf_dir))


@query(f"SELECT key FROM {ORDERS}")
def keys_only(spark, sf_dir):
    return t.orders(spark, sf_dir).select("key")


# neighbours ------------------------------------------------------------------------------------------------------------


@query(f"SELECT key, lead(key) OVER w AS near_key, lead(value) OVER w AS near_value FROM {CUSTOMERS} WINDOW w AS (ORDER BY key)")
def next_all(spark, sf_dir):
    return reads.next_all(t.customers(spark, sf_dir))


@query(f"SELECT key, lag(key) OVER w AS near_key, lag(value) OVER w AS near_value FROM {CUSTOMERS} WINDOW w AS (ORDER BY key)")
def prev_all(spark, sf_dir):
    return reads.prev_all(t.customers(spark, sf_dir))


def _third(spark, sf_dir):
    return t.orders(spark, sf_dir).filter(F.col("key").cast("long") % 3 == 0)


@query(f"SELECT o.key, n.key AS near_key, n.value AS near_value FROM {ORDERS} o ASOF LEFT JOIN (SELECT * FROM {ORDERS} WHERE k % 3 = 0) n ON o.key < n.key")
def seek_next(spark, sf_dir):
    return reads.seek_next(_third(spark, sf_dir), t.orders(spark, sf_dir).select("key"))


@query(f"SELECT o.key, n.key AS near_key, n.value AS near_value FROM {ORDERS} o ASOF LEFT JOIN (SELECT * FROM {ORDERS} WHERE k % 3 = 0) n ON o.key > n.key")
def seek_prev(spark, sf_dir):
    return reads.seek_prev(_third(spark, sf_dir), t.orders(spark, sf_dir).select("key"))


@query(f"SELECT o.key, n.key AS near_key, n.value AS near_value FROM {ORDERS} o ASOF LEFT JOIN (SELECT * FROM {ORDERS} WHERE k % 3 = 0) n ON o.key <= n.key")
def lower_bound(spark, sf_dir):
    return reads.lower_bound(_third(spark, sf_dir), t.orders(spark, sf_dir).select("key"))


# the same over every order key and the whole table; a lengthened key is absent and lies between two
EVERY = f"(SELECT unnest([key, key || '5']) AS key FROM {ORDERS})"


def _every(spark, sf_dir):
    return t.orders(spark, sf_dir).select(F.explode(F.array("key", F.concat("key", F.lit("5")))).alias("key"))


@query(f"SELECT p.key, o.value FROM {EVERY} p LEFT JOIN {ORDERS} o USING (key)")
def get_many_all(spark, sf_dir):
    return reads.get_many(t.orders(spark, sf_dir), _every(spark, sf_dir))


@query(f"SELECT p.key, o.key IS NOT NULL AS found FROM {EVERY} p LEFT JOIN {ORDERS} o ON o.key = p.key")
def contains_many_all(spark, sf_dir):
    return reads.contains_many(t.orders(spark, sf_dir), _every(spark, sf_dir))


@query(f"SELECT p.key, n.key AS near_key, n.value AS near_value FROM {EVERY} p ASOF LEFT JOIN {ORDERS} n ON p.key < n.key")
def seek_next_all(spark, sf_dir):
    return reads.seek_next(t.orders(spark, sf_dir), _every(spark, sf_dir))


@query(f"SELECT p.key, n.key AS near_key, n.value AS near_value FROM {EVERY} p ASOF LEFT JOIN {ORDERS} n ON p.key > n.key")
def seek_prev_all(spark, sf_dir):
    return reads.seek_prev(t.orders(spark, sf_dir), _every(spark, sf_dir))


@query(f"SELECT p.key, n.key AS near_key, n.value AS near_value FROM {EVERY} p ASOF LEFT JOIN {ORDERS} n ON p.key <= n.key")
def lower_bound_all(spark, sf_dir):
    return reads.lower_bound(t.orders(spark, sf_dir), _every(spark, sf_dir))


# scans -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT key, value FROM {ORDERS}")
def scan_forward(spark, sf_dir):
    return reads.scan(t.orders(spark, sf_dir))


@query(f"SELECT key, value FROM {ORDERS}")
def scan_reverse(spark, sf_dir):
    return reads.scan(t.orders(spark, sf_dir), reverse=True)


@query(f"SELECT key, value FROM {LINES} WHERE key >= '000000000100' ORDER BY key LIMIT 10")
def scan_from_10(spark, sf_dir):
    return reads.scan_from(t.lineitems(spark, sf_dir), "000000000100", 10)


@query(f"SELECT key, value FROM {LINES} WHERE key >= '000000000100' ORDER BY key LIMIT 100")
def scan_from_100(spark, sf_dir):
    return reads.scan_from(t.lineitems(spark, sf_dir), "000000000100", 100)


@query(f"SELECT key, value FROM {LINES} WHERE key <= '000000000500' ORDER BY key DESC LIMIT 10")
def scan_back_10(spark, sf_dir):
    return reads.scan_from(t.lineitems(spark, sf_dir), "000000000500", 10, reverse=True)


@query(f"SELECT key, value FROM {PARTS} WHERE key >= 'Brand#2' AND key < 'Brand#4'")
def range_scan(spark, sf_dir):
    return reads.between(t.parts(spark, sf_dir), "Brand#2", "Brand#4")


@query(f"SELECT key, value FROM {PARTS} WHERE starts_with(key, 'Brand#1')")
def prefix_scan(spark, sf_dir):
    return reads.prefix_scan(t.parts(spark, sf_dir), "Brand#1")


# versions and writes ---------------------------------------------------------------------------------------------------

LATEST = "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC) AS r FROM {0} {1}) WHERE r = 1 AND op = 'put'"


@query(LATEST.format(LOG, ""))
def snapshot_latest(spark, sf_dir):
    return history.snapshot(t.change_log(spark, sf_dir))


@query(LATEST.format(LOG, "WHERE txn_id <= 500"))
def snapshot_at_t(spark, sf_dir):
    return history.snapshot(t.change_log(spark, sf_dir), 500)


@query(f"SELECT txn_id, source, CAST(0 AS BIGINT) AS seq, op, key, value FROM {LOG} WHERE key = '00000007'")
def history_of_key(spark, sf_dir):
    return history.history(t.change_log(spark, sf_dir), "00000007")


COMMITTED = f"(SELECT l.* FROM {LOG} l JOIN (SELECT event_id, {STATE} AS state FROM events) s ON s.event_id = l.txn_id WHERE state = 'committed')"


@query(LATEST.format(COMMITTED, ""))
def rollback_view(spark, sf_dir):
    """Aborted, open and prepared transactions are invisible."""
    return history.snapshot(history.committed(t.change_log(spark, sf_dir), t.transactions(spark, sf_dir)))


@query(f"SELECT txn_id, key, op FROM {LOG} l JOIN (SELECT event_id, {STATE} AS state FROM events) s ON s.event_id = l.txn_id WHERE state = 'prepared'")
def prepared_pending(spark, sf_dir):
    txn = t.transactions(spark, sf_dir).filter("state = 'prepared'").select("db", "source", "txn_id")
    return t.change_log(spark, sf_dir).join(txn, ["db", "source", "txn_id"], "left_semi").select("txn_id", "key", "op")


def _wal(spark, sf_dir):
    """A raw log: each event's transaction has begin, change, prepare and commit records, some cut short."""
    e = t.read(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    recs = F.when(m == 3, F.array(*map(F.lit, ("begin", "put", "abort")))).when(m == 5, F.array(*map(F.lit, ("begin", "put", "prepare")))).when(m == 7, F.array(*map(F.lit, ("begin", "put")))).when(
        m == 9, F.array(*map(F.lit, ("begin", "put", "commit")))
    ).otherwise(F.array(*map(F.lit, ("begin", "put", "prepare", "commit"))))
    return e.select(F.col("event_id").alias("txn_id"), codec.padded(F.col("user_id"), 8).alias("key"), F.col("event_type").alias("value"), F.posexplode(recs).alias("seq", "rec"))


@query("SELECT event_id AS txn_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_type AS value FROM events WHERE event_id % 10 NOT IN (3, 5, 7, 9) AND event_id > 100")
def recover_wal(spark, sf_dir):
    return history.replayable(_wal(spark, sf_dir).filter("txn_id > 100")).select("txn_id", "key", "value")


@query(_sql["recover_wal"].replace(" AND event_id > 100", ""))
def recover_wal_all(spark, sf_dir):
    return history.replayable(_wal(spark, sf_dir)).select("txn_id", "key", "value")


@query("SELECT event_id AS txn_id FROM events WHERE event_id % 10 = 5")
def recover_dangling(spark, sf_dir):
    return history.dangling(_wal(spark, sf_dir))


UPSERTS = "(SELECT key, 'u' || value AS value FROM {0} WHERE k % 5 = 0 UNION ALL SELECT lpad(CAST(o_orderkey + 100000000 AS VARCHAR), 12, '0'), 'new' FROM orders WHERE o_orderkey % 50 = 0)".format(ORDERS)


def _upserts(spark, sf_dir):
    old = t.orders(spark, sf_dir).filter(F.col("key").cast("long") % 5 == 0).select("key", F.concat(F.lit("u"), "value").alias("value"))
    new = t.read(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(codec.padded(F.col("o_orderkey") + 100_000_000, 12).alias("key"), F.lit("new").alias("value"))
    return old.unionByName(new)


@query(f"SELECT coalesce(u.key, o.key) AS key, CASE WHEN u.key IS NOT NULL THEN u.value ELSE o.value END AS value FROM {ORDERS} o FULL JOIN {UPSERTS} u ON u.key = o.key")
def put_upsert(spark, sf_dir):
    return history.upsert(t.orders(spark, sf_dir), _upserts(spark, sf_dir))


@query(f"SELECT key, value FROM {ORDERS} WHERE k % 3 <> 0")
def delete_keys(spark, sf_dir):
    return history.delete_keys(t.orders(spark, sf_dir), _probes(spark, sf_dir))


@query(f"SELECT key, CAST(CASE WHEN k % 4 = 0 THEN value + 100 ELSE value END AS DECIMAL(18,2)) AS value FROM {BALANCES}")
def rmw_increment(spark, sf_dir):
    kv = t.balances(spark, sf_dir)
    out = history.read_modify_write(kv, kv.filter(F.col("key").cast("long") % 4 == 0), lambda k, v: (v + 100).cast("decimal(18,2)"))
    return out


# merges ----------------------------------------------------------------------------------------------------------------

DST = f"(SELECT key, value FROM {ORDERS} WHERE k % 3 <> 0)"
SRC = f"(SELECT key, CAST(CAST(value AS DECIMAL(18,2)) + (k % 5) - 2 AS VARCHAR) AS value, k FROM {ORDERS} WHERE k % 2 = 0)"
PAIRED = f"SELECT coalesce(d.key, s.key) AS key, d.value AS d, s.value AS s, d.key IS NOT NULL AS in_d, s.key IS NOT NULL AS in_s FROM {DST} d FULL JOIN {SRC} s ON s.key = d.key"


def _dst(spark, sf_dir):
    return t.orders(spark, sf_dir).filter(F.col("key").cast("long") % 3 != 0)


def _src(spark, sf_dir):
    k = F.col("key").cast("long")
    return t.orders(spark, sf_dir).filter(k % 2 == 0).select("key", t.money(F.col("value").cast("decimal(18,2)") + (k % 5) - 2).alias("value"))


def _number(v):
    return v.cast("decimal(18,2)")


@query(f"SELECT key, CASE WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED})")
def merge_overwrite(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir))


@query(f"SELECT key, CASE WHEN in_d THEN d ELSE s END AS value FROM ({PAIRED})")
def merge_keep_dst(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir), merging.KEEP_DST)


@query(f"SELECT key, CASE WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED}) WHERE in_d OR CAST(key AS BIGINT) % 4 = 0")
def merge_filter_add(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir), merging.Policy(may_add=lambda k, v: k.cast("long") % 4 == 0))


@query(f"SELECT key, CASE WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED}) WHERE in_d OR NOT starts_with(key, '0000000001')")
def merge_prefix_reject(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir), merging.Policy(rejected_prefixes=("0000000001",)))


@query(f"SELECT key, value FROM {SRC} WHERE substr(key, 1, 11) NOT IN (SELECT substr(key, 1, 11) FROM {ORDERS} WHERE k % 100 = 0)")
def merge_prefix_set(spark, sf_dir):
    prefixes = t.orders(spark, sf_dir).filter(F.col("key").cast("long") % 100 == 0).select(F.substring("key", 1, 11).alias("prefix")).distinct()
    return merging.reject_prefixes(_src(spark, sf_dir), prefixes, [11])


@query(f"SELECT key, CASE WHEN in_d AND in_s THEN CASE WHEN CAST(s AS DECIMAL(18,2)) > CAST(d AS DECIMAL(18,2)) THEN s ELSE d END WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED})")
def merge_lww_tie_dst(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir), merging.newer_wins(_number, tie_to_src=False))


@query(f"SELECT key, CASE WHEN in_d AND in_s THEN CASE WHEN CAST(s AS DECIMAL(18,2)) >= CAST(d AS DECIMAL(18,2)) THEN s ELSE d END WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED})")
def merge_lww_tie_src(spark, sf_dir):
    return merging.merge(_dst(spark, sf_dir), _src(spark, sf_dir), merging.newer_wins(_number, tie_to_src=True))


@query(
    f"SELECT CAST(count(*) FILTER (WHERE in_d AND in_s AND CAST(s AS DECIMAL(18,2)) > CAST(d AS DECIMAL(18,2))) AS BIGINT) AS overwrites, CAST(count(*) FILTER (WHERE in_s AND NOT in_d) AS BIGINT) AS adds, "
    f"CAST(count(*) FILTER (WHERE in_d AND in_s AND NOT CAST(s AS DECIMAL(18,2)) > CAST(d AS DECIMAL(18,2))) AS BIGINT) AS rejected FROM ({PAIRED})"
)
def merge_stats(spark, sf_dir):
    return merging.merge_stats(_dst(spark, sf_dir), _src(spark, sf_dir), merging.newer_wins(_number, tie_to_src=False))


# many writers ----------------------------------------------------------------------------------------------------------


@query(LATEST.format(LOG, ""))
def confluence_resolve(spark, sf_dir):
    return merging.fold(t.change_log(spark, sf_dir))


@query(LATEST.format(LOG, ""))
def confluence_scan(spark, sf_dir):
    return merging.fold(t.change_log(spark, sf_dir)).orderBy("key")


FOLD_LOG = f"(SELECT lpad(CAST(CAST(key AS BIGINT) % 40 AS VARCHAR), 8, '0') AS key, source, txn_id, op, value FROM {LOG})"


@query(
    f"""
WITH RECURSIVE l AS (SELECT key, source, max(txn_id) AS txn_id FROM {FOLD_LOG} GROUP BY key, source),
c AS (SELECT f.key, f.op, f.value, row_number() OVER (PARTITION BY f.key ORDER BY f.txn_id) AS i FROM {FOLD_LOG} f JOIN l USING (key, source, txn_id)),
r AS (SELECT key, CAST(0 AS BIGINT) AS i, false AS present, CAST(NULL AS VARCHAR) AS value FROM (SELECT DISTINCT key FROM c)
      UNION ALL
      SELECT r.key, c.i, CASE WHEN c.op = 'del' THEN false ELSE true END,
             CASE WHEN c.op = 'del' THEN NULL WHEN r.present AND NOT c.value > r.value THEN r.value ELSE c.value END
      FROM r JOIN c ON c.key = r.key AND c.i = r.i + 1)
SELECT key, value FROM r WHERE present AND i = (SELECT max(i) FROM c WHERE c.key = r.key)
"""
)
def confluence_fold_greater(spark, sf_dir):
    """An order-dependent policy: a put replaces a present value only if greater."""
    log = t.change_log(spark, sf_dir).withColumn("key", codec.padded(F.col("key").cast("long") % 40, 8))
    return merging.fold(log, merging.Policy(may_overwrite=lambda k, old, new: new > old))


WRITERS_LOG = f"(SELECT lpad(CAST(CAST(key AS BIGINT) // 8 AS VARCHAR), 8, '0') AS key, source, txn_id, op, value FROM {LOG})"


@query(_sql["confluence_fold_greater"].replace(FOLD_LOG, WRITERS_LOG))
def confluence_fold_writers(spark, sf_dir):
    """The same policy where each key has changes of up to eight writers."""
    log = t.change_log(spark, sf_dir).withColumn("key", codec.padded(F.floor(F.col("key").cast("long") / 8), 8))
    return merging.fold(log, merging.Policy(may_overwrite=lambda k, old, new: new > old))


@query(f"SELECT source, count(*) AS writes, max(ts) AS last_ts, max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR AS idle FROM {LOG} GROUP BY source HAVING count(*) >= 1200 OR max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR")
def confluence_eligible(spark, sf_dir):
    return merging.eligible(t.change_log(spark, sf_dir), 1200, 6 * 3_600_000, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


MAIN_LOG = f"(SELECT * FROM {LOG} WHERE source IN ('0', '1', '2', '3'))"
SIDE = f"(SELECT lpad(CAST(CAST(key AS BIGINT) - 4 AS VARCHAR), 8, '0') AS key, op, value, txn_id FROM {LOG} WHERE source IN ('4', '5', '6', '7') AND CAST(key AS BIGINT) >= 4)"


@query(
    f"WITH m AS ({LATEST.format(MAIN_LOG, '')}), s AS (SELECT key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC) AS r FROM {SIDE}) WHERE r = 1) "
    "SELECT coalesce(s.key, m.key) AS key, CASE WHEN s.key IS NOT NULL THEN s.value ELSE m.value END AS value FROM m FULL JOIN s ON s.key = m.key WHERE s.op IS NULL OR s.op = 'put'"
)
def confluence_compact(spark, sf_dir):
    log = t.change_log(spark, sf_dir)
    main = history.snapshot(log.filter("source < '4'"))
    side = log.filter("source >= '4' and key >= '00000004'").withColumn("key", codec.padded(F.col("key").cast("long") - 4, 8))
    return merging.compact(main, side)


# hashes and differences ------------------------------------------------------------------------------------------------

OTHER = f"(SELECT key, CASE WHEN k % 7 = 0 THEN value || '0' ELSE value END AS value FROM {ORDERS} WHERE k % 11 <> 0)"


def _other(spark, sf_dir):
    k = F.col("key").cast("long")
    return t.orders(spark, sf_dir).filter(k % 11 != 0).select("key", F.when(k % 7 == 0, F.concat("value", F.lit("0"))).otherwise(F.col("value")).alias("value"))


@query(f"SELECT key, {HASH.format('o')} AS hash FROM {ORDERS} o")
def hash_leaf(spark, sf_dir):
    return hashing.record_hashes(t.orders(spark, sf_dir)).select("key", "hash")


BUCKETS = f"SELECT substr(key, 1, 10) AS prefix, 10 AS depth, count(*) AS n, sha256(string_agg(h, '' ORDER BY key)) AS hash FROM (SELECT key, {HASH.format('o')} AS h FROM {ORDERS} o) GROUP BY 1"


@query(BUCKETS)
def hash_bucket(spark, sf_dir):
    return hashing.level(t.orders(spark, sf_dir), 10)


@query(
    f"WITH b AS ({BUCKETS}), c AS (SELECT substr(prefix, 1, 8) AS prefix, 8 AS depth, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM b GROUP BY 1), "
    "d AS (SELECT substr(prefix, 1, 4) AS prefix, 4 AS depth, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM c GROUP BY 1) "
    "SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d"
)
def hash_levels(spark, sf_dir):
    return hashing.levels(t.orders(spark, sf_dir), [10, 8, 4])


@query(f"SELECT * FROM ({BUCKETS}) WHERE prefix = '0000000001'")
def hash_lookup(spark, sf_dir):
    return hashing.lookup(hashing.level(t.orders(spark, sf_dir), 10), "0000000001")


@query(BUCKETS.replace(ORDERS + " o", OTHER + " o"))
def hash_update(spark, sf_dir):
    """Buckets brought up to date after changes, from the old ones."""
    old, new = t.orders(spark, sf_dir), _other(spark, sf_dir)
    touched = old.filter((F.col("key").cast("long") % 7 == 0) | (F.col("key").cast("long") % 11 == 0))
    return hashing.update_level(hashing.level(old, 10), new, touched, 10)


@query(f"SELECT DISTINCT substr(o.key, 1, 10) AS prefix FROM {ORDERS} o LEFT JOIN {OTHER} x USING (key) WHERE x.value IS DISTINCT FROM o.value")
def diff_buckets(spark, sf_dir):
    return hashing.diff_buckets(t.orders(spark, sf_dir), _other(spark, sf_dir), 10)


DIFF = f"SELECT coalesce(o.key, x.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN x.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {ORDERS} o FULL JOIN {OTHER} x ON x.key = o.key WHERE x.value IS DISTINCT FROM o.value"


@query(DIFF)
def diff_keys(spark, sf_dir):
    return hashing.diff(t.orders(spark, sf_dir), _other(spark, sf_dir))


@query(DIFF)
def diff_by_bucket(spark, sf_dir):
    return hashing.diff(t.orders(spark, sf_dir), _other(spark, sf_dir), 10)


# replication -----------------------------------------------------------------------------------------------------------

# source: other orders, with markers for k % 11 = 0; destination: orders but k % 13 = 0, of which it holds markers
STICKY = f"""
WITH src AS {OTHER}, sd AS (SELECT key FROM {ORDERS} WHERE k % 11 = 0), dst AS (SELECT key, value FROM {ORDERS} WHERE k % 13 <> 0), dd AS (SELECT key FROM {ORDERS} WHERE k % 13 = 0),
m1 AS (SELECT * FROM dst WHERE key NOT IN (SELECT key FROM sd WHERE key NOT IN (SELECT key FROM dd)))
SELECT coalesce(m1.key, src.key) AS key, CASE WHEN src.key IS NOT NULL THEN src.value ELSE m1.value END AS value
FROM m1 FULL JOIN src ON src.key = m1.key WHERE m1.key IS NOT NULL OR src.key NOT IN (SELECT key FROM dd)
"""


def _marks(kv: DataFrame, mod: int) -> DataFrame:
    return kv.filter(F.col("key").cast("long") % mod == 0).select("key", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("deleted_at"), F.lit(None).cast("binary").alias("meta"))


def _replicas(spark, sf_dir):
    kv = t.orders(spark, sf_dir)
    return replication.Replica(_other(spark, sf_dir), _marks(kv, 11)), replication.Replica(kv.filter(F.col("key").cast("long") % 13 != 0), _marks(kv, 13))


@query(STICKY)
def replicate_sticky(spark, sf_dir):
    src, dst = _replicas(spark, sf_dir)
    return replication.apply(src, dst).main


@query(f"SELECT key FROM {ORDERS} WHERE k % 11 = 0 OR k % 13 = 0")
def replicate_markers(spark, sf_dir):
    src, dst = _replicas(spark, sf_dir)
    return replication.apply(src, dst).deletions.select("key")


@query(f"SELECT key, value FROM {OTHER}")
def replicate_apply(spark, sf_dir):
    src, dst = _replicas(spark, sf_dir)
    return replication.apply(src, dst, mode="lww").main


@query(
    f"WITH a AS (SELECT key, value FROM {ORDERS} WHERE k % 3 <> 0), b AS (SELECT key, value FROM {ORDERS} WHERE k % 3 <> 1), gone AS (SELECT key FROM {ORDERS} WHERE k % 6 = 0 UNION SELECT key FROM {ORDERS} WHERE k % 10 = 1) "
    "SELECT r.replica, o.key, o.value FROM (SELECT * FROM a UNION SELECT * FROM b) o, (SELECT unnest(['a', 'b']) AS replica) r WHERE o.key NOT IN (SELECT key FROM gone)"
)
def sync_converge(spark, sf_dir):
    kv = t.orders(spark, sf_dir).withColumn("k", F.col("key").cast("long"))
    mark = lambda rows: rows.select("key", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("deleted_at"), F.lit(None).cast("binary").alias("meta"))
    a = replication.Replica(kv.filter("k % 3 <> 0 and k % 10 <> 1").select("key", "value"), mark(kv.filter("k % 10 = 1 and k % 3 <> 0")))
    b = replication.Replica(kv.filter("k % 3 <> 1 and k % 6 <> 0").select("key", "value"), mark(kv.filter("k % 6 = 0")))
    # keys deleted on one side only reach the other as deletions
    b = replication.Replica(b.main.join(kv.filter("k % 10 = 1").select("key"), "key", "left_anti"), b.deletions.unionByName(mark(kv.filter("k % 10 = 1 and k % 3 = 0 and k % 6 <> 0"))))
    x, y = replication.sync(a, b)
    return x.main.withColumn("replica", F.lit("a")).unionByName(y.main.withColumn("replica", F.lit("b")))


MARKERS = "(SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS key, ts AS deleted_at FROM events WHERE event_type = 'error')"


def _event_marks(spark, sf_dir):
    return t.read(spark, sf_dir, "events").filter("event_type = 'error'").select(codec.padded(F.col("event_id"), 10).alias("key"), F.col("ts").alias("deleted_at"))


@query(f"SELECT key, deleted_at FROM {MARKERS} WHERE deleted_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECOND")
def purge_deletions(spark, sf_dir):
    return replication.purge(_event_marks(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(f"SELECT count(*) FILTER (WHERE deleted_at <= c) AS purged, min(deleted_at) FILTER (WHERE deleted_at > c) AS oldest_remaining FROM {MARKERS}, (SELECT TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECOND AS c)")
def oldest_remaining(spark, sf_dir):
    return replication.purge_stats(_event_marks(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query(f"SELECT key, value FROM {CUSTOMERS} WHERE NOT (k % 2 = 0 AND value <> 'BUILDING')")
def veto_delete(spark, sf_dir):
    """Even keys are deleted unless the hook protects their value."""
    kv = t.customers(spark, sf_dir)
    none = spark.createDataFrame([], "key string, deleted_at timestamp, meta binary")
    out = replication.tracked_delete(replication.Replica(kv, none), kv.filter(F.col("key").cast("long") % 2 == 0), F.lit("2024-01-01").cast("timestamp"), lambda k, v: v != "BUILDING")
    return out.main


class Tagged(Aspect):
    """A tag before every value, added on write and taken off on read."""

    def on_write(self, key, value):
        return F.concat(F.lit(b"tag:"), value)

    def on_read(self, key, value):
        return F.substr(value, F.lit(5))


def _db(spark, kind: str = "plain", aspect: Aspect | None = None, kv: DataFrame | None = None) -> Db:
    """A database of its own, with rows if given."""
    db = Store.in_memory(spark).open("q", kind, aspect)
    if kv is not None:
        db.put(t.binary(kv))
    return db


def _keys(kv: DataFrame) -> DataFrame:
    return kv.select(F.col("key").cast("binary").alias("key"))


@query(f"SELECT key, 'tag:' || value AS stored, value FROM {CUSTOMERS}")
def transform_roundtrip(spark, sf_dir):
    """A value transformed on write and back on read."""
    db = _db(spark, aspect=Tagged(), kv=t.customers(spark, sf_dir))
    return t.text(db._raw()).withColumnRenamed("value", "stored").join(t.text(db.snapshot()), "key").select("key", "stored", "value")


# metrics ---------------------------------------------------------------------------------------------------------------


def _counted(spark, counts: dict[str, int], *names: str) -> DataFrame:
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"SELECT count(*) FILTER (WHERE op = 'put') AS writes, CAST(sum(strlen(value)) FILTER (WHERE op = 'put') AS BIGINT) AS bytes_written, count(*) FILTER (WHERE op = 'del') AS deletes FROM {LOG}")
def ops_stats(spark, sf_dir):
    m = Metrics()
    log = t.change_log(spark, sf_dir)
    with _db(spark, "confluence", m).begin() as txn:
        txn.put(t.binary(log.filter("op = 'put'")))
        txn.delete(_keys(log.filter("op = 'del'")))
    return _counted(spark, m.ops_snapshot(), "writes", "bytes_written", "deletes")


@query("SELECT count(*) AS user_started, count(*) FILTER (WHERE r_regionkey % 2 = 0) AS user_committed, count(*) FILTER (WHERE r_regionkey % 2 = 1) AS user_rolled_back, CAST(0 AS BIGINT) AS merge_committed, CAST(1 AS BIGINT) AS defrag_committed FROM region")
def txn_counters(spark, sf_dir):
    """A transaction for each region; every other one is rolled back. Then a compaction."""
    m = Metrics()
    db = _db(spark, aspect=m)
    for r in t.read(spark, sf_dir, "region").collect():  # a table of fixed size
        txn = db.begin()
        txn.put(spark.createDataFrame([(bytearray(r["r_name"].encode()), bytearray(b"1"))], "key binary, value binary"))
        if r["r_regionkey"] % 2:
            txn.rollback()
        else:
            txn.commit()
    db.compact()
    return _counted(spark, m.txn_snapshot(), "user_started", "user_committed", "user_rolled_back", "merge_committed", "defrag_committed")


@query(f"SELECT CASE WHEN event_id % 4 = 0 THEN 'merge' ELSE 'user' END AS origin, {STATE} AS state, count(*) AS n FROM events GROUP BY 1, 2")
def txn_stats(spark, sf_dir):
    return t.transactions(spark, sf_dir).groupBy("origin", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS finds, count(o.value) AS finds_hit FROM {PROBES} p LEFT JOIN {ORDERS} o USING (key)")
def nav_stats(spark, sf_dir):
    return _found(spark, sf_dir, _probes(spark, sf_dir))


def _found(spark, sf_dir, probes: DataFrame) -> DataFrame:
    m = Metrics()
    db = t.compacted(spark, sf_dir, "orders")
    db.aspect = m
    db.find(_keys(probes))
    return _counted(spark, m.nav_snapshot(), "finds", "finds_hit")


@query(f"SELECT count(*) AS finds, count(o.value) AS finds_hit FROM {EVERY} p LEFT JOIN {ORDERS} o USING (key)")
def nav_stats_all(spark, sf_dir):
    return _found(spark, sf_dir, _every(spark, sf_dir))


@query(f"SELECT 2 * count(*) AS navigations, CAST(2 * (count(*) - 1) AS BIGINT) AS reads FROM {CUSTOMERS}")
def nav_counters(spark, sf_dir):
    """A step to the next and one to the previous record from each record; the ends reach none."""
    m = Metrics()
    db = t.compacted(spark, sf_dir, "customers")
    db.aspect = m
    keys = db.snapshot().select("key")
    db.seek_next(keys)
    db.seek_prev(keys)
    return _counted(spark, m.counts, "navigations", "reads")


# databases -------------------------------------------------------------------------------------------------------------


@query(f"SELECT key, CASE WHEN k % 5 = 0 THEN 'u' || value ELSE value END AS value FROM {ORDERS} WHERE k % 3 <> 0")
def store_two_handles(spark, sf_dir):
    """Writes by two handles, a prepared transaction settled after reopening, compaction and vacuum beside them."""
    kv = t.orders(spark, sf_dir)
    k = F.col("key").cast("string").cast("long")
    a = _db(spark, kv=kv)
    b = a.store.open("q")
    a.delete(_keys(kv).filter(k % 3 == 0))
    pending = b.begin()
    pending.put(t.binary(kv.limit(1).select(F.concat("key", F.lit("x")).alias("key"), "value")))
    pending.prepare()
    a.store.open("q").resolve_prepared(commit=False)
    b.put(t.binary(kv.filter(k % 5 == 0).filter(k % 3 != 0).select("key", F.concat(F.lit("u"), "value").alias("value"))))
    a.compact()
    a.vacuum()
    b.update()
    return t.text(b.snapshot())


@query(f"SELECT key, value FROM {ORDERS} WHERE k % 3 <> 0")
def store_version(spark, sf_dir):
    """The version between two transactions."""
    kv = t.orders(spark, sf_dir)
    db = _db(spark, kv=kv)
    then = db.delete(_keys(kv).filter(F.col("key").cast("string").cast("long") % 3 == 0))
    db.put(t.binary(kv.select("key", F.lit("later").alias("value"))))
    return t.text(db.snapshot(then))


def _tributaries(spark, sf_dir, aspect: Aspect | None = None) -> Db:
    """Main and two sources: one overwrites, adds and deletes, the other is settled by its transaction's order."""
    db = _db(spark, "confluence", aspect, _dst(spark, sf_dir))
    with db.begin("w1") as txn:
        txn.put(t.binary(_src(spark, sf_dir)))
        txn.delete(_keys(t.orders(spark, sf_dir)).filter(F.col("key").cast("string").cast("long") % 18 == 1))
    return db


@query(f"SELECT key, CASE WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED}) WHERE CAST(key AS BIGINT) % 18 <> 1")
def store_confluence(spark, sf_dir):
    db = _tributaries(spark, sf_dir)
    db.merge_all()
    return t.text(db.snapshot())


@query(f"SELECT key, CASE WHEN in_s THEN s ELSE d END AS value FROM ({PAIRED}) WHERE CAST(key AS BIGINT) % 18 <> 1")
def store_tributary_reads(spark, sf_dir):
    """The same before any merge."""
    return t.text(_tributaries(spark, sf_dir).snapshot())


@query(f"SELECT count(*) FILTER (WHERE in_d AND in_s) AS overwrites, count(*) FILTER (WHERE in_s AND NOT in_d) AS adds, count(*) FILTER (WHERE CAST(key AS BIGINT) % 18 = 1) AS merge_deletes FROM ({PAIRED})")
def merge_counters(spark, sf_dir):
    m = Metrics()
    _tributaries(spark, sf_dir, m).merge_all()
    return _counted(spark, m.merge_snapshot(), "overwrites", "adds", "merge_deletes")


@query(f"SELECT key, CASE WHEN k % 3 <> 0 THEN value ELSE 'b' || value END AS value FROM {ORDERS} WHERE k % 6 <> 2")
def store_receive(spark, sf_dir):
    """One replicated database receives from another: deletions first, then records."""
    kv = t.orders(spark, sf_dir)
    k = F.col("key").cast("string").cast("long")
    a = _db(spark, "replicated", kv=kv.filter(k % 3 != 0))
    b = _db(spark, "replicated", kv=kv.filter(k % 3 != 1).select("key", F.concat(F.lit("b"), "value").alias("value")))
    a.delete(_keys(kv).filter(k % 6 == 2))
    b.receive(a)
    return t.text(b.snapshot())


@query(f"SELECT key FROM {ORDERS} WHERE k % 6 = 2")
def store_markers(spark, sf_dir):
    kv = t.orders(spark, sf_dir)
    db = _db(spark, "replicated", kv=kv)
    db.delete(_keys(kv).filter(F.col("key").cast("string").cast("long") % 6 == 2))
    db.purge()
    return t.text(db.deletions().withColumn("value", F.lit(""))).select("key")


# scans of a compacted database, which is sorted by key: comparisons reach its Parquet files
@query(f"SELECT key, value FROM {LINES} WHERE key >= '000000000100' ORDER BY key LIMIT 100")
def stored_scan_from_100(spark, sf_dir):
    return t.text(reads.scan_from(t.compacted(spark, sf_dir, "lineitems").snapshot(), b"000000000100", 100))


@query(f"SELECT key, value FROM {PARTS} WHERE key >= 'Brand#2' AND key < 'Brand#4'")
def stored_range_scan(spark, sf_dir):
    return t.text(reads.between(t.compacted(spark, sf_dir, "parts").snapshot(), b"Brand#2", b"Brand#4"))


@query(f"SELECT key, value FROM {PARTS} WHERE starts_with(key, 'Brand#1')")
def stored_prefix_scan(spark, sf_dir):
    return t.text(reads.prefix_scan(t.compacted(spark, sf_dir, "parts").snapshot(), b"Brand#1"))


@query(f"SELECT key, value FROM {ORDERS} WHERE k = 17")
def stored_get_one(spark, sf_dir):
    return t.text(reads.get(t.compacted(spark, sf_dir, "orders").snapshot(), b"000000000017"))


# structure -------------------------------------------------------------------------------------------------------------

FANOUT = "SELECT substr(key, 1, d) AS prefix, d AS depth, count(DISTINCT substr(key, d + 1, 1)) AS fanout, count(*) AS keys FROM (SELECT key, CAST(unnest(range(0, length(key) + 1)) AS INTEGER) AS d FROM {0}) GROUP BY 1, 2"


@query(FANOUT.format(NAMES))
def trie_fanout(spark, sf_dir):
    return trie.fanout(t.names(spark, sf_dir))


@query(f"SELECT * FROM ({FANOUT.format(PARTS)}) WHERE fanout > 1")
def trie_branch_nodes(spark, sf_dir):
    return trie.branch_nodes(t.parts(spark, sf_dir))


@query(
    f"SELECT 'branch' AS kind, count(*) AS n, CAST(sum(strlen(prefix)) AS BIGINT) AS bytes FROM ({FANOUT.format(PARTS)}) WHERE fanout > 1 "
    f"UNION ALL SELECT CASE WHEN strlen(value) > 4096 THEN 'big_leaf' ELSE 'leaf' END, count(*), CAST(sum(strlen(key) + strlen(value)) AS BIGINT) FROM {PARTS} GROUP BY 1"
)
def trie_node_counts(spark, sf_dir):
    return trie.node_counts(t.parts(spark, sf_dir))


@query(
    f"SELECT key, CASE WHEN p IS NULL THEN NULL ELSE CAST((SELECT max(i) FROM (SELECT unnest(range(0, length(key) + 1)) AS i) WHERE substr(key, 1, i) = substr(p, 1, i) AND i <= length(p)) AS INTEGER) END AS lcp "
    f"FROM (SELECT key, lag(key) OVER (ORDER BY key) AS p FROM {PARTS})"
)
def neighbour_lcp(spark, sf_dir):
    return trie.neighbour_lcp(t.parts(spark, sf_dir))


@query(f"SELECT prefix, 'branch' AS kind, fanout, CAST(NULL AS VARCHAR) AS value FROM ({FANOUT.format(NAMES)}) WHERE fanout > 1 UNION ALL SELECT key, 'leaf', 0, value FROM {NAMES}")
def trie_dump(spark, sf_dir):
    return trie.dump(t.names(spark, sf_dir))


@query("SELECT event_id, ((4294967290 + event_id - 1) % 4294967295) + 1 AS s FROM events")
def serial_add(spark, sf_dir):
    return t.read(spark, sf_dir, "events").select("event_id", codec.serial_add(F.lit(4294967290), F.col("event_id")).alias("s"))


@query("SELECT event_id, CASE WHEN d >= 2147483648 THEN d - 4294967296 ELSE d END AS diff, d >= 2147483648 AS less FROM (SELECT event_id, ((event_id * 700001 - event_id * event_id * 31) % 4294967296 + 4294967296) % 4294967296 AS d FROM events)")
def serial_less(spark, sf_dir):
    a, b = F.col("event_id") * 700_001, F.col("event_id") * F.col("event_id") * 31
    return t.read(spark, sf_dir, "events").select("event_id", codec.serial_diff(a, b).alias("diff"), codec.serial_less(a, b).alias("less"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_custkey) AS r FROM customer")
def codec_order(spark, sf_dir):
    """Ranks by an encoded composite binary key are those by its columns."""
    from pyspark.sql import Window

    c = t.read(spark, sf_dir, "customer").withColumn("key", codec.encode_key((F.col("c_nationkey"), "long"), (F.col("c_mktsegment"), "string"), (F.col("c_custkey"), "long")))
    return c.select("c_custkey", F.row_number().over(Window.orderBy("key")).cast("long").alias("r"))


# extensions ------------------------------------------------------------------------------------------------------------


@query(f"SELECT key, value FROM {CUSTOMERS} WHERE key IN (SELECT key FROM {SUPPLIERS})")
def ext_intersect(spark, sf_dir):
    return reads.intersect_keys(t.customers(spark, sf_dir), t.suppliers(spark, sf_dir))


@query(f"SELECT key, value FROM {PARTS} WHERE regexp_matches(key, '#[13]./0*[0-9]*7$')")
def ext_regex_set(spark, sf_dir):
    return reads.matching(t.parts(spark, sf_dir), "#[13]./0*[0-9]*7$")


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", source, op, count(*) AS n FROM {LOG} GROUP BY ALL")
def ext_activity(spark, sf_dir):
    return changes.activity(t.change_log(spark, sf_dir))
