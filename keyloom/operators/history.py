"""Versions: a change log (db, source, txn_id, seq, op, key, value, ts, meta) and the snapshots it resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("txn_id", "source", "seq")


def committed(log: DataFrame, txn: DataFrame) -> DataFrame:
    """Log rows of committed transactions; open, prepared and aborted ones are invisible."""
    keys = [c for c in ("db", "source", "txn_id") if c in log.columns and c in txn.columns]
    return log.join(txn.filter("state = 'committed'").select(*keys), keys, "left_semi")


def latest(log: DataFrame, *keep: str) -> DataFrame:
    """The last change of each key: op, value and the columns in keep. One partial aggregate, one shuffle on key."""
    fields = ["op", "value", *keep]
    last = F.max_by(F.struct(*fields), F.struct(*ORDER))
    return log.groupBy("key").agg(last.alias("last")).select("key", *[F.col(f"last.{c}").alias(c) for c in fields])


def snapshot(log: DataFrame, txn_id: int | None = None) -> DataFrame:
    """(key, value) as of a transaction: the last change of each key, without deleted ones."""
    if txn_id is not None:
        log = log.filter(F.col("txn_id") <= txn_id)
    return latest(log).filter("op = 'put'").select("key", "value")


def history(log: DataFrame, key: bytes | str) -> DataFrame:
    return log.filter(F.col("key") == F.lit(key)).select(*ORDER, "op", "key", "value").orderBy(*ORDER)


def own_view(log: DataFrame, staged: DataFrame) -> DataFrame:
    """A writer's view: committed changes and its own staged ones, which come last."""
    return snapshot(log.unionByName(staged, allowMissingColumns=True))


def puts(kv: DataFrame, txn_id: int, source: str = "main", db: str = "main") -> DataFrame:
    """kv as log rows of one transaction."""
    return kv.select(
        F.lit(db).alias("db"), F.lit(source).alias("source"), F.lit(txn_id).cast("long").alias("txn_id"), F.lit(0).cast("long").alias("seq"), F.lit("put").alias("op"), "key", "value", F.current_timestamp().alias("ts"), F.lit(None).cast("binary").alias("meta")
    )


def dels(keys: DataFrame, txn_id: int, source: str = "main", db: str = "main", meta: Column | None = None) -> DataFrame:
    return puts(keys.withColumn("value", F.lit(None).cast("binary")), txn_id, source, db).withColumn("op", F.lit("del")).withColumn("meta", F.lit(None).cast("binary") if meta is None else meta)


def upsert(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """kv after writing changes (key, value)."""
    joined = kv.select("key", F.col("value").alias("old"), F.lit(True).alias("in_old")).join(changes.select("key", F.col("value").alias("new"), F.lit(True).alias("in_new")), "key", "full_outer")
    return joined.select("key", F.when(F.col("in_new"), F.col("new")).otherwise(F.col("old")).alias("value"))


def delete_keys(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")


def read_modify_write(kv: DataFrame, keys: DataFrame, change) -> DataFrame:
    """kv where change(key, value) replaced the values of keys."""
    hit = kv.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
    return hit.select("key", F.when(F.col("__hit"), change(F.col("key"), F.col("value"))).otherwise(F.col("value")).alias("value"))


def replayable(wal: DataFrame) -> DataFrame:
    """Puts and deletes of a raw log (txn_id, seq, rec in begin|put|del|prepare|commit|abort, key, value) whose transaction began, prepared and committed."""
    whole = F.max(F.col("rec") == "begin") & F.max(F.col("rec") == "prepare") & F.max(F.col("rec") == "commit") & ~F.max(F.col("rec") == "abort")
    good = wal.groupBy("txn_id").agg(whole.alias("ok")).filter("ok").select("txn_id")
    return wal.filter(F.col("rec").isin("put", "del")).join(good, "txn_id", "left_semi")


def dangling(wal: DataFrame) -> DataFrame:
    """Transactions prepared but neither committed nor aborted."""
    flags = wal.groupBy("txn_id").agg(*[F.max(F.col("rec") == r).alias(r) for r in ("prepare", "commit", "abort")])
    return flags.filter("prepare and not commit and not abort").select("txn_id")
