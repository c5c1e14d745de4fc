"""The driver's tables as key-value and change-log DataFrames with string keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.codec import padded


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string") if isinstance(c, str) else c.cast("decimal(18,2)").cast("string")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(padded(F.col("o_orderkey"), 12).alias("key"), money("o_totalprice").alias("value"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(padded(F.col("c_custkey"), 10).alias("key"), F.col("c_mktsegment").alias("value"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(padded(F.col("c_custkey"), 10).alias("key"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(padded(F.col("s_suppkey"), 10).alias("key"), F.col("s_name").alias("value"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), padded(F.col("p_partkey"), 8)).alias("key"), F.col("p_name").alias("value"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(padded(F.col("l_orderkey"), 12), padded(F.col("l_linenumber"), 2), padded(F.col("l_partkey"), 10), padded(F.col("l_suppkey"), 8), F.date_format("l_shipdate", "yyyyMMdd"))
    return read(spark, sf_dir, "lineitem").select(key.alias("key"), money("l_quantity").alias("value"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region names."""
    n = read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return n.unionByName(read(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))).dropDuplicates(["key"])


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: one transaction an event, eight sources, errors delete."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit("events").alias("db"),
        (F.col("user_id") % 8).cast("string").alias("source"),
        F.col("event_id").alias("txn_id"),
        F.lit(0).cast("long").alias("seq"),
        F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"),
        padded(F.col("user_id"), 8).alias("key"),
        F.col("event_type").alias("value"),
        F.col("ts"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each event's transaction: of every ten ids one is aborted, one prepared and one open."""
    state = F.when(F.col("event_id") % 10 == 3, "aborted").when(F.col("event_id") % 10 == 5, "prepared").when(F.col("event_id") % 10 == 7, "open").otherwise("committed")
    origin = F.when(F.col("event_id") % 4 == 0, "merge").otherwise("user")
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("db"), (F.col("user_id") % 8).cast("string").alias("source"), F.col("event_id").alias("txn_id"), state.alias("state"), origin.alias("origin"))


_kept: dict[tuple[str, str, str], str] = {}


def compacted(spark: SparkSession, sf_dir: str, name: str):
    """A database of the key-value table `name` of this module, compacted, so sorted by key: written once an application and folder."""
    from keyloom.sources.store import Store

    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _kept:
        store = Store.in_memory(spark)
        db = store.open(name)
        db.put(binary(globals()[name](spark, sf_dir)))
        db.compact()
        _kept[at] = store.path
    return Store(spark, _kept[at]).open(name)


def binary(kv: DataFrame) -> DataFrame:
    return kv.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"))


def text(kv: DataFrame) -> DataFrame:
    return kv.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
