"""Operator 1, sharding: a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash of id and text. Pass two shuffles each
bucket with Spark's `shuffle`, which is Fisher-Yates, applied to the bucket's row numbers, and lays the buckets one after
the other. A record's place in that sequence gives its shard and slot, so a bucket is written as one run of one shard or a
few neighbouring ones.

Each shard takes the same number of records, give or take one (law `rows`). No step collects records: the permutation of a
bucket holds one integer a record, and buckets are bounded because their number follows the table's bytes. Rows equal in id
and text would all share a bucket; where one holds over `hot_rows` rows, such rows are scattered by their place in the
input as well, over as many buckets as there are.

Defined cases: a null text counts no bytes; null ids hash like any other value; repeated rows are kept, each with a slot of
its own (equal rows are interchangeable); an empty table gives an empty result; columns named `shard`
or `slot` in the input come back as `shard_in` and `slot_in`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import reserve

RECORD_OVERHEAD = 16


def record_size(text_col: str = "text"):
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 20240131, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 64 << 20, min_buckets: int = 256, hot_rows: int = 1 << 20) -> DataFrame:
    """All columns of df plus `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard)."""
    df = reserve(df, ("shard", "slot"))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_size(text_col)), F.lit(0))).first()
    buckets = max(min_buckets, -(-total // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    scattered = df.withColumn("__h", hashed).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(buckets)))

    counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    if n > hot_rows and counts.agg(F.max("__n")).first()[0] > hot_rows:
        # a hash with so many rows is one row repeated; at most n / hot_rows of them
        hot = scattered.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows).select("__h", F.lit(True).alias("__hot"))
        place = F.when(F.col("__hot"), F.xxhash64(F.lit(seed + 2), F.monotonically_increasing_id())).otherwise(F.col("__h"))
        scattered = scattered.join(F.broadcast(hot), "__h", "left").withColumn("__h", place).drop("__hot").withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.lit(buckets)))
        counts = scattered.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row a bucket: the running sum needs them in one place, and their number is total bytes / bucket_bytes
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    shuffled = (
        offsets.repartition("__bucket")
        .sortWithinPartitions("__bucket")  # the permutation depends on the row's place in its partition: keep that fixed on retries
        .select("__bucket", "__start", F.shuffle(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), F.lit(seed)).alias("__perm"))
    )
    in_bucket = Window.partitionBy("__bucket").orderBy("__h", F.col(id_col))
    rows = scattered.withColumn("__rn", F.row_number().over(in_bucket))
    # a merge join: the permutations together are as many integers as there are records, so they are never broadcast
    placed = rows.hint("merge").join(shuffled.hint("merge"), "__bucket").withColumn("__pos", F.col("__start") + F.element_at("__perm", F.col("__rn")))

    per, extra = divmod(n, shards)
    edge = extra * (per + 1)
    pos = F.col("__pos")
    shard = F.when(pos < edge, F.floor(pos / (per + 1))).otherwise(F.lit(extra) + F.floor((pos - edge) / max(per, 1)))
    slot = F.when(pos < edge, F.pmod(pos, F.lit(per + 1))).otherwise(F.pmod(pos - edge, F.lit(max(per, 1))))
    return placed.select(*[c for c in df.columns], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each file sorted by slot."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
