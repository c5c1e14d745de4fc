"""Merkle-style hashes over key prefixes, and the difference of two key sets found through them.

Leaf hashes are length-prefixed (key length, key, value), so no two records share an input. A bucket's hash covers its
leaf hashes in key order. A difference compares mergeable bucket digests first and opens only buckets that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaf_hash(key: Column, value: Column) -> Column:
    k = key.cast("binary")
    return F.sha2(F.concat(F.octet_length(k).cast("string").cast("binary"), F.lit(b":"), k, F.coalesce(value.cast("binary"), F.lit(b""))), 256)


def record_hashes(kv: DataFrame) -> DataFrame:
    return kv.select("key", "value", leaf_hash(F.col("key"), F.col("value")).alias("hash"))


def bucket_of(key: Column, depth: int) -> Column:
    return F.substring(key, 1, depth)


def level(kv: DataFrame, depth: int) -> DataFrame:
    """(prefix, depth, n, hash): one row for each key prefix of `depth` characters or bytes.

    A bucket's hash is over its leaf hashes in key order, so a bucket must fit a task; choose depth so that it does, and
    use `levels` to reach shallower ones from there.
    """
    rows = record_hashes(kv).select(bucket_of(F.col("key"), depth).alias("prefix"), "key", "hash")
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "hash"))), lambda x: x["hash"]), ""), 256).alias("hash")).select("prefix", F.lit(depth).alias("depth"), "n", "hash")


def parent_level(hashes: DataFrame, depth: int) -> DataFrame:
    """A shallower level from a deeper one: a branch's hash is over its children's, in order."""
    up = hashes.select(bucket_of(F.col("prefix"), depth).alias("up"), "prefix", "n", "hash")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "hash"))), lambda x: x["hash"]), "")
    return up.groupBy("up").agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("hash")).select(F.col("up").alias("prefix"), F.lit(depth).alias("depth"), "n", "hash")


def levels(kv: DataFrame, depths: list[int]) -> DataFrame:
    """All levels, deepest first computed from records, each shallower one from the one below."""
    depths = sorted(depths, reverse=True)
    now = level(kv, depths[0])
    out = now
    for d in depths[1:]:
        now = parent_level(now, d)
        out = out.unionByName(now)
    return out


def lookup(hashes: DataFrame, prefix: bytes | str) -> DataFrame:
    return hashes.filter(F.col("prefix") == F.lit(prefix))


def update_level(hashes: DataFrame, kv: DataFrame, touched: DataFrame, depth: int) -> DataFrame:
    """hashes after changes to the keys in `touched`: only their buckets are hashed again."""
    dirty = touched.select(bucket_of(F.col("key"), depth).alias("prefix")).distinct()
    fresh = level(kv.join(dirty, bucket_of(F.col("key"), depth) == F.col("prefix"), "left_semi"), depth)
    return hashes.join(dirty, "prefix", "left_anti").unionByName(fresh)


def hash_bucket_of(key: Column, buckets: int) -> Column:
    """A bucket by the key's hash: of even size whatever the keys look like."""
    return F.pmod(F.xxhash64(key.cast("binary")), F.lit(buckets)).cast("int")


def fingerprints(kv: DataFrame, depth: int | None = None, buckets: int | None = None) -> DataFrame:
    """(prefix, n, x, y): a mergeable digest of each bucket, by key prefix or by the key's hash, for comparing replicas. It combines before the shuffle, so a hot prefix costs no more than others; keys are unique, so no two records cancel out."""
    parts = (F.octet_length("key"), F.col("key"), F.col("value"))
    bucket = hash_bucket_of(F.col("key"), buckets) if depth is None else bucket_of(F.col("key"), depth)
    rows = kv.select(bucket.alias("prefix"), F.xxhash64(F.lit(1), *parts).alias("x"), F.xxhash64(F.lit(2), *parts).alias("y"))
    return rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))


def compared(fa: DataFrame, fb: DataFrame) -> DataFrame:
    """Prefixes (or buckets) whose digests differ or that one side lacks; the digests may be stored ones."""
    x, y = fa.select("prefix", F.struct("n", "x", "y").alias("fa")), fb.select("prefix", F.struct("n", "x", "y").alias("fb"))
    return x.join(y, "prefix", "full_outer").filter(~F.col("fa").eqNullSafe(F.col("fb"))).select("prefix")


def diff_buckets(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """Prefixes whose contents differ or that one side lacks."""
    return compared(fingerprints(a, depth), fingerprints(b, depth))


def diff(a: DataFrame, b: DataFrame, depth: int | None = None, buckets: int | None = None, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(key, change) from a to b: added, removed or changed.

    With a depth, or a number of hash buckets, only buckets whose digests differ are opened; digests: those of a and b, if they
    are stored (of the same depth or buckets). Hash buckets are so few that the differing ones are broadcast, and records of
    equal buckets are dropped where they are read.
    """
    x, y = record_hashes(a).select("key", F.col("hash").alias("ha")), record_hashes(b).select("key", F.col("hash").alias("hb"))
    if depth is not None or buckets is not None:
        fa, fb = digests or (fingerprints(a, depth, buckets), fingerprints(b, depth, buckets))
        open_ = compared(fa, fb)
        open_, bucket = (open_, bucket_of(F.col("key"), depth)) if depth is not None else (F.broadcast(open_), hash_bucket_of(F.col("key"), buckets))
        x, y = (t.join(open_, bucket == F.col("prefix"), "left_semi") for t in (x, y))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").otherwise("changed")
    return x.join(y, "key", "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("key", change.alias("change"))
