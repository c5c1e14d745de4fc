"""Point lookups, neighbour search and ordered scans over key-value DataFrames (key, value).

Keys are binary or string; both sort by unsigned bytes. Lookups of many keys are joins; neighbour search over many probes
cuts the key space into ranges, answers within each range by one sorted pass and carries range ends over by a small table,
so no step gathers all keys in one task. The number of ranges follows the bytes of records and probes, and borders come
from both, so neither dense keys nor dense probes make a range large; probes of one key that fill whole ranges by
themselves are asked once and joined back by broadcast. A record is present by a flag of its own: its value may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.codec import prefix_succ

BROADCAST_PROBES = 1_000_000


def get(kv: DataFrame, key: bytes | str) -> DataFrame:
    return kv.filter(F.col("key") == F.lit(key))


def get_many(kv: DataFrame, probes: DataFrame, small: int | None = None) -> DataFrame:
    """probes (key, ...) with value, null where absent. small: the caller's bound on the probes' number, if known; they are then broadcast."""
    if small is not None and small <= BROADCAST_PROBES:
        found = kv.join(F.broadcast(probes.select("key").distinct()), "key", "left_semi")
        return probes.join(found, "key", "left")
    return probes.join(kv, "key", "left")


def contains_many(kv: DataFrame, probes: DataFrame) -> DataFrame:
    present = kv.select("key", F.lit(True).alias("__p"))
    return probes.join(present, "key", "left").withColumn("found", F.coalesce("__p", F.lit(False))).drop("__p")


def first_kv(kv: DataFrame) -> DataFrame:
    return kv.orderBy("key").limit(1)


def last_kv(kv: DataFrame) -> DataFrame:
    return kv.orderBy(F.desc("key")).limit(1)


def next_one(kv: DataFrame, key: bytes | str) -> DataFrame:
    return kv.filter(F.col("key") > F.lit(key)).orderBy("key").limit(1)


def prev_one(kv: DataFrame, key: bytes | str) -> DataFrame:
    return kv.filter(F.col("key") < F.lit(key)).orderBy(F.desc("key")).limit(1)


def scan(kv: DataFrame, reverse: bool = False) -> DataFrame:
    return kv.orderBy(F.desc("key") if reverse else F.col("key"))


def scan_from(kv: DataFrame, key: bytes | str, n: int, reverse: bool = False) -> DataFrame:
    """The first n records at or after key (reverse: at or before it)."""
    if reverse:
        return kv.filter(F.col("key") <= F.lit(key)).orderBy(F.desc("key")).limit(n)
    return kv.filter(F.col("key") >= F.lit(key)).orderBy("key").limit(n)


def between(kv: DataFrame, low: bytes | str | None, high: bytes | str | None) -> DataFrame:
    """low <= key < high; comparisons reach the Parquet scan."""
    if low is not None:
        kv = kv.filter(F.col("key") >= F.lit(low))
    return kv if high is None else kv.filter(F.col("key") < F.lit(high))


def prefix_scan(kv: DataFrame, prefix: bytes | str) -> DataFrame:
    return between(kv, prefix, prefix_succ(prefix))


def count_kv(kv: DataFrame) -> DataFrame:
    return kv.agg(F.count(F.lit(1)).alias("n"))


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Extension: records of a whose key is in b."""
    return a.join(b.select("key"), "key", "left_semi")


def matching(kv: DataFrame, pattern: str) -> DataFrame:
    """Extension: records whose string key matches a regular expression."""
    return kv.filter(F.col("key").cast("string").rlike(pattern))


RANGE_BYTES, MOST_RANGES, DRAWN_PER_RANGE = 128 << 20, 1 << 16, 20


def range_bounds(keys: DataFrame, range_bytes: int = RANGE_BYTES, row_bytes: int = 64) -> list:
    """Borders that cut keys (column key) into ranges of about range_bytes, each row counted with its key's bytes and row_bytes. Any borders give right results; a key that spans ranges occurs as often as borders fall on it.

    The driver draws DRAWN_PER_RANGE keys a range, at most 2 * MOST_RANGES * DRAWN_PER_RANGE.
    """
    n, size = keys.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    ranges = min(MOST_RANGES, -(-((size or 0) + n * row_bytes) // range_bytes))
    # a range for each core where there are rows for it
    ranges = max(ranges, min(keys.sparkSession.sparkContext.defaultParallelism, n // 4096))
    if ranges < 2:
        return []
    want = ranges * DRAWN_PER_RANGE
    drawn = sorted(r[0] for r in keys.sample(min(1.0, want / n), seed=1).limit(2 * want).collect())
    return [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []


def range_of(key: Column, bounds: list) -> Column:
    """How many borders are at or below key: a binary search, over literals for a few borders and over an array beyond."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(bounds) <= 32:
        return search(0, len(bounds))
    held = F.array(*[F.lit(b) for b in bounds])
    # steps of falling powers of two: the largest count of borders that are at or below the key
    steps = F.array(*[F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, w: F.when((at + w <= len(bounds)) & (F.try_element_at(held, at + w) <= key), at + w).otherwise(at))


def _neighbour(kv: DataFrame, probes: DataFrame, forward: bool, bounds: list | None, strict: bool = True, repeated: bool = True) -> DataFrame:
    """probes (key, ...) plus near_key and near_value: the nearest record beyond each probe, or at it if not strict. repeated: probes may hold a key more than once."""
    if bounds is None:
        bounds = range_bounds(kv.select("key").unionByName(probes.select("key")) if repeated else kv.select("key"))
        often = [k for i, k in enumerate(bounds) if repeated and bounds[i - 1 : i] == [k] and bounds[i - 2 : i - 1] != [k]]
        bounds = [k for i, k in enumerate(bounds) if bounds[i - 1 : i] != [k]]
        if often:
            # each of these keys is on two borders or more, so they are at most half as many as borders
            dense = F.broadcast(kv.sparkSession.createDataFrame([(k,) for k in often], kv.select("key").schema))
            once = _neighbour(kv, probes.join(dense, "key", "left_anti").unionByName(dense, allowMissingColumns=True), forward, bounds, strict)
            answers = once.join(dense, "key", "left_semi").select("key", "near_key", "near_value")
            back = probes.join(dense, "key", "left_semi").join(F.broadcast(answers), "key", "left")
            return once.join(dense, "key", "left_anti").unionByName(back)
    extra = [c for c in probes.columns if c != "key"]
    data = kv.select("key", F.struct("key", "value").alias("rec"), F.lit(1).alias("src"), F.lit(None).cast(probes.select(F.struct(*[F.col(c) for c in probes.columns])).schema[0].dataType).alias("row"))
    asked = probes.select("key", F.lit(None).cast(data.schema["rec"].dataType).alias("rec"), F.lit(0).alias("src"), F.struct(*[F.col(c) for c in probes.columns]).alias("row"))
    both = data.unionByName(asked).withColumn("range", range_of(F.col("key"), bounds))
    # a probe comes before the record of its own key, so what was last seen is strictly beyond it; or after
    order = (F.desc("key") if forward else F.col("key"), F.col("src") if strict else F.desc("src"))
    seen = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("rec", ignorenulls=True).over(seen)).filter("src = 0")
    if bounds:
        edge = F.min_by if forward else F.max_by
        ends = data.withColumn("range", range_of(F.col("key"), bounds)).groupBy("range").agg(edge("rec", "key").alias("end"))
        every = kv.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range")).join(F.broadcast(ends), "range", "left")
        carry = Window.orderBy(F.desc("range") if forward else F.col("range")).rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select("range", F.last("end", ignorenulls=True).over(carry).alias("end"))
        near = near.join(F.broadcast(carried), "range", "left").withColumn("near", F.coalesce("near", "end"))  # one row a range
    return near.select("row.key", *[F.col(f"row.{c}").alias(c) for c in extra], F.col("near.key").alias("near_key"), F.col("near.value").alias("near_value"))


def seek_next(kv: DataFrame, probes: DataFrame, bounds: list | None = None) -> DataFrame:
    """For each probe the record with the least key above it."""
    return _neighbour(kv, probes, True, bounds)


def seek_prev(kv: DataFrame, probes: DataFrame, bounds: list | None = None) -> DataFrame:
    """For each probe the record with the greatest key below it."""
    return _neighbour(kv, probes, False, bounds)


def next_all(kv: DataFrame, bounds: list | None = None) -> DataFrame:
    return _neighbour(kv, kv.select("key"), True, bounds, repeated=False)


def prev_all(kv: DataFrame, bounds: list | None = None) -> DataFrame:
    return _neighbour(kv, kv.select("key"), False, bounds, repeated=False)


def lower_bound(kv: DataFrame, probes: DataFrame, bounds: list | None = None) -> DataFrame:
    """The record at each probe, else the next one: what a seek followed by a step on a miss reaches."""
    return _neighbour(kv, probes, True, bounds, strict=False)
