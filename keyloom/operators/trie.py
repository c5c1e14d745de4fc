"""Statistics of the trie that a key set spans: branches, fan-out, common prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.reads import prev_all, range_bounds, range_of


def prefixes(kv: DataFrame) -> DataFrame:
    """(prefix, d, next): for each key every prefix, the whole key included, with the symbol that follows ('' at a key's end). As many symbols as the squares of the keys' lengths: what needs branches only takes `branches`."""
    size = F.char_length("key") if dict(kv.dtypes)["key"] == "string" else F.octet_length("key")
    cut = kv.select("key", F.explode(F.sequence(F.lit(0), size)).alias("d"))
    return cut.select(F.substring("key", F.lit(1), F.col("d")).alias("prefix"), "d", F.substring("key", F.col("d") + 1, F.lit(1)).alias("next"))


def fanout(kv: DataFrame) -> DataFrame:
    """(prefix, depth, fanout, keys) of every prefix: partial counts, so hot short prefixes cost no more than others."""
    per = prefixes(kv).groupBy("prefix", "d", "next").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("prefix", "d").agg(F.count(F.lit(1)).alias("fanout"), F.sum("n").alias("keys")).select("prefix", F.col("d").alias("depth"), "fanout", "keys")


def branches(kv: DataFrame, bounds: list | None = None) -> DataFrame:
    """(prefix, depth, fanout) of prefixes with more than one continuation, at any depth; a key's end is a continuation.

    Keys under a prefix are neighbours in key order, and where the continuation changes from one to the next, their common
    prefix is the branch: each key gives one row, however long it is.
    """
    near = neighbour_lcp(kv.select("key", F.lit(True).alias("value")), bounds).filter("lcp is not null")
    # the continuation of the least key under a prefix is in no pair
    steps = near.select(F.substring("key", F.lit(1), F.col("lcp")).alias("prefix"), F.col("lcp").alias("depth"), F.substring("key", F.col("lcp") + 1, F.lit(1)).alias("next")).distinct()
    return steps.groupBy("prefix", "depth").agg((F.count(F.lit(1)) + 1).alias("fanout"))


def branch_nodes(kv: DataFrame, bounds: list | None = None) -> DataFrame:
    """(prefix, depth, fanout, keys) of branches. The keys under one are those below its end without those below its start: one sorted pass a range, and a table of one row a range."""
    bounds = range_bounds(kv.select("key")) if bounds is None else bounds
    # hexadecimal digits keep order and prefixes, and G is above them all
    digits = lambda c: F.hex(F.col(c).cast("binary"))
    borders = sorted({(b.encode() if isinstance(b, str) else bytes(b)).hex().upper() for b in bounds})
    ends = F.explode(F.array(F.struct(digits("prefix").alias("at"), F.lit(-1).alias("sign")), F.struct(F.concat(digits("prefix"), F.lit("G")).alias("at"), F.lit(1).alias("sign"))))
    asked = branches(kv, bounds).select(F.struct("prefix", "depth", "fanout").alias("node"), ends.alias("e")).select("e.at", "e.sign", "node", F.lit(0).alias("n"))
    data = kv.select(digits("key").alias("at"), F.lit(0).alias("sign"), F.lit(None).cast(asked.schema["node"].dataType).alias("node"), F.lit(1).alias("n"))
    both = data.unionByName(asked).withColumn("range", range_of(F.col("at"), borders))
    # a start comes before the key that equals it
    seen = Window.partitionBy("range").orderBy("at", "sign").rowsBetween(Window.unboundedPreceding, 0)
    below = both.withColumn("below", F.sum("n").over(seen)).filter("sign <> 0")
    if borders:
        sizes = data.groupBy(range_of(F.col("at"), borders).alias("range")).agg(F.sum("n").alias("n"))
        every = kv.sparkSession.range(len(borders) + 1).select(F.col("id").cast("int").alias("range")).join(F.broadcast(sizes), "range", "left")
        carried = every.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        below = below.join(F.broadcast(carried), "range").withColumn("below", F.col("below") + F.col("before"))  # one row a range
    return below.groupBy("node").agg(F.sum(F.col("sign") * F.col("below")).alias("keys")).select("node.*", "keys")


def node_counts(kv: DataFrame) -> DataFrame:
    """(kind, n, bytes): branch and leaf nodes, big values apart."""
    from keyloom.functions.codec import is_big

    leaf = kv.select(F.when(is_big(F.col("value")), "big_leaf").otherwise("leaf").alias("kind"), (F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))
    branch = branches(kv).select(F.lit("branch").alias("kind"), F.octet_length("prefix").cast("long").alias("bytes"))
    return leaf.unionByName(branch).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def common_prefix(a, b):
    """Length of the longest common prefix of two string or binary columns."""
    most = F.least(F.length(a), F.length(b))
    # halving steps, not symbol by symbol: keys can have 2^20 symbols
    step = lambda n, w: F.when((n + w <= most) & (F.substring(a, n + 1, w) == F.substring(b, n + 1, w)), n + w).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), step)


def neighbour_lcp(kv: DataFrame, bounds: list | None = None) -> DataFrame:
    """(key, lcp): common prefix with the key before."""
    near = prev_all(kv, bounds)
    return near.select("key", F.when(F.col("near_key").isNotNull(), common_prefix(F.col("key"), F.col("near_key"))).alias("lcp"))


def dump(kv: DataFrame) -> DataFrame:
    """The trie as rows in depth-first order: branches and records."""
    branch = branches(kv).select("prefix", F.lit("branch").alias("kind"), "fanout", F.lit(None).cast(kv.schema["value"].dataType).alias("value"))
    leaf = kv.select(F.col("key").alias("prefix"), F.lit("leaf").alias("kind"), F.lit(0).cast("long").alias("fanout"), "value")
    return branch.unionByName(leaf).orderBy("prefix", "kind")

