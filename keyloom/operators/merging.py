"""Policy-driven merge of two key sets, and the ordered fold of many writers' changes.

A merge is one full outer join on the key: records only in the destination stay, records in both go by `may_overwrite`,
records only in the source by `may_add` and rejected prefixes. Merging never deletes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[Column, Column, Column], Column]


def _always(*_: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Policy:
    may_overwrite: Callable[[Column, Column, Column], Column] = _always
    may_add: Callable[[Column, Column], Column] = _always
    may_delete: Callable[[Column, Column], Column] = _always
    rejected_prefixes: tuple = ()


OVERWRITE = Policy()
KEEP_DST = Policy(may_overwrite=lambda k, d, s: F.lit(False))


def newer_wins(version: Callable[[Column], Column], tie_to_src: bool) -> Policy:
    """Last writer wins by a version read from the value; equal versions go to the source or stay."""
    return Policy(may_overwrite=lambda k, d, s: version(s) >= version(d) if tie_to_src else version(s) > version(d))


def paired(dst: DataFrame, src: DataFrame) -> DataFrame:
    """(key, d, in_d, s, in_s); presence is a flag of its own, as a value may be null or empty."""
    a = dst.select("key", F.col("value").alias("d"), F.lit(True).alias("in_d"))
    b = src.select("key", F.col("value").alias("s"), F.lit(True).alias("in_s"))
    both = a.join(b, "key", "full_outer")
    return both.withColumn("in_d", F.coalesce("in_d", F.lit(False))).withColumn("in_s", F.coalesce("in_s", F.lit(False)))


def under_prefix(key: Column, prefixes: tuple) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | key.startswith(F.lit(p))
    return out


def judged(dst: DataFrame, src: DataFrame, policy: Policy) -> DataFrame:
    """paired rows with overwrite and add decisions."""
    key, d, s = F.col("key"), F.col("d"), F.col("s")
    rows = paired(dst, src)
    only = F.col("in_s") & ~F.col("in_d")
    return rows.withColumn("overwrite", F.col("in_d") & F.col("in_s") & policy.may_overwrite(key, d, s)).withColumn("add", only & policy.may_add(key, s) & ~under_prefix(key, policy.rejected_prefixes))


def merge(dst: DataFrame, src: DataFrame, policy: Policy = OVERWRITE) -> DataFrame:
    """dst after src was merged into it."""
    rows = judged(dst, src, policy)
    return rows.filter("in_d or add").select("key", F.when(F.col("overwrite") | F.col("add"), F.col("s")).otherwise(F.col("d")).alias("value"))


def merge_stats(dst: DataFrame, src: DataFrame, policy: Policy = OVERWRITE) -> DataFrame:
    rows = judged(dst, src, policy)
    return rows.agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(n) for c, n in (("overwrite", "overwrites"), ("add", "adds"))], F.sum((F.col("in_s") & ~F.col("overwrite") & ~F.col("add")).cast("long")).alias("rejected"))


def reject_prefixes(src: DataFrame, prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """src without keys under any of many prefixes (column prefix, of the given lengths): exploded to a hash anti-join, not a nested loop."""
    cut = src.withColumn("__p", F.explode(F.array(*[F.substring("key", 1, n) for n in lengths]))).join(prefixes.select(F.col("prefix").alias("__p")), "__p", "left_semi").select("key")
    return src.join(cut, "key", "left_anti")


def fold(log: DataFrame, policy: Policy = OVERWRITE) -> DataFrame:
    """(key, value) that each key's changes, in (txn_id, source, seq) order, leave under a policy.

    The default policy is the last change. Others depend on the order, so each key's changes are sorted and folded; a
    source's changes of a key collapse to its last first.
    """
    if policy is OVERWRITE:
        from keyloom.operators.history import snapshot

        return snapshot(log)
    per = log.groupBy("key", "source").agg(F.max_by(F.struct("txn_id", "source", "seq", "op", "value", F.coalesce("meta", F.lit(b"")).alias("meta")) if "meta" in log.columns else F.struct("txn_id", "source", "seq", "op", "value", F.lit(b"").alias("meta")), F.struct("txn_id", "seq")).alias("c"))
    grouped = per.groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    kind = log.schema["value"].dataType
    zero = F.struct(F.lit(False).alias("present"), F.lit(None).cast(kind).alias("value"))

    def step(state: Column, c: Column) -> Column:
        key = F.col("key")
        gone = F.struct(F.lit(False).alias("present"), F.lit(None).cast(kind).alias("value"))
        new = F.struct(F.lit(True).alias("present"), c["value"].alias("value"))
        on_del = F.when(policy.may_delete(key, c["meta"]), gone).otherwise(state)
        on_put = F.when(state["present"], F.when(policy.may_overwrite(key, state["value"], c["value"]), new).otherwise(state)).otherwise(F.when(policy.may_add(key, c["value"]), new).otherwise(state))
        return F.when(c["op"] == "del", on_del).otherwise(on_put)

    out = grouped.select("key", F.aggregate("cs", zero, step).alias("r"))
    return out.filter("r.present").select("key", F.col("r.value").alias("value"))


def eligible(log: DataFrame, threshold: int = 50_000, max_age_ms: int = 1000, now=None) -> DataFrame:
    """Sources due for compaction: at least `threshold` changes, or idle for `max_age_ms`."""
    now = F.current_timestamp() if now is None else now
    idle = F.max("ts") <= now - F.make_dt_interval(secs=F.lit(max_age_ms / 1000).cast("decimal(18,6)"))
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("writes"), F.max("ts").alias("last_ts"), idle.alias("idle")).filter((F.col("writes") >= threshold) | F.col("idle"))


def _pending(log: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Keys that a source's pending tombstones delete, and its data."""
    from keyloom.operators.history import latest

    last = latest(log, *(["meta"] if "meta" in log.columns else []))
    meta = F.coalesce("meta", F.lit(b"")) if "meta" in log.columns else F.lit(b"")
    gone = last.filter(F.col("op") == "del").filter(policy.may_delete(F.col("key"), meta)).select("key")
    return gone, last.filter("op = 'put'").select("key", "value")


def compact(main: DataFrame, log: DataFrame, policy: Policy = OVERWRITE) -> DataFrame:
    """main after a source's pending changes: its tombstones first, then its data."""
    gone, data = _pending(log, policy)
    return merge(main.join(gone, "key", "left_anti"), data, policy)


def compact_stats(main: DataFrame, log: DataFrame, policy: Policy = OVERWRITE) -> DataFrame:
    """(overwrites, adds, merge_deletes) of compact: records replaced, added and deleted."""
    gone, data = _pending(log, policy)
    deleted = main.join(gone, "key", "left_semi").agg(F.count(F.lit(1)).alias("merge_deletes"))
    return merge_stats(main.join(gone, "key", "left_anti"), data, policy).select("overwrites", "adds").crossJoin(deleted)
