"""Replication between key sets with retained deletion markers (key, deleted_at, meta)."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.errors import ReplicationFailed
from keyloom.operators import hashing, merging
from keyloom.sources.shared import kept

RETENTION_SECONDS = 86_400
#: Digests compared before records are: at most this many rows of each side.
BUCKETS = 1024
#: The kinds of error that a session reports.
ERRORS = {"NONE": 0, "SESSION_MISMATCH": 1, "INVALID_MESSAGE": 2, "INVALID_STATE": 3, "INTERNAL_ERROR": 4, "PAYLOAD_TOO_LARGE": 5, "RESOURCE_LIMIT": 6}


@dataclass(frozen=True)
class Replica:
    main: DataFrame  # key, value
    deletions: DataFrame  # key, deleted_at, meta


def tracked_delete(replica: Replica, keys: DataFrame, at: Column, may_delete=None) -> Replica:
    """Deletes keys that exist (and pass the veto) and records a marker for each."""
    hit = replica.main.join(keys.select("key").distinct(), "key", "left_semi")
    if may_delete is not None:
        hit = hit.filter(may_delete(F.col("key"), F.col("value")))
    meta = keys.select("key", "meta") if "meta" in keys.columns else keys.select("key", F.lit(None).cast("binary").alias("meta"))
    marks = hit.select("key").join(meta, "key").select("key", at.alias("deleted_at"), "meta")
    kept = replica.deletions.join(marks.select("key"), "key", "left_anti")
    return Replica(replica.main.join(marks.select("key"), "key", "left_anti"), kept.unionByName(marks))


def apply(src: Replica, dst: Replica, policy: merging.Policy = merging.OVERWRITE, mode: str = "sticky", depth: int | None = None, buckets: int | None = BUCKETS) -> Replica:
    """dst after receiving src: deletions first, then data, against dst's markers from before.

    Digests of hash buckets (or, with a depth, of key prefixes) are compared first, and only records of buckets that differ are
    compared by key; buckets=None compares all.

    mode `sticky`: a key with a marker on dst is not taken again until the marker is purged. mode `lww` (extension): a put
    is taken and drops the marker if the source itself has no marker for the key.
    """
    if mode not in ("sticky", "lww"):
        raise ValueError(mode)
    before = dst.deletions
    new = src.deletions.join(before.select("key"), "key", "left_anti").filter(policy.may_delete(F.col("key"), F.coalesce("meta", F.lit(b""))))
    main = dst.main.join(new.select("key"), "key", "left_anti")
    same = hashing.diff(main, src.main, depth, buckets).filter("change != 'removed'").select("key")
    changed = src.main.join(same, "key", "left_semi")
    if mode == "sticky":
        held = main.select("key", F.lit(True).alias("__held"))
        marked = before.select("key", F.lit(True).alias("__marked"))
        changed = changed.join(held, "key", "left").join(marked, "key", "left").filter("__held or __marked is null").drop("__held", "__marked")
        left = before
    else:
        back = changed.join(src.deletions.select("key"), "key", "left_anti").select("key")
        left = before.join(back, "key", "left_anti")
    overlap = src.deletions.join(left.select("key"), "key", "left_semi")
    marks = left.join(overlap.select("key"), "key", "left_anti").unionByName(overlap).unionByName(new)
    return Replica(merging.merge(main, changed, policy), marks)


def sync(a: Replica, b: Replica, policy: merging.Policy = merging.OVERWRITE, mode: str = "sticky") -> tuple[Replica, Replica]:
    """Both ways: a to b, then b to a. What b became is written once, as the way back reads it several times."""
    b2 = apply(a, b, policy, mode)
    b2 = Replica(kept(b2.main), kept(b2.deletions))
    return apply(b2, a, policy, mode), b2


def purge(deletions: DataFrame, now: Column, seconds: int = RETENTION_SECONDS) -> DataFrame:
    """Markers that stay: younger than the retention; one exactly as old goes."""
    cut = now - F.make_dt_interval(secs=F.lit(seconds))
    return deletions.filter(F.col("deleted_at") > cut)


def purge_stats(deletions: DataFrame, now: Column, seconds: int = RETENTION_SECONDS) -> DataFrame:
    """(purged, oldest_remaining)."""
    stays = F.col("deleted_at") > now - F.make_dt_interval(secs=F.lit(seconds))
    return deletions.agg(F.count(F.when(~stays, 1)).alias("purged"), F.min(F.when(stays, F.col("deleted_at"))).alias("oldest_remaining"))


def _code(e: Exception) -> str:
    """The kind of an error: records of the wrong form, a wrong call, a limit, or anything else."""
    if isinstance(e, ReplicationFailed):
        return e.code
    if isinstance(e, (ValueError, TypeError)):
        return "INVALID_STATE"
    if isinstance(e, AnalysisException):
        return "INVALID_MESSAGE"
    return "RESOURCE_LIMIT" if "OutOfMemory" in str(e) or "maxResultSize" in str(e) else "INTERNAL_ERROR"


def session(src: Replica, dst: Replica, policy: merging.Policy = merging.OVERWRITE, on_progress=None, on_complete=None, on_error=None, mode: str = "sticky", max_bytes: int | None = None) -> tuple[Replica, dict]:
    """apply() as a session with a report: id, state, error and its code, keys added, overwritten and deleted, records and bytes sent.

    on_progress(report) is called after the markers, after the comparison and after the records; on_complete(report) at the end;
    on_error(report) before an error is raised as ReplicationFailed. More than max_bytes of records are refused.
    """
    report = {"session_id": uuid.uuid4().hex, "state": "active", "phase": "start", "error": None, "code": ERRORS["NONE"], "started": time.time(), "records": 0, "bytes": 0}

    def reached(phase: str, rows: DataFrame, *columns: str) -> None:
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        report.update(phase=phase, records=report["records"] + n, bytes=report["bytes"] + total)
        if on_progress:
            on_progress(dict(report))

    try:
        out = apply(src, dst, policy, mode)
        reached("deletions", src.deletions.join(dst.deletions.select("key"), "key", "left_anti"), "key")
        sent = src.main.join(hashing.diff(dst.main, src.main, buckets=BUCKETS).filter("change != 'removed'").select("key"), "key", "left_semi")
        change = hashing.diff(dst.main, out.main, buckets=BUCKETS).groupBy("change").count().collect()
        n = {r["change"]: r["count"] for r in change}
        report |= {"keys_added": n.get("added", 0), "overwritten": n.get("changed", 0), "deleted": n.get("removed", 0), "phase": "difference"}
        if on_progress:
            on_progress(dict(report))
        reached("data", sent, "key", "value")
        if max_bytes is not None and report["bytes"] > max_bytes:
            raise ReplicationFailed("PAYLOAD_TOO_LARGE", f"{report['bytes']} bytes, {max_bytes} allowed")
        report["state"] = "idle"
        if on_complete:
            on_complete(report)
        return out, report
    except Exception as e:
        code = _code(e)
        report |= {"state": "error", "error": str(e), "code": ERRORS[code]}
        if on_error:
            on_error(report)
        raise e if isinstance(e, ReplicationFailed) else ReplicationFailed(code, str(e)) from e
