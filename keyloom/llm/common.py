"""What the operators of this subpackage share: tables, names, scratch folders and key folding."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.shared import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character kept; pure ASCII takes the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def reserve(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rename input columns that clash with an operator's output names to `<name>_in` (plus further `_in` if taken)."""
    taken = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application, so that executors need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="keyloom-")) / "keyloom.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """A new folder in the session's shared folder, deleted with all that is in it when the application ends."""
    folder = f"{shared_folder(spark)}/keyloom-{uuid.uuid4().hex}"
    fs, path = _at(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def _at(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def tables(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a scratch folder."""
    fs, path = _at(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(path)]


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of a scratch folder that nothing reads any more."""
    for name in names:
        fs, path = _at(spark, f"{folder}/{name}")
        fs.delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if it is read from fewer files than there are cores, as a table of one file with one row group would keep a single core busy. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def give_back() -> None:
    """Return what a Python worker has freed to the machine: workers live on after a task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table in folder and return it as read back: lineage ends there, and lost executors cost nothing before it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, tag: str, least: int = 512, share: int = 10_000) -> DataFrame:
    """left with right's columns, null where it has no row; right has one row a key, left any number.

    Keys with more than `least` and more than a `share`-th of left's rows are at most `share`: their rows of right are
    broadcast, so the rows of a hot key stay where they are. All others meet by shuffle. tag: two such joins may stand in one plan.
    """
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(least, (total or 0) // share)
    if (most or 0) <= limit:
        return left.join(right, key, "left")
    more = [c for c in right.columns if c != key]
    hot = right.join(F.broadcast(counts.filter(F.col("n") > limit).select(key)), key, "left_semi")
    hot = hot.select(F.col(key).alias(f"__{tag}k"), F.struct(*more).alias(f"__{tag}h"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col(f"__{tag}k"), "left")
    # a hot key's rows, and those without a key, are spread and find nothing more
    settled = F.col(f"__{tag}h").isNotNull() | F.col(key).isNull()
    out = out.withColumn(f"__{tag}s", F.when(settled, F.pmod(F.monotonically_increasing_id(), F.lit(9973)) + 1).otherwise(0))
    # always 0, but no literal: it must stay a part of the join's key
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    cold = right.select(F.col(key).alias(f"__{tag}c"), zero.alias(f"__{tag}z"), F.struct(*more).alias(f"__{tag}r"))
    out = out.join(cold, (F.when(settled, F.lit(None)).otherwise(F.col(key)).eqNullSafe(F.col(f"__{tag}c"))) & (F.col(f"__{tag}s") == F.col(f"__{tag}z")), "left")
    got = F.coalesce(f"__{tag}h", f"__{tag}r")
    return out.select(*left.columns, *[got[c].alias(c) for c in more])
