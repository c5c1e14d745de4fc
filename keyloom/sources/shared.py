"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir. Where it names none, a temporary folder on a local master, which is one machine; elsewhere an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _local[sc.applicationId]


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, for results that several steps use: lineage ends there. Deleted when the application ends."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    df.write.parquet(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)
