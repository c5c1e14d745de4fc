"""Change logs as streams (extension): windowed activity with a watermark, and a table kept current by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import history


def stream_log(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A folder of log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def activity(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Changes by window, source and op; rows later than `late` are dropped. For streams and tables."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    return log.groupBy(F.window("ts", window).alias("w"), "source", "op").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "op", "n")


class CurrentTable:
    """Each key's last change, kept current by a stream at a cost that follows the batch, not the table.

    A batch adds one delta, the last change of each key it holds; a batch that runs again after a failure overwrites its own.
    `compact` folds deltas into a new base. Readers take the newest base and the deltas after it.
    """

    FIELDS = ("key", "txn_id", "source", "seq", "op", "value")

    def __init__(self, spark: SparkSession, path: str, schema: str):
        from keyloom.sources.store import Files

        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).select(*self.FIELDS).schema
        self.files = Files(spark, self.path)

    def follow(self, log: DataFrame, checkpoint: str):
        """A stream writer; choose a trigger and start it."""

        def apply(batch: DataFrame, number: int) -> None:
            last = history.latest(batch.select(*self.FIELDS), *history.ORDER).select(*self.FIELDS)
            last.write.mode("overwrite").parquet(f"{self.path}/delta-{number:012d}")

        return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)

    def _parts(self) -> tuple[int, list[str]]:
        done = [n for n in self.files.names("") if self.files.exists(f"{n}/_SUCCESS")]
        base = max((int(n[5:]) for n in done if n.startswith("base-")), default=-1)
        deltas = [n for n in done if n.startswith("delta-") and int(n[6:]) > base]
        return base, [*([f"base-{base:012d}"] if base >= 0 else []), *deltas]

    def changes(self) -> DataFrame:
        """The last change of each key, deletes included."""
        parts = self._parts()[1]
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], self.schema)
        return history.latest(rows, *history.ORDER).select(*self.FIELDS)

    def read(self) -> DataFrame:
        return self.changes().filter("op = 'put'").select("key", "value")

    def compact(self) -> None:
        """Fold all deltas into a base; deletes stay in it as marks, for changes that arrive late."""
        parts = self._parts()[1]
        last = max((int(p[6:]) for p in parts if p.startswith("delta-")), default=None)
        if last is not None:
            self.changes().repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{self.path}/base-{last:012d}")
            for p in parts:
                self.files.delete(p)
