"""The event log as a stream: ingest once, fold, count, rebuild.

A stream reads log files as they land. Exactly-once folding comes from the
checkpoint plus states that are a function of the rows seen so far: a repeated
micro-batch writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.log import LOG_SCHEMA
from tessera.operators.states import Fold
from tessera.streaming.keyed import once_across_batches, write_by_batch


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema=LOG_SCHEMA, files: str = "*.parquet") -> DataFrame:
    """The log folder as a stream of its files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def once(events: DataFrame, key: str = "id", late: str = "1 day", time: str = "created_at") -> DataFrame:
    """Each event once; the watermark bounds the state that remembers keys."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, late: str = "1 day", time: str = "created_at", by: str = "type") -> DataFrame:
    """Events per UTC day and type."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


def append_batches(new: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append to a log folder exactly once: each key in one batch only (by state of the keys seen), and a batch under its own id, so a repeat replaces it."""
    return write_by_batch(once_across_batches(new, key), target, checkpoint, "append")


def fold_batches(events: DataFrame, fold: Fold, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep a fold's state up to date in a folder: a batch is merged into the state before it, and the log is not read again.

    A version is named by its batch, so a repeated batch writes its own again
    from the same one before; versions older than that one are removed.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = sorted(v for v in _versions(spark, folder) if v < batch_id)
        now = fold.merge(spark.read.parquet(f"{folder}/version-{old[-1]}"), batch) if old else fold.state(batch)
        now.write.mode("overwrite").parquet(f"{folder}/version-{batch_id}")
        for v in old[:-1]:
            _folder(spark, f"{folder}/version-{v}", remove=True)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, folder: str, fold: Fold) -> DataFrame | dict[str, DataFrame]:
    """The table (or tables) of the state that fold_batches keeps."""
    return fold.finish(spark.read.parquet(f"{folder}/version-{max(_versions(spark, folder))}"))


def _folder(spark: SparkSession, place: str, remove: bool = False):
    """(file system, path) of a place in any store that Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if remove:
        fs.delete(path, True)
    return fs, path


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that are written to the end."""
    fs, path = _folder(spark, folder)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()]
    return [int(n[8:]) for n in names if n.startswith("version-") and fs.exists(_folder(spark, f"{folder}/{n}/_SUCCESS")[1])]


def latest_state(events: DataFrame, key: str, value: str, order: str = "id") -> DataFrame:
    """Per key the value at the largest order seen so far, as an update-mode aggregate."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
