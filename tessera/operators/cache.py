"""A cache of embeddings that is written back: a table bucketed by the hash of the text.

The table has the buckets that the session's joins have partitions, so a join by
hash reads it where it lies and shuffles the asking side only. Of the texts
asked for, those that are not in the table are embedded, each once, and
appended; a second run finds all of them and embeds nothing. Rows without a
text get no vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Embeds texts: a list of texts to as many vectors.
Embedder = Callable[[list[str]], list[list[float]]]


def open_cache(spark: SparkSession, name: str) -> DataFrame:
    """The cache (text_hash, vector) as a table of the catalog; made, empty, if it is not there."""
    if not spark.catalog.tableExists(name):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([], "text_hash string, vector array<double>").write.format("parquet").bucketBy(n, "text_hash").saveAsTable(name)
    return spark.table(name)


def missing(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """(text_hash, text) of the distinct texts that the cache lacks."""
    asked = texts.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text"))
    return asked.groupBy("text_hash").agg(F.any_value("text").alias("text")).join(cache.select("text_hash"), "text_hash", "left_anti")


def embedded(texts: DataFrame, name: str, embed: Embedder, text: str = "text", chunk: int = 64) -> DataFrame:
    """texts with their `vector`; what the cache lacked is embedded, `chunk` texts at a time, and appended to it first."""
    spark = texts.sparkSession
    lacking = missing(texts, open_cache(spark, name), text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embed(part.column(1).to_pylist()), pa.list_(pa.float64()))], names=["text_hash", "vector"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new = lacking.mapInArrow(go, "text_hash string, vector array<double>")
    new.write.format("parquet").bucketBy(_buckets(spark, name, n), "text_hash").mode("append").saveAsTable(name)
    keyed = texts.withColumn("text_hash", F.sha2(text, 256))
    return keyed.join(spark.table(name), "text_hash", "left").drop("text_hash")


def _buckets(spark: SparkSession, name: str, default: int) -> int:
    """The number of buckets that the table was made with."""
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    return int(rows[0].data_type) if rows else default
