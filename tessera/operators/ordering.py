"""Numbers in an order over a whole table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import cut


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with its row numbers from 1 in the given order, which should end with a key that tells rows apart.

    Rows are dealt out by ranges of the order and kept, so that sizes and numbers
    are of the same partitions; each partition is numbered for itself, from where
    the ones before it end. The driver reads one number a partition.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    start = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    kind = "int" if at < 1 << 31 else "long"
    return dealt.withColumn("_nth", nth).join(F.broadcast(start), "_part").withColumn(name, (F.col("_start") + F.col("_nth")).cast(kind)).drop("_part", "_start", "_nth")
