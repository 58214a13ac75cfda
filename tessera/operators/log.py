"""The append-only event log: envelopes, appends, latest rows, quarantine, snapshots.

A log is a DataFrame (id, stream_id, type, data, tenant_id, created_at); data is
JSON text, order is id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def envelope(stream_id: Column, kind: Column, data: Column, tenant: Column | str = "default") -> Column:
    """One event as JSON text."""
    tenant = F.lit(tenant) if isinstance(tenant, str) else tenant
    return F.to_json(F.struct(stream_id.alias("stream_id"), kind.alias("type"), data.alias("data"), tenant.alias("tenant_id")))


def operator_event(target: Column, reason: Column | None = None, actor: str = "operator", **fields: Column) -> Column:
    """Payload of an operator's decision."""
    return F.struct(target.alias("target"), F.lit(actor).alias("actor"), (reason if reason is not None else F.lit("")).alias("reason"), *[c.alias(k) for k, c in fields.items()])


def append_once(log: DataFrame, new: DataFrame, key: str = "js_seq") -> DataFrame:
    """Rows of new that the log has not yet, one for each key; rows without a key are all new."""
    keyed = new.where(F.col(key).isNotNull())
    first = keyed.dropDuplicates([key]).join(log.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(new.columns)
    return first.unionByName(new.where(F.col(key).isNull()))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def since(log: DataFrame, watermark: int) -> DataFrame:
    """Log rows past a watermark, in order."""
    return log.where(F.col("id") > watermark).orderBy("id")


def quarantine(rows: DataFrame, schema: str, stage: str = "log", column: str = "data") -> tuple[DataFrame, DataFrame]:
    """(rows whose data parses, as column `payload`; dead letters with stage and error)."""
    read = rows.withColumn("payload", F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    whole = F.get_json_object(column, "$").isNotNull()
    good = read.where(whole)
    dead = rows.where(~F.coalesce(whole, F.lit(False))).withColumn("stage", F.lit(stage)).withColumn("error", F.concat(F.lit("not JSON: "), F.substring(F.coalesce(column, F.lit("")), 1, 200)))
    return good, dead


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], watermark: int, folder: str, keep: int = 3) -> DataFrame:
    """Write all tables at a watermark; gives the manifest of the newest `keep` snapshots."""
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{watermark}/{name}")
        rows.append((watermark, name, spark.read.parquet(f"{folder}/{watermark}/{name}").count()))
    spark.createDataFrame(rows, "watermark long, table string, n_rows long").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return manifest(spark, folder, keep)


def manifest(spark: SparkSession, folder: str, keep: int = 3) -> DataFrame:
    """The newest snapshots, newest first."""
    every = spark.read.parquet(f"{folder}/manifest").dropDuplicates(["watermark", "table"])
    top = every.select("watermark").distinct().orderBy(F.desc("watermark")).limit(keep)
    return every.join(top, "watermark").orderBy(F.desc("watermark"), "table")


def restore(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """A table of the newest snapshot by the columns it shares with the schema (the others null), and its watermark."""
    mark = spark.read.parquet(f"{folder}/manifest").agg(F.max("watermark")).first()[0]
    old = spark.read.parquet(f"{folder}/{mark}/{table}")
    return old.select(*[F.col(f.name).cast(f.dataType) if f.name in old.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]), mark
