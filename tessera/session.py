"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "tessera") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may go without that setting; it then gets a fresh
    temporary folder, as driver and executors are one process there.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame, fresh: bool = False) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder.

    A checkpoint still carries the planner's guess of its size, and that of a join
    is the product of its sides: in rounds of joins the guess becomes a number of
    millions of digits that fills the driver. fresh drops it, at the cost of
    reading each row as an object, so it is for what goes through rounds.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint()
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark) if fresh else kept
