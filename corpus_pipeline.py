"""A training corpus from raw documents: filter, deduplicate, decontaminate, pack.

Defined cases of every stage: a null text counts as empty (and stays null if its
row stays); rows with null or repeated doc_ids are judged each by its own text;
of rows alike in what a stage goes by, the ones that stay are chosen by a hash of
their other columns; other columns pass through all stages but the last,
whatever their names; no rows in, no rows out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, packing_nnls, quality_rqda, simhash_bk
from tessera.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_rqda.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return simhash_bk.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    return packing_nnls.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    A run that is started again with the run_id of one that broke off goes on
    after the last stage that was written to the end. Once a stage is written,
    the rows of the one before it are removed; the last stage's stay, as the result.
    """
    place = f"{shared_dir(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    done = max((k for k in range(len(STAGES)) if _there(spark, f"{place}/{k}/_SUCCESS")), default=-1)
    docs = table(spark, sf_dir, "documents") if done < 0 else spark.read.parquet(f"{place}/{done}")
    for k, (_, stage) in enumerate(STAGES[done + 1 :], done + 1):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            _there(spark, f"{place}/{k - 1}", remove=True)
    return docs


def _there(spark: SparkSession, name: str, remove: bool = False) -> bool:
    """Whether a path is there, in any store that Spark reads; removes it if asked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(path, True) if remove else fs.exists(path)
