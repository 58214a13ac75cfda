"""Language of a text by the character n-grams of its words: naive Bayes over hashed n-grams.

Learned on Spark from all rows that have a language: tasks count n-grams by
bucket, the counts are summed by (language, bucket). The model is one table of
LANGUAGES x BUCKETS log-probabilities at most; its size is checked, and it goes to
the tasks with the function. N-grams are those of GRAMS bytes of the lower-cased
text in UTF-8, white space and marks being one blank, so words' ends count.

Defined cases: a null text, or one without letters, has no language (''). Rows
whose language is null or empty, or whose text has no letters, teach nothing.
Ties go to the first language in order of name. A model of no rows gives ''.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

GRAMS, BUCKETS, LANGUAGES, SMOOTH = (2, 3, 4), 1 << 15, 256, 0.5
_BLANK = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text, repeats included."""
    words = _BLANK.sub(" ", (text or "").lower()).strip()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ b[j : len(b) - n + 1 + j]
            out.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Languages:
    """names and, for each of them, the log-probability of each bucket; prior holds that of the language."""

    names: list[str]
    table: np.ndarray
    prior: np.ndarray

    def of(self, text: str | None) -> str:
        found = grams(text)
        if not len(found) or not self.names:
            return ""
        bucket, n = np.unique(found, return_counts=True)
        return self.names[int(np.argmax(self.table[:, bucket] @ n + self.prior))]


def learn(rows: DataFrame, text: str = "text", language: str = "language") -> Languages:
    """From all rows with a language."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        texts: dict[str, int] = defaultdict(int)
        for b in batches:
            for t, name in zip(b.column(0), b.column(1).to_pylist()):
                found = grams(t.as_py())
                if len(found):
                    sums[name] += np.bincount(found, minlength=BUCKETS)
                    texts[name] += 1
                    if len(sums) > LANGUAGES:
                        raise ValueError(f"more than {LANGUAGES} languages")
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.r_[at, -1]), pa.array(np.r_[n[at], texts[name]])], names=["name", "bucket", "n"])

    known = rows.where((F.coalesce(language, F.lit("")) != "") & F.col(text).isNotNull()).select(F.col(text), F.col(language))
    sums = known.mapInArrow(counted, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r.name for r in sums.select("name").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table, prior = np.full((len(names), BUCKETS), SMOOTH), np.zeros(len(names))
    got = sums.toArrow()  # LANGUAGES x (BUCKETS + 1) rows at most
    row = np.searchsorted(names, got["name"].to_pylist()) if names else np.zeros(0, int)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    gram = bucket >= 0
    table[row[gram], bucket[gram]] += n[gram]
    prior[row[~gram]] = n[~gram]
    return Languages(names, np.log(table / table.sum(1, keepdims=True)), np.log(prior / max(1.0, prior.sum())) if names else prior)


def detect(rows: DataFrame, model: Languages, text: str = "text", name: str = "detected") -> DataFrame:
    """rows with the language of each text in column `name` (which replaces one of that name)."""
    rows = rows.drop(name)
    at = rows.columns.index(text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.of(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, name])

    return rows.mapInArrow(go, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def fill(rows: DataFrame, model: Languages, text: str = "body", language: str = "language") -> DataFrame:
    """rows whose language, where it is null or empty, is that of the text; others keep theirs."""
    out = detect(rows, model, text, "_detected")
    return out.withColumn(language, F.when(F.coalesce(language, F.lit("")) == "", F.col("_detected")).otherwise(F.col(language))).drop("_detected")
