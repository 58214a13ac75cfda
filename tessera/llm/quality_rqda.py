"""Document quality by a regularised quadratic discriminant.

Each text becomes N_FEATURES bounded statistics. Per class a mean and a
covariance are summed on Spark (one row per class reaches the driver), the
covariance is shrunk towards the pooled one by POOL and towards a multiple of
the identity by RIDGE, and its Cholesky factor is cached in the model. A score
is the logistic function of the difference of the two Gaussian log-densities
(Mahalanobis distances by triangular solves) plus the log prior odds.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
labels, lang, source and doc_id are never inputs of a score.

Defined cases: a null text counts as empty and is scored; a null doc_id is in
fold crc32('') and joins no label; label rows that are null are not learned
from, and each repeated label row counts once. With fewer than two labelled
rows of a class, or none, every score is the share of label 1 (1 if there is no
label at all). No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, utf8
from tessera.session import cut

POOL, RIDGE, THRESHOLD = 0.1, 0.05, 0.3
_CLASS = np.zeros(256, np.int64)  # 0: other, 1: lower, 2: upper, 3: digit, 4: space, 5: sentence mark, 6: symbol, 7: continuation of a code point
for _k, _bytes in ((1, range(97, 123)), (2, range(65, 91)), (3, range(48, 58)), (4, (9, 10, 11, 12, 13, 32)), (5, b".,;:?'\"-()"), (6, b"!#$%&*+/<=>@[\\]^_`{|}~"), (7, range(128, 192))):
    _CLASS[list(_bytes)] = _k
N_FEATURES = 12


def features(text: bytes) -> list[float]:
    """Bounded statistics of a text in UTF-8; all zero for the empty text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    count = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    w = len(words)
    chars = n - count[7]
    letters = count[1] + count[2] + count[0] + 1
    low = text.lower().split()
    same = sum(a == b for a, b in zip(low, low[1:]))
    threes = list(zip(low, low[1:], low[2:]))
    lines = text.split(b"\n")
    symbol_words = sum(1 for x in words if x[-1] in b"!#$%&*|")
    root = lambda x: float(np.sqrt(x))
    return [
        root(count[2] / letters),
        root(count[6] / chars),
        root(symbol_words / w),
        root(same / w),
        root(1 - len(set(threes)) / len(threes)) if threes else 0.0,
        root(1 - len(set(low)) / w) / root(np.log1p(w)),
        root(count[5] / chars),
        root(count[3] / chars),
        float(min(chars / w, 20) / 20),
        root(1 - len(set(lines)) / len(lines)),
        float(np.log1p(w) / 12),
        root(text.count(b" | ") / w),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) per row of docs."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield batch("doc_id x", b.column(0), pa.array([features(t) for t in utf8(b.column(1))], pa.list_(pa.float64())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, x array<double>")


def held_out(doc_id) -> F.Column:
    """True for the rows whose label is never learned: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    """Class means, inverse Cholesky factors, log determinants and log prior odds; or a constant score."""

    mean: np.ndarray | None = None
    inverse: np.ndarray | None = None
    logdet: np.ndarray | None = None
    prior: float = 0.0
    constant: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - 0.5 * d for m, inv, d in zip(self.mean, self.inverse, self.logdet)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows that are not held out; sums are made on Spark."""
    known = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)")
    rows = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("l_id"))
    d = N_FEATURES
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in upper]).alias("ss"),
    )
    found = {r.y: r for r in sums.collect()}  # two rows at most
    if any(k not in found or found[k].n < 2 for k in (0, 1)):
        n = {k: found[k].n if k in found else 0 for k in (0, 1)}
        return Model(constant=n[1] / sum(n.values()) if sum(n.values()) else 1.0)
    n = np.array([found[k].n for k in (0, 1)], float)
    mean = np.array([found[k].s for k in (0, 1)]) / n[:, None]
    cov = np.zeros((2, d, d))
    for k in (0, 1):
        for (i, j), v in zip(upper, found[k].ss):
            cov[k, i, j] = cov[k, j, i] = v / n[k] - mean[k, i] * mean[k, j]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.trace(pooled) / d + 1e-9
    inverse, logdet = [], []
    for k in (0, 1):
        c = (1 - POOL) * cov[k] + POOL * pooled
        c = (1 - RIDGE) * c + RIDGE * scale * np.eye(d)
        low = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    return Model(mean, np.array(inverse), np.array(logdet), float(np.log(n[1] / n[0])))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    stats = cut(statistics(docs))
    model = fit(stats, labels)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, N_FEATURES)
            yield batch("doc_id score", b.column(0), pa.array(model.score(x)))

    scored = stats.mapInArrow(go, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject; texts are scored where they lie, without a join."""
    model = fit(statistics(docs), labels)
    at = docs.columns.index("text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = np.array([features(t) for t in utf8(b.column(at))], float).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(go, docs.schema)
