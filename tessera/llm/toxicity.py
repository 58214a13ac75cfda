"""Toxicity categories by a chain of linear classifiers.

Categories are predicted one after the other; each logistic model sees the
text features and the probabilities of all earlier categories. For training,
those probabilities are out of fold (FOLDS folds by crc32(doc_id)), so a later
model never learns from a probability that has seen its own label.

The last category is the labelled one, `toxic`. The labels know no finer ones,
so the earlier categories are learned from the labelled evidence: the toxic
training rows are clustered by their features (spherical k-means, KINDS
clusters, largest first), and a row has category kind_k if it is toxic and in
cluster k. On texts in several languages these are the wordings of toxicity.

Features are the presence of lower-case words and, for each of their first
letters of each length in PREFIXES, whether 1, 2 or 3 different words start with
them: forms of one word count together, and one chance likeness counts less than
three. Those whose log-likelihood ratio for `toxic` is at least MIN_GAIN stay,
counted on Spark over the training rows. Models are fitted on at most TRAIN_ROWS
labelled rows per label value, those of least xxhash64(doc_id); every text of
the table is scored whole.

Defined cases: a null text counts as empty and gets the probabilities of no
features. Null doc_ids are scored and never learned from. Of repeated label
rows the largest label counts. Without labelled rows of both values every
probability is 0. Repeated rows are scored each; very long texts are read whole;
other columns are not read, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, texts
from tessera.session import cut

TRAIN_ROWS, KINDS, FOLDS, THRESHOLD, MIN_GAIN = 10_000, 2, 5, 0.5, 5.0
PREFIXES, LEVELS = range(3, 9), 3
#: Steps of a fit at most.
STEPS = 100
_WORD = re.compile(r"[^\W\d_]+")


class Heads(dict):
    """The first letters of a word that some known feature counts, made once a word; emptied when it holds too many words."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__()
        self.letters = frozenset(f[1:-1] for f in known if f[0] == "|")

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = [h for k in PREFIXES if len(word) > k and (h := word[:k]) in self.letters]
        return found


def features(text: str, known: dict[str, int] | None = None, heads: Heads | None = None) -> list[str]:
    """Words of a text, and a bar, first letters and 1, 2 or 3 for these letters of that many words; of `known` features only, if given."""
    words = set(_WORD.findall(text.lower()))
    if known is None:
        count = Counter(w[:k] for w in words for k in PREFIXES if len(w) > k)
        return [*words, *(f"|{h}{j + 1}" for h, n in count.items() for j in range(min(n, LEVELS)))]
    heads = Heads(known) if heads is None else heads
    count = Counter(chained.from_iterable(map(heads.__getitem__, words)))
    return [w for w in words if w in known] + [f for h, n in count.items() for j in range(min(n, LEVELS)) if (f := f"|{h}{j + 1}") in known]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse binary rows: features of row i are ids[start[i]:start[i + 1]]."""

    ids: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(lists: list[list[int]]) -> Rows:
        return Rows(np.array([k for x in lists for k in x], np.int32), np.cumsum([0, *map(len, lists)]))

    def times(self, w: np.ndarray) -> np.ndarray:
        """Sum of w over the features of each row."""
        if not len(self.ids):
            return np.zeros(len(self.start) - 1)
        some = np.flatnonzero(np.diff(self.start))
        total = np.zeros(len(self.start) - 1)
        total[some] = np.add.reduceat(w[self.ids], self.start[some])
        return total

    def gather(self, per_row: np.ndarray, size: int) -> np.ndarray:
        """Sum over the rows of each feature; the rows are put in order of features once."""
        if "rows" not in self.__dict__:
            order = np.argsort(self.ids, kind="stable")
            self.rows = np.repeat(np.arange(len(self.start) - 1, dtype=np.int32), np.diff(self.start))[order]
            found, self.at = np.unique(self.ids[order], return_index=True)
            self.found = found
        total = np.zeros(size)
        if len(self.found):
            total[self.found] = np.add.reduceat(per_row[self.rows], self.at)
        return total

    def sorted(self, order: np.ndarray) -> Rows:
        """The same rows in another order."""
        size = np.diff(self.start)[order]
        start = np.concatenate([[0], np.cumsum(size)])
        return Rows(self.ids[np.repeat(self.start[:-1][order] - start[:-1], size) + np.arange(start[-1])], start)

    def take(self, keep: np.ndarray) -> Rows:
        size = np.diff(self.start)
        return Rows(self.ids[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))


@dataclass
class Linear:
    w: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, x: Rows, before: np.ndarray) -> np.ndarray:
        return _logistic(x.times(self.w) + before @ self.earlier + self.bias)


def fit_linear(x: Rows, before: np.ndarray, y: np.ndarray, size: int, l2: float = 1e-4, steps: int = STEPS, memory: int = 8) -> Linear:
    """Logistic regression by L-BFGS, a step being halved until it pays; classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    sign = np.where(y == 1, -1.0, 1.0)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(theta[:size]) + before @ theta[size:-1] + theta[-1]
        gap = (_logistic(z) - y) * weight
        g = np.concatenate([x.gather(gap, size), before.T @ gap, [gap.sum()]])
        g[:-1] += l2 * theta[:-1]
        return float(weight @ np.logaddexp(0, sign * z) + l2 / 2 * (theta[:-1] @ theta[:-1])), g

    theta = np.zeros(size + before.shape[1] + 1)
    value, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, d, r in reversed(past):
            used.append(a := r * (s @ q))
            q -= a * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, r), a in zip(past, reversed(used)):
            q += s * (a - r * (d @ q))
        slope, reach = float(g @ q), 1.0 if past else 1.0 / max(1e-12, np.sqrt(g @ g))
        while True:
            new = theta - reach * q
            now, g_new = loss(new)
            if now <= value - 1e-4 * reach * slope or reach < 1e-10:
                break
            reach /= 2
        s, d = new - theta, g_new - g
        done = value - now < 1e-9
        theta, value, g = new, now, g_new
        if done:
            break
        if s @ d > 1e-12:
            past = [*past[1 - memory :], (s, d, 1 / (s @ d))]
    return Linear(theta[:size], theta[size:-1], float(theta[-1]))


@dataclass
class Chain:
    names: list[str]
    vocabulary: dict[str, int]
    models: list[Linear]

    def predict(self, x: Rows) -> np.ndarray:
        """Probabilities, a column per category."""
        n = len(x.start) - 1
        if not self.models:
            return np.zeros((n, len(self.names)))
        before = np.zeros((n, 0))
        for model in self.models:
            before = np.column_stack([before, model.predict(x, before)])
        return before

    def rows(self, found: list[str], heads: Heads | None = None) -> Rows:
        known, heads = self.vocabulary, Heads(self.vocabulary) if heads is None else heads
        return Rows.of([[known[f] for f in features(t, known, heads)] for t in found])


def fit_chain(names: list[str], vocabulary: dict[str, int], x: Rows, y: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit the chain; y has a column per category."""
    size, models, before = len(vocabulary), [], np.zeros((len(y), 0))
    for k in range(len(names)):
        models.append(fit_linear(x, before, y[:, k], size))
        if k + 1 == len(names):
            break
        out = np.zeros(len(y))
        for f in range(FOLDS):
            inside, outside = fold != f, fold == f
            if outside.any():
                part = fit_linear(x.take(inside), before[inside], y[inside, k], size)
                out[outside] = part.predict(x.take(outside), before[outside])
        before = np.column_stack([before, out])
    return Chain(names, vocabulary, models)


def kinds_of(x: Rows, size: int, n: int, rounds: int = 20) -> np.ndarray:
    """The cluster (0 the largest) of each row by spherical k-means; centres start far apart, the first at the row with most features."""
    count = np.diff(x.start)
    norm = np.sqrt(np.maximum(count, 1))
    dense = lambda i: np.bincount(x.ids[x.start[i] : x.start[i + 1]], minlength=size) / norm[i]
    centres = [dense(int(np.argmax(count)))]
    while len(centres) < n:
        centres.append(dense(int(np.argmin(np.max([x.times(c) / norm for c in centres], axis=0) - (count > 0)))))
    label = np.zeros(len(count), int)
    for _ in range(rounds):
        now = np.argmax([x.times(c) / norm for c in centres], axis=0)
        if (now == label).all() and _:
            break
        label = now
        for k in range(n):
            c = x.gather((label == k) / norm, size)
            centres[k] = c / max(1e-12, np.sqrt(c @ c))
    order = np.argsort(-np.bincount(label, minlength=n), kind="stable")
    return np.argsort(order)[label]


def learn(docs: DataFrame, labels: DataFrame, kinds: int = KINDS, train_rows: int = TRAIN_ROWS) -> Chain:
    """Screen features on Spark and fit the chain on a bounded sample of labelled rows."""
    names = [*(f"kind_{k + 1}" for k in range(kinds)), "toxic"]
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = {r.doc_id: r.y for v in (0, 1) for r in known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()}
    if len(set(chosen.values())) < 2:
        return Chain(names, {}, [])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = [(i, d) for i, d in enumerate(b.column(0).to_pylist()) if d in chosen]
            yield batch("doc_id y text", pa.array([d for _, d in at], pa.int64()), pa.array([chosen[d] for _, d in at], pa.int32()), b.column(1).take(pa.array([i for i, _ in at], pa.int64())))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = sorted({*seen[0], *seen[1]})
            part = batch("w a b", pa.array(words, pa.string()), *[pa.array([seen[v][w] for w in words], pa.int64()) for v in (1, 0)])
            seen[0].clear(), seen[1].clear()
            return part

        for b in small(batches):
            for y, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
                seen[y].update(features(t))
            if len(seen[0]) + len(seen[1]) > 1_000_000:
                yield out()
        yield out()

    sample = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, y int, text string"))
    total = sample.agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).first()
    if not total.a or not total.b:
        return Chain(names, {}, [])
    count = sample.select("y", "text").mapInArrow(counted, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (total.a + total.b)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0)
    gain = F.round(part(F.col("a"), F.lit(total.a)) + part(F.col("b"), F.lit(total.b)), 6)
    best = count.where((F.col("a") / total.a > F.col("b") / total.b) & (gain >= MIN_GAIN)).select("w").collect()  # bounded by the sample
    vocabulary = {w: k for k, w in enumerate(sorted(r.w for r in best))}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = Heads(vocabulary)
        for b in small(batches):
            ids = [sorted(vocabulary[f] for f in features(t, vocabulary, heads)) for t in texts(b.column(2))]
            yield batch("doc_id y ids", b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())))

    got = sample.mapInArrow(found, "doc_id long, y int, ids array<int>").toArrow().combine_chunks()
    doc_id, label, ids = (got.column(c).combine_chunks() for c in ("doc_id", "y", "ids"))
    doc_id, label = doc_id.to_numpy(), label.to_numpy()
    x = Rows(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int64))
    own = np.array([zlib.crc32(x.ids[i:j].tobytes()) for i, j in zip(x.start[:-1].tolist(), x.start[1:].tolist())], np.int64)
    order = np.lexsort((own, label, doc_id))  # not as tasks happened to end
    x = x.sorted(order)
    doc_id = doc_id[order]
    y = np.zeros((len(doc_id), len(names)))
    y[:, -1] = label[order]
    toxic = np.flatnonzero(y[:, -1])
    if kinds:
        y[toxic, kinds_of(x.take(y[:, -1] == 1), len(vocabulary), kinds)] = 1
    return fit_chain(names, vocabulary, x, y, np.array([zlib.crc32(str(d).encode()) % FOLDS for d in doc_id.tolist()]))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per row of docs: doc_id, p_<category> for each category, toxic (0 or 1)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = Heads(chain.vocabulary)
        for b in small(batches):
            p = chain.predict(chain.rows(texts(b.column(1)), heads))
            yield batch(" ".join(["doc_id", *(f"p_{n}" for n in chain.names), "toxic"]), b.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array((p[:, -1] >= THRESHOLD).astype(np.int32)))

    schema = ", ".join(["doc_id long", *(f"p_{n} double" for n in chain.names), "toxic int"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are found toxic, with the probability of each category."""
    return score(docs, learn(docs, labels)).where("toxic = 1")
