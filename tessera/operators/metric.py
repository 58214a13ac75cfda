"""Cosine search through an exact metric index: cells around pivots, cut into rings of equal angle.

Pivots are the centres of a few rounds of spherical k-means over a bounded sample
(SAMPLE rows of least hash); every row of the table is put into the cell of its
nearest pivot and the ring of its angle to it. For a query at angle f to a pivot
and rows at angles lo to hi, no row is nearer than max(f - hi, lo - f), as angles
are a metric, so a ring beyond the wanted angle is not visited. What is visited
is multiplied out, so results are those of comparing all. The table of rings has
PIVOTS x RINGS rows at most at any size. Rings with many rows, and many queries,
are dealt out in blocks of BLOCK_ROWS, so no task holds a ring.

How much is skipped depends on the data: vectors in clusters are mostly skipped;
of vectors spread evenly over many dimensions, all at nearly right angles, none
are, and the work is that of all pairs. visited() tells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.similarity import unit_vectors
from tessera.session import cut

PIVOTS, SAMPLE, RINGS, ROUNDS, BLOCK_ROWS = 64, 8_192, 32, 5, 8_192
#: Angles are compared with this much to spare for rounding.
SLACK = 1e-7


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def fit_pivots(units: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots from the sample of (k, v); a row each, none if there are no rows."""
    got = units.orderBy(F.xxhash64("k"), "k").limit(sample).select("v").toArrow()
    if not got.num_rows:
        return np.zeros((0, 1))
    v = _matrix(got["v"])
    p = np.unique(v[:pivots], axis=0)
    for _ in range(ROUNDS):
        near = np.argmax(v @ p.T, axis=1)
        sums = np.zeros_like(p)
        np.add.at(sums, near, v)
        size = np.linalg.norm(sums, axis=1)
        p = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], p)
    return p


@dataclass(frozen=True)
class Index:
    """Rows (k, v, cell, ring) and the table of rings: cell, ring, lo, hi, n."""

    rows: DataFrame
    pivots: np.ndarray
    rings: np.ndarray


def build(df: DataFrame, key: str, vector: str, pivots: int = PIVOTS) -> Index:
    """Index all vectors but zero ones, which are like nothing."""
    units = cut(unit_vectors(df, key, vector))
    p = fit_pivots(units, pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = _angles(_matrix(b.column(1)), p)
                cell = np.argmin(angle, axis=1)
                angle = angle[np.arange(len(cell)), cell]
                ring = np.minimum((angle * (RINGS / np.pi)).astype(np.int32), RINGS - 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(ring), pa.array(angle)], names=["k", "v", "cell", "ring", "angle"])

    rows = cut(units.mapInArrow(dealt, f"k {dict(units.dtypes)['k']}, v array<double>, cell int, ring int, angle double"))
    rings = rows.groupBy("cell", "ring").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("cell", "ring").collect()  # PIVOTS x RINGS at most
    return Index(rows, p, np.array([tuple(r) for r in rings], float).reshape(-1, 5))


def _wanted(index: Index, v: np.ndarray, at_least: float) -> np.ndarray:
    """Which rings each row of v has to visit."""
    f = _angles(v, index.pivots)[:, index.rings[:, 0].astype(int)]
    nearest = np.maximum(f - index.rings[:, 3], index.rings[:, 2] - f)
    return nearest <= np.arccos(np.clip(at_least, -1, 1)) + SLACK


def search(index: Index, queries: DataFrame, key: str, vector: str, at_least: float, block: int = BLOCK_ROWS) -> DataFrame:
    """(q, k, sim) of all queries and indexed rows with a cosine of at_least or more."""
    units = cut(unit_vectors(queries, key, vector))
    kind, of = dict(index.rows.dtypes)["k"], dict(units.dtypes)["k"]
    q_blocks = max(1, -(-units.count() // block))
    schema = f"q {of}, k {kind}, sim double"
    if not len(index.rings):
        return units.sparkSession.createDataFrame([], schema)
    n_blocks = {(int(c), int(r)): max(1, -(-int(n) // block)) for c, r, _, _, n in index.rings}
    blocks = units.sparkSession.createDataFrame([(c, r, n) for (c, r), n in n_blocks.items()], "cell int, ring int, blocks int")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ring = index_rings[:, 0].astype(np.int32), index_rings[:, 1].astype(np.int32)
        for b in batches:
            for x in range(0, b.num_rows, 512):
                part = b.slice(x, 512)
                i, j = np.nonzero(_wanted(bare, _matrix(part.column(1)), at_least))
                if len(i):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(cell[j]), pa.array(ring[j])], names=["k", "v", "cell", "ring"])

    index_rings, bare = index.rings, Index(None, index.pivots, index.rings)  # what goes to the tasks has no DataFrame
    asked = units.mapInArrow(visits, f"k {of}, v array<double>, cell int, ring int").join(F.broadcast(blocks), ["cell", "ring"])
    asked = asked.select("k", "v", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.pmod(F.xxhash64("k"), F.lit(q_blocks)).cast("int").alias("j"))
    held = index.rows.join(F.broadcast(blocks), ["cell", "ring"])
    held = held.select("k", "v", "cell", "ring", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("j"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"q": left["k"].slice(0, 0), "k": right["k"].slice(0, 0), "sim": pa.array([], pa.float64())})]
        if len(left) and len(right):
            a, b = _matrix(left["v"]), _matrix(right["v"])
            for x in range(0, len(a), 512):
                i, j = np.nonzero(a[x : x + 512] @ b.T >= at_least - 1e-9)
                sim = np.einsum("ij,ij->i", a[x + i], b[j])
                i, j, sim = i[sim >= at_least], j[sim >= at_least], sim[sim >= at_least]
                out.append(pa.table({"q": left["k"].take(pa.array(x + i)), "k": right["k"].take(pa.array(j)), "sim": sim}))
        return pa.concat_tables(out)

    unit = ["cell", "ring", "i", "j"]
    return asked.groupBy(*unit).cogroup(held.groupBy(*unit)).applyInArrow(product, schema)


def visited(index: Index, queries: DataFrame, key: str, vector: str, at_least: float) -> DataFrame:
    """One row: queries, rows they are compared with in all, and the share of all pairs that this is."""
    units, total = unit_vectors(queries, key, vector), float(index.rings[:, 4].sum())
    rings, bare = index.rings, Index(None, index.pivots, index.rings)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(rings):
                yield pa.RecordBatch.from_arrays([pa.array((_wanted(bare, _matrix(b.column(1)), at_least) @ rings[:, 4]).astype(np.int64))], names=["n"])

    n = units.mapInArrow(counted, "n long").agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    return n.withColumn("share", F.try_divide(F.col("compared"), F.col("queries") * F.lit(total)))
