"""Connected components of an undirected graph held as edge rows.

Large-star / small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every round is two grouped minima and two joins,
so a hub of any degree is pre-aggregated before it is shuffled, and the minima of
the largest hubs are broadcast to their edges (join_per_key).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.skew import join_per_key
from tessera.session import cut


def forest(pairs: Iterator[tuple]) -> list[tuple]:
    """(node, root) for every node that is not its own root; the root is the smallest member."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, r) for x in list(root) if (r := find(x)) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by its spanning stars: fewer edges, the same components."""
    for b in batches:
        stars = forest(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if stars:
            a, r = zip(*stars)
            yield pa.RecordBatch.from_arrays([pa.array(a, b.schema.field(0).type), pa.array(r, b.schema.field(1).type)], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b."""
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = near.groupBy("a").agg(F.least(F.max("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    hung = join_per_key(near, low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if large:
        hung = hung.where(F.col("a") > F.col("b")).union(low.where("a > m").select("a", "m"))
    else:
        hung = hung.union(low.select("a", "m")).where(F.col("a") != F.col("b"))
    return hung.distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs under one smaller node that hangs under none: then each component is one star."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") > 1).isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Rows with a null end and self loops link nothing and are left out; repeated
    and reversed edges count once; an empty edge table gives no rows.
    """
    kind = dict(edges.select(a, b).dtypes)[a]
    now = edges.select(F.greatest(a, b).cast(kind).alias("a"), F.least(a, b).cast(kind).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))
    )
    now = cut(now.mapInArrow(_contract, f"a {kind}, b {kind}"), fresh=True)
    for _ in range(rounds):
        if _all_stars(now):
            break
        now = cut(_star(cut(_star(now, large=True), fresh=True), large=False), fresh=True)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
