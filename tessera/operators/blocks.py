"""All pairs of two tables without shuffling the pairs: blocks of one are held in tasks, slices of the other stream past them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def each(n: int) -> Column:
    """A row for each number below n."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def stream_past(held: DataFrame, streamed: DataFrame, blocks: int, slices: int, build: Callable, found: Callable, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """What found(index, batch) yields for every block of `held` and every slice of `streamed`.

    held has a column block, streamed a column slice (whole numbers below blocks
    and slices); their other columns have different names. A block and a slice are
    a unit. It comes sorted to one task, the block first, of which build(table)
    makes an index (None: nothing to be found); the slice then streams past it
    batch by batch, in `order`. Each row is moved once for each block or slice of the other table.
    """
    unit = (F.col("block") * F.lit(slices) + F.col("slice")).cast("int").alias("unit")
    names = lambda df, own: [c for c in df.columns if c != own]
    left = held.withColumn("slice", each(slices)).select(unit, F.lit(0).alias("side"), *names(held, "block"))
    right = streamed.withColumn("block", each(blocks)).select(unit, F.lit(1).alias("side"), *names(streamed, "slice"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, index = None, [], None
        for b in batches:
            units, side = b.column("unit").to_numpy(), b.column("side").to_numpy()
            edges = np.append(np.flatnonzero(np.diff(2 * units.astype(np.int64) + side, prepend=-1)), len(units))
            for x, y in zip(edges, edges[1:]):
                if units[x] != now:
                    now, block, index = units[x], [], None
                part = b.slice(x, y - x)
                if side[x] == 0:
                    block.append(part)
                    continue
                if block:
                    index, block = build(pa.Table.from_batches(block).combine_chunks()), []
                if index is not None:
                    yield from found(index, part)

    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(blocks * slices, "unit").sortWithinPartitions("unit", "side", *order).mapInArrow(go, schema)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n numbers) of each row, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def tiles(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows, row x taking first[x] to first[x + 1], whose places begin in one stretch of `most`."""
    tile = first[:-1] // max(1, most)
    edges = np.append(np.flatnonzero(np.diff(tile, prepend=-1)), len(tile))
    return zip(edges, edges[1:])
