"""What several operators of this subpackage share: Arrow columns and words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: In every operator here a word is a longest run without ASCII white space, [^\x20\x09-\x0D]+;
#: bytes.split() without arguments splits at exactly these bytes.


#: Bytes of a batch that a task turns into Python objects at a time.
SMALL = 4 << 20


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SMALL bytes, one row at least; no batch stays empty."""
    for b in batches:
        step = max(1, int(b.num_rows * SMALL / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return pc.fill_null(column, "").to_pylist()


def utf8(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def rank_of(docs: DataFrame, *but: str) -> Column:
    """A hash of a row's columns but those named, to choose among rows alike in these; maps can't be hashed and are left out."""
    kept = [docs[c] for c, t in docs.dtypes if c not in but and "map<" not in t]
    return F.xxhash64(*kept) if kept else F.lit(0).cast("long")


def batch(names: str, *columns) -> pa.RecordBatch:
    """A record batch; names are divided by spaces."""
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def runs(keys: list) -> list[tuple[int, int]]:
    """(start, end) of each run of equal neighbours over several equally long numpy arrays."""
    import numpy as np

    n = len(keys[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), n]))
