"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys that are joined by broadcast instead of by shuffle; a key beyond them has at most one in TOP of the rows.
TOP = 256


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str = "n", top: int = TOP) -> DataFrame:
    """rows joined to per_key, which has one row a key and the number of rows of the key in column n.

    The `top` keys with the most rows (read by the driver, `top` rows at any size)
    are joined by broadcast, so their rows stay where they are; all other rows are
    shuffled, and none of their keys has more than one in `top` of all rows.
    Both inputs are read twice: cut them if they are costly. Null keys join nothing.
    """
    most = per_key.orderBy(F.desc(n), *keys).limit(top).collect()
    if not most:
        return rows.join(per_key, keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(most, per_key.schema))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(per_key, keys))
