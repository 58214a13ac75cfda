"""Digests of tables that do not depend on the order of rows, to tell whether two tables hold the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def row_text(columns: list[str]) -> Column:
    """A row as text in which no two different rows are alike: each value with its length, N for null."""
    each = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in sorted(columns)]
    return F.concat_ws(",", *each)


def table_digests(tables: dict[str, DataFrame], tenant: str = "tenant_id") -> DataFrame:
    """(table, tenant, n, a, b) of each table and tenant: rows and two sums of 60-bit hashes of them; the tenant itself is not hashed.

    Sums do not depend on order and count repeated rows, are made where the rows
    are and merged by tenant. Different tables agree in both by chance once in
    2**120. Columns count by name; values as their text. A null tenant is ''.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        h = F.md5(row_text([c for c in df.columns if c != tenant]))
        part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
        return df.groupBy(F.coalesce(F.col(tenant).cast("string"), F.lit("")).alias("tenant")).agg(F.count("*").alias("n"), part(1).alias("a"), part(17).alias("b")).select(F.lit(name).alias("table"), "tenant", "n", "a", "b")

    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


def differing(digests: DataFrame, one: str, other: str) -> DataFrame:
    """(table, same): whether two tenants hold the same rows of each table; a table that only one of them has differs."""
    same = lambda c: F.max(F.when(F.col("tenant") == one, F.col(c))).eqNullSafe(F.max(F.when(F.col("tenant") == other, F.col(c))))
    return digests.where(F.col("tenant").isin(one, other)).groupBy("table").agg((same("n") & same("a") & same("b")).alias("same"))
