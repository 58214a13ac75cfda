"""Ids made from content: the same content has the same id in every run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _head(payload: Column, n: int) -> Column:
    return F.substring(F.sha1(payload), 1, n)


def text_fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def article_id(url: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "-"), _head(url, 18))


def cluster_id(claim_ids: Column) -> Column:
    """Order of the claims does not matter."""
    return _head(F.array_join(F.array_sort(claim_ids), "|"), 24)


def node_id(spine: Column, cluster: Column) -> Column:
    return F.concat(F.lit("node:"), _head(F.concat(F.array_join(F.array_sort(spine), "|"), F.lit(":"), cluster), 16))


def relation_id(a: Column, b: Column, relation: Column) -> Column:
    """Order of the pair does not matter."""
    return F.concat(F.lit("rel-"), _head(F.concat_ws("|", F.least(a, b), F.greatest(a, b), relation), 20))


def snapshot_id(cluster: Column, day: Column) -> Column:
    return F.concat(F.lit("snap-"), _head(F.concat_ws(":", cluster, day), 18))


def backfill_run_id(source: Column, stamp: Column) -> Column:
    return F.concat(F.lit("bf-"), _head(F.concat_ws("|", source, stamp), 16))


def issue_key(category: Column, base: Column) -> Column:
    return F.concat(category, F.lit("::"), _head(base, 12))
