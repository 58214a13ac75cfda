"""What to fetch next, within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.scoring import FLOOR_WEIGHT


def rank_for_fetch(candidates: DataFrame, weights: DataFrame, budget: int, query: list[str] | None = None) -> DataFrame:
    """Candidates (source, pos) in fetch order: rounds over the sources by weight, arrival order within one.

    Every round takes at most one of each source, so the order is (number within
    its source, weight of the source, name).
    """
    query = query or []
    c = candidates.join(weights.select("source", F.col("weight").alias("w")), "source", "left").withColumn("w", F.coalesce("w", F.lit(FLOOR_WEIGHT)))
    c = c.withColumn("k", F.row_number().over(Window.partitionBy(*query, "source").orderBy("pos"))).where(F.col("k") <= budget)
    order = Window.partitionBy(*query).orderBy("k", F.desc("w"), "source")
    return c.withColumn("fetch_rank", F.row_number().over(order)).where(F.col("fetch_rank") <= budget).drop("k", "w")


def deepening_plan(prefs: DataFrame, topics: list[str], top_n: int = 3, most: int = 6) -> DataFrame:
    """(nth, source, query): top proven sources taken in turn over the topics."""
    topics = [t for t in topics if t and t.strip()]
    top = prefs.where("not low_evidence and not solo_flag").orderBy("rank").limit(top_n).withColumn("at", F.row_number().over(Window.orderBy("rank")))
    if not topics:
        return top.select(F.lit(1).alias("nth"), "source", F.lit("").alias("query")).limit(0)
    rounds = top.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(min(most, len(topics)) - 1))))
    named = rounds.withColumn("topic", F.element_at(F.array(*map(F.lit, topics)), F.col("r") + 1))
    distinct = named.groupBy("source", "topic").agg(F.min(F.struct("r", "at")).alias("o"))
    return distinct.withColumn("nth", F.row_number().over(Window.orderBy("o"))).where(F.col("nth") <= most).select("nth", "source", F.concat("topic", F.lit(" domain:"), "source").alias("query"))


def source_history(channels: list[DataFrame], depth: int = 100) -> DataFrame:
    """Articles of several channels in order of trust: the first of each url, at most depth per source."""
    rows = [c.withColumn("channel", F.lit(i)) for i, c in enumerate(channels)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    first = every.withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("channel", "pos"))).where("nth = 1")
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("channel", "pos"))).where(F.col("nth") <= depth).drop("nth")


def ingest(candidates: DataFrame, articles: DataFrame, denied: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Outcome of each candidate (url, source, title, body, pos): the first reason that applies, else published."""
    from tessera.functions.identity import host_of, is_hard_rejected

    c = candidates.withColumn("domain", host_of("source")).withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("pos")))
    c = c.join(articles.select("url", F.lit(True).alias("known")).distinct(), "url", "left").join(denied.select(F.col("source").alias("domain"), F.lit(True).alias("deny")).distinct(), "domain", "left")
    c = c.join(verdicts.select("domain", "accept"), "domain", "left") if verdicts is not None else c.withColumn("accept", F.lit(True))
    has = lambda x: F.coalesce(F.col(x), F.lit(False))
    outcome = (
        F.when((F.col("nth") > 1) | has("known"), "duplicate").when(has("deny"), "denied").when(is_hard_rejected("domain"), "rejected").when(~F.coalesce("accept", F.lit(True)), "rejected").when(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0, "empty").otherwise("published")
    )
    return c.withColumn("outcome", outcome).drop("nth", "known", "deny", "accept")
