"""Stories and their sources: assembly, ranking, editing, grounding, golden checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import scoring as S
from tessera.functions.identity import is_primary_source
from tessera.operators.ordering import numbered
from tessera.operators.log import latest
from tessera.operators.originators import corroborate


def clusters_of_claim(clusters: DataFrame, claim: str) -> DataFrame:
    """Clusters that hold a claim."""
    return clusters.where(F.array_contains("claim_ids", claim))


def member_claims(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, pos, claim columns): a cluster's claims in order; ids that no claim has are left out."""
    return clusters.select("id", F.posexplode("claim_ids").alias("pos", "claim_id")).join(claims, "claim_id")


def originator_group_sources(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, g, sources, collapsed): the distinct source names of each originator group; an unknown article stands for itself."""
    g = clusters.select("id", F.posexplode("originators").alias("g", "group")).select("id", "g", F.explode("group").alias("article_id"))
    named = g.join(articles.select(F.col("id").alias("article_id"), "source"), "article_id", "left").withColumn("name", F.coalesce(F.nullif("source", F.lit("")), F.col("article_id").cast("string")))
    s = named.groupBy("id", "g").agg(F.array_sort(F.collect_set("name")).alias("sources"))
    return s.withColumn("collapsed", F.size("sources") > 1)


def group_reputation(groups: DataFrame, reputation: DataFrame) -> DataFrame:
    """Mean reputation of a group's rated sources, null if none is."""
    r = groups.select("id", "g", F.explode("sources").alias("source")).join(reputation.select("source", "reputation"), "source", "left")
    return r.groupBy("id", "g").agg(F.avg("reputation").alias("reputation"))


def cluster_sources(clusters: DataFrame, claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Distinct sources of a cluster through its claims and its originators."""
    a = articles.select(F.col("id").alias("article_id"), "source")
    by_claim = clusters.select("id", F.explode("claim_ids").alias("claim_id")).join(claims.select("claim_id", "article_id"), "claim_id").select("id", "article_id")
    by_group = clusters.select("id", F.explode(F.flatten("originators")).alias("article_id"))
    return by_claim.union(by_group).join(a, "article_id").select("id", "source").distinct()


def longest_primary_body(members: DataFrame) -> DataFrame:
    """The longest body by a primary source in each cluster (cluster_id, article_id, source, body, pos); the first of ties."""
    p = members.where(is_primary_source("source") & (F.length(F.coalesce("body", F.lit(""))) > 0))
    return latest(p, ["cluster_id"], [F.desc(F.length("body")), F.col("pos")])


def superseded(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of clusters that are gone."""
    return before.select("id").join(after.select("id"), "id", "left_anti")


def regroup(members: DataFrame, moves: DataFrame, **weights) -> tuple[DataFrame, DataFrame]:
    """Split, merge or move: members (cluster_id, claim_id, article_id, source, body) with moves (claim_id, to_cluster).

    Gives the corroboration of every cluster that changed, and the ids of those
    left empty, to be removed.
    """
    m = members.join(moves, "claim_id", "left").withColumn("new", F.coalesce("to_cluster", "cluster_id"))
    changed = m.where("new <> cluster_id").select(F.explode(F.array("cluster_id", "new")).alias("new")).distinct()
    now = m.join(changed, "new", "left_semi").select(F.col("new").alias("cluster_id"), "article_id", "source", "body").dropDuplicates(["cluster_id", "article_id"])
    empty = changed.join(m.select("new").distinct(), "new", "left_anti").select(F.col("new").alias("cluster_id"))
    return corroborate(now, **weights), empty


def ground(clusters: DataFrame, verdicts: DataFrame, judged: DataFrame) -> DataFrame:
    """Confidence of clusters with a primary source not judged before, under the verdict on it (id, verdict)."""
    todo = clusters.where("has_primary").join(judged.select("id"), "id", "left_anti")
    c = S.confidence_read(F.col("independent_originators"), F.col("has_primary"), F.col("extremity"), F.col("verdict"))
    return todo.join(verdicts, "id").select("id", F.col("verdict").alias("grounding"), c.alias("confidence"))


def rank_stories(stories: DataFrame) -> DataFrame:
    """Forecasts last, then by score, then by last change, then by id; with the count of all."""
    total = stories.agg(F.count("*").alias("total"))
    return stories.crossJoin(F.broadcast(total)).orderBy("forecast_only", F.desc("score"), F.desc("last_updated"), "id")


def facts_and_forecasts(stories: DataFrame) -> DataFrame:
    """Split a node's clusters: (node_id, facts, forecasts) as ids in order of confidence."""
    ids = lambda forecast: F.transform(F.array_sort(F.collect_list(F.when(F.col("is_forecast") == forecast, F.struct(-F.col("confidence"), "id")))), lambda x: x["id"])
    return stories.groupBy("node_id").agg(ids(False).alias("facts"), ids(True).alias("forecasts"))


def english_gloss(clusters: DataFrame, claims: DataFrame, pivots: DataFrame) -> DataFrame:
    """(id, fact_en): the English pivot of the first claim whose text is the fact, if it differs."""
    m = member_claims(clusters.select("id", "claim_ids"), claims).join(clusters.select("id", "fact"), "id").where(F.trim("text") == F.trim("fact"))
    first = latest(m, ["id"], [F.col("pos")]).join(pivots.select("claim_id", "text_en"), "claim_id")
    return first.where(F.trim("text_en") != F.trim("fact")).select("id", F.col("text_en").alias("fact_en"))


def gate(rejected: Column, known_good: Column, verdict: Column) -> Column:
    """Whether a source is let in: never if rejected, always if known good, else by the verdict; no verdict lets in."""
    return ~F.coalesce(rejected, F.lit(False)) & (F.coalesce(known_good, F.lit(False)) | F.coalesce(verdict, F.lit(True)))


def locales_without_articles(locales: DataFrame, articles: DataFrame) -> DataFrame:
    """Locales that a pass brought nothing for, to be tried again."""
    return locales.join(articles.select("language").distinct(), "language", "left_anti")


def trajectory(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Daily snapshots if there are any, else the corroboration events."""
    none = F.broadcast(snapshots.limit(1).agg(F.count("*").alias("n")))
    return snapshots.unionByName(events.crossJoin(none).where("n = 0").drop("n"), allowMissingColumns=True)


def direct_owners(statements: Column) -> Column:
    """Distinct entity ids of two statement lists joined, in order; other ids go."""
    return F.array_distinct(F.filter(statements, lambda q: q.rlike("^Q[0-9]+$")))


def pick_entity(candidates: DataFrame) -> DataFrame:
    """Of each source's candidates (source, pos, qid, site) the first whose site is the source's, else the first."""
    from tessera.functions.identity import host_of

    return latest(candidates, ["source"], [F.desc(host_of("site") == host_of("source")), F.col("pos")])


def group_feedback(items: DataFrame) -> DataFrame:
    """Feedback by key: items in order and how many."""
    from tessera.functions.text import feedback_key

    g = items.withColumn("key", feedback_key(F.col("category"), F.col("text"))).groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return g.withColumn("n", F.size("items"))


def policy_step(tuned: DataFrame, reputation: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed decays and proposed source preferences, each within reach of what holds now."""
    want = F.coalesce("confirmation_rate", "independent_rate")
    p = reputation.join(current.select("source", F.col("preference").alias("now")), "source", "left").withColumn("now", F.coalesce("now", F.lit(0.5)))
    return tuned.where("tuned <> current"), p.select("source", "now", S.clamped_preference(F.col("now"), want).alias("proposed"))


def golden_checks(clusters: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expectation (name, match, independent, has_primary): the best sourced matching fact and whether it is as expected."""
    m = expected.join(clusters, F.lower(clusters["fact"]).contains(F.lower(expected["match"])), "left").select(expected["*"], clusters["fact"], clusters["independent_originators"], clusters["has_primary"].alias("got_primary"), F.size("sources").alias("n_sources"))
    best = latest(m, ["name"], [F.desc_nulls_last("n_sources"), F.col("fact")])
    return best.select("name", "fact", (F.col("fact").isNotNull() & (F.col("independent_originators") == F.col("independent")) & F.col("got_primary").eqNullSafe(F.col("has_primary"))).alias("passed"))


def reconcile_order(items: DataFrame, proposed: DataFrame) -> DataFrame:
    """A proposed order (id, at) made whole: known ids once, in that order, then the rest in theirs (pos, which tells items apart)."""
    p = proposed.groupBy("id").agg(F.min("at").alias("at"))
    j = items.join(p, "id", "left")
    return numbered(j.withColumns({"_rest": F.col("at").isNull(), "_at": F.coalesce("at", "pos")}), "_rest", "_at", "pos").drop("at", "_rest", "_at")


def summary(fact: Column, claims: Column) -> Column:
    """A fact and its first two claims that say something else."""
    return F.concat_ws(" ", F.array(fact), F.slice(F.filter(claims, lambda c: F.lower(F.trim(c)) != F.lower(F.trim(fact))), 1, 2))


def write_csv(df: DataFrame, folder: str) -> None:
    """A table as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(folder)
