"""What readers and operators are shown: lookups, payloads, one story's page, grids and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.identity import is_primary_source
from tessera.operators.feed import as_of, credibility
from tessera.operators.ordering import numbered
from tessera.operators.folds import _events, last_of
from tessera.operators.log import latest


def corrected_clusters(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """Ids of the clusters with a corrected member claim."""
    bad = claims.where("corrected").select("claim_id")
    return clusters.select("id", F.explode("claim_ids").alias("claim_id")).join(bad, "claim_id", "left_semi").select("id").distinct()


def triaged_feedback(log: DataFrame) -> DataFrame:
    """The latest triage of each item with what was submitted, if it is known."""
    t = _events(log, "feedback.triaged", "item_id string, category string, route string, confidence double")
    t = t.groupBy(F.col("d.item_id").alias("item_id")).agg(F.max_by(F.struct("d.category", "d.route", "d.confidence"), "id").alias("t")).select("item_id", "t.*")
    s = _events(log, "feedback.submitted", "item_id string, text string").groupBy(F.coalesce("d.item_id", "stream_id").alias("item_id")).agg(last_of("d.text").alias("text"))
    return t.join(s, "item_id", "left")


def nodes_of_claim(links: DataFrame, claim: str) -> DataFrame:
    """Nodes of the story graph that a claim is linked to; links has (claim_id, node_id)."""
    return links.where(F.col("claim_id") == claim).select("node_id").distinct()


def claims_of_node(links: DataFrame, node: str) -> DataFrame:
    return links.where(F.col("node_id") == node).select("claim_id").distinct()


def visitor_paths(signals: DataFrame) -> DataFrame:
    """Per visitor: views before the first click, the first click, whether they asked to be told."""
    s = signals.where(F.col("visitor_id").isNotNull())
    click = s.where("kind = 'click'").groupBy("visitor_id").agg(F.min("id").alias("first_click"))
    return s.join(click, "visitor_id", "left").groupBy("visitor_id").agg(
        F.count_if((F.col("kind") == "view") & (F.col("first_click").isNull() | (F.col("id") < F.col("first_click")))).alias("views_before"),
        F.max("first_click").alias("first_click"),
        F.bool_or(F.col("kind") == "notify").alias("notified"),
    )


def _group_articles(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, g, i, article columns): the articles of each originator group in order."""
    g = clusters.select("id", F.posexplode("originators").alias("g", "group")).select("id", "g", F.posexplode("group").alias("i", "article_id"))
    return g.join(articles.withColumnRenamed("id", "article_id"), "article_id")


def first_source(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, source): the first named source in originator order, else the first of the cluster's own list."""
    named = _group_articles(clusters, articles).where("source <> ''").groupBy("id").agg(F.min_by("source", F.struct("g", "i")).alias("by_group"))
    return clusters.select("id", F.get("sources", 0).alias("own")).join(named, "id", "left").select("id", F.coalesce("by_group", "own", F.lit("")).alias("source"))


def hero_article(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, article_id): the first article in originator order that has an image."""
    return _group_articles(clusters, articles).where("image_url <> ''").groupBy("id").agg(F.min_by("article_id", F.struct("g", "i")).alias("article_id"))


def provenance(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, g, sources, languages, is_primary): what stands behind each originator group."""
    return _group_articles(clusters, articles).groupBy("id", "g").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("language")).alias("languages"), F.bool_or(is_primary_source("source")).alias("is_primary")
    )


def sources_by_language(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    return _group_articles(clusters, articles).groupBy("id", "language").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def article_ids(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, article_ids): those of the claims in order, then those of the originators, each once."""
    by_claim = clusters.select("id", F.posexplode("claim_ids").alias("i", "claim_id")).join(claims.select("claim_id", "article_id"), "claim_id").select("id", F.lit(0).alias("part"), "i", "article_id")
    by_group = clusters.select("id", F.posexplode(F.flatten("originators")).alias("i", "article_id")).select("id", F.lit(1).alias("part"), "i", "article_id")
    each = by_claim.union(by_group).groupBy("id", "article_id").agg(F.min(F.struct("part", "i")).alias("at"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "article_id"))), lambda x: x["article_id"]).alias("article_ids"))


def fact_json(fact: Column, confidence: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(fact.alias("fact"), F.round(confidence, 4).alias("confidence"), *[c.alias(k) for k, c in fields.items()]))


def story_json(stories: DataFrame, full: bool = False) -> DataFrame:
    """(id, json): a story for lists, or with its claims and languages (full)."""
    short = [F.col("id"), F.col("fact"), F.round("confidence", 4).alias("confidence"), F.col("label"), F.col("tier")]
    return stories.select("id", F.to_json(F.struct(*short, *([F.col("languages"), F.col("claims")] if full else []))).alias("json"))


def preference_json(preferences: DataFrame) -> DataFrame:
    """(source, json) of ranked acquisition weights."""
    return preferences.select("source", F.to_json(F.struct("source", "weight", "low_evidence")).alias("json"))


def rated_sources(reputation: DataFrame) -> DataFrame:
    """(source, reputation) of sources with a settled fact: a map to join."""
    return reputation.where(F.col("confirmation_rate").isNotNull()).select("source", F.col("score").alias("reputation"))


def preference_from_reputation(confirmation: Column, independent: Column) -> Column:
    return F.coalesce(confirmation, independent)


def graph_json(nodes: DataFrame, active_since: float | None = None) -> DataFrame:
    """(id, json) of nodes; a centroid is given only while its node is active (last_updated at or past active_since)."""
    centroid = F.col("centroid") if active_since is None else F.when(F.col("last_updated") >= active_since, F.col("centroid"))
    return nodes.select("id", F.to_json(F.struct("id", "headline", "entity_spine", "first_seen", "last_updated", "cluster_count", centroid.alias("centroid"))).alias("json"))


def credibility_by_day(snapshots: DataFrame, members: DataFrame, reputation: DataFrame) -> DataFrame:
    """(story_id, day, score, band): each story scored anew on every day from the then latest snapshots of its clusters.

    snapshots: (id, day, fact columns of feed.credibility); members: (story_id, id, pos).
    """
    rows = as_of(snapshots, "id", "day").join(members, "id")
    key = F.to_json(F.struct("story_id", "day"))
    facts = rows.withColumn("story", key).withColumn("id", F.concat_ws("@", F.col("id").cast("string"), F.col("day").cast("string")))
    scores = credibility(facts.drop("story_id", "day").withColumnRenamed("story", "story_id"), reputation)
    of = F.from_json("story_id", rows.select("story_id", "day").schema)
    return scores.select(of["story_id"].alias("story_id"), of["day"].alias("day"), "score", "band")


def story_members(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(story_id, id, pos): clusters by node; a cluster in no node is a story of its own, `cluster:` and its id. nodes has (node_id, id, pos)."""
    alone = clusters.select("id").join(nodes.select("id"), "id", "left_anti").select(F.concat(F.lit("cluster:"), F.col("id").cast("string")).alias("story_id"), "id", F.lit(0).alias("pos"))
    return nodes.select(F.col("node_id").alias("story_id"), "id", "pos").unionByName(alone)


def story_detail(story: str, nodes: DataFrame, clusters: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One story: its clusters in order, and their state on each day (as of)."""
    own = story_members(nodes, clusters).where(F.col("story_id") == story)
    return own.join(clusters, "id").orderBy("pos"), as_of(snapshots.join(own.select("id"), "id", "left_semi"), "id", "day")


def steering_summary(preferences: DataFrame, deepened: DataFrame, top: int = 10) -> DataFrame:
    """The top sources by weight with how many articles deepening has brought of each."""
    n = deepened.groupBy("source").agg(F.count("*").alias("deepened"))
    best = preferences.orderBy(F.desc("weight"), "source").limit(top)
    return best.join(n, "source", "left").select("source", "weight", "low_evidence", F.coalesce("deepened", F.lit(0)).alias("deepened"))


def derivation(n: Column, primary: Column, level: Column, confidence: Column) -> Column:
    """How a confidence came about, in words."""
    return F.format_string(
        "%s independent originator%s%s; %s claim; confidence %s%%",
        n.cast("string"), F.when(n == 1, "").otherwise("s"), F.when(primary, ", with a primary source").otherwise(""), level, F.round(confidence * 100).cast("int").cast("string"),
    )


def issue_payloads(items: DataFrame) -> DataFrame:
    """(key, title, body) of each group of feedback (key, category, item_id, text): the first text as title, all as a list."""
    g = items.groupBy("key").agg(F.min_by("category", "item_id").alias("category"), F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("all"))
    line = F.transform("all", lambda x: F.concat(F.lit("- "), x["text"], F.lit(" ("), x["item_id"], F.lit(")")))
    title = F.concat(F.lit("["), "category", F.lit("] "), F.substring(F.get("all", 0)["text"], 1, 80))
    return g.select("key", title.alias("title"), F.array_join(line, "\n").alias("body"))


def unplaced_clusters(countries: DataFrame, judged: DataFrame) -> DataFrame:
    """Clusters (id, country) that no rule could place and nobody has judged yet."""
    return countries.where("country = ''").select("id").join(judged.select("id"), "id", "left_anti")


def tenant_state(log: DataFrame, tenant: str) -> DataFrame:
    """A tenant's latest mark of each story; `clear` takes it back."""
    e = _events(log.where(F.col("tenant_id") == tenant), "tenant.story.marked", "id string, mark string")
    return e.groupBy(F.col("d.id").alias("id")).agg(last_of("d.mark").alias("mark")).where("mark <> 'clear'")


def events_of_types(log: DataFrame, types: list[str]) -> DataFrame:
    return log.where(F.col("type").isin(types)).orderBy("id")


def curation_stories(payloads: DataFrame, column: str = "data") -> DataFrame:
    """Stories of curation requests; the country is the first two letters, in capitals."""
    s = payloads.select(F.explode(F.from_json(column, "stories array<struct<id:string,confidence:double,country:string,source:string,language:string>>")["stories"]).alias("s")).select("s.*")
    return s.withColumn("country", F.upper(F.substring(F.coalesce("country", F.lit("")), 1, 2)))


def consumer_lag(log: DataFrame, acks: DataFrame, stages: dict[str, str]) -> DataFrame:
    """(stage, lag): events of a stage's type past the last one that it has acknowledged; acks has (stage, id)."""
    wanted = log.sparkSession.createDataFrame(list(stages.items()), "stage string, type string")
    done = acks.groupBy("stage").agg(F.max("id").alias("acked"))
    e = log.select("type", "id").join(F.broadcast(wanted.join(done, "stage", "left")), "type")
    n = e.groupBy("stage").agg(F.count_if(F.col("acked").isNull() | (F.col("id") > F.col("acked"))).alias("lag"))
    return wanted.select("stage").join(n, "stage", "left").select("stage", F.coalesce("lag", F.lit(0)).alias("lag"))


def feedback_bursts(items: DataFrame, at_least: int = 5) -> DataFrame:
    """Feedback per source (source): so many from one may be concerted."""
    return items.groupBy("source").agg(F.count("*").alias("n")).withColumn("suspicious", F.col("n") >= at_least)


def eval_metrics(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """(what, value, n, mean): claims by kind, clusters by label with their mean confidence."""
    a = claims.groupBy(F.coalesce("kind", F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("mean"))
    b = clusters.groupBy(F.col("label").alias("value")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("mean"))
    return a.select(F.lit("kind").alias("what"), "*").unionByName(b.select(F.lit("label").alias("what"), "*"))


def effective_by_weight(members: DataFrame) -> DataFrame:
    """(id, effective): the sum over originator groups (id, g, weight) of the largest attribution weight; a group without one counts 0.3."""
    best = members.groupBy("id", "g").agg(F.coalesce(F.max("weight"), F.lit(0.3)).alias("w"))
    return best.groupBy("id").agg(F.round(F.sum("w"), 2).alias("effective"))


def source_list(reputation: DataFrame, registry: DataFrame, flags: DataFrame, counts: DataFrame) -> DataFrame:
    """All sources that are rated or registered, with status, flag and number of articles; unrated ones stand at a neutral 0.5."""
    s = reputation.select("source", "score").join(registry.select("source", F.col("status").alias("registered")), "source", "full_outer")
    s = s.join(flags.select("source", F.col("status").alias("flag")), "source", "left").join(counts.select("source", "articles"), "source", "left")
    return s.select("source", F.coalesce("score", F.lit(0.5)).alias("reputation"), F.col("score").isNotNull().alias("rated"), F.coalesce("registered", F.lit("")).alias("status"), F.coalesce("flag", F.lit("")).alias("flag"), F.coalesce("articles", F.lit(0)).alias("articles"))


def ratings_order(sources: DataFrame) -> DataFrame:
    """Place of each source (source, reputation, rated): unrated ones last, then by reputation and name."""
    return numbered(sources, F.desc("rated"), F.desc("reputation"), "source")


def originations(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """(source, originations): originator groups whose first article is a source's."""
    first = latest(_group_articles(clusters, articles), ["id", "g"], [F.col("i")])
    return first.groupBy("source").agg(F.count("*").alias("originations"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): the values that a grid's filters offer."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(each.alias("f")).groupBy("f.column", "f.value").agg(F.count("*").alias("n"))


def grid(rows: DataFrame, search: str = "", filters: dict[str, list] | None = None, sort: list[Column] = (), page: int = 0, size: int = 50) -> DataFrame:
    """One page of a table: rows in which any column holds the search text, all filters (any of their values) hold, in order."""
    out = rows
    if search:
        hay = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in rows.columns]))
        out = out.where(hay.contains(search.lower()))
    for column, values in (filters or {}).items():
        out = out.where(F.col(column).isin(values))
    return (out.orderBy(*sort) if sort else out).offset(page * size).limit(size)
