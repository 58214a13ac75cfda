"""The reader's feed: claims and stories as rows, filters, order, trajectories, credibility."""

from __future__ import annotations

from collections import Counter, deque
from heapq import heappop, heappush
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions import scoring as S
from tessera.functions.identity import language_country, source_country
from tessera.functions.text import is_index_page, matches_terms, norm_fact


def build_claims(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims with their article's source, title, url and language ('en' if unknown)."""
    a = articles.select(F.col("id").alias("article_id"), "source", F.col("title").alias("article_title"), "url", F.col("language").alias("lang"))
    return claims.join(a, "article_id", "left").select(
        *[claims[c] for c in claims.columns if c != "article_id"], "article_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("article_title", F.lit("")).alias("article_title"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")).alias("language")
    )


def build_stories(clusters: DataFrame, claims: DataFrame) -> DataFrame:
    """Clusters with label, member claims in order (unknown ones skipped) and sorted languages."""
    member = clusters.select("id", F.posexplode("claim_ids").alias("pos", "claim_id")).join(claims, "claim_id")
    per = member.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim_id", "text"))), lambda x: F.struct(x["claim_id"].alias("claim_id"), x["text"].alias("text"))).alias("claims"),
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.min_by("url", F.when(F.col("url") != "", F.col("pos"))).alias("first_url"),
        (F.count_if(F.col("kind") == "projection") > F.count_if(F.col("kind") == "fact")).alias("is_forecast"),
        F.bool_or(F.coalesce("disputed", F.lit(False))).alias("disputed"),
    )
    label = S.confidence_label(F.col("confidence"), F.col("independent_originators"), F.col("has_primary"), F.col("extremity"))
    none = F.array().cast("array<string>")
    return clusters.join(per, "id", "left").select(clusters["*"], "claims", F.when(F.size(F.coalesce("languages", none)) > 0, F.col("languages")).otherwise(F.array(F.lit("en"))).alias("languages"), "first_url", F.coalesce("is_forecast", F.lit(False)).alias("is_forecast"), F.coalesce("disputed", F.lit(False)).alias("disputed"), label.alias("label"), S.confidence_tier(F.col("confidence")).alias("tier"))


def dominant_language(members: DataFrame) -> DataFrame:
    """Most common language of each cluster's claims (id, pos, language); the one seen first wins ties."""
    n = members.groupBy("id", "language").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return n.groupBy("id").agg(F.max_by("language", F.struct("n", -F.col("pos"))).alias("language"))


def without_sources(stories: DataFrame, names: DataFrame, sources: str = "sources") -> DataFrame:
    """Drop stories all of whose sources are named; stories without sources stay."""
    each = stories.select("id", F.explode(sources).alias("source")).join(names.select("source", F.lit(1).alias("hit")).distinct(), "source", "left")
    gone = each.groupBy("id").agg(F.bool_and(F.col("hit").isNotNull()).alias("gone")).where("gone").select("id")
    return stories.join(gone, "id", "left_anti")


def by_topics(stories: DataFrame, topics: list[list[str]], text: Column, min_hits: int = 1) -> DataFrame:
    """Stories that match any topic; no topics keeps all."""
    if not topics:
        return stories
    hit = F.lit(False)
    for terms in topics:
        hit = hit | matches_terms(text, F.array(*map(F.lit, terms)), min_hits)
    return stories.where(hit)


def index_page_clusters(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Clusters that have article titles and only those of index pages."""
    a = articles.select(F.col("id").alias("article_id"), is_index_page(F.col("title"), F.lit("")).alias("index"), "title")
    each = clusters.select("id", F.explode("article_ids").alias("article_id")).join(a, "article_id").where("title <> ''")
    return each.groupBy("id").agg(F.bool_and("index").alias("all_index")).where("all_index").select("id")


def story_country(clusters: DataFrame, articles: DataFrame, claim_languages: DataFrame) -> DataFrame:
    """First country by an originator's domain, else by a claim's language other than English, else ''."""
    o = clusters.select("id", F.posexplode("originators").alias("g", "group")).select("id", "g", F.posexplode("group").alias("i", "article_id"))
    o = o.join(articles.select(F.col("id").alias("article_id"), source_country("source").alias("c")), "article_id").where("c <> ''")
    place = o.groupBy("id").agg(F.min_by("c", F.struct("g", "i")).alias("by_source"))
    lang = claim_languages.withColumn("c", language_country("language")).where("c <> ''").groupBy("id").agg(F.min_by("c", "pos").alias("by_language"))
    return clusters.select("id").join(place, "id", "left").join(lang, "id", "left").select("id", F.coalesce("by_source", "by_language", F.lit("")).alias("country"))


def resolved_country(c: Column, override: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), override, F.lit(""))


def diversified(stories: DataFrame, by: str | None = None, country_cap: float = 0.25, source_cap: float = 0.20, band: float = 0.20) -> DataFrame:
    """Feed order (feed_rank) by confidence, varied by country and source.

    Each place goes to the first story within `band` of the best one left whose
    country and source are under their caps, else to the best one. The order is
    sequential within one feed, so a feed (all rows, or each value of `by`) is
    one group: a feed is what a reader is shown, not a corpus.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["confidence", "pos"], ascending=[False, True], kind="stable").reset_index(drop=True)
        n = len(left)
        caps = (max(1, ceil(n * country_cap - 1e-3)), max(1, ceil(n * source_cap - 1e-3)))
        conf, names = left["confidence"].tolist(), list(zip(left["country"].fillna(""), left["source"].fillna("")))
        used, rank = (Counter(), Counter()), [0] * n
        queues: dict[tuple, deque] = {}
        for row, key in enumerate(names):
            queues.setdefault(key, deque()).append(row)
        # heads of the queues by place; a name that has reached its cap never comes under it again
        free, full = sorted(q[0] for q in queues.values()), []
        for place in range(1, n + 1):
            while free and any(v and u[v] >= cap for v, u, cap in zip(names[free[0]], used, caps)):
                heappush(full, heappop(free))
            best = min(free[:1] + full[:1])
            floor = conf[best] - band
            heads = free if free and (free[0] == best or conf[free[0]] >= floor or floor != floor) else full
            row = heappop(heads)
            rank[row] = place
            queue = queues[names[row]]
            queue.popleft()
            if queue:
                heappush(heads, queue[0])
            for v, u in zip(names[row], used):
                u[v] += 1
        return left.assign(feed_rank=rank)

    schema = T.StructType([*stories.schema.fields, T.StructField("feed_rank", T.IntegerType())])
    return stories.groupBy(*([by] if by else [])).applyInPandas(order, schema)


def novel_first(stories: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Stories (id, pos) with novelty for one reader's views (id, seen_at in seconds); novel ones first."""
    last = seen.groupBy("id").agg(F.max("seen_at").alias("seen_at"))
    return stories.join(last, "id", "left").withColumn("novelty", S.novelty(F.col("seen_at"), now)).orderBy(F.desc("novelty"), "pos")


def tenant_view(stories: DataFrame, state: DataFrame) -> DataFrame:
    """One tenant's order: pinned, others, hidden; state has (id, mark)."""
    mark = state.groupBy("id").agg(F.bool_or(F.col("mark") == "pinned").alias("pinned"), F.bool_or(F.col("mark") == "hidden").alias("hidden"))
    v = stories.join(mark, "id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False))).withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    return v.withColumn("section", F.when(F.col("hidden"), 2).when(F.col("pinned"), 0).otherwise(1)).orderBy("section", "pos")


def visible(view: DataFrame, include_hidden: bool = False) -> DataFrame:
    return view if include_hidden else view.where("not hidden")


def page(df: DataFrame, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of an ordered result; limit within 1..most, offset not negative."""
    return df.offset(max(0, offset)).limit(max(1, min(most, limit)))


def annotate_accuracy(stories: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return stories.withColumn("key", norm_fact("fact")).join(lifecycle.select("key", "state"), "key", "left").drop("key")


def as_of(snapshots: DataFrame, key: str, day: str) -> DataFrame:
    """Per day of the table and key: the key's latest row on or before the day.

    Days and keys make a dense grid, joined to the rows of that very day; the
    last value carried forward fills the rest, so no range join is needed.
    """
    cols = [c for c in snapshots.columns if c not in (key, day)]
    days = snapshots.select(F.col(day).alias("day")).distinct()
    grid = snapshots.groupBy(key).agg(F.min(day).alias("from")).join(F.broadcast(days), F.col("day") >= F.col("from")).select(key, "day")
    one = snapshots.groupBy(key, F.col(day).alias("day")).agg(F.max(F.struct(*cols)).alias("row"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(one, [key, "day"], "left").withColumn("row", F.last("row", ignorenulls=True).over(w)).select(key, "day", "row.*")


def effective_originators(facts: DataFrame, reputation: DataFrame) -> DataFrame:
    """Per cluster (id, originator_sources array<array>): reputation-weighted count and rated groups."""
    g = facts.select("id", F.posexplode("originator_sources").alias("g", "group")).select("id", "g", F.explode_outer("group").alias("source"))
    per = g.join(reputation.select("source", F.col("reputation").alias("r")), "source", "left").groupBy("id", "g").agg(F.avg("r").alias("r"))
    return per.groupBy("id").agg(F.sum(S.group_weight(F.col("r"))).alias("effective"), F.count("r").alias("rated"))


def credibility(facts: DataFrame, reputation: DataFrame) -> DataFrame:
    """Score 0 to 100, band and reasons of each story.

    facts: (story_id, id, pos, confidence, independent_originators, has_primary,
    extremity, originator_sources, grounding, disputed), forecasts left out.
    """
    f = facts.join(effective_originators(facts, reputation), "id", "left").withColumn("effective", F.coalesce("effective", F.lit(0.0))).withColumn("rated", F.coalesce("rated", F.lit(0)))
    head = F.max_by(F.struct("id", "effective", "rated", "independent_originators", "has_primary", "extremity", "grounding", "confidence"), F.struct("independent_originators", -F.col("pos"))).alias("h")
    s = f.groupBy("story_id").agg(
        head, F.count_if(F.col("confidence") >= S.STRONG_SUPPORT).alias("strong_all"), F.max("rated").alias("any_rated"), F.bool_or(F.coalesce("disputed", F.lit(False))).alias("disputed")
    )
    base = S.confidence_read(F.col("h.effective"), F.col("h.has_primary"), F.col("h.extremity"), F.col("h.grounding"))
    s = s.withColumn("strong", F.col("strong_all") - (F.col("h.confidence") >= S.STRONG_SUPPORT).cast("int")).withColumn("b0", base)
    s = s.withColumn("b1", F.when(F.col("strong") > 0, F.least(F.lit(0.99), F.col("b0") + F.least(S.SUPPORT_BONUS * F.col("strong"), F.lit(S.SUPPORT_CAP)))).otherwise(F.col("b0")))
    s = s.withColumn("capped", (F.col("any_rated") == 0) & (F.col("b1") > S.COLD_START_CAP)).withColumn("b2", F.when(F.col("capped"), S.COLD_START_CAP).otherwise(F.col("b1")))
    bad = F.col("disputed") | (F.coalesce(F.col("h.grounding"), F.lit("")) == "contradicted")
    s = s.withColumn("score", F.round(S.clamp(F.when(bad, F.col("b2") - S.DISPUTED_PENALTY).otherwise(F.col("b2"))) * 100).cast("int"))
    n = F.col("h.independent_originators")
    why = F.array_compact(
        F.array(
            F.when(bad, "a core claim is disputed by a stronger contradicting claim"),
            F.concat(n.cast("string"), F.lit(" independent originator"), F.when(n != 1, "s").otherwise(""), F.when(F.col("h.rated") > 0, F.concat(F.lit(", "), F.col("h.rated").cast("string"), F.lit(" with a track record"))).otherwise("")),
            F.when(F.col("strong") > 0, F.concat(F.col("strong").cast("string"), F.lit(" corroborating fact"), F.when(F.col("strong") != 1, "s").otherwise(""), F.lit(" in the story"))),
            F.when(F.col("h.has_primary") & (F.col("h.grounding") == "supported"), "backed by a primary source"),
            F.when(F.col("h.extremity").isin(*S.BIG), F.concat(F.col("h.extremity"), F.lit(" claim — bar raised"))),
            F.when(F.col("capped"), "carriers not yet proven — capped"),
        )
    )
    return s.select("story_id", "score", F.when(bad, "disputed").otherwise(S.score_band(F.col("score"))).alias("band"), why.alias("why"), "capped")


def threads(stories: DataFrame, node_of: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that hold at least two stories, with them in feed order and the node's outgoing edges."""
    t = stories.select("id", "pos").join(node_of, "id").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s")).where(F.size("s") >= 2)
    out = edges.groupBy(F.col("from_id").alias("node_id")).agg(F.array_sort(F.collect_set(F.struct("kind", "to_id"))).alias("edges"))
    return t.join(out, "node_id", "left").select("node_id", F.transform("s", lambda x: x["id"]).alias("story_ids"), "edges")


def contradictions(near: DataFrame, scores: DataFrame, clusters: DataFrame, least: float = 0.7) -> DataFrame:
    """Claims to dispute: contradicting near pairs of different clusters, the loser by grounding, then confidence.

    scores: (a, b, label, p) for ordered pairs; clusters: (claim_id, cluster_id, grounding, confidence).
    """
    both = scores.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label", "p").join(near.select("a", "b"), ["a", "b"])
    top = both.groupBy("a", "b").agg(F.max_by(F.struct("label", "p"), F.struct("p", "label")).alias("s")).where((F.col("s.label") == "contradiction") & (F.col("s.p") >= least))
    side = lambda k: clusters.select(F.col("claim_id").alias(k), F.col("cluster_id").alias(f"c_{k}"), F.col("grounding").alias(f"g_{k}"), F.col("confidence").alias(f"f_{k}"))
    j = top.join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b")
    loser = S.arbitrate(F.col("g_a"), F.col("f_a"), F.col("g_b"), F.col("f_b"))
    return j.select("a", "b", "s.p", F.when(loser == "a", F.col("a")).when(loser == "b", F.col("b")).alias("disputed_claim"))
