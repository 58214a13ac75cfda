"""Folds of the event log into tables, each a plain aggregate in log order.

"Latest" and "first" are by event id. A fold reads only the columns it needs and
groups once by the table's key, so it is one shuffle with map-side combine where
values have a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.log import latest
from tessera.operators.skew import join_per_key


def _events(log: DataFrame, kind: str, schema: str) -> DataFrame:
    return log.where(F.col("type") == kind).withColumn("d", F.from_json("data", schema))


def last_of(c: Column | str, where: Column | None = None) -> Column:
    """Value at the largest id (where the condition holds); the value may be null."""
    c = F.col(c) if isinstance(c, str) else c
    if where is None:
        return F.max_by(F.struct(c.alias("v")), "id")["v"]
    return F.max_by(F.when(where, F.struct(c.alias("v"))), F.when(where, F.col("id")))["v"]


def first_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.min_by(F.struct(c.alias("v")), "id")["v"]


def last_set(c: Column | str) -> Column:
    """Latest value that is not null: a chain of coalesce(new, old)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(c, F.when(c.isNotNull(), F.col("id")))


def articles(log: DataFrame) -> DataFrame:
    """article.ingested: title, body and image are replaced, all else stays from the first event."""
    e = _events(log, "article.ingested", "source string, title string, url string, language string, body string, image_url string")
    return e.groupBy(F.col("stream_id").alias("id")).agg(
        first_of("tenant_id").alias("tenant_id"),
        last_of("d.title").alias("title"),
        first_of("d.source").alias("source"),
        first_of("d.url").alias("url"),
        first_of("d.language").alias("language"),
        last_of("d.body").alias("body"),
        last_of("d.image_url").alias("image_url"),
        F.min("created_at").alias("ingested_at"),
    )


_CLAIM = (
    "article_id string, claims array<struct<id:string,text:string,voice:string,speaker:string,relay_chain:array<string>,in_headline:boolean,"
    "evidence_span:string,kind:string,is_synthesis:boolean,horizon:string>>"
)


def extracted_claims(log: DataFrame) -> DataFrame:
    """claims.extracted: one row per claim, the first event of a claim wins."""
    e = _events(log, "claims.extracted", _CLAIM).select("id", "created_at", F.coalesce("d.article_id", "stream_id").alias("article_id"), F.posexplode("d.claims").alias("pos", "c"))
    e = e.select(F.col("c.id").alias("claim_id"), "article_id", F.col("id").alias("event_id"), "pos", "created_at", *[F.col(f"c.{x}") for x in "text voice speaker relay_chain in_headline evidence_span kind is_synthesis horizon".split()])
    return latest(e.where("claim_id is not null"), ["claim_id"], [F.col("event_id"), F.col("pos")]).drop("pos")


def claims(log: DataFrame) -> DataFrame:
    """Claims with classification (not after a correction), corrections, laundering flags and disputes."""
    base = extracted_claims(log)
    fix = _events(log, "admin.classification.corrected", "target string, kind string, voice string, speaker string").select(F.col("d.target").alias("claim_id"), "id", F.lit("fix").alias("what"), "d.kind", "d.voice", "d.speaker", F.lit(None).cast("boolean").alias("flag"))
    flag = _events(log, "admin.laundering.flagged", "target string, flagged boolean").select(F.col("d.target").alias("claim_id"), "id", F.lit("flag").alias("what"), *[F.lit(None).cast("string").alias(x) for x in ("kind", "voice", "speaker")], F.col("d.flagged").alias("flag"))
    dispute = _events(log, "claim.disputed", "claim_id string").select(F.coalesce("d.claim_id", "stream_id").alias("claim_id"), "id", F.lit("dispute").alias("what"), *[F.lit(None).cast("string").alias(x) for x in ("kind", "voice", "speaker")], F.lit(None).cast("boolean").alias("flag"))
    sorts = _events(log, "claims.classified", "claims array<struct<id:string,kind:string,is_synthesis:boolean,horizon:string>>").select("id", F.explode("d.claims").alias("c"))
    sorts = sorts.select(F.col("c.id").alias("claim_id"), "id", "c.kind", "c.is_synthesis", "c.horizon")
    acts = fix.unionByName(flag).unionByName(dispute).join(base.select("claim_id", "event_id"), "claim_id").where("id > event_id")
    acted = acts.groupBy("claim_id").agg(
        F.min(F.when(F.col("what") != "dispute", F.col("id"))).alias("corrected_id"),
        last_set(F.when(F.col("what") == "fix", F.col("kind"))).alias("kind_fix"),
        last_set(F.when(F.col("what") == "fix", F.col("voice"))).alias("voice_fix"),
        last_set(F.when(F.col("what") == "fix", F.col("speaker"))).alias("speaker_fix"),
        last_of("flag", F.col("what") == "flag").alias("laundering_flag"),
        F.bool_or(F.col("what") == "dispute").alias("disputed"),
    )
    known = base.join(acted, "claim_id", "left")
    kinds = (
        sorts.join(known.select("claim_id", "event_id", "corrected_id"), "claim_id")
        .where((F.col("id") > F.col("event_id")) & (F.col("corrected_id").isNull() | (F.col("id") < F.col("corrected_id"))))
        .groupBy("claim_id")
        .agg(F.max_by(F.struct("kind", "is_synthesis", "horizon"), "id").alias("s"))
    )
    return known.join(kinds, "claim_id", "left").select(
        "claim_id", "article_id", "text",
        F.coalesce("voice_fix", "voice").alias("voice"),
        F.coalesce("speaker_fix", "speaker").alias("speaker"),
        "relay_chain", "in_headline", "evidence_span",
        F.coalesce("kind_fix", F.when(F.col("s").isNotNull(), F.col("s.kind")).otherwise(F.col("kind"))).alias("kind"),
        F.when(F.col("s").isNotNull(), F.col("s.is_synthesis")).otherwise(F.col("is_synthesis")).alias("is_synthesis"),
        F.when(F.col("s").isNotNull(), F.col("s.horizon")).otherwise(F.col("horizon")).alias("horizon"),
        F.col("corrected_id").isNotNull().alias("corrected"),
        F.coalesce("laundering_flag", F.lit(False)).alias("laundering_flag"),
        F.coalesce("disputed", F.lit(False)).alias("disputed"),
        "created_at",
    )


_CLUSTER = (
    "fact string, sources array<string>, originators array<array<string>>, independent_originators int, has_primary boolean, claim_ids array<string>, "
    "confidence double, extremity string, grounding string, verdict string, harvested_at string, corrected boolean"
)


def clusters(log: DataFrame) -> DataFrame:
    """cluster.corroborated, cluster.grounded and cluster.removed: the state of each cluster that lives.

    A removal ends a life; grounding outlasts a later corroboration, but the
    confidence is that of the later of the two events.
    """
    e = log.where(F.col("type").isin("cluster.corroborated", "cluster.grounded", "cluster.removed")).withColumn("d", F.from_json("data", _CLUSTER))
    made = F.col("type") == "cluster.corroborated"
    # boundaries are grouped first and joined to the events, so a stream with many events moves no payload to one task
    gone = e.groupBy("stream_id").agg(F.max(F.when(F.col("type") == "cluster.removed", F.col("id"))).alias("gone"), F.count("*").alias("n"))
    e = join_per_key(e, gone, ["stream_id"]).where(F.col("gone").isNull() | (F.col("id") > F.col("gone"))).drop("n")
    born = e.groupBy("stream_id").agg(F.min(F.when(made, F.col("id"))).alias("born"), F.count("*").alias("n"))
    e = join_per_key(e, born, ["stream_id"]).where("id >= born")
    state = e.groupBy(F.col("stream_id").alias("id")).agg(
        F.max_by(F.when(made, F.col("d")), F.when(made, F.col("id"))).alias("d"),
        last_of(F.coalesce("d.grounding", "d.verdict"), F.col("type") == "cluster.grounded").alias("grounding"),
        last_of("d.confidence", F.col("d.confidence").isNotNull()).alias("confidence"),
        F.min("created_at").alias("created_at"),
    )
    return state.select("id", *[F.col(f"d.{x}") for x in "fact sources originators independent_originators has_primary claim_ids extremity".split()], "confidence", "grounding", "created_at")


def cluster_snapshots(log: DataFrame) -> DataFrame:
    """cluster.snapshot: one row per cluster and day, the last write wins."""
    e = _events(log, "cluster.snapshot", _CLUSTER + ", cluster_id string")
    e = e.withColumn("cluster_id", F.coalesce("d.cluster_id", "stream_id")).withColumn("snapshot_day", F.to_date(F.coalesce(F.try_to_timestamp("d.harvested_at"), "created_at")))
    cols = "fact independent_originators has_primary extremity confidence sources originators corrected grounding".split()
    return latest(e, ["cluster_id", "snapshot_day"], [F.desc("id")]).select("cluster_id", "snapshot_day", *[F.col(f"d.{x}") for x in cols])


def claim_relations(log: DataFrame) -> DataFrame:
    e = _events(log, "claim.related", "claim_a string, claim_b string, relation string, score double")
    return e.groupBy("d.claim_a", "d.claim_b", "d.relation").agg(last_of("d.score").alias("score"))


_GRAPH = (
    "reset boolean, nodes array<struct<id:string,headline:string,entity_spine:array<string>,first_seen:double,last_updated:double,cluster_count:int,topic_embedding:array<double>>>, "
    "edges array<struct<kind:string,from_id:string,to_id:string>>, node_clusters array<struct<node_id:string,cluster_id:string>>, "
    "claim_node_links array<struct<claim_id:string,node_id:string,cluster_id:string>>"
)


def story_graph_tables(log: DataFrame) -> dict[str, DataFrame]:
    """story.graph.rebuilt and story.graph.delta: nodes, edges and links since the tenant's last reset."""
    e = log.where(F.col("type").isin("story.graph.rebuilt", "story.graph.delta")).withColumn("d", F.from_json("data", _GRAPH))
    reset = (F.col("type") == "story.graph.rebuilt") | F.coalesce("d.reset", F.lit(False))
    e = e.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("")))
    start = e.groupBy("tenant_id").agg(F.max(F.when(reset, F.col("id"))).alias("start"), F.count("*").alias("n"))
    e = join_per_key(e, start, ["tenant_id"]).where(F.col("start").isNull() | (F.col("id") >= F.col("start")))
    n = e.select("tenant_id", "id", F.explode("d.nodes").alias("n"))
    nodes = n.groupBy("tenant_id", F.col("n.id").alias("node_id")).agg(
        last_of("n.headline").alias("headline"),
        last_of("n.entity_spine").alias("entity_spine"),
        first_of("n.first_seen").alias("first_seen"),
        last_of("n.last_updated").alias("last_updated"),
        last_of("n.cluster_count").alias("cluster_count"),
        last_set("n.topic_embedding").alias("topic_embedding"),
    )
    lists = {k: e.select("tenant_id", F.explode(f"d.{k}").alias("x")).select("tenant_id", "x.*").distinct() for k in ("edges", "node_clusters", "claim_node_links")}
    return {"nodes": nodes} | lists


def prompts(log: DataFrame) -> DataFrame:
    """admin.prompt.updated: versions count up per key, the newest is active."""
    e = _events(log, "admin.prompt.updated", "target string, text string, reason string, actor string").withColumn("key", F.coalesce("d.target", "stream_id"))
    w = Window.partitionBy("key").orderBy("id")
    return e.select("key", F.row_number().over(w).alias("version"), "d.text", F.lead("id").over(w).isNull().alias("active"), "d.reason", "d.actor", "created_at")


_FUNNEL = "visitor_id string, platform string, referrer string, utm string, email string, beta boolean"


def acquisition_signals(log: DataFrame) -> DataFrame:
    e = log.where(F.col("type").startswith("acquisition.")).withColumn("d", F.from_json("data", _FUNNEL))
    kind = F.when(F.col("type") == "acquisition.viewed", "view").when(F.col("type") == "acquisition.clicked", "click").otherwise("notify")
    return e.select("id", kind.alias("kind"), "d.visitor_id", "d.platform", "d.referrer", "d.utm", "created_at")


def acquisition_signups(log: DataFrame) -> DataFrame:
    """One row per email: hits, beta if ever asked for, platform and referrer of the first."""
    e = _events(log, "acquisition.notify_requested", _FUNNEL).where(F.coalesce("d.email", F.lit("")) != "")
    return e.groupBy(F.col("d.email").alias("email")).agg(
        F.count("*").alias("hits"),
        F.bool_or(F.coalesce("d.beta", F.lit(False))).alias("beta"),
        first_of("d.platform").alias("platform"),
        first_of("d.referrer").alias("referrer"),
        first_of("d.utm").alias("utm"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


# Folds made on reading.


def source_flags(log: DataFrame) -> DataFrame:
    """Latest allow or deny of each source; other words are ignored."""
    e = _events(log, "admin.source.flagged", "target string, status string").withColumn("source", F.coalesce("d.target", "stream_id"))
    return e.where(F.col("d.status").isin("allow", "deny")).groupBy("source").agg(last_of("d.status").alias("status"))


def denied_sources(log: DataFrame) -> DataFrame:
    return source_flags(log).where("status = 'deny'").select("source")


_REGISTRY_FIELDS = ("canonical", "provider", "status", "country", "language", "reputation")


def source_registry(log: DataFrame) -> DataFrame:
    """Per source the last value that is set of each field; the time of the first record stays."""
    schema = "source string, at string, " + ", ".join(f"{f} string" for f in _REGISTRY_FIELDS)
    e = log.where(F.col("type").startswith("source.")).withColumn("d", F.from_json("data", schema)).withColumn("source", F.coalesce("d.source", "stream_id"))
    at = F.nullif(F.col("d.at"), F.lit(""))
    return e.groupBy("source").agg(*[last_set(F.nullif(F.col(f"d.{f}"), F.lit(""))).alias(f) for f in _REGISTRY_FIELDS], F.min_by(at, F.when(at.isNotNull(), F.col("id"))).alias("first_at"))


def pending_sources(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status").isin("registered", "backfilling", "scored"))


def active_sources(registry: DataFrame) -> DataFrame:
    return registry.where("status = 'active'")


def plan_registry(seen: DataFrame, registry: DataFrame, clustered: DataFrame, reputation: DataFrame, step: float = 0.01) -> DataFrame:
    """What to record next for each source: registered, active, refresh or nothing (left out)."""
    all_rows = (
        seen.select("source", "provider")
        .join(registry.select("source", "status", F.col("reputation").cast("double").alias("old")), "source", "full_outer")
        .join(clustered.select("source", F.lit(True).alias("has_cluster")), "source", "left")
        .join(reputation.select("source", F.col("reputation").alias("new")), "source", "left")
    )
    got = F.coalesce("has_cluster", F.lit(False))
    moved = F.col("new").isNotNull() & (F.abs(F.col("new") - F.coalesce("old", F.lit(-1.0))) >= step)
    action = (
        F.when(F.col("status").isNull() & got, "active")
        .when(F.col("status").isNull(), "registered")
        .when(F.col("status").isin("registered", "backfilling", "scored") & got, "active")
        .when((F.col("status") == "active") & moved, "refresh")
    )
    return all_rows.select("source", "provider", action.alias("action"), "new").where("action is not null").orderBy("source")


def active_config(log: DataFrame, knobs: list[str]) -> DataFrame:
    """Latest value of each known knob that is a number."""
    e = _events(log, "admin.threshold.promoted", "key string, target string, value string").withColumn("knob", F.coalesce("d.key", "d.target"))
    e = e.withColumn("value", F.expr("try_cast(d.value as double)")).where(F.col("knob").isin(knobs) & F.col("value").isNotNull())
    return e.groupBy("knob").agg(last_of("value").alias("value"))


def paused_clocks(log: DataFrame) -> DataFrame:
    e = _events(log, "admin.clock.set", "clock string, paused boolean").withColumn("clock", F.coalesce("d.clock", F.lit("ingestion")))
    return e.groupBy("clock").agg(F.coalesce(last_of("d.paused"), F.lit(False)).alias("paused"))


def ownership(resolved: DataFrame) -> DataFrame:
    """(canonical, owner_label) for sources that share an owner with another; resolved has (id, canonical, owners array<struct<qid,label>>)."""
    from tessera.operators.components import connected_components

    pairs = resolved.select("id", "canonical", F.posexplode("owners").alias("pos", "o")).where("o.qid is not null and o.qid <> ''").select("id", "pos", "canonical", F.col("o.qid").alias("qid"), F.col("o.label").alias("label"))
    label = pairs.where("label is not null and label <> ''").groupBy("qid").agg(F.max_by("label", F.struct("id", "pos")).alias("label"))
    each = pairs.groupBy("canonical", "qid").agg(F.min(F.struct("id", "pos")).alias("seen"))
    edges = each.select(F.concat(F.lit("s:"), "canonical").alias("a"), F.concat(F.lit("q:"), "qid").alias("b"))
    part = connected_components(edges).where("node like 's:%'").select(F.substring("node", 3, 1 << 20).alias("canonical"), "component")
    big = part.join(part.groupBy("component").count().where("count >= 2").select("component"), "component")
    votes = each.join(big, "canonical").groupBy("component", "qid").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    top = latest(votes, ["component"], [F.desc("n"), F.col("seen"), F.col("qid")]).join(label, "qid", "left").select("component", F.coalesce("label", "qid").alias("owner_label"))
    return big.join(top, "component").select("canonical", "owner_label")


def with_manual_groups(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """Groups found and groups set by hand; the latter win."""
    return auto.join(manual.select("canonical", F.col("owner_label").alias("by_hand")), "canonical", "full_outer").select("canonical", F.coalesce("by_hand", "owner_label").alias("owner_label"))


def comment_thread(log: DataFrame) -> DataFrame:
    """Comments that live, in the order in which they were first made, with their last text."""
    e = log.where(F.col("type").isin("comment.added", "comment.deleted")).withColumn("d", F.from_json("data", "comment_id string, cluster_id string, user_id string, body string"))
    add = F.col("type") == "comment.added"
    return (
        e.groupBy("tenant_id", "d.cluster_id", "d.comment_id")
        .agg(last_of("type").alias("last"), F.min(F.when(add, F.col("id"))).alias("pos"), last_of("d.body", add).alias("body"), last_of("d.user_id", add).alias("user_id"))
        .where("last = 'comment.added'")
        .drop("last")
    )


def user_pins(log: DataFrame) -> DataFrame:
    """What each user has pinned now; nth counts from the newest."""
    e = log.where(F.col("type").isin("story.pinned", "story.unpinned")).withColumn("d", F.from_json("data", "user_id string, cluster_id string"))
    now = e.groupBy("tenant_id", "d.user_id", "d.cluster_id").agg(last_of("type").alias("last"), F.max("id").alias("at")).where("last = 'story.pinned'")
    return now.withColumn("nth", F.row_number().over(Window.partitionBy("tenant_id", "user_id").orderBy(F.desc("at")))).drop("last")


def routed_feedback(log: DataFrame, route: str, route_first: bool = False) -> DataFrame:
    """Feedback whose latest triage has the route, with its submission; route_first looks at triages of that route only."""
    t = _events(log, "feedback.triaged", "item_id string, category string, route string, confidence double, auto_fixable boolean").select(F.col("d.item_id").alias("item_id"), "id", "d.category", "d.route", "d.confidence", "d.auto_fixable")
    t = latest(t.where(F.col("route") == route) if route_first else t, ["item_id"], [F.desc("id")]).where(F.col("route") == route)
    s = _events(log, "feedback.submitted", "item_id string, text string, cluster_id string").select(F.coalesce("d.item_id", "stream_id").alias("item_id"), "d.text", "d.cluster_id", "created_at")
    return t.join(s, "item_id", "left")


def untriaged_feedback(log: DataFrame) -> DataFrame:
    s = _events(log, "feedback.submitted", "item_id string, text string").select(F.coalesce("d.item_id", "stream_id").alias("item_id"), "d.text", "id")
    t = _events(log, "feedback.triaged", "item_id string").select(F.col("d.item_id").alias("item_id"))
    return s.join(t, "item_id", "left_anti")


def issue_links(log: DataFrame) -> DataFrame:
    """Latest status of each item and the first issue of each key."""
    e = _events(log, "feedback.linked", "item_id string, issue_ref string, dedup_key string, status string").select("id", "d.*")
    first = e.where("dedup_key <> ''").groupBy("dedup_key").agg(first_of("issue_ref").alias("first_issue"))
    return e.groupBy("item_id").agg(last_of("status").alias("status"), last_of("dedup_key").alias("dedup_key")).join(first, "dedup_key", "left")


def harvest(clusters: DataFrame, claims: DataFrame, at: Column) -> DataFrame:
    """Daily snapshot events of clusters; corrected if any member claim is corrected, flagged or disputed."""
    bad = claims.where(F.col("corrected") | F.col("laundering_flag") | F.col("disputed")).select("claim_id")
    hit = clusters.select("id", F.explode("claim_ids").alias("claim_id")).join(bad, "claim_id", "left_semi").select("id").distinct().withColumn("corrected", F.lit(True))
    return clusters.join(hit, "id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(False))).withColumn("harvested_at", at)
