"""Queries over the event log: scans, latest rows, folds, counts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import folds, log as L
from tessera.plans.registry import query
from tessera.plans.stand_ins import SQL_EVENTS, events, k_of, log, k
from tessera.session import table

ARTICLE = {"view": "article.ingested", "click": "article.ingested"}
CLUSTER = {"view": "cluster.corroborated", "purchase": "cluster.corroborated", "click": "cluster.grounded", "signup": "cluster.removed"}


@query(f"""SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT user_id, event_type, k FROM {SQL_EVENTS}
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type""")
def w2_latest_per_stream(spark, sf):
    last = L.latest(events(spark, sf).select("user_id", "ts", "event_id", "event_type", "k"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))



@query("""SELECT min(event_id) AS event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)""")
def n9_append_once_per_key(spark, sf):
    e = table(spark, sf, "events").withColumn("js_seq", F.concat_ws("-", "user_id", "event_type", F.to_date("ts").cast("string")))
    first = e.groupBy("js_seq").agg(F.min("event_id").alias("event_id"))
    known = e.where("event_id < 0").select("js_seq")
    rows = L.append_once(known, e.join(first, ["js_seq", "event_id"]).select("js_seq", "event_id", "user_id", "event_type", F.to_date("ts").alias("day")))
    return rows.select("event_id", "user_id", "event_type", "day")


@query("""SELECT count(*) FILTER (WHERE k % 10 <> 0) AS good, count(*) FILTER (WHERE k % 10 = 0) AS dead FROM """ + SQL_EVENTS)
def n10_quarantine_unreadable(spark, sf):
    e = events(spark, sf).select("event_id", F.when(k() % 10 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")).alias("data"))
    good, dead = L.quarantine(e, "k int")
    return good.agg(F.count("*").alias("good")).crossJoin(dead.agg(F.count("*").alias("dead")))


def article_log(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return log(spark, sf, ARTICLE, {"title": s("t", k()), "source": s("s", k() % 20), "url": s("u", k()), "body": s("b", k() % 9), "language": F.lit("en")})


@query(f"""SELECT CAST(user_id AS VARCHAR) AS id, arg_max('t' || k, event_id) AS title, arg_min('s' || k % 20, event_id) AS source, arg_max('b' || k % 9, event_id) AS body,
    CAST(min(ts) AS DATE) AS day FROM {SQL_EVENTS} WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def k1_article_upsert(spark, sf):
    return folds.articles(article_log(spark, sf)).select("id", "title", "source", "body", F.to_date("ingested_at").alias("day"))


@query(f"""SELECT claim_id, article_id, voice FROM (SELECT 'c' || k * 7 % 400 AS claim_id, CAST(user_id AS VARCHAR) AS article_id, event_type AS voice, event_id, 0 AS pos FROM {SQL_EVENTS} WHERE event_type IN ('view', 'click')
    UNION ALL SELECT 'c' || (k * 7 + user_id) % 400, CAST(user_id AS VARCHAR), event_type, event_id, 1 FROM {SQL_EVENTS} WHERE event_type IN ('view', 'click'))
    QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY event_id, pos) = 1""")
def k2_claims_first_wins(spark, sf):
    one = lambda n: F.struct(F.concat(F.lit("c"), (n % 400).cast("string")).alias("id"), F.col("event_type").alias("voice"))
    rows = log(spark, sf, {"view": "claims.extracted", "click": "claims.extracted"}, {"claims": F.array(one(k() * 7), one(k() * 7 + F.col("user_id")))})
    return folds.extracted_claims(rows).select("claim_id", "article_id", "voice")


def claim_log(spark, sf):
    kinds = {"view": "claims.extracted", "click": "claims.classified", "error": "admin.classification.corrected", "purchase": "claim.disputed"}
    c, kind = F.concat(F.lit("c"), k().cast("string")), (F.col("user_id") % 3).cast("string")
    fix = F.when(F.col("event_type") == "error", F.when(kind != "0", F.concat(F.lit("fix"), kind)))
    item = F.struct(c.alias("id"), F.when(F.col("event_type") == "click", F.concat(F.lit("kind"), kind)).alias("kind"))
    return log(spark, sf, kinds, {"claims": F.array(item), "target": c, "claim_id": c, "kind": fix})


@query(f"""WITH e AS (SELECT 'c' || k AS c, event_id AS id, event_type AS t, user_id % 3 AS kind, k FROM {SQL_EVENTS}),
    born AS (SELECT c, min(id) AS b FROM e WHERE t = 'view' GROUP BY c),
    fixed AS (SELECT e.c, min(id) AS f, arg_max(CASE kind WHEN 0 THEN NULL ELSE 'fix' || kind END, CASE WHEN kind = 0 THEN NULL ELSE id END) AS kind_fix FROM e JOIN born USING (c) WHERE t = 'error' AND id > b GROUP BY e.c),
    sorted AS (SELECT e.c, arg_max('kind' || kind, id) AS kind FROM e JOIN born USING (c) LEFT JOIN fixed USING (c) WHERE t = 'click' AND id > b AND (f IS NULL OR id < f) GROUP BY e.c),
    odd AS (SELECT DISTINCT e.c FROM e JOIN born USING (c) WHERE t = 'purchase' AND id > b)
    SELECT c AS claim_id, coalesce(kind_fix, sorted.kind) AS kind, f IS NOT NULL AS corrected, odd.c IS NOT NULL AS disputed FROM born LEFT JOIN fixed USING (c) LEFT JOIN sorted USING (c) LEFT JOIN odd USING (c)""")
def k3_claims_classified_corrected_disputed(spark, sf):
    return folds.claims(claim_log(spark, sf)).select("claim_id", "kind", "corrected", "disputed")


def cluster_log(spark, sf):
    judged = F.col("event_type") == "click"
    return log(spark, sf, CLUSTER, {"independent_originators": F.when(~judged, k() % 6), "confidence": k() / 100.0, "grounding": F.when(judged, F.concat(F.lit("g"), (k() % 3).cast("string")))})


@query(f"""WITH e AS (SELECT user_id AS s, event_id AS id, CASE event_type WHEN 'view' THEN 'made' WHEN 'purchase' THEN 'made' WHEN 'click' THEN 'judged' WHEN 'signup' THEN 'gone' END AS t, k FROM {SQL_EVENTS} WHERE event_type <> 'error'),
    alive AS (SELECT * FROM (SELECT e.*, max(CASE WHEN t = 'gone' THEN id END) OVER (PARTITION BY s) AS g FROM e) WHERE g IS NULL OR id > g),
    born AS (SELECT * FROM (SELECT alive.*, min(CASE WHEN t = 'made' THEN id END) OVER (PARTITION BY s) AS b FROM alive) WHERE id >= b)
    SELECT CAST(s AS VARCHAR) AS id, arg_max(k % 6, id) FILTER (WHERE t = 'made') AS independent_originators, arg_max(k, id) / 100.0::DOUBLE AS confidence,
    arg_max('g' || k % 3, id) FILTER (WHERE t = 'judged') AS grounding FROM born GROUP BY s""")
def k4_clusters_with_grounding_and_removal(spark, sf):
    return folds.clusters(cluster_log(spark, sf)).select("id", "independent_originators", "confidence", "grounding")


def snapshot_log(spark, sf):
    return log(spark, sf, dict.fromkeys(("view", "click", "error", "purchase", "signup"), "cluster.snapshot"), {"confidence": k() / 100.0})


@query(f"""SELECT CAST(user_id AS VARCHAR) AS cluster_id, CAST(ts AS DATE) AS snapshot_day, k / 100.0::DOUBLE AS confidence FROM {SQL_EVENTS} QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""")
def k5_daily_snapshots_last_write(spark, sf):
    return folds.cluster_snapshots(snapshot_log(spark, sf)).select("cluster_id", "snapshot_day", "confidence")


def relation_log(spark, sf):
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    return log(spark, sf, dict.fromkeys(("view", "click", "error", "purchase", "signup"), "claim.related"), {"claim_a": c(F.least(k(), F.col("user_id"))), "claim_b": c(F.greatest(k(), F.col("user_id"))), "relation": F.col("event_type"), "score": F.col("value")})


@query(f"""SELECT 'c' || least(k, user_id) AS claim_a, 'c' || greatest(k, user_id) AS claim_b, event_type AS relation, arg_max(CAST(value AS DOUBLE), event_id) AS score FROM {SQL_EVENTS} GROUP BY 1, 2, 3""")
def k7_relations_last_score(spark, sf):
    return folds.claim_relations(relation_log(spark, sf))


@query(f"""WITH e AS (SELECT event_id AS id, event_type AS t, k, CAST(value AS DOUBLE) AS v FROM {SQL_EVENTS}), r AS (SELECT max(id) AS start FROM e WHERE t = 'error' AND k < 2)
    SELECT 'n' || k AS node_id, arg_max('h' || t, id) AS headline, arg_min(v, id) AS first_seen, arg_max(v, id) AS last_updated, CAST(count(*) AS BIGINT) AS n FROM e, r WHERE (t IN ('view', 'click') OR (t = 'error' AND k < 2)) AND (start IS NULL OR id >= start) GROUP BY k""")
def k10_story_graph_since_reset(spark, sf):
    kinds = {"view": "story.graph.delta", "click": "story.graph.delta", "error": "story.graph.delta"}
    node = F.struct(F.concat(F.lit("n"), k().cast("string")).alias("id"), F.concat(F.lit("h"), "event_type").alias("headline"), F.col("value").alias("first_seen"), F.col("value").alias("last_updated"))
    rows = log(spark, sf, kinds, {"reset": F.col("event_type") == "error", "nodes": F.array(node), "k": k()}).where("type <> '' and not (get_json_object(data, '$.reset') = 'true' and cast(get_json_object(data, '$.k') as int) >= 2)")
    g = folds.story_graph_tables(rows)["nodes"]
    n = rows.withColumn("start", F.max(F.when(F.get_json_object("data", "$.reset") == "true", F.col("id"))).over(Window.partitionBy("tenant_id"))).where("start is null or id >= start").groupBy(F.concat(F.lit("n"), F.get_json_object("data", "$.k")).alias("node_id")).agg(F.count("*").alias("n"))
    return g.join(n, "node_id").select("node_id", "headline", "first_seen", "last_updated", "n")


@query(f"""SELECT 'p' || k % 25 AS key, CAST(row_number() OVER (PARTITION BY k % 25 ORDER BY event_id) AS INTEGER) AS version, 't' || event_id AS text, lead(event_id) OVER (PARTITION BY k % 25 ORDER BY event_id) IS NULL AS active FROM {SQL_EVENTS} WHERE event_type = 'click'""")
def k14_prompt_versions(spark, sf):
    rows = log(spark, sf, {"click": "admin.prompt.updated"}, {"target": F.concat(F.lit("p"), (k() % 25).cast("string")), "text": F.concat(F.lit("t"), F.col("event_id").cast("string"))})
    return folds.prompts(rows).select("key", "version", "text", "active")


@query("""SELECT CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' ELSE 'notify' END AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1""")
def k15_funnel_kinds(spark, sf):
    rows = log(spark, sf, {"view": "acquisition.viewed", "click": "acquisition.clicked", "signup": "acquisition.notify_requested"}, {"visitor_id": F.col("user_id").cast("string")})
    return folds.acquisition_signals(rows).groupBy("kind").agg(F.count("*").alias("n"))


def signup_log(spark, sf):
    return log(spark, sf, {"signup": "acquisition.notify_requested"}, {"email": F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")), "beta": k() % 10 == 0, "platform": F.concat(F.lit("p"), (k() % 4).cast("string"))})


@query(f"""SELECT 'u' || user_id || '@example.com' AS email, count(*) AS hits, bool_or(k % 10 = 0) AS beta, arg_min('p' || k % 4, event_id) AS platform, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM {SQL_EVENTS} WHERE event_type = 'signup' GROUP BY user_id""")
def k16_signups_by_email(spark, sf):
    return folds.acquisition_signups(signup_log(spark, sf)).select("email", "hits", "beta", "platform", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"))


def _flags():
    return {"target": F.concat(F.lit("src"), (k() % 30).cast("string")), "status": F.when(k() % 3 == 0, "allow").when(k() % 3 == 1, "deny").otherwise("watch")}
SQL_FLAGS = f"""(SELECT 'src' || k % 30 AS source, arg_max(CASE k % 3 WHEN 0 THEN 'allow' ELSE 'deny' END, event_id) AS status FROM {SQL_EVENTS} WHERE event_type = 'error' AND k % 3 < 2 GROUP BY 1)"""


@query(f"SELECT source, status FROM {SQL_FLAGS}")
def r1_source_flags(spark, sf):
    return folds.source_flags(log(spark, sf, {"error": "admin.source.flagged"}, _flags()))


@query(f"SELECT source FROM {SQL_FLAGS} WHERE status = 'deny'")
def r2_denied_sources(spark, sf):
    return folds.denied_sources(log(spark, sf, {"error": "admin.source.flagged"}, _flags()))


def _registry_fields():
    return {"source": F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")), "status": F.when(k() % 4 == 0, "registered").when(k() % 4 == 1, "active").when(k() % 4 == 2, "scored").otherwise(""), "country": F.when(k() % 5 == 0, "FR").otherwise(""), "at": F.when(k() % 2 == 0, F.concat(F.lit("d"), k().cast("string"))).otherwise("")}
SQL_REGISTRY = f"""(SELECT 'src' || user_id % 40 AS source, arg_max(CASE k % 4 WHEN 0 THEN 'registered' WHEN 1 THEN 'active' ELSE 'scored' END, event_id) FILTER (WHERE k % 4 < 3) AS status,
    arg_max('FR', event_id) FILTER (WHERE k % 5 = 0) AS country, arg_min('d' || k, event_id) FILTER (WHERE k % 2 = 0) AS first_at FROM {SQL_EVENTS} WHERE event_type = 'view' GROUP BY 1)"""


def _registry(spark, sf):
    return folds.source_registry(log(spark, sf, {"view": "source.recorded"}, _registry_fields()))


@query(f"SELECT * FROM {SQL_REGISTRY}")
def r3_source_registry_last_set(spark, sf):
    return _registry(spark, sf).select("source", "status", "country", "first_at")


@query(f"SELECT CASE WHEN status = 'active' THEN 'active' ELSE 'pending' END AS state, count(*) AS n FROM {SQL_REGISTRY} GROUP BY 1")
def r4_r5_pending_and_active(spark, sf):
    r = _registry(spark, sf)
    return folds.pending_sources(r).agg(F.lit("pending").alias("state"), F.count("*").alias("n")).union(folds.active_sources(r).agg(F.lit("active").alias("state"), F.count("*").alias("n"))).where("n > 0")


@query(f"""WITH seen AS (SELECT DISTINCT source, 'rss' AS provider FROM documents), r AS (SELECT source, status FROM {SQL_REGISTRY} WHERE source <> 'src3'),
    j AS (SELECT coalesce(seen.source, r.source) AS source, status, coalesce(seen.source, r.source) LIKE '%5' AS got, length(coalesce(seen.source, r.source)) / 10.0 AS new FROM seen FULL JOIN r ON seen.source = r.source)
    SELECT source, CASE WHEN status IS NULL AND got THEN 'active' WHEN status IS NULL THEN 'registered' WHEN status <> 'active' AND got THEN 'active' WHEN status = 'active' THEN 'refresh' END AS action FROM j
    WHERE status IS NULL OR (status <> 'active' AND got) OR status = 'active'""")
def r6_registry_plan(spark, sf):
    seen = table(spark, sf, "documents").select("source", F.lit("rss").alias("provider")).distinct()
    reg = _registry(spark, sf).where("source <> 'src3'")
    names = seen.select("source").union(reg.select("source")).distinct()
    return folds.plan_registry(seen, reg, names.where("source like '%5'"), names.select("source", (F.length("source") / 10.0).alias("reputation"))).select("source", "action")


@query(f"""SELECT 'knob' || k % 6 AS knob, arg_max(CAST(value AS DOUBLE), event_id) AS value FROM {SQL_EVENTS} WHERE event_type = 'purchase' AND k % 6 < 4 AND k % 7 <> 0 GROUP BY 1""")
def r7_active_config(spark, sf):
    rows = log(spark, sf, {"purchase": "admin.threshold.promoted"}, {"key": F.concat(F.lit("knob"), (k() % 6).cast("string")), "value": F.when(k() % 7 == 0, "high").otherwise(F.col("value").cast("string"))})
    return folds.active_config(rows, [f"knob{i}" for i in range(4)])


@query(f"SELECT 'clock' || k % 3 AS clock, arg_max(k % 2 = 0, event_id) AS paused FROM {SQL_EVENTS} WHERE event_type = 'error' GROUP BY 1")
def r9_paused_clocks(spark, sf):
    return folds.paused_clocks(log(spark, sf, {"error": "admin.clock.set"}, {"clock": F.concat(F.lit("clock"), (k() % 3).cast("string")), "paused": k() % 2 == 0}))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT 's' || user_id AS s, 'q' || user_id // 3 AS q FROM events UNION SELECT DISTINCT 's' || user_id, 'q' || (user_id // 3 + 1) FROM events WHERE user_id % 30 = 29),
    r(a, b) AS (SELECT s, s FROM e UNION SELECT r.a, y.s FROM r JOIN e x ON r.b = x.s JOIN e y ON x.q = y.q),
    part AS (SELECT a AS canonical, min(b) AS c FROM r GROUP BY a), big AS (SELECT c FROM part GROUP BY c HAVING count(*) > 1)
    SELECT canonical, c AS grp FROM part JOIN big USING (c)""")
def r10_ownership_groups(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    owner = lambda n: F.struct(F.concat(F.lit("q"), n.cast("string")).alias("qid"), F.lit(None).cast("string").alias("label"))
    n = F.floor(F.col("user_id") / 3)
    resolved = u.select(F.col("user_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("canonical"), F.when(F.col("user_id") % 30 == 29, F.array(owner(n), owner(n + 1))).otherwise(F.array(owner(n))).alias("owners"))
    g = folds.ownership(resolved)
    least = g.groupBy("owner_label").agg(F.min("canonical").alias("grp"))
    return g.join(least, "owner_label").select("canonical", "grp")


@query(f"""SELECT CAST(user_id AS VARCHAR) AS cluster_id, 'c' || k AS comment_id, arg_max(event_type, event_id) = 'click' AS live, min(event_id) FILTER (WHERE event_type = 'click') AS pos, arg_max('b' || event_id, event_id) FILTER (WHERE event_type = 'click') AS body
    FROM {SQL_EVENTS} WHERE event_type IN ('click', 'error') GROUP BY user_id, k HAVING arg_max(event_type, event_id) = 'click'""")
def r12_comment_threads(spark, sf):
    rows = log(spark, sf, {"click": "comment.added", "error": "comment.deleted"}, {"comment_id": F.concat(F.lit("c"), k().cast("string")), "cluster_id": F.col("user_id").cast("string"), "user_id": F.lit("u"), "body": F.concat(F.lit("b"), F.col("event_id").cast("string"))})
    return folds.comment_thread(rows).select("cluster_id", "comment_id", F.lit(True).alias("live"), "pos", "body")


@query(f"""SELECT user_id, cluster_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY newest DESC) AS INTEGER) AS nth FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, 'c' || k AS cluster_id, max(event_id) AS newest FROM {SQL_EVENTS}
    WHERE event_type IN ('view', 'error') GROUP BY user_id, k HAVING arg_max(event_type, event_id) = 'view')""")
def r13_user_pins(spark, sf):
    rows = log(spark, sf, {"view": "story.pinned", "error": "story.unpinned"}, {"user_id": F.col("user_id").cast("string"), "cluster_id": F.concat(F.lit("c"), k().cast("string"))})
    return folds.user_pins(rows).select("user_id", "cluster_id", "nth")


FEEDBACK = {"signup": "feedback.submitted", "click": "feedback.triaged"}


def _feedback(spark, sf):
    item = F.concat(F.lit("i"), F.when(F.col("event_type") == "signup", F.col("event_id")).otherwise(F.col("event_id") - 1).cast("string"))
    return log(spark, sf, FEEDBACK, {"item_id": item, "text": F.concat(F.lit("t"), k().cast("string")), "route": F.when(k() % 2 == 0, "review").otherwise("auto-fix"), "category": F.lit("bug")})


@query(f"""WITH s AS (SELECT 'i' || event_id AS item_id, 't' || k AS text FROM {SQL_EVENTS} WHERE event_type = 'signup'), t AS (SELECT 'i' || (event_id - 1) AS item_id, CASE WHEN k % 2 = 0 THEN 'review' ELSE 'auto-fix' END AS route FROM {SQL_EVENTS} WHERE event_type = 'click')
    SELECT item_id, t.route, s.text FROM t LEFT JOIN s USING (item_id) WHERE t.route = 'review'""")
def r15_routed_feedback(spark, sf):
    return folds.routed_feedback(_feedback(spark, sf), "review").select("item_id", "route", "text")


@query(f"""SELECT 'i' || event_id AS item_id FROM events s WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'click' AND t.event_id = s.event_id + 1)""")
def r17_untriaged_feedback(spark, sf):
    return folds.untriaged_feedback(_feedback(spark, sf)).select("item_id")


@query(f"""SELECT 'i' || user_id AS item_id, arg_max('s' || k % 3, event_id) AS status, arg_max('d' || k % 17, event_id) AS dedup_key, (SELECT arg_min('r' || y.event_id, y.event_id) FROM {SQL_EVENTS} y WHERE y.event_type = 'purchase' AND y.k % 17 = arg_max(x.k, x.event_id) % 17) AS first_issue
    FROM {SQL_EVENTS} x WHERE event_type = 'purchase' GROUP BY user_id""")
def r16_issue_links(spark, sf):
    rows = log(spark, sf, {"purchase": "feedback.linked"}, {"item_id": F.concat(F.lit("i"), F.col("user_id").cast("string")), "issue_ref": F.concat(F.lit("r"), F.col("event_id").cast("string")), "dedup_key": F.concat(F.lit("d"), (k() % 17).cast("string")), "status": F.concat(F.lit("s"), (k() % 3).cast("string"))})
    return folds.issue_links(rows).select("item_id", "status", "dedup_key", "first_issue")



@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id, CAST(max(ts) AS DATE) AS last_day FROM events GROUP BY 1")
def q2_events_by_type(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.to_date(F.max("ts")).alias("last_day"))


@query("SELECT event_id, event_type FROM events WHERE event_type LIKE 'e%' ORDER BY event_id DESC LIMIT 50")
def q3_recent_of_a_kind(spark, sf):
    return table(spark, sf, "events").where("event_type like 'e%'").orderBy(F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages""")
def q1_a26_table_sizes(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("documents").union(one("events")).union(one("labels")).union(one("pages"))


@query(f"""SELECT coalesce(nullif('r' || CASE WHEN k % 5 = 0 THEN '' ELSE CAST(k % 15 AS VARCHAR) END, 'r'), 'direct') AS referrer, count(*) AS n FROM {SQL_EVENTS} WHERE event_type = 'click' GROUP BY 1 ORDER BY n DESC, referrer LIMIT 10""")
def q8_clicks_by_referrer(spark, sf):
    ref = F.when(k() % 5 == 0, "").otherwise(F.concat(F.lit("r"), (k() % 15).cast("string")))
    rows = log(spark, sf, {"click": "acquisition.clicked"}, {"referrer": ref})
    s = folds.acquisition_signals(rows).groupBy(F.coalesce(F.nullif("referrer", F.lit("")), F.lit("direct")).alias("referrer")).agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "referrer").limit(10)


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1""")
def q8_views_and_clicks_14_days(spark, sf):
    e = table(spark, sf, "events")
    top = e.agg(F.max("ts").alias("top"))
    recent = e.crossJoin(F.broadcast(top)).where("ts >= top - interval 14 days")
    return recent.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7")
def q11_last_seven_days(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(7)


@query("SELECT event_type, count(*) AS calls FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1")
def q10_todays_calls(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.join(F.broadcast(e.agg(F.max("day").alias("day"))), "day").groupBy("event_type").agg(F.count("*").alias("calls"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 OR CAST(json_extract_string(props, '$.k') AS INTEGER) = 7")
def q14_history_of_one(spark, sf):
    return table(spark, sf, "events").where((F.col("user_id") == 7) | (k_of() == 7)).select("event_id", "event_type")


@query("SELECT max(event_id) AS version FROM events")
def q19_data_version(spark, sf):
    return table(spark, sf, "events").agg(F.max("event_id").alias("version"))


@query("""SELECT CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'extract' WHEN 'purchase' THEN 'classify' ELSE 'cluster' END AS stage, count(*) AS n,
    CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) < 3600 THEN 'fresh' WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) < 86400 THEN 'stale' ELSE 'stalled' END AS freshness
    FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1 UNION ALL SELECT 'review', 0, 'never'""")
def a24_stage_health(spark, sf):
    from tessera.operators.health import stage_health

    rows = log(spark, sf, {"view": "article.ingested", "click": "claims.extracted", "purchase": "claims.classified", "signup": "cluster.corroborated"}, {"k": k()})
    stages = {"acquire": "article.ingested", "extract": "claims.extracted", "classify": "claims.classified", "cluster": "cluster.corroborated", "review": "review.done"}
    return stage_health(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), stages).select("stage", F.col("n").cast("long").alias("n"), "freshness")


@query("""SELECT event_id AS id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 10""")
def a25_dead_letters(spark, sf):
    from tessera.operators.health import dead_letter_summary

    dead = table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("props").alias("error"))
    return dead_letter_summary(dead).select("id", "total")


@query(f"SELECT coalesce(CASE k % 4 WHEN 0 THEN NULL ELSE 'stage' || k % 4 END, 'kernel') AS stage, count(*) AS n FROM {SQL_EVENTS} WHERE event_type = 'error' GROUP BY 1")
def a33_dead_by_stage(spark, sf):
    from tessera.operators.health import dead_by_stage

    return dead_by_stage(events(spark, sf).where("event_type = 'error'").withColumn("stage", F.when(k() % 4 > 0, F.concat(F.lit("stage"), (k() % 4).cast("string")))))
