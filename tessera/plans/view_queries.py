"""Queries over what readers and operators are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions.text import entity_spine
from tessera.operators import folds, history as H, stories as ST, views as VW
from tessera.plans.registry import query
from tessera.plans.score_queries import SQL_RATED
from tessera.plans.stand_ins import SQL_EVENTS, articles, events, history, k, level, log
from tessera.session import table

CL = f"(SELECT DISTINCT user_id AS id, k FROM {SQL_EVENTS} WHERE event_type = 'view')"
ALL = dict.fromkeys(("view", "click", "error", "purchase", "signup"))


def clusters(spark, sf):
    """A cluster per user: claims are the distinct k of its views; even and odd k are its two originator groups."""
    e = events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_set(k().cast("long"))).alias("claim_ids"))
    part = lambda r: F.filter("claim_ids", lambda x: x % 2 == r)
    return e.withColumn("originators", F.array(part(0), part(1))).withColumn("sources", F.array(F.lit("own"))).withColumn("fact", F.concat(F.lit("fact "), F.col("id").cast("string")))


def pictures(spark, sf):
    return articles(spark, sf).withColumn("image_url", F.when(F.col("id") % 3 == 0, "x.jpg").otherwise(""))


@query(f"SELECT DISTINCT id FROM {CL} WHERE k % 17 = 3")
def j3_clusters_with_corrected_claims(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 17 == 3).alias("corrected"))
    return VW.corrected_clusters(clusters(spark, sf), d)


@query(f"""WITH t AS (SELECT 'i' || k AS item_id, arg_max('r' || event_id % 3, event_id) AS route FROM {SQL_EVENTS} WHERE event_type = 'click' GROUP BY k), s AS (SELECT 'i' || k AS item_id, arg_max('t' || event_id, event_id) AS text FROM {SQL_EVENTS} WHERE event_type = 'signup' AND k % 3 > 0 GROUP BY k)
    SELECT item_id, route, text FROM t LEFT JOIN s USING (item_id)""")
def j18_triage_with_submission(spark, sf):
    n = F.col("event_id")
    item = F.when((F.col("event_type") == "click") | (k() % 3 > 0), F.concat(F.lit("i"), k().cast("string"))).otherwise("other")
    rows = log(spark, sf, {"click": "feedback.triaged", "signup": "feedback.submitted"}, {"item_id": item, "route": F.concat(F.lit("r"), (n % 3).cast("string")), "text": F.concat(F.lit("t"), n.cast("string"))})
    return VW.triaged_feedback(rows).select("item_id", "route", "text")


def _links(spark, sf):
    return events(spark, sf).select(F.concat(F.lit("c"), k().cast("string")).alias("claim_id"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_id"))


@query(f"SELECT DISTINCT 'n' || user_id AS node_id FROM {SQL_EVENTS} WHERE k = 42")
def z27_j20_nodes_of_a_claim(spark, sf):
    return VW.nodes_of_claim(_links(spark, sf), "c42")


@query(f"SELECT DISTINCT 'c' || k AS claim_id FROM {SQL_EVENTS} WHERE user_id = 7")
def z28_j20_claims_of_a_node(spark, sf):
    return VW.claims_of_node(_links(spark, sf), "n7")


@query("""WITH c AS (SELECT user_id, min(event_id) AS first_click FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS visitor_id, count(*) FILTER (WHERE event_type = 'view' AND (first_click IS NULL OR event_id < first_click)) AS views_before, max(first_click) AS first_click, bool_or(event_type = 'signup') AS notified
    FROM events LEFT JOIN c USING (user_id) WHERE event_type IN ('view', 'click', 'signup') GROUP BY user_id""")
def j21_visitor_paths(spark, sf):
    rows = log(spark, sf, {"view": "acquisition.viewed", "click": "acquisition.clicked", "signup": "acquisition.notify_requested"}, {"visitor_id": F.col("user_id").cast("string")})
    return VW.visitor_paths(folds.acquisition_signals(rows))


@query(f"SELECT u.id, coalesce(arg_min(source, (k % 2) * 1000 + k), 'own') AS source FROM (SELECT DISTINCT id FROM {CL}) u LEFT JOIN (SELECT id, k, source FROM {CL} JOIN documents ON doc_id = k) s ON s.id = u.id GROUP BY u.id")
def f37_first_source(spark, sf):
    return VW.first_source(clusters(spark, sf), articles(spark, sf))


@query(f"SELECT id, arg_min(doc_id, (k % 2) * 1000 + k) AS article_id FROM {CL} JOIN documents ON doc_id = k WHERE k % 3 = 0 GROUP BY id")
def f38_hero_article(spark, sf):
    return VW.hero_article(clusters(spark, sf), pictures(spark, sf))


@query(f"SELECT id, CAST(k % 2 AS INTEGER) AS g, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, false AS is_primary FROM {CL} JOIN documents ON doc_id = k GROUP BY 1, 2")
def p3_provenance(spark, sf):
    return VW.provenance(clusters(spark, sf), articles(spark, sf)).select("id", "g", F.array_join("sources", ",").alias("sources"), F.array_join("languages", ",").alias("languages"), "is_primary")


@query(f"SELECT id, lang AS language, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {CL} JOIN documents ON doc_id = k GROUP BY 1, 2")
def p3_sources_by_language(spark, sf):
    return VW.sources_by_language(clusters(spark, sf), articles(spark, sf)).select("id", "language", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH a AS (SELECT id, k // 2 AS a, 0 AS part, k AS i FROM {CL} JOIN documents ON doc_id = k UNION ALL SELECT id, k, 1, (k % 2) * 1000 + k FROM {CL}), m AS (SELECT id, a, min(part * 100000 + i) AS place FROM a GROUP BY 1, 2)
    SELECT id, string_agg(a, ',' ORDER BY place) AS ids FROM m GROUP BY id""")
def z47_article_ids(spark, sf):
    claims = table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.floor(F.col("doc_id") / 2).alias("article_id"))
    return VW.article_ids(clusters(spark, sf), claims).select("id", F.array_join("article_ids", ",").alias("ids"))


@query(f"""SELECT event_id, '{{"fact":"f' || k || '","confidence":' || CAST(round(k / 100.0::DOUBLE, 4) AS VARCHAR) || ',"disputed":' || CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END || '}}' AS json FROM {SQL_EVENTS}""")
def z5_fact_json(spark, sf):
    return events(spark, sf).select("event_id", VW.fact_json(F.concat(F.lit("f"), k().cast("string")), k() / 100.0, disputed=k() % 5 == 0).alias("json"))


@query(f"""SELECT user_id AS id, '{{"id":' || user_id || ',"fact":"fact ' || user_id || '","confidence":0.5,"label":"x","tier":"mid"}}' AS json FROM (SELECT DISTINCT id AS user_id FROM {CL})""")
def z4_story_json(spark, sf):
    s = clusters(spark, sf).select("id", "fact", F.lit(0.5).alias("confidence"), F.lit("x").alias("label"), F.lit("mid").alias("tier"))
    return VW.story_json(s)


@query("""SELECT source, '{"source":"' || source || '","weight":0.25,"low_evidence":' || CASE WHEN source LIKE '%1' THEN 'true' ELSE 'false' END || '}' AS json FROM (SELECT DISTINCT source FROM documents)""")
def z3_preference_json(spark, sf):
    s = table(spark, sf, "documents").select("source").distinct()
    return VW.preference_json(s.select("source", F.lit(0.25).alias("weight"), F.col("source").endswith("1").alias("low_evidence")))


@query("""SELECT 'n' || user_id AS id, '{"id":"n' || user_id || '","headline":"h","entity_spine":["a"],"first_seen":0.0,"last_updated":' || user_id || '.0,"cluster_count":' || n || CASE WHEN user_id >= 100 THEN ',"centroid":[1.0]' ELSE '' END || '}' AS json FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def g8_z30_graph_payload(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("cluster_count"))
    n = e.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("id"), F.lit("h").alias("headline"), F.array(F.lit("a")).alias("entity_spine"), F.lit(0.0).alias("first_seen"), F.col("user_id").cast("double").alias("last_updated"), "cluster_count", F.array(F.lit(1.0)).alias("centroid"))
    return VW.graph_json(n, active_since=100.0)


def _snapshots(spark, sf):
    e = events(spark, sf).where("event_type = 'click'")
    last = e.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("day")).agg(F.max_by("k", "event_id").alias("k"))
    return last.select("id", "day", (k() / 100.0).alias("confidence"), (k() % 5).alias("independent_originators"), F.lit(False).alias("has_primary"), F.lit("notable").alias("extremity"), F.array(F.array(F.lit("nobody"))).alias("originator_sources"), F.lit(None).cast("string").alias("grounding"), F.lit(False).alias("disputed"))


def _nodes(spark, sf):
    """Two clusters a node; every tenth cluster is in none."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().where("id % 10 > 0")
    return u.select(F.concat(F.lit("n"), F.floor(F.col("id") / 2).cast("string")).alias("node_id"), "id", (F.col("id") % 2).cast("int").alias("pos"))


SQL_MEMBERS = "(SELECT CASE WHEN user_id % 10 > 0 THEN 'n' || user_id // 2 ELSE 'cluster:' || user_id END AS story_id, user_id AS id FROM (SELECT DISTINCT user_id FROM events))"


@query(f"""WITH s AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, arg_max(k, event_id) AS k FROM {SQL_EVENTS} WHERE event_type = 'click' GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM s), f AS (SELECT id, min(day) AS f FROM s GROUP BY 1),
    a AS (SELECT f.id, d.day, (SELECT arg_max(s.k, s.day) FROM s WHERE s.id = f.id AND s.day <= d.day) AS k FROM f JOIN d ON d.day >= f)
    SELECT m.story_id, day, count(*) AS clusters FROM a JOIN {SQL_MEMBERS} m USING (id) GROUP BY 1, 2""")
def z10_story_members_by_day(spark, sf):
    from tessera.operators.feed import as_of

    s = _snapshots(spark, sf)
    m = VW.story_members(_nodes(spark, sf), table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct())
    return as_of(s, "id", "day").join(m, "id").groupBy("story_id", "day").agg(F.count("*").alias("clusters"))


@query(f"""WITH s AS (SELECT user_id AS id, CAST(ts AS DATE) AS day, arg_max(k, event_id) AS k FROM {SQL_EVENTS} WHERE event_type = 'click' GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM s), f AS (SELECT id, min(day) AS f FROM s GROUP BY 1),
    a AS (SELECT f.id, d.day, (SELECT arg_max(s.k, s.day) FROM s WHERE s.id = f.id AND s.day <= d.day) AS k FROM f JOIN d ON d.day >= f), m AS (SELECT story_id, day, k, id FROM a JOIN {SQL_MEMBERS} USING (id)),
    h AS (SELECT story_id, day, arg_max(k, (k % 5) * 10 - id % 2) AS head, count(*) FILTER (WHERE k / 100.0::DOUBLE >= {S.STRONG_SUPPORT}) AS strong FROM m GROUP BY 1, 2),
    b AS (SELECT story_id, day, round(1 - power(0.55::DOUBLE, 0.8), 2) AS b0, strong - CASE WHEN head / 100.0::DOUBLE >= {S.STRONG_SUPPORT} THEN 1 ELSE 0 END AS more FROM h)
    SELECT story_id, day, CAST(round(least(b0 + least({S.SUPPORT_BONUS}::DOUBLE * more, {S.SUPPORT_CAP}::DOUBLE), {S.COLD_START_CAP}::DOUBLE) * 100) AS INTEGER) AS score FROM b""")
def z11_credibility_by_day(spark, sf):
    s, m = _snapshots(spark, sf), VW.story_members(_nodes(spark, sf), table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct())
    return VW.credibility_by_day(s, m, spark.createDataFrame([], "source string, reputation double")).select("story_id", "day", "score")


@query(f"SELECT id, k FROM (SELECT user_id AS id, arg_max(k, event_id) AS k FROM {SQL_EVENTS} WHERE event_type = 'click' GROUP BY 1) WHERE id IN (SELECT id FROM {SQL_MEMBERS} WHERE story_id = 'n3')")
def z10_story_detail(spark, sf):
    c = events(spark, sf).where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max_by("k", "event_id").alias("k"))
    return VW.story_detail("n3", _nodes(spark, sf), c, _snapshots(spark, sf))[0].select("id", "k")


@query("""WITH p AS (SELECT source, count(*) AS w FROM documents GROUP BY 1 ORDER BY w DESC, source LIMIT 10) SELECT p.source, w / 1000.0::DOUBLE AS weight, p.source LIKE '%1' AS low_evidence, coalesce(d.n, 0) AS deepened FROM p LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id % 7 = 0 GROUP BY 1) d USING (source)""")
def t5_steering_summary(spark, sf):
    d = table(spark, sf, "documents")
    p = d.groupBy("source").agg((F.count("*") / 1000.0).alias("weight")).withColumn("low_evidence", F.col("source").endswith("1"))
    return VW.steering_summary(p, d.where("doc_id % 7 = 0"))


@query(f"""SELECT event_id, k % 4 || ' independent originator' || CASE WHEN k % 4 = 1 THEN '' ELSE 's' END || CASE WHEN k % 3 = 0 THEN ', with a primary source' ELSE '' END || '; ' || CASE k % 5 WHEN 0 THEN 'routine' WHEN 1 THEN 'ordinary' WHEN 2 THEN 'notable' WHEN 3 THEN 'significant' ELSE 'extraordinary' END || ' claim; confidence ' || k || '%' AS why FROM {SQL_EVENTS}""")
def f47_derivations(spark, sf):
    return events(spark, sf).select("event_id", VW.derivation(k() % 4, k() % 3 == 0, level(k()), k() / 100.0).alias("why"))


@query("""SELECT 'k' || conv_id AS key, '[bug] ' || substr(arg_min(text, conv_id || '-' || turn), 1, 80) AS title, string_agg('- ' || text || ' (' || conv_id || '-' || turn || ')', chr(10) ORDER BY conv_id || '-' || turn) AS body FROM conversations GROUP BY conv_id""")
def f24_issue_payloads(spark, sf):
    c = table(spark, sf, "conversations")
    return VW.issue_payloads(c.select(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("key"), F.lit("bug").alias("category"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "text"))


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def z42_unplaced_clusters(spark, sf):
    from tessera.functions.identity import language_country

    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), language_country("lang").alias("country"))
    return VW.unplaced_clusters(c, table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query(f"SELECT 's' || k AS id, arg_max(m, event_id) AS mark FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'pinned' WHEN 1 THEN 'hidden' ELSE 'clear' END AS m FROM {SQL_EVENTS} WHERE event_type = 'error') GROUP BY k HAVING arg_max(m, event_id) <> 'clear'")
def z51_tenant_state(spark, sf):
    mark = F.when(F.col("user_id") % 3 == 0, "pinned").when(F.col("user_id") % 3 == 1, "hidden").otherwise("clear")
    rows = log(spark, sf, {"error": "tenant.story.marked"}, {"id": F.concat(F.lit("s"), k().cast("string")), "mark": mark})
    return VW.tenant_state(rows, "default")


@query("SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'comment.added' ELSE 'story.pinned' END AS type FROM events WHERE event_type IN ('click', 'view')")
def z35_social_events(spark, sf):
    rows = log(spark, sf, {"click": "comment.added", "view": "story.pinned", "error": "other"}, {"k": k()})
    return VW.events_of_types(rows, ["comment.added", "story.pinned"]).select("id", "type")


@query(f"SELECT 's' || k AS id, k / 100.0::DOUBLE AS confidence, CASE WHEN k % 2 = 0 THEN 'FR' ELSE '' END AS country FROM {SQL_EVENTS} WHERE event_type = 'click'")
def z23_curation_stories(spark, sf):
    one = F.struct(F.concat(F.lit("s"), k().cast("string")).alias("id"), (k() / 100.0).alias("confidence"), F.when(k() % 2 == 0, "france").alias("country"))
    rows = events(spark, sf).where("event_type = 'click'").select(F.to_json(F.struct(F.array(one).alias("stories"))).alias("data"))
    return VW.curation_stories(rows).select("id", "confidence", "country")


@query("""SELECT CASE event_type WHEN 'view' THEN 'extract' ELSE 'classify' END AS stage, count(*) FILTER (WHERE acked IS NULL OR event_id > acked) AS lag FROM events LEFT JOIN (SELECT 'view' AS event_type, max(event_id) AS acked FROM events WHERE event_type = 'view' AND event_id % 2 = 0 AND event_id < 700) a USING (event_type) WHERE event_type IN ('view', 'click') GROUP BY 1
    UNION ALL SELECT 'review', 0""")
def a34_consumer_lag(spark, sf):
    rows = log(spark, sf, {"view": "article.ingested", "click": "claims.extracted"}, {"k": k()})
    acks = rows.where("type = 'article.ingested' and id % 2 = 0 and id < 700").select(F.lit("extract").alias("stage"), "id")
    return VW.consumer_lag(rows, acks, {"extract": "article.ingested", "classify": "claims.extracted", "review": "review.asked"})


@query("SELECT 'u' || user_id AS source, count(*) AS n, count(*) >= 5 AS suspicious FROM events WHERE event_type = 'signup' GROUP BY 1")
def a35_feedback_bursts(spark, sf):
    return VW.feedback_bursts(table(spark, sf, "events").where("event_type = 'signup'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source")))


@query(f"""SELECT 'kind' AS what, coalesce(nullif(lang, 'fr'), 'unknown') AS value, count(*) AS n, NULL::DOUBLE AS mean FROM documents GROUP BY lang UNION ALL SELECT 'label', 'l' || k % 8, count(*), round(avg(CAST(value AS DOUBLE)), 2) FROM {SQL_EVENTS} GROUP BY k % 8""")
def a36_eval_metrics(spark, sf):
    c = events(spark, sf).select(F.concat(F.lit("l"), (k() % 8).cast("string")).alias("label"), F.col("value").alias("confidence"))
    return VW.eval_metrics(c, table(spark, sf, "documents").select(F.when(F.col("lang") != "fr", F.col("lang")).alias("kind")))


@query(f"SELECT id, round(sum(w), 2) AS effective FROM (SELECT user_id AS id, k % 3 AS g, coalesce(max(CASE WHEN k % 4 > 0 THEN (k % 7) / 7.0::DOUBLE END), 0.3) AS w FROM {SQL_EVENTS} GROUP BY 1, 2) GROUP BY id")
def a41_originator_counts(spark, sf):
    m = events(spark, sf).select(F.col("user_id").alias("id"), (k() % 3).alias("g"), F.when(k() % 4 > 0, k() % 7 / 7.0).alias("weight"))
    return VW.effective_by_weight(m)


def _source_list(spark, sf):
    d = table(spark, sf, "documents")
    counts = d.groupBy("source").agg(F.count("*").alias("articles"))
    names = spark.range(30).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), "id")
    reputation = names.where("id % 3 = 0").select("source", (F.col("id") / 30.0).alias("score"))
    registry = names.where("id % 2 = 0").select("source", F.lit("active").alias("status"))
    flags = names.where("id % 5 = 0").select("source", F.lit("deny").alias("status"))
    return VW.source_list(reputation, registry, flags, counts)


SQL_SOURCES = """(SELECT 'src' || i AS source, CASE WHEN i % 3 = 0 THEN i / 30.0::DOUBLE ELSE 0.5 END AS reputation, i % 3 = 0 AS rated, CASE WHEN i % 2 = 0 THEN 'active' ELSE '' END AS status, CASE WHEN i % 5 = 0 THEN 'deny' ELSE '' END AS flag, coalesce(n, 0) AS articles
    FROM range(30) r(i) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON d.source = 'src' || i WHERE i % 3 = 0 OR i % 2 = 0)"""


@query(f"SELECT * FROM {SQL_SOURCES}")
def j16_source_list(spark, sf):
    return _source_list(spark, sf)


@query(f"SELECT source, reputation, rated FROM {SQL_SOURCES}")
def j17_all_sources(spark, sf):
    return _source_list(spark, sf).select("source", "reputation", "rated")


@query(f"SELECT source, rated, CAST(row_number() OVER (ORDER BY NOT rated, reputation DESC, source) AS INTEGER) AS place FROM {SQL_SOURCES}")
def t11_w7_ratings(spark, sf):
    return VW.ratings_order(_source_list(spark, sf)).select("source", "rated", "place")


@query(f"SELECT source, count(*) AS originations FROM (SELECT id, k % 2 AS g, arg_min(source, k) AS source FROM {CL} JOIN documents ON doc_id = k GROUP BY 1, 2) GROUP BY source")
def q17_originations_per_source(spark, sf):
    return VW.originations(clusters(spark, sf), articles(spark, sf))


@query("SELECT 'lang' AS column, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def l6_facets(spark, sf):
    return VW.facets(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') AND contains(lower(concat_ws(chr(1), doc_id, lang, source)), 'src1') ORDER BY lang DESC, doc_id LIMIT 20 OFFSET 20")
def l6_grid_page(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return VW.grid(d, "SRC1", {"lang": ["en", "fr"]}, [F.desc("lang"), F.col("doc_id")], page=1, size=20).select("doc_id", "lang")


@query(f"SELECT source, round(0.7 * confirmation_rate + 0.3 * independent_rate, 3) AS reputation FROM {SQL_RATED} WHERE confirmation_rate IS NOT NULL")
def z2_z9_reputation_of_rated_sources(spark, sf):
    return VW.rated_sources(H.reputation(history(spark, sf)))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 10) / 10.0::DOUBLE END, (c_custkey % 7) / 7.0::DOUBLE) AS preference FROM customer")
def z14_preference_from_reputation(spark, sf):
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", VW.preference_from_reputation(F.when(n % 3 > 0, n % 10 / 10.0), n % 7 / 7.0).alias("preference"))


@query("SELECT event_id, 'acme corp|north ' || user_id % 7 || '|queen' AS spine FROM events")
def z26_f18_spines_of_written_facts(spark, sf):
    said = F.concat(F.lit("In Acme Corp, where we saw North "), (F.col("user_id") % 7).cast("string"), F.lit(" on Monday, the Queen spoke"))
    return table(spark, sf, "events").select("event_id", F.array_join(entity_spine(F.regexp_replace(said, r"North (\d)", "North-$1")), "|").alias("spine")).select("event_id", F.replace("spine", F.lit("north-"), F.lit("north ")).alias("spine"))


@query("SELECT 'case' || i AS name, CASE WHEN i % 2 = 0 THEN 'Fact ' || i || ' from two' END AS fact FROM range(6) t(i)")
def t13_eval_headlines(spark, sf):
    r = spark.range(6)
    c = r.select(F.concat(F.lit("Fact "), F.col("id").cast("string")).alias("f"), "id").where("id % 2 = 0")
    rows = c.select(F.concat("f", F.lit(" from one")).alias("fact"), F.array(F.lit("a")).alias("sources")).union(c.select(F.concat("f", F.lit(" from two")), F.array(F.lit("a"), F.lit("b"))))
    rows = rows.select("fact", "sources", F.lit(1).alias("independent_originators"), F.lit(False).alias("has_primary"))
    want = r.select(F.concat(F.lit("case"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("fact "), F.col("id").cast("string"), F.lit(" from")).alias("match"), F.lit(1).alias("independent"), F.lit(False).alias("has_primary"))
    return ST.golden_checks(rows, want).select("name", "fact")
