"""Queries over stories, their claims and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as H, stories as ST
from tessera.plans.registry import query
from tessera.plans.score_queries import SQL_RATED
from tessera.plans.stand_ins import SQL_EVENTS, articles, events, history, k
from tessera.session import table


def _clusters(spark, sf):
    """A cluster per user: claims are the distinct k of its views, each k is also an article."""
    e = events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_set(k().cast("long"))).alias("claim_ids"))
    return e.withColumn("originators", F.array("claim_ids")).withColumn("fact", F.concat(F.lit("fact "), F.col("id").cast("string")))


def _claims(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("article_id"), "text", F.col("lang").alias("language"))


SQL_CLUSTERS = f"(SELECT DISTINCT user_id AS id, k FROM {SQL_EVENTS} WHERE event_type = 'view')"


@query(f"SELECT DISTINCT id FROM {SQL_CLUSTERS} WHERE k = 42")
def j2_q6_clusters_of_a_claim(spark, sf):
    return ST.clusters_of_claim(_clusters(spark, sf), 42).select("id")


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS pos, CAST(k AS BIGINT) AS claim_id FROM {SQL_CLUSTERS} QUALIFY k < 90")
def j5_member_claims(spark, sf):
    return ST.member_claims(_clusters(spark, sf), _claims(spark, sf).where("claim_id < 90")).select("id", "pos", "claim_id")


@query(f"SELECT id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM {SQL_CLUSTERS} JOIN documents ON doc_id = k GROUP BY id")
def j6_z1_originator_sources(spark, sf):
    return ST.originator_group_sources(_clusters(spark, sf), articles(spark, sf)).select("id", F.array_join("sources", ",").alias("sources"))


@query(f"SELECT DISTINCT id, source FROM {SQL_CLUSTERS} JOIN documents ON doc_id = k")
def z48_cluster_sources(spark, sf):
    return ST.cluster_sources(_clusters(spark, sf), _claims(spark, sf), articles(spark, sf))


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'view' EXCEPT SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND user_id % 3 = 0")
def j10_superseded(spark, sf):
    c = _clusters(spark, sf)
    return ST.superseded(c, c.where("id % 3 = 0"))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) = 1")
def t12_longest_body(spark, sf):
    m = articles(spark, sf).select(F.col("language").alias("cluster_id"), F.col("id").alias("article_id"), F.lit("data.gov").alias("source"), "body", F.col("id").alias("pos"))
    return ST.longest_primary_body(m).select(F.col("cluster_id").alias("lang"), F.col("article_id").alias("doc_id"))


@query(f"""SELECT user_id AS id, CASE user_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_addressed' ELSE 'contradicted' END AS grounding FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0 AND user_id % 5 <> 0""")
def z41_grounding_pass(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    c = u.select("id", (F.col("id") % 2 == 0).alias("has_primary"), (F.col("id") % 4).alias("independent_originators"), F.lit("notable").alias("extremity"))
    v = u.select("id", F.when(F.col("id") % 3 == 0, "supported").when(F.col("id") % 3 == 1, "not_addressed").otherwise("contradicted").alias("verdict"))
    return ST.ground(c, v, u.where("id % 5 = 0")).select("id", "grounding")


@query("SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY doc_id % 7 = 0, doc_id * 13 % 101 DESC, doc_id % 50 DESC, doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 200")
def t6_t7_ranked_stories(spark, sf):
    n = F.col("doc_id")
    s = table(spark, sf, "documents").select(n.alias("id"), (n % 7 == 0).alias("forecast_only"), (n * 13 % 101).alias("score"), (n % 50).alias("last_updated"))
    top = ST.rank_stories(s).limit(200).withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    return top.select("id", F.row_number().over(Window.orderBy("forecast_only", F.desc("score"), F.desc("last_updated"), "id")).alias("place"))


@query("""SELECT source, CASE WHEN source LIKE '%1%' THEN false WHEN source LIKE '%5' THEN true WHEN source LIKE '%7' THEN false ELSE true END AS accepted FROM (SELECT DISTINCT source FROM documents)""")
def n4_source_gate(spark, sf):
    s = table(spark, sf, "documents").select("source").distinct()
    return s.select("source", ST.gate(F.col("source").contains("1"), F.col("source").endswith("5"), F.when(F.col("source").endswith("7"), F.lit(False))).alias("accepted"))


@query("SELECT n_name AS language FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)")
def s33_locales_without_articles(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier").where("s_acctbal > 9000")
    got = n.join(s, n.n_nationkey == s.s_nationkey).select(F.col("n_name").alias("language"))
    return ST.locales_without_articles(n.select(F.col("n_name").alias("language")), got)


@query("SELECT event_id, CAST(value AS DOUBLE) AS value FROM events WHERE event_type = 'click'")
def s27_trajectory_scan(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'click'").select("event_id", "value")
    return ST.trajectory(e.where("false"), e)


@query("""SELECT count(*) AS n FROM (SELECT 'ui::' || substr(sha1(array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'not', 'but', 'you', 'are', 'was')), 1, 8), ' ')), 1, 12) AS key FROM conversations GROUP BY 1)""")
def a38_feedback_groups(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.lit("ui").alias("category"), "text")
    return ST.group_feedback(c).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 1 END, CASE WHEN doc_id % 10 = 3 THEN -doc_id ELSE doc_id END) AS INTEGER) AS place FROM documents")
def l3_l4_reconciled_order(spark, sf):
    d = table(spark, sf, "documents")
    items, asked = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos")), d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id"), (-F.col("doc_id")).alias("at"))
    return ST.reconcile_order(items, asked.union(asked).union(spark.createDataFrame([(-5, 0)], "id long, at long"))).select("id", "place")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n = 1 GROUP BY conv_id")
def l5_first_turn_summary(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("fact"))
    return c.select("conv_id", ST.summary(F.col("fact"), F.array(F.col("fact"))).alias("summary"))


@query(f"SELECT source, 0.5::DOUBLE AS now, round(greatest(0.2::DOUBLE, least(0.8::DOUBLE, coalesce(confirmation_rate, independent_rate))), 4) AS proposed FROM {SQL_RATED}")
def m13_policy_step(spark, sf):
    h = history(spark, sf)
    none = spark.createDataFrame([], "source string, preference double")
    return ST.policy_step(H.tuned_decay(H.observations(h)), H.reputation(h), none)[1]


@query("SELECT name, fact, n = 3 AS passed FROM (SELECT 'case' || i AS name, 'fact ' || i AS fact, i % 5 AS n FROM range(10) t(i))")
def m16_z38_golden_checks(spark, sf):
    r = spark.range(10)
    c = r.select(F.concat(F.lit("fact "), F.col("id").cast("string")).alias("fact"), (F.col("id") % 5).cast("int").alias("independent_originators"), F.lit(True).alias("has_primary"), F.array(F.lit("s")).alias("sources"))
    x = r.select(F.concat(F.lit("case"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("FACT "), F.col("id").cast("string")).alias("match"), F.lit(3).alias("independent"), F.lit(True).alias("has_primary"))
    return ST.golden_checks(c, x)



@query("SELECT doc_id FROM documents WHERE doc_id IN (5, 17, 400)")
def q21_articles_by_id(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(5, 17, 400)).select("doc_id")



@query(f"SELECT knob, value FROM (SELECT 'knob' || k % 6 AS knob, CAST(value AS DOUBLE) AS value, event_id FROM {SQL_EVENTS} WHERE event_type = 'purchase') QUALIFY row_number() OVER (PARTITION BY knob ORDER BY event_id DESC) = 1")
def q12_latest_proposals(spark, sf):
    from tessera.operators.log import latest

    e = events(spark, sf).where("event_type = 'purchase'").select(F.concat(F.lit("knob"), (k() % 6).cast("string")).alias("knob"), "value", "event_id")
    return latest(e, ["knob"], [F.desc("event_id")]).select("knob", "value")
