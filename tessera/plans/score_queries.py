"""Queries over scores: reads, reputation, calibration, diversity, steering, feed, graph, spend."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.functions import scoring as S
from tessera.functions.identity import is_primary_source
from tessera.operators import diversity as D, feed, graph as G, health, history as H, steering
from tessera.plans.registry import query
from tessera.plans.stand_ins import LEVELS, SQL_EVENTS, SQL_FACTS, SQL_HISTORY, SQL_LEVEL, articles, events, history, level, sql_read, k
from tessera.session import cut, table


@query(f"""SELECT event_id, {sql_read('k % 6', 'k % 7 = 0', "CASE extremity WHEN 'routine' THEN 0.35 WHEN 'ordinary' THEN 0.45 WHEN 'notable' THEN 0.55 WHEN 'significant' THEN 0.66 ELSE 0.76 END::DOUBLE")} AS confidence FROM (SELECT *, {SQL_LEVEL} AS extremity FROM {SQL_EVENTS})""")
def m1_confidence_read(spark, sf):
    return events(spark, sf).select("event_id", S.confidence_read(k() % 6, k() % 7 == 0, level(k())).alias("confidence"))


@query("""SELECT c_custkey, CASE WHEN c >= 0.85 THEN 'Well corroborated' WHEN c >= 0.6 THEN 'Corroborated' WHEN n <= 1 THEN 'Single source' ELSE 'Thinly corroborated' END AS label,
    CASE WHEN c >= 0.85 THEN 'hi' WHEN c >= 0.6 THEN 'mid' WHEN c >= 0.4 THEN 'lo' ELSE 'floor' END AS tier FROM (SELECT c_custkey, c_custkey % 100 / 100.0 AS c, c_custkey % 5 AS n FROM customer)""")
def f27_confidence_labels(spark, sf):
    c = F.col("c_custkey") % 100 / 100.0
    return table(spark, sf, "customer").select("c_custkey", S.confidence_label(c, F.col("c_custkey") % 5, F.lit(False), F.lit("notable")).alias("label"), S.confidence_tier(c).alias("tier"))


@query("""SELECT c_custkey, CASE WHEN s >= 85 THEN 'established' WHEN s >= 65 THEN 'corroborated' WHEN s >= 45 THEN 'developing' WHEN s >= 25 THEN 'thin' ELSE 'single' END AS band,
    CASE WHEN s % 9 = 0 THEN 'not yet rated' WHEN s >= 85 THEN 'highly reliable' WHEN s >= 70 THEN 'generally reliable' WHEN s >= 50 THEN 'mixed reliability' WHEN s >= 30 THEN 'generally unreliable' ELSE 'unreliable' END AS tier FROM (SELECT c_custkey, c_custkey % 101 AS s FROM customer)""")
def f28_f29_bands(spark, sf):
    s = F.col("c_custkey") % 101
    return table(spark, sf, "customer").select("c_custkey", S.score_band(s).alias("band"), S.source_tier(s / 100.0, s % 9 == 0).alias("tier"))


@query(f"SELECT outcome, count(*) AS n FROM {SQL_FACTS} GROUP BY 1")
def m5_a6_outcomes(spark, sf):
    return H.observations(history(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""SELECT fact AS key, CASE WHEN outcome IN ('confirmed', 'refuted') THEN CASE WHEN n_events > 1 AND (last_n > first_n OR last_p <> first_p) THEN 'extended' ELSE 'resolved' END
    WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(last_ts) > 86400 THEN 'decayed' WHEN last_n > first_n THEN 'resolving' ELSE 'dormant' END AS state FROM {SQL_FACTS}""")
def m6_a11_lifecycles(spark, sf):
    return H.lifecycles(history(spark, sf), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).select("key", "state")


SQL_SCORED = f"(SELECT {sql_read('first_n', 'first_p')} AS read, CASE outcome WHEN 'confirmed' THEN 1.0 ELSE 0.0 END::DOUBLE AS target, extremity, first_n, first_p, outcome FROM {SQL_FACTS} WHERE outcome IN ('confirmed', 'refuted'))"


@query(f"SELECT round(avg(power(read - target, 2)), 4) AS brier, count(*) AS n FROM {SQL_SCORED}")
def a4_brier_score(spark, sf):
    return H.brier(H.observations(history(spark, sf)))


@query(f"""SELECT lo, hi, count(*) AS n, round(avg(read), 3) AS predicted, round(avg(target), 3) AS actual FROM {SQL_SCORED} JOIN (VALUES (0.0::DOUBLE, 0.4::DOUBLE), (0.4, 0.6), (0.6, 0.85), (0.85, 1.01)) b(lo, hi) ON read >= lo AND read < hi GROUP BY 1, 2""")
def a5_calibration_bins(spark, sf):
    return H.calibration_bins(H.observations(history(spark, sf)))


SQL_GRID = "(VALUES (0.30::DOUBLE, 1), (0.40, 2), (0.50, 3), (0.55, 4), (0.60, 5), (0.66, 6), (0.70, 7), (0.76, 8), (0.82, 9)) g(v, nth)"
SQL_BASE = "(VALUES ('routine', 0.35::DOUBLE), ('ordinary', 0.45), ('notable', 0.55), ('significant', 0.66), ('extraordinary', 0.76)) b(extremity, current)"


@query(f"""WITH b AS (SELECT * FROM {SQL_BASE}), o AS (SELECT extremity, current, current AS v, 0 AS nth FROM b UNION ALL SELECT extremity, current, v, nth FROM b, {SQL_GRID} WHERE v BETWEEN greatest(0.2::DOUBLE, current - 0.25) AND least(0.9::DOUBLE, current + 0.25)),
    t AS (SELECT o.extremity, current, v, nth, round(avg(power(round(least(CASE WHEN first_p THEN 1 - power(v, first_n) + power(v, first_n) * 0.5 ELSE 1 - power(v, first_n) END, 0.97::DOUBLE), 2) - target, 2)), 4) AS brier FROM o JOIN {SQL_SCORED} s ON s.extremity = o.extremity GROUP BY 1, 2, 3, 4)
    SELECT b.extremity, b.current, coalesce(t.v, b.current) AS tuned FROM b LEFT JOIN (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY extremity ORDER BY brier, nth) = 1) t USING (extremity)""")
def a7_a9_tuned_decay(spark, sf):
    return H.tuned_decay(H.observations(history(spark, sf))).select("extremity", "current", "tuned")


@query(f"""WITH r AS (SELECT read, target, {sql_read('first_n', 'first_p', "0.5::DOUBLE")} AS after FROM {SQL_SCORED}), t AS (SELECT *, CASE WHEN read >= 0.85 THEN 3 WHEN read >= 0.6 THEN 2 WHEN read >= 0.4 THEN 1 ELSE 0 END AS x, CASE WHEN after >= 0.85 THEN 3 WHEN after >= 0.6 THEN 2 WHEN after >= 0.4 THEN 1 ELSE 0 END AS y FROM r)
    SELECT round(avg(power(read - target, 2)), 4) AS brier_base, round(avg(power(after - target, 2)), 4) AS brier_candidate, count(*) AS n_scored, count(*) FILTER (WHERE x <> y) AS flips, count(*) FILTER (WHERE y > x) AS promoted, count(*) FILTER (WHERE y < x) AS demoted FROM t""")
def a8_z45_replay(spark, sf):
    return H.replay_ab(H.observations(history(spark, sf)), dict.fromkeys(LEVELS, 0.5))


SQL_REP = f"""(SELECT source, count(*) AS appearances, count(*) FILTER (WHERE own) AS independent_appearances, count(*) FILTER (WHERE last_p AND prim) AS primary_appearances,
    count(*) FILTER (WHERE last_n = 1 AND last_extremity IN ('significant', 'extraordinary')) AS solo_extraordinary, count(*) FILTER (WHERE outcome = 'confirmed') AS facts_confirmed, count(*) FILTER (WHERE outcome = 'refuted') AS facts_refuted,
    round(coalesce(avg(CASE WHEN own THEN CASE WHEN prim THEN 1.0 ELSE 0.3 END::DOUBLE END), 0), 3) AS mean_attribution_weight
    FROM (SELECT *, source LIKE 'ministry%' AS prim, CASE WHEN last_n = 0 THEN false WHEN last_n = 1 THEN source LIKE 'ministry%' ELSE true END AS own FROM
      (SELECT *, 'src' || last_k % 20 AS source FROM {SQL_FACTS} UNION ALL SELECT *, CASE WHEN last_k % 3 = 0 THEN 'ministry of truth' ELSE 'src' || last_k % 7 END FROM {SQL_FACTS})) GROUP BY source)"""
SQL_RATED = f"(SELECT *, round(independent_appearances / CAST(appearances AS DOUBLE), 3) AS independent_rate, round(facts_confirmed / CAST(nullif(facts_confirmed + facts_refuted, 0) AS DOUBLE), 3) AS confirmation_rate FROM {SQL_REP})"


@query(f"SELECT source, appearances, independent_appearances, primary_appearances, solo_extraordinary, facts_confirmed, facts_refuted, mean_attribution_weight, independent_rate, confirmation_rate FROM {SQL_RATED}")
def a1_a2_reputation(spark, sf):
    return H.reputation(history(spark, sf)).select("source", "appearances", "independent_appearances", "primary_appearances", "solo_extraordinary", "facts_confirmed", "facts_refuted", "mean_attribution_weight", "independent_rate", "confirmation_rate")


@query(f"SELECT source, round(CASE WHEN confirmation_rate IS NOT NULL THEN 0.7 * confirmation_rate + 0.3 * independent_rate ELSE 0.5 * independent_rate END, 3) AS score FROM {SQL_RATED}")
def m8_reputation_scores(spark, sf):
    return H.reputation(history(spark, sf)).select("source", "score")


@query(f"""WITH e AS (SELECT *, rank() OVER (ORDER BY id) AS r FROM {SQL_HISTORY}), c AS (SELECT DISTINCT CAST(greatest(1, round_even((SELECT count(*) FROM events) * i / 8.0, 0)) AS INTEGER) AS cut FROM range(1, 9) t(i)),
    f AS (SELECT cut, fact, arg_min(n, id) AS first_n, arg_max(n, id) AS last_n, arg_max(p, id) AS last_p, bool_or(corrected) AS corrected, arg_max(contradicted, id) AS bad, arg_max(k, id) AS k FROM e JOIN c ON r <= cut GROUP BY 1, 2),
    o AS (SELECT *, CASE WHEN corrected OR bad THEN 'refuted' WHEN last_n >= 3 OR last_p THEN 'confirmed' ELSE 'open' END AS outcome FROM f),
    s AS (SELECT *, 'src' || k % 20 AS source FROM o UNION ALL SELECT *, CASE WHEN k % 3 = 0 THEN 'ministry of truth' ELSE 'src' || k % 7 END FROM o),
    a AS (SELECT source, cut, count(*) AS n, count(*) FILTER (WHERE last_n > 1 OR (last_n = 1 AND source LIKE 'ministry%')) AS own, count(*) FILTER (WHERE outcome = 'confirmed') AS c, count(*) FILTER (WHERE outcome <> 'open') AS t FROM s GROUP BY 1, 2)
    SELECT source, cut, round(CASE WHEN t > 0 THEN 0.7 * round(c / CAST(t AS DOUBLE), 3) + 0.3 * round(own / CAST(n AS DOUBLE), 3) ELSE 0.5 * round(own / CAST(n AS DOUBLE), 3) END, 3) AS score FROM a""")
def a3_w6_reputation_series(spark, sf):
    return H.reputation_series(history(spark, sf))


@query(f"""WITH s AS (SELECT source, appearances, CASE WHEN coalesce(solo_extraordinary / CAST(nullif(independent_appearances, 0) AS DOUBLE), 0) > 0.25 THEN 0.6 ELSE 1 END * CASE WHEN confirmation_rate >= 0.7 AND independent_rate >= 0.6 THEN 1.2 ELSE 1 END *
      (0.5 * CASE WHEN appearances < 5 THEN 0.5 ELSE coalesce(confirmation_rate, 0.35) END + 0.35 * CASE WHEN appearances < 5 THEN 0.5 ELSE independent_rate END + 0.15 * mean_attribution_weight) AS score FROM {SQL_RATED}),
    b AS (SELECT *, greatest(0.02, least(0.3, score)) AS w FROM s), t AS (SELECT sum(w) AS total FROM b)
    SELECT source, round(round(w * CASE WHEN total > 1 THEN 1 / total ELSE 1 END, 4), 3) AS weight, appearances < 5 AS low_evidence FROM b, t""")
def t14_m10_m12_preferences(spark, sf):
    return H.preferences(H.reputation(history(spark, sf))).select("source", F.round("weight", 3).alias("weight"), "low_evidence")


@query(f"""SELECT * FROM (SELECT count(*) AS n_facts, count(*) FILTER (WHERE outcome = 'confirmed') AS confirmed, count(*) FILTER (WHERE outcome = 'refuted') AS refuted, count(*) FILTER (WHERE outcome = 'corroborating') AS corroborating, count(*) FILTER (WHERE outcome = 'unconfirmed') AS unconfirmed FROM {SQL_FACTS}),
    (SELECT round(avg(power(read - target, 2)), 4) AS brier, count(*) AS n_scored, CASE WHEN avg(read - target) > 0.1 THEN 'over-confident' WHEN avg(read - target) < -0.1 THEN 'under-confident' ELSE 'calibrated' END AS flag FROM {SQL_SCORED}),
    (SELECT CASE WHEN age < 3600 THEN 'fresh' WHEN age < 86400 THEN 'stale' ELSE 'stalled' END AS freshness FROM (SELECT epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) AS age FROM events))""")
def a10_z19_calibration_status(spark, sf):
    return H.calibration_status(history(spark, sf), F.to_timestamp(F.lit("2024-01-31 00:00:00"))).select("n_facts", "confirmed", "refuted", "corroborating", "unconfirmed", "brier", "n_scored", "flag", "freshness")


@query("""SELECT c_custkey, CASE WHEN a < b THEN 'a' WHEN b < a THEN 'b' WHEN y - x >= 0.2 THEN 'a' WHEN x - y >= 0.2 THEN 'b' END AS loser FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS a, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS b,
    CAST(c_custkey % 10 AS DOUBLE) AS x, CAST(c_custkey % 7 AS DOUBLE) AS y FROM customer)""")
def m14_arbitration(spark, sf):
    n = F.col("c_custkey")
    ga = F.when(n % 4 == 0, "supported").when(n % 4 == 2, "not_addressed").when(n % 4 == 3, "contradicted")
    gb = F.when(n % 3 == 0, "supported").when(n % 3 == 2, "not_addressed")
    return table(spark, sf, "customer").select("c_custkey", S.arbitrate(ga, (n % 10).cast("double"), gb, (n % 7).cast("double")).alias("loser"))


@query("""SELECT c_custkey, c_acctbal < 1000 AS allowed, round(c_acctbal, 2) AS today FROM customer""")
def p22_spend_gate(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.cap_status(F.col("c_acctbal"), F.lit(1000.0))["allowed"].alias("allowed"), F.round("c_acctbal", 2).alias("today"))


SQL_ART = "(SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CASE doc_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'FR' WHEN 3 THEN 'DE' ELSE 'NG' END END AS country FROM documents)"


def _art(spark, sf):
    n = F.col("doc_id")
    c = F.when(n % 5 == 0, "US").when(n % 5 == 1, "GB").when(n % 5 == 2, "FR").when(n % 5 == 3, "DE").otherwise("NG")
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.when(n % 7 != 0, c).alias("country"))


@query(f"SELECT lang AS language, coalesce(lower(country), 'unknown') AS country, count(*) AS n FROM {SQL_ART} GROUP BY 1, 2")
def a12_strata(spark, sf):
    return D.strata(_art(spark, sf))


@query(f"""WITH s AS (SELECT lang, country, count(*) AS n FROM {SQL_ART} GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(*) AS k FROM s)
    SELECT doc_id, round(total / (k * n), 6) AS weight FROM {SQL_ART} a JOIN s ON a.lang = s.lang AND a.country IS NOT DISTINCT FROM s.country, t""")
def a13_correction_weights(spark, sf):
    return D.correction_weights(_art(spark, sf)).select("doc_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH s AS (SELECT lang, country, count(*) AS n FROM {SQL_ART} GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS k FROM s)
    SELECT count(*) AS strata, round(round(sum(-round(n / total, 6) * log2(round(n / total, 6))), 6), 4) AS entropy_raw, round(round(sum((1 / k) * log2(k)), 6), 4) AS entropy_corrected, round(round(power(sum(total / k), 2) / sum(total * total / (k * k * n)), 4), 3) AS effective_n FROM s, t""")
def a14_a15_bias_summary(spark, sf):
    b = D.bias_summary(_art(spark, sf))
    return b.select("strata", F.round("entropy_raw", 4).alias("entropy_raw"), F.round("entropy_corrected", 4).alias("entropy_corrected"), F.round("effective_n", 3).alias("effective_n"))


@query(f"SELECT doc_id FROM {SQL_ART} QUALIFY row_number() OVER (PARTITION BY lang, country ORDER BY doc_id) <= 3")
def w3_z13_cap_per_stratum(spark, sf):
    return D.cap_per_stratum(_art(spark, sf), 3, "doc_id").select("doc_id")


@query(f"SELECT country, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM (SELECT country, count(*) AS n FROM {SQL_ART} WHERE country IS NOT NULL GROUP BY 1)")
def a16_country_share(spark, sf):
    return D.country_share(_art(spark, sf))


@query(f"SELECT lang AS language, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM (SELECT lang, count(*) AS n FROM {SQL_ART} GROUP BY 1)")
def a17_language_share(spark, sf):
    return D.language_share(_art(spark, sf))


@query(f"""WITH c AS (SELECT country, count(*) AS n FROM {SQL_ART} WHERE country IS NOT NULL GROUP BY 1), s AS (SELECT country, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 4) AS share FROM c), l AS (SELECT count(*) AS languages, max(share) AS top FROM (SELECT round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 4) AS share FROM documents GROUP BY lang)),
    g AS (SELECT round(sum(CASE WHEN country IN ('US', 'GB') THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 4) AS anglo_share, round(sum(share * share), 4) AS hhi, count(*) AS countries FROM s)
    SELECT anglo_share, hhi, countries, languages, round((CASE WHEN anglo_share <= 0.4 THEN 1 ELSE 1 - (anglo_share - 0.4) / 0.6 END + CASE WHEN hhi <= 0.25 THEN 1 ELSE 1 - (hhi - 0.25) / 0.75 END + least(1, countries / 10.0) + least(1, languages / 5.0) + CASE WHEN top <= 0.6 THEN 1 ELSE 1 - (top - 0.6) / 0.4 END)::DOUBLE / 5, 4) AS overall FROM g, l""")
def a18_a21_diversity_score(spark, sf):
    return D.diversity_score(_art(spark, sf)).select("anglo_share", "hhi", "countries", "languages", "overall")


@query(f"SELECT round(avg(CASE WHEN country IN ('US', 'GB', 'CA', 'AU') THEN 1.0 ELSE 0 END::DOUBLE), 6) AS share FROM {SQL_ART}")
def a22_anglosphere_share(spark, sf):
    return D.anglosphere_share(_art(spark, sf)).select(F.round("share", 6).alias("share"))


@query(f"SELECT coalesce(country, '') AS country, count(*) AS n FROM {SQL_ART} GROUP BY 1")
def a23_region_counts(spark, sf):
    return D.region_counts(_art(spark, sf))


@query(f"""SELECT count(*) AS n, round(avg(c), 4) AS mean_confidence, count(*) FILTER (WHERE c >= 0.85) AS high, count(*) FILTER (WHERE c >= 0.7 AND c < 0.85) AS good, count(*) FILTER (WHERE c >= 0.5 AND c < 0.7) AS fair, count(*) FILTER (WHERE c < 0.5) AS weak FROM (SELECT k / 100.0::DOUBLE AS c FROM {SQL_EVENTS})""")
def a28_cluster_rollup(spark, sf):
    return health.cluster_rollup(events(spark, sf).select((k() / 100.0).alias("confidence"), F.lit(False).alias("has_primary"))).drop("with_primary")


@query("""SELECT event_type AS stage, count(*) AS calls, round(count(*) * (1500 / 1e6 * 3 + 600 / 1e6 * 15), 4) AS usd FROM events GROUP BY 1""")
def a30_a32_spend(spark, sf):
    calls = table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"))
    return health.spend(calls, {t: (1500, 600, 3.0, 15.0) for t in ("view", "click", "error", "purchase", "signup")})


@query("""SELECT coalesce(nullif(CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END, ''), 'untagged') AS provider, count(*) AS articles FROM documents GROUP BY 1""")
def a31_q9_by_provider(spark, sf):
    d = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("source")).alias("provider"))
    return health.spend_by_provider(d, 4.0).select("provider", "articles")


def _clusters(spark, sf):
    """Clusters by user: confidence from the last k, sources from the events."""
    e = events(spark, sf)
    return e.groupBy(F.col("user_id").alias("id")).agg((F.max_by("k", "event_id") / 100.0).alias("confidence"), (F.max_by("k", "event_id") % 6).alias("n"))


@query(f"""SELECT user_id AS id, arg_max(k, event_id) / 100.0::DOUBLE AS confidence, arg_max(k, event_id) % 6 AS n FROM {SQL_EVENTS} GROUP BY 1 ORDER BY confidence DESC, n DESC, id LIMIT 40""")
def q7_clusters_by_confidence(spark, sf):
    return feed.page(_clusters(spark, sf).orderBy(F.desc("confidence"), F.desc("n"), "id"), 40)


@query(f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), s AS (SELECT user_id, CAST(ts AS DATE) AS day, max(k) AS k FROM {SQL_EVENTS} GROUP BY 1, 2), f AS (SELECT user_id, min(day) AS f FROM s GROUP BY 1)
    SELECT user_id, d.day, (SELECT arg_max(k, s.day) FROM s WHERE s.user_id = f.user_id AND s.day <= d.day) AS k FROM f JOIN d ON d.day >= f""")
def j14_w4_as_of_per_day(spark, sf):
    s = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("k").alias("k"))
    return feed.as_of(s, "user_id", "day")


@query("""WITH seen AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS id, max(epoch(ts)) AS t FROM events WHERE event_type = 'view' AND user_id = 3 GROUP BY 1) SELECT doc_id AS id, CASE WHEN t IS NULL OR epoch(TIMESTAMP '2024-02-05 00:00:00') - t > 2592000 THEN 1 ELSE 0 END AS novelty FROM documents LEFT JOIN seen ON seen.id = doc_id""")
def p20_t9_novelty(spark, sf):
    seen = events(spark, sf).where("event_type = 'view' and user_id = 3").select(k().cast("long").alias("id"), F.col("ts").cast("timestamp").cast("double").alias("seen_at"))
    stories = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return feed.novel_first(stories, seen, F.to_timestamp(F.lit("2024-02-05 00:00:00")).cast("double")).select("id", "novelty")


@query(f"""WITH s AS (SELECT DISTINCT user_id AS id, 'src' || k % 30 AS source FROM {SQL_EVENTS} WHERE event_type = 'error' AND k < user_id % 4), d AS (SELECT 'src' || i AS source FROM range(2) t(i)), u AS (SELECT DISTINCT user_id AS id FROM events)
    SELECT id FROM u WHERE id NOT IN (SELECT id FROM s LEFT JOIN d USING (source) GROUP BY id HAVING bool_and(d.source IS NOT NULL))""")
def p4_p5_without_denied(spark, sf):
    e = events(spark, sf)
    some = e.where("event_type = 'error' and k < user_id % 4").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(F.concat(F.lit("src"), (k() % 30).cast("string"))).alias("sources"))
    stories = e.select(F.col("user_id").alias("id")).distinct().join(some, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return feed.without_sources(stories, spark.range(2).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))).select("id")


@query(f"""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n, w DESC, source) AS INTEGER) AS fetch_rank FROM (SELECT user_id, event_id, 'src' || k % 12 AS source, CASE WHEN k % 12 < 8 THEN (k % 12) / 20.0 ELSE 0.02 END AS w, row_number() OVER (PARTITION BY user_id, k % 12 ORDER BY event_id) AS n FROM {SQL_EVENTS})
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n, w DESC, source) <= 10""")
def t3_rank_for_fetch(spark, sf):
    c = events(spark, sf).select("user_id", F.col("event_id").alias("pos"), F.concat(F.lit("src"), (k() % 12).cast("string")).alias("source"))
    w = spark.range(8).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") / 20.0).alias("weight"))
    return steering.rank_for_fetch(c, w, 10, ["user_id"]).select("user_id", F.col("pos").alias("event_id"), "fetch_rank")


@query()
def t4_deepening_plan(spark, sf):
    return steering.deepening_plan(H.preferences(H.reputation(history(spark, sf))), ["energy", "trade"])


@query(f"""WITH c AS (SELECT event_id AS pos, 'u' || k AS url, 'src' || k % 20 || '.com' AS source, k FROM {SQL_EVENTS} WHERE event_type = 'click'), n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS nth FROM c)
    SELECT CASE WHEN nth > 1 OR k < 5 THEN 'duplicate' WHEN k % 20 IN (7, 8) THEN 'denied' WHEN k % 6 = 0 THEN 'empty' ELSE 'published' END AS outcome, count(*) AS n FROM n GROUP BY 1""")
def n1_n16_ingest_outcomes(spark, sf):
    e = events(spark, sf).where("event_type = 'click'")
    c = e.select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), k().cast("string")).alias("url"), F.concat(F.lit("src"), (k() % 20).cast("string"), F.lit(".com")).alias("source"), F.when(k() % 6 == 0, "").otherwise("text").alias("body"))
    known = spark.range(5).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    deny = spark.createDataFrame([("src7.com",), ("src8.com",)], "source string")
    return steering.ingest(c, known, deny).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ch, doc_id) AS nth FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS ch FROM documents)) WHERE nth <= 10""")
def s21_source_history(spark, sf):
    a = articles(spark, sf).select("url", "source", F.col("id").alias("pos"))
    return steering.source_history([a.where("pos % 3 = 0"), a], 10).select(F.col("pos").alias("doc_id"), "source")


def _stories(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.floor(F.col("doc_id") / 400).alias("feed"), F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), ((F.col("doc_id") * 37) % 101 / 100.0).alias("confidence"), F.col("lang").alias("country"), "source")


@query()
def t1_t2_diversified_feed(spark, sf):
    """A feed is what one reader is shown: 400 stories. Every document is in one feed."""
    return feed.diversified(_stories(spark, sf), by="feed").select("id", "feed_rank")


@query("""WITH m AS (SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS INTEGER) AS id, event_type FROM events WHERE user_id = 11 AND event_type IN ('view', 'error')), f AS (SELECT id, bool_or(event_type = 'view') AS pinned, bool_or(event_type = 'error') AS hidden FROM m GROUP BY 1)
    SELECT doc_id AS id, CASE WHEN coalesce(hidden, false) THEN 2 WHEN coalesce(pinned, false) THEN 0 ELSE 1 END AS section FROM documents LEFT JOIN f ON f.id = doc_id""")
def t10_p11_tenant_view(spark, sf):
    state = events(spark, sf).where("user_id = 11 and event_type in ('view', 'error')").select(k().cast("long").alias("id"), F.when(F.col("event_type") == "view", "pinned").otherwise("hidden").alias("mark"))
    stories = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"))
    return feed.tenant_view(stories, state).select("id", "section")


def _graph_clusters(spark, sf):
    """One cluster per event of a few types: entities from k, time in seconds, a two-dimensional vector."""
    e = events(spark, sf).where("event_type = 'purchase'")
    ent = F.array_distinct(F.array(F.concat(F.lit("e"), k().cast("string")), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))))
    return e.select(F.col("event_id").cast("string").alias("cluster_id"), ent.alias("spine"), F.array(F.cos(k().cast("double")), F.sin(k().cast("double"))).alias("vector"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.concat(F.lit("fact "), k().cast("string")).alias("fact"))


@query()
def g1_g6_story_graph(spark, sf):
    g = G.story_graph(_graph_clusters(spark, sf))
    return g.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("members")).cast("long"), F.lit(0)).alias("members"))


@query("SELECT count(*) AS members, count(DISTINCT event_id) AS clusters FROM events WHERE event_type = 'purchase'")
def g2_g7_extended_graph(spark, sf):
    """The first half of the clusters is folded and kept, the rest is folded onto it: every cluster lies in one node."""
    c = _graph_clusters(spark, sf)
    half = c.agg(F.avg("ts")).first()[0] or 0.0
    first = cut(G.story_graph(c.where(F.col("ts") < half)))
    more = G.extend_graph(first, c.where(F.col("ts") >= half))
    now = first.where("kind = 'node'").join(more.where("kind = 'node'").select("id"), "id", "left_anti").unionByName(more.where("kind = 'node'"))
    m = now.select(F.explode("members").alias("c"))
    return m.agg(F.count("*").alias("members"), F.countDistinct("c").alias("clusters"))


@query()
def g6_headlines(spark, sf):
    c = _graph_clusters(spark, sf)
    return G.headlines(G.story_graph(c), c)


@query(f"""WITH c AS (SELECT DISTINCT user_id AS id, k FROM {SQL_EVENTS} WHERE event_type = 'view'), t AS (SELECT id, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, id LIMIT 20) SELECT DISTINCT c.id, d.source FROM c JOIN t USING (id) JOIN documents d ON d.doc_id = c.k""")
def j19_g11_fact_source_graph(spark, sf):
    e = events(spark, sf).where("event_type = 'view'").select(F.col("user_id").alias("id"), "k").distinct()
    clusters = e.groupBy("id").agg(F.collect_list(F.col("k").cast("long")).alias("claim_ids"), F.count("*").alias("independent_originators"))
    claims = e.select(F.col("k").cast("long").alias("claim_id"), F.col("k").cast("long").alias("article_id")).distinct()
    return G.fact_source_edges(clusters, claims, articles(spark, sf), 20)






def _facts(spark, sf):
    e = events(spark, sf).where("event_type = 'signup'")
    g = F.when(k() % 2 == 0, F.array(F.concat(F.lit("src"), (k() % 20).cast("string")))).otherwise(F.array(F.concat(F.lit("src"), (k() % 20).cast("string")), F.lit("nobody")))
    return e.select(F.col("user_id").alias("story_id"), F.col("event_id").alias("id"), F.col("event_id").alias("pos"), (k() / 100.0).alias("confidence"), (k() % 5).alias("independent_originators"), (k() % 7 == 0).alias("has_primary"), level(k()).alias("extremity"), F.array(g).alias("originator_sources"), F.lit(None).cast("string").alias("grounding"), F.lit(False).alias("disputed"))


@query(f"""WITH f AS (SELECT user_id AS s, event_id AS id, k, k % 5 AS n, k % 7 = 0 AS p, {SQL_LEVEL} AS extremity, k % 20 < 10 AS rated, 0.6 + 0.4 * CASE WHEN k % 20 < 10 THEN (k % 20) / 10.0 ELSE 0.5 END::DOUBLE AS effective FROM {SQL_EVENTS} WHERE event_type = 'signup'),
    h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, id) = 1), a AS (SELECT s, count(*) FILTER (WHERE k >= 70) AS strong_all, bool_or(rated) AS any_rated FROM f GROUP BY s),
    b AS (SELECT h.*, any_rated, strong_all - CASE WHEN k >= 70 THEN 1 ELSE 0 END AS strong, {sql_read('effective', 'p')} AS b0 FROM h JOIN a USING (s)),
    c AS (SELECT *, CASE WHEN strong > 0 THEN least(0.99::DOUBLE, b0 + least(0.03::DOUBLE * strong, 0.09::DOUBLE)) ELSE b0 END AS b1 FROM b), d AS (SELECT *, NOT any_rated AND b1 > 0.7 AS capped FROM c),
    x AS (SELECT *, CAST(round(greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN capped THEN 0.7 ELSE b1 END)) * 100) AS INTEGER) AS score FROM d)
    SELECT s AS story_id, score, CASE WHEN score >= 85 THEN 'established' WHEN score >= 65 THEN 'corroborated' WHEN score >= 45 THEN 'developing' WHEN score >= 25 THEN 'thin' ELSE 'single' END AS band, capped,
    array_to_string(list_filter([n || ' independent originator' || CASE WHEN n <> 1 THEN 's' ELSE '' END || CASE WHEN rated THEN ', 1 with a track record' ELSE '' END, CASE WHEN strong > 0 THEN strong || ' corroborating fact' || CASE WHEN strong <> 1 THEN 's' ELSE '' END || ' in the story' END,
      CASE WHEN extremity IN ('significant', 'extraordinary') THEN extremity || ' claim — bar raised' END, CASE WHEN capped THEN 'carriers not yet proven — capped' END], lambda y: y IS NOT NULL), '; ') AS why FROM x""")
def m9_a42_credibility(spark, sf):
    rep = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") / 10.0).alias("reputation"))
    return feed.credibility(_facts(spark, sf), rep).select("story_id", "score", "band", "capped", F.array_join("why", "; ").alias("why"))


@query(f"""SELECT event_id AS id, round(0.6 + 0.4 * CASE WHEN k % 20 < 10 THEN (k % 20) / 10.0 ELSE 0.5 END::DOUBLE, 6) AS effective, CASE WHEN k % 20 < 10 THEN 1 ELSE 0 END AS rated FROM {SQL_EVENTS} WHERE event_type = 'signup'""")
def a42_effective_originators(spark, sf):
    rep = spark.range(10).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") / 10.0).alias("reputation"))
    return feed.effective_originators(_facts(spark, sf), rep).select("id", F.round("effective", 6).alias("effective"), F.col("rated").cast("int").alias("rated"))
