"""Queries over single rules of the folds, over snapshots and rebuilds, streams, commands and queues."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import admin, feed, folds, graph as G, health, log as L, originators as O, similarity as SIM, states, stories as ST
from tessera.operators.log import LOG_SCHEMA
from tessera.plans import log_queries
from tessera.plans.registry import ORACLES, query
from tessera.plans.text_queries import CANONICAL, SQL_NAMES, _case, _names
from tessera.functions.scoring import DECAY as S_DECAY
from tessera.plans.stand_ins import LEVELS, SQL_EVENTS, articles, events, k, log
from tessera.session import cut, shared_dir, table
from tessera.streaming import keyed, stream

S = lambda p, c: F.concat(F.lit(p), c.cast("string"))


@query(f"""SELECT CAST(user_id AS VARCHAR) AS id, arg_max(k, event_id) / 100.0::DOUBLE AS confidence, arg_max('g' || k % 3, event_id) FILTER (WHERE event_type = 'click') AS grounding
    FROM {SQL_EVENTS} e JOIN (SELECT user_id, min(event_id) AS born FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id) WHERE event_type IN ('view', 'click') AND event_id >= born GROUP BY user_id""")
def k6_grounding_overwrites_confidence(spark, sf):
    judged = F.col("event_type") == "click"
    rows = log(spark, sf, {"view": "cluster.corroborated", "click": "cluster.grounded"}, {"confidence": k() / 100.0, "grounding": F.when(judged, S("g", k() % 3))})
    return folds.clusters(rows).select("id", "confidence", "grounding")


@query("""SELECT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id HAVING max(event_id) FILTER (WHERE event_type = 'view') > coalesce(max(event_id) FILTER (WHERE event_type = 'signup'), -1)""")
def k13_removed_clusters(spark, sf):
    rows = log(spark, sf, {"view": "cluster.corroborated", "signup": "cluster.removed"}, {"confidence": k() / 100.0})
    return folds.clusters(rows).select("id")


SQL_CLAIMS = f"(SELECT 'c' || k AS c, event_id AS id, event_type AS t, user_id % 3 AS v, k FROM {SQL_EVENTS}), born AS (SELECT c, min(id) AS b FROM e WHERE t = 'view' GROUP BY c)"


def _claims(spark, sf, kinds, fields):
    c = S("c", k())
    rows = log(spark, sf, {"view": "claims.extracted"} | kinds, {"claims": F.array(F.struct(c.alias("id"))), "target": c, "claim_id": c} | fields)
    return folds.claims(rows)


@query(f"WITH e AS {SQL_CLAIMS} SELECT c AS claim_id, coalesce(bool_or(t = 'error' AND id > b), false) AS disputed FROM born JOIN e USING (c) GROUP BY c")
def k8_disputes_are_never_cleared(spark, sf):
    return _claims(spark, sf, {"error": "claim.disputed"}, {}).select("claim_id", "disputed")


@query(f"""WITH e AS {SQL_CLAIMS} SELECT c AS claim_id, arg_max('voice' || v, id) FILTER (WHERE t = 'click' AND id > b AND v > 0) AS voice, coalesce(bool_or(t = 'click' AND id > b), false) AS corrected FROM born JOIN e USING (c) GROUP BY c""")
def k11_corrections_keep_what_they_do_not_name(spark, sf):
    voice = F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 > 0), S("voice", F.col("user_id") % 3))
    return _claims(spark, sf, {"click": "admin.classification.corrected"}, {"voice": voice}).select("claim_id", "voice", "corrected")


@query(f"""WITH e AS {SQL_CLAIMS} SELECT c AS claim_id, coalesce(arg_max(v > 0, id) FILTER (WHERE t = 'purchase' AND id > b), false) AS laundering_flag, coalesce(bool_or(t = 'purchase' AND id > b), false) AS corrected FROM born JOIN e USING (c) GROUP BY c""")
def k12_laundering_flags(spark, sf):
    return _claims(spark, sf, {"purchase": "admin.laundering.flagged"}, {"flagged": F.col("user_id") % 3 > 0}).select("claim_id", "laundering_flag", "corrected")


@query("""WITH r AS (SELECT max(event_id) AS start FROM events WHERE event_type = 'error'), e AS (SELECT 'n' || user_id AS f, event_type AS kind, 'n' || event_id % 9 AS t FROM events, r WHERE event_type IN ('error', 'view') AND event_id >= start) SELECT DISTINCT kind, f AS from_id, t AS to_id FROM e""")
def k9_rebuilt_graph_replaces_edges(spark, sf):
    edge = F.struct(F.col("event_type").alias("kind"), S("n", F.col("user_id")).alias("from_id"), S("n", F.col("event_id") % 9).alias("to_id"))
    rows = log(spark, sf, {"error": "story.graph.rebuilt", "view": "story.graph.delta"}, {"edges": F.array(edge)})
    return folds.story_graph_tables(rows)["edges"].select("kind", "from_id", "to_id")


@query(f"SELECT CAST(user_id AS VARCHAR) AS stream_id, arg_max(event_type, event_id) AS type, max(event_id) AS id FROM {SQL_EVENTS} GROUP BY user_id")
def n13_n15_k17_rebuild_from_a_snapshot(spark, sf):
    """The table at half of the log is written as a snapshot and restored; the rest of the log is replayed over it."""
    rows = log(spark, sf, {t: t for t in ("view", "click", "error", "purchase", "signup")}, {"k": k()})
    last = lambda df: L.latest(df.select("stream_id", "type", "id"), ["stream_id"], [F.desc("id")])
    half = rows.agg((F.max("id") / 2).cast("long")).first()[0] or 0
    folder = f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}"
    before = last(rows.where(F.col("id") <= half))
    L.snapshot(spark, {"streams": before}, half, folder)
    old, mark = L.restore(spark, folder, "streams", before.schema)
    return last(old.unionByName(L.since(rows, mark).select("stream_id", "type", "id")))


@query("SELECT event_id, '{\"stream_id\":\"' || user_id || '\",\"type\":\"' || event_type || '\",\"data\":{\"target\":\"' || event_id || '\",\"actor\":\"me\",\"reason\":\"why\",\"level\":' || user_id || '},\"tenant_id\":\"t\"}' AS event FROM events")
def n7_n8_envelopes(spark, sf):
    data = L.operator_event(F.col("event_id").cast("string"), F.lit("why"), "me", level=F.col("user_id"))
    return table(spark, sf, "events").select("event_id", L.envelope(F.col("user_id").cast("string"), F.col("event_type"), data, "t").alias("event"))


@query(f"SELECT event_id % 200 AS id, 'stage' || event_id % 3 AS stage, arg_max('e' || k, k * 100000 + event_id) AS error FROM {SQL_EVENTS} WHERE k >= 6 GROUP BY 1, 2")
def n11_n12_dead_letters_per_stage(spark, sf):
    tries = events(spark, sf).select((F.col("event_id") % 200).alias("id"), S("stage", F.col("event_id") % 3).alias("stage"), (k() * 100000 + F.col("event_id")).alias("n"), S("e", k()).alias("error"))
    return admin.dead_letters(tries, 600000).select("id", "stage", "error")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 500")
def s1_log_scan_past_watermark(spark, sf):
    return L.since(table(spark, sf, "events").withColumnRenamed("event_id", "id"), 500).select(F.col("id").alias("event_id"), "user_id", "event_type")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def s2_w10_daily_counts_of_a_stream(spark, sf):
    """The log read as a stream, counted by day and type; batches write what has changed to files."""
    e = stream.read_log(spark, sf, schema=table(spark, sf, "events").schema, files="events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    done = keyed.run_to_table(stream.daily_counts(e, time="at", by="event_type"), ["day", "event_type"], _new_folder(spark))
    return done.select("event_type", F.to_date("day").alias("day"), "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def s3_w2_latest_state_of_a_stream(spark, sf):
    e = stream.read_log(spark, sf, schema=table(spark, sf, "events").schema, files="events.parquet")
    return keyed.run_to_table(stream.latest_state(e, "user_id", "event_type", "event_id"), ["user_id"], _new_folder(spark))


def _new_folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _landed(spark, sf, rows):
    """A log as a stream of files: what has landed, in five parts by id."""
    folder = _new_folder(spark)
    last = rows.agg(F.max("id")).first()[0] or 0
    rows = rows.withColumn("part", F.least(F.floor(F.col("id") * 5 / max(1, last)), F.lit(4)))
    for i in range(5):  # one after another, as logs land; a stream takes files in the order of their times
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return stream.read_log(spark, f"{folder}/log", files_per_trigger=1), folder


@query(ORACLES["k4_clusters_with_grounding_and_removal"])
def s3_k4_k6_k13_clusters_of_a_stream(spark, sf):
    """The table of clusters from a stream in five batches, by keyed state."""
    events, folder = _landed(spark, sf, log_queries.cluster_log(spark, sf))
    done = keyed.run_to_table(keyed.cluster_rows(events), ["id"], f"{folder}/done")
    return done.where("alive").select("id", "independent_originators", "confidence", "grounding")


@query(ORACLES["k3_claims_classified_corrected_disputed"])
def s3_k3_k8_k11_claims_of_a_stream(spark, sf):
    """The table of claims from a stream in five batches, by keyed state."""
    events, folder = _landed(spark, sf, log_queries.claim_log(spark, sf))
    return keyed.run_to_table(keyed.claim_rows(events), ["claim_id"], f"{folder}/done").select("claim_id", "kind", "corrected", "disputed")


@query(ORACLES["k7_relations_last_score"])
def s2_k7_relations_kept_by_batches(spark, sf):
    """The table of relations from a fold's state that each batch is merged into."""
    events, folder = _landed(spark, sf, log_queries.relation_log(spark, sf))
    fold = states.FOLDS["claim_relations"]
    stream.fold_batches(events, fold, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return stream.folded(spark, f"{folder}/state", fold)


def _from_snapshot(spark, rows, name):
    """A fold's table from its state at a third of the log, brought to two thirds, and the tail."""
    folder, last = _new_folder(spark), rows.agg(F.max("id")).first()[0] or 0
    mark = states.save(rows.where(F.col("id") <= last // 3), folder, [name])
    mark = states.advance(spark, folder, mark, rows.where(F.col("id") <= last * 2 // 3), [name])
    return states.rebuilt(spark, folder, mark, rows, name)


@query(ORACLES["k1_article_upsert"])
def n13_k1_articles_from_a_snapshot(spark, sf):
    return _from_snapshot(spark, log_queries.article_log(spark, sf), "articles").select("id", "title", "source", "body", F.to_date("ingested_at").alias("day"))


@query(ORACLES["k3_claims_classified_corrected_disputed"])
def n14_k3_claims_from_a_snapshot(spark, sf):
    return _from_snapshot(spark, log_queries.claim_log(spark, sf), "claims").select("claim_id", "kind", "corrected", "disputed")


@query(ORACLES["k4_clusters_with_grounding_and_removal"])
def n15_k4_clusters_from_a_snapshot(spark, sf):
    return _from_snapshot(spark, log_queries.cluster_log(spark, sf), "clusters").select("id", "independent_originators", "confidence", "grounding")


@query(ORACLES["k5_daily_snapshots_last_write"])
def k17_k5_daily_snapshots_from_a_snapshot(spark, sf):
    return _from_snapshot(spark, log_queries.snapshot_log(spark, sf), "cluster_snapshots").select("cluster_id", "snapshot_day", "confidence")


@query(ORACLES["k16_signups_by_email"])
def k17_k16_signups_from_a_snapshot(spark, sf):
    return _from_snapshot(spark, log_queries.signup_log(spark, sf), "acquisition_signups").select("email", "hits", "beta", "platform", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"))


@query("""WITH t AS (SELECT 'stage' || event_id % 3 AS stage, user_id AS id, event_id, event_type <> 'view' AND event_type <> 'click' AS failed FROM events),
    r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY stage, id ORDER BY event_id) AS run FROM t),
    c AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY stage, id, run ORDER BY event_id) AS n FROM r)
    SELECT stage, id, CAST(4 AS INTEGER) AS attempt, 'e' || min(event_id) AS error FROM c WHERE failed AND n = 4 GROUP BY stage, id""")
def n10_n12_dead_letters_of_a_stream(spark, sf):
    """Deliveries that fail four times running, each a dead letter once, from a stream in five batches by keyed state."""
    e = events(spark, sf)
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("stream_id"), F.col("event_type").alias("type"), F.lit("{}").alias("data"), F.lit("default").alias("tenant_id"), F.col("ts").cast("timestamp").alias("created_at"))
    landed, folder = _landed(spark, sf, rows)
    tries = landed.select(S("stage", F.col("id") % 3).alias("stage"), F.col("stream_id").cast("long").alias("id"), F.col("id").alias("at"), F.col("type").isin("view", "click").alias("ok"), S("e", F.col("id")).alias("error"))
    keyed.write_by_batch(keyed.counted_deliveries(tries, 4), f"{folder}/tries", f"{folder}/checkpoint", "append").awaitTermination()
    return spark.read.parquet(f"{folder}/tries").where("dead").select("stage", "id", "attempt", "error")


@query("SELECT DISTINCT k FROM (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE k IS NOT NULL")
def n9_once_across_batches(spark, sf):
    """Keys appended once, whatever batches of a stream they come in."""
    rows = log_queries.relation_log(spark, sf).join(events(spark, sf).select(F.col("event_id").alias("id"), "k"), "id").withColumn("stream_id", F.col("k").cast("string")).drop("k")
    landed, folder = _landed(spark, sf, rows.select(LOG_SCHEMA.fieldNames()))
    stream.append_batches(landed, f"{folder}/out", f"{folder}/checkpoint", "stream_id").awaitTermination()
    return spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/out").select(F.col("stream_id").cast("int").alias("k"))


@query("""SELECT source, CASE WHEN i % 5 = 0 THEN 'by hand' ELSE 'group ' || i // 4 END AS owner_label FROM (SELECT DISTINCT source, substr(source, 4)::INTEGER AS i FROM documents) WHERE i % 5 = 0 OR i % 2 = 0""")
def r11_manual_groups_win(spark, sf):
    n = table(spark, sf, "documents").select(F.col("source").alias("canonical"), F.substring("source", 4, 9).cast("int").alias("id")).distinct()
    auto = n.where("id % 2 = 0").select("canonical", S("group ", F.floor(F.col("id") / 4)).alias("owner_label"))
    return folds.with_manual_groups(auto, n.where("id % 5 = 0").select("canonical", F.lit("by hand").alias("owner_label"))).select(F.col("canonical").alias("source"), "owner_label")


@query("SELECT event_id AS id FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 25")
def r14_feedback_queue(spark, sf):
    return admin.feedback_queue(log(spark, sf, {"signup": "feedback.submitted"}, {"k": k()}), 25).select("id")


@query(f"WITH t AS (SELECT 'i' || k AS item_id, CASE WHEN user_id % 2 = 0 THEN 'review' ELSE 'auto-fix' END AS route, event_id FROM {SQL_EVENTS} WHERE event_type = 'click') SELECT item_id, arg_max(event_id, event_id) AS at FROM t WHERE route = 'auto-fix' GROUP BY item_id")
def r18_auto_fix_queue(spark, sf):
    route = F.when(F.col("user_id") % 2 == 0, "review").otherwise("auto-fix")
    rows = log(spark, sf, {"click": "feedback.triaged"}, {"item_id": S("i", k()), "route": route, "category": F.col("event_id").cast("string")})
    return folds.routed_feedback(rows, "auto-fix", route_first=True).select("item_id", F.col("category").cast("long").alias("at"))


@query(f"SELECT 'c' || k AS claim, arg_max('en' || event_id, event_id) AS text_en FROM {SQL_EVENTS} WHERE event_type = 'view' GROUP BY k")
def r19_latest_pivot_per_claim(spark, sf):
    return admin.latest_state_by(log(spark, sf, {"view": "claim.pivoted"}, {"claim": S("c", k()), "text_en": S("en", F.col("event_id"))}), "claim.pivoted", "claim", "text_en")


@query(f"SELECT id, bool_or(k % 13 = 1) AS corrected FROM (SELECT DISTINCT user_id AS id, k FROM {SQL_EVENTS} WHERE event_type = 'view') GROUP BY id")
def r21_harvested_snapshots(spark, sf):
    c = events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.collect_set(k()).alias("claim_ids"))
    no = F.lit(False)
    claims = spark.range(100).select(F.col("id").cast("int").alias("claim_id"), no.alias("corrected"), no.alias("laundering_flag"), (F.col("id") % 13 == 1).alias("disputed"))
    return folds.harvest(c, claims, F.lit("2024-01-31")).select("id", "corrected")


SQL_PROMPTS = f"(SELECT 'p' || k % 25 AS key, row_number() OVER (PARTITION BY k % 25 ORDER BY event_id) AS version, 't' || event_id AS text, event_id FROM {SQL_EVENTS} WHERE event_type = 'click')"


def _prompts(spark, sf):
    return log(spark, sf, {"click": "admin.prompt.updated", "view": "admin.prompt.reviewed"}, {"target": S("p", k() % 25), "text": S("t", F.col("event_id")), "version": k() % 4 + 1})


@query(f"SELECT coalesce(max(text), 'none') AS text FROM {SQL_PROMPTS} WHERE key = 'p7' AND event_id = (SELECT max(event_id) FROM {SQL_PROMPTS} WHERE key = 'p7')")
def r22_active_prompt(spark, sf):
    return admin.active_text(_prompts(spark, sf), "p7", "none")


@query(f"SELECT p.key, CAST(p.version AS INTEGER) AS version, r.key IS NOT NULL AS reviewed FROM {SQL_PROMPTS} p LEFT JOIN (SELECT DISTINCT 'p' || k % 25 AS key, k % 4 + 1 AS version FROM {SQL_EVENTS} WHERE event_type = 'view') r ON r.key = p.key AND r.version = p.version")
def r23_q13_reviewed_prompts(spark, sf):
    return admin.reviewed_prompts(_prompts(spark, sf)).select("key", "version", "reviewed")


def _knobs(spark, sf):
    """Events as promoted settings of knobs: a level's decay, the lift, or one that nothing has."""
    names = [*(f"decay.{x}" for x in LEVELS), "primary_lift", "unheard.of"]
    e = events(spark, sf)
    return e.select(F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, names)), k() % 7 + 1).alias("knob"), ((k() + 1) / 200.0).alias("value"))


SQL_LEVELS = "(VALUES (0, 'routine', 0.35::DOUBLE), (1, 'ordinary', 0.45), (2, 'notable', 0.55), (3, 'significant', 0.66), (4, 'extraordinary', 0.76)) t(i, level, base)"


@query(f"""WITH last AS (SELECT k % 7 AS i, arg_max((k + 1) / 200.0::DOUBLE, event_id) AS v FROM {SQL_EVENTS} GROUP BY 1)
    SELECT level AS extremity, coalesce(v, base) AS decay, coalesce((SELECT v FROM last WHERE i = 5), 0.5) AS lift FROM {SQL_LEVELS} LEFT JOIN last USING (i)""")
def r8_parameters_from_knobs(spark, sf):
    got = admin.overrides(_knobs(spark, sf))
    return spark.createDataFrame([(x, got["decay"][x], got["lift"]) for x in LEVELS], "extremity string, decay double, lift double")


@query(f"""WITH p AS (SELECT DISTINCT k % 7 AS i, (k + 1) / 200.0::DOUBLE AS v FROM {SQL_EVENTS} WHERE k % 7 < 5)
    SELECT p.v AS proposed, level AS extremity, CASE WHEN p.i = t.i THEN p.v ELSE base END AS decay FROM p CROSS JOIN {SQL_LEVELS}""")
def z46_knob_candidates(spark, sf):
    """One table of decays for each proposal of a level's decay."""
    found = [(next((c[x] for x in LEVELS if c[x] != S_DECAY[x]), None), c) for c in admin.knob_candidates(_knobs(spark, sf))]
    return spark.createDataFrame([(p, x, c[x]) for p, c in found for x in LEVELS], "proposed double, extremity string, decay double")


@query("SELECT event_id AS id, '{\"type\":\"article.ingested\",\"stream_id\":\"' || user_id || '\",\"at\":\"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '\",\"data\":\"x\"}' AS message FROM events WHERE event_type = 'view'")
def z39_live_messages(spark, sf):
    rows = log(spark, sf, {"view": "article.ingested"}, {"k": k()}).withColumn("data", F.lit("x")).withColumn("created_at", F.date_format(F.col("created_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    return admin.live_messages(rows)


@query("SELECT CAST(doc_id AS VARCHAR) AS stream_id, 'feedback.triaged' AS type, '{\"target\":\"' || doc_id || '\",\"actor\":\"me\",\"reason\":\"r\",\"route\":\"' || source || '\"}' AS data FROM documents")
def q22_z32_commands(spark, sf):
    return admin.command_events(table(spark, sf, "documents"), "triage-feedback", F.col("doc_id"), F.lit("r"), "me", route=F.col("source"))


@query("SELECT 'c' || conv_id AS stream_id, '{\"user_id\":\"u\",\"cluster_id\":\"c' || conv_id || '\",\"comment_id\":\"cm-' || substr(sha1('u|c' || conv_id || '|b' || turn), 1, 16) || '\",\"body\":\"b' || turn || '\"}' AS data FROM conversations")
def z34_comment_events(spark, sf):
    c = table(spark, sf, "conversations").select(F.lit("u").alias("user_id"), S("c", F.col("conv_id")).alias("cluster_id"), F.lit(None).cast("string").alias("comment_id"), S("b", F.col("turn")).alias("body"))
    return admin.social_events(c, "comment.added").select("stream_id", "data")


@query("""WITH s AS (SELECT event_type AS stage, count(*) AS n, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) AS age FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
    SELECT 'critical' AS level, stage || ' is stalled' AS message FROM s WHERE age >= 86400 UNION ALL SELECT 'warn', 'idle is never' UNION ALL SELECT 'warn', (SELECT count(*) FROM events WHERE event_type = 'error') || ' dead letters' UNION ALL SELECT 'warn', 'pages is empty'""")
def z20_alerts(spark, sf):
    rows = log(spark, sf, {"view": "view", "click": "click"}, {"k": k()})
    stages = health.stage_health(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), {"view": "view", "click": "click", "idle": "idle"})
    sizes = spark.createDataFrame([("pages", 0), ("events", 5)], "table string, n long")
    return health.alerts(stages, table(spark, sf, "events").where("event_type = 'error'"), sizes).select("level", "message")


@query("SELECT CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) >= 86400 THEN 'stalled' ELSE 'degraded' END AS status FROM events WHERE event_type = 'view'")
def z21_a29_overall_status(spark, sf):
    rows = log(spark, sf, {"view": "view"}, {"k": k()})
    stages = health.stage_health(rows, F.to_timestamp(F.lit("2024-01-31 00:00:00")), {"view": "view"})
    return health.overall_status(stages, table(spark, sf, "events").where("event_type = 'error'"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id <> 5 ORDER BY (doc_id * 7) % 101 DESC, doc_id LIMIT 30")
def q15_merge_candidates(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") * 7 % 101).alias("confidence"))
    return feed.page(admin.other_clusters(c, 5), 30).select("id")


@query("SELECT doc_id AS id, place FROM (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS place FROM documents) WHERE place > 3 AND place <= 203 AND place <= 3 + 200")
def t8_page_bounds(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("place"))
    return feed.page(d.orderBy("id"), 5000, 3)


@query("SELECT c.conv_id * 1000 + c.turn AS claim_id, c.text, coalesce(d.source, '') AS source, coalesce(nullif(d.lang, ''), 'en') AS language FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 3")
def p1_j1_j4_q5_claims_with_articles(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), (F.col("conv_id") * 3).alias("article_id"), "text")
    return feed.build_claims(c, articles(spark, sf)).select("claim_id", "text", "source", "language")


@query(f"""WITH m AS (SELECT DISTINCT user_id AS id, k, lang FROM {SQL_EVENTS} JOIN documents ON doc_id = k WHERE event_type = 'view')
    SELECT id, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, arg_min('u' || k, k) FILTER (WHERE k % 2 = 1) AS first_url, count(*) FILTER (WHERE k % 3 = 0) > count(*) FILTER (WHERE k % 3 = 1) AS is_forecast, bool_or(k % 50 = 7) AS disputed FROM m GROUP BY id""")
def p2_a39_f36_z7_stories(spark, sf):
    c = events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_set(k().cast("long"))).alias("claim_ids"))
    c = c.select("*", F.lit(0.5).alias("confidence"), F.lit(2).alias("independent_originators"), F.lit(False).alias("has_primary"), F.lit("notable").alias("extremity"))
    n = F.col("doc_id")
    claims = table(spark, sf, "documents").select(n.alias("claim_id"), "text", F.col("lang").alias("language"), F.when(n % 2 == 1, S("u", n)).otherwise("").alias("url"), F.when(n % 3 == 0, "projection").when(n % 3 == 1, "fact").alias("kind"), (n % 50 == 7).alias("disputed"))
    return feed.build_stories(c, claims).select("id", F.size("claims").cast("long").alias("n"), F.array_join("languages", ",").alias("languages"), "first_url", "is_forecast", "disputed")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'resolved' END AS state FROM documents")
def p10_accuracy_annotation(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), S(" Fact  N", F.col("doc_id")).alias("fact"))
    states = table(spark, sf, "documents").where("doc_id % 3 = 0").select(S("fact n", F.col("doc_id")).alias("key"), F.lit("resolved").alias("state"))
    return feed.annotate_accuracy(d, states).select("id", "state")


@query(f"""SELECT DISTINCT user_id AS id, CASE user_id % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' ELSE '' END AS country, CASE user_id % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' ELSE 'XX' END AS resolved FROM events""")
def f6_f7_story_countries(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    c = u.select("id", F.array(F.array(F.lit(0), (F.col("id") % 3 + 1).cast("int"))).alias("originators"))
    a = spark.createDataFrame([(0, "wire"), (1, "bbc.co.uk"), (2, "plain"), (3, "plain")], "id int, source string")
    lang = u.select("id", F.lit(0).alias("pos"), F.when(F.col("id") % 3 == 1, "fr").otherwise("en").alias("language"))
    got = feed.story_country(c, a, lang)
    return got.select("id", "country", feed.resolved_country(F.col("country"), F.lit("XX")).alias("resolved"))


@query("SELECT 'n' || doc_id // 3 AS node_id, string_agg(doc_id, ',' ORDER BY doc_id) AS stories, CASE WHEN doc_id // 3 % 2 = 0 THEN 1 ELSE 0 END AS n_edges FROM documents GROUP BY doc_id // 3 HAVING count(*) >= 2")
def j7_g10_threads(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), S("n", F.floor(F.col("doc_id") / 3)).alias("node_id"))
    edges = d.where("id % 6 = 0").select(F.col("node_id").alias("from_id"), F.lit("n0").alias("to_id"), F.lit("spawns").alias("kind"))
    return feed.threads(d.select("id", "pos"), d.select("id", "node_id"), edges).select("node_id", F.array_join("story_ids", ",").alias("stories"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"))


@query("SELECT 2 * r_regionkey AS a, 2 * r_regionkey + 1 AS b, CASE WHEN r_regionkey % 2 = 0 THEN 2 * r_regionkey + 1 ELSE 2 * r_regionkey END AS disputed_claim FROM region WHERE r_regionkey <> 4")
def z40_contradictions(spark, sf):
    """Pairs of claims judged both ways; the worse grounded one is disputed, and pairs of one cluster are left alone."""
    n = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("r"))
    near = n.select((2 * F.col("r")).alias("a"), (2 * F.col("r") + 1).alias("b"))
    scores = near.select("a", "b", F.lit("contradiction").alias("label"), F.lit(0.9).alias("p")).union(near.select("b", "a", F.lit("neutral"), F.lit(0.4)))
    claim = n.select("r", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    best = F.when((F.col("r") % 2 == 0) == (F.col("side") == 0), "supported").otherwise("contradicted")
    c = claim.select((2 * F.col("r") + F.col("side")).alias("claim_id"), F.when(F.col("r") == 4, 99).otherwise(2 * F.col("r") + F.col("side")).alias("cluster_id"), best.alias("grounding"), F.lit(0.5).alias("confidence"))
    return feed.contradictions(near, scores, c).select("a", "b", "disputed_claim")


@query(f"SELECT id, 'n' || k AS node FROM (SELECT event_id AS id, k FROM {SQL_EVENTS} WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM events) - 259200)")
def j15_recent_nodes(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("id"), S("n", k()).alias("node"), F.col("ts").cast("timestamp").cast("double").alias("last_updated"))
    new = e.agg(F.max("last_updated").alias("ts"))
    return G.recent_nodes(e, new).select("id", "node")


@query("SELECT text_hash, count(*) AS n, bool_or(cached) AS cached FROM (SELECT sha256(text) AS text_hash, min(doc_id) OVER (PARTITION BY text) % 2 = 0 AS cached FROM documents) GROUP BY 1")
def s28_v12_cached_embeddings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cache = d.groupBy("text").agg(F.min("doc_id").alias("f")).where("f % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(1.0)).alias("vector"))
    found, missing = SIM.cached_embeddings(d, cache)
    return found.groupBy("text_hash").agg(F.count("*").alias("n"), F.bool_or(F.col("vector").isNotNull()).alias("cached")).join(missing.select("text_hash", F.lit(False).alias("known")), "text_hash", "left").select("text_hash", "n", F.coalesce("known", "cached").alias("cached"))


@query(f"""SELECT DISTINCT source, min(source) OVER (PARTITION BY canonical) AS alias_group FROM (SELECT source, {_case(CANONICAL)} AS canonical FROM {SQL_NAMES})""")
def c2_c7_c9_alias_groups(spark, sf):
    return O.alias_clusters(_names(spark, sf).select("source"))


@query("SELECT lang AS cluster_id, count(DISTINCT CASE WHEN substr(source, 4)::INTEGER % 3 = 0 THEN 'one owner' ELSE source END) AS independent FROM documents GROUP BY lang")
def c5_ownership_collapse(spark, sf):
    s = table(spark, sf, "documents").select(F.col("lang").alias("cluster_id"), "source").distinct()
    owned = s.select("source").distinct().where("cast(substr(source, 4) as int) % 3 = 0").select("source", F.lit("one owner").alias("owner_group"))
    return O.collapse_by_ownership(s, owned)


@query("SELECT 'k' || doc_id // 4 AS id, 'g' || doc_id // 2 % 2 AS g, round(avg(CASE WHEN substr(source, 4)::INTEGER < 10 THEN substr(source, 4)::INTEGER / 10.0::DOUBLE END), 6) AS reputation FROM (SELECT DISTINCT doc_id // 4 * 4 + doc_id // 2 % 2 * 2 AS doc_id, source FROM documents) GROUP BY 1, 2")
def z6_group_reputation(spark, sf):
    d = table(spark, sf, "documents")
    g = d.groupBy(S("k", F.floor(F.col("doc_id") / 4)).alias("id"), S("g", F.floor(F.col("doc_id") / 2) % 2).alias("g")).agg(F.collect_set("source").alias("sources"))
    rep = spark.range(10).select(S("src", F.col("id")).alias("source"), (F.col("id") / 10.0).alias("reputation"))
    return ST.group_reputation(g, rep).select("id", "g", F.round("reputation", 6).alias("reputation"))


@query("SELECT 'n' || doc_id // 5 AS node_id, coalesce(string_agg(doc_id, ',' ORDER BY doc_id DESC) FILTER (WHERE doc_id % 3 > 0), '') AS facts, coalesce(string_agg(doc_id, ',' ORDER BY doc_id DESC) FILTER (WHERE doc_id % 3 = 0), '') AS forecasts FROM documents GROUP BY doc_id // 5")
def m15_facts_and_forecasts(spark, sf):
    n = F.col("doc_id")
    s = table(spark, sf, "documents").select(S("n", F.floor(n / 5)).alias("node_id"), n.alias("id"), n.cast("double").alias("confidence"), (n % 3 == 0).alias("is_forecast"))
    return ST.facts_and_forecasts(s).select("node_id", F.array_join("facts", ",").alias("facts"), F.array_join("forecasts", ",").alias("forecasts"))


@query("SELECT doc_id AS id, 'english ' || doc_id AS fact_en FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 > 0")
def f35_english_gloss(spark, sf):
    n = F.col("doc_id")
    d = table(spark, sf, "documents")
    c = d.select(n.alias("id"), F.array(n).alias("claim_ids"), S("fact ", n).alias("fact"))
    claims = d.select(n.alias("claim_id"), F.when(n % 2 == 0, S("fact ", n)).otherwise("else").alias("text"))
    pivots = d.select(n.alias("claim_id"), F.when(n % 5 > 0, S("english ", n)).otherwise(S("fact ", n)).alias("text_en"))
    return ST.english_gloss(c, claims, pivots)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'review' ELSE 'auto-fix' END AS route, CASE doc_id % 3 WHEN 0 THEN 'veracity-dispute' WHEN 1 THEN 'bug' ELSE 'ui' END AS category, CASE doc_id % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.82 ELSE 0.78 END::DOUBLE AS confidence FROM documents")
def f25_z50_triage(spark, sf):
    from tessera.functions.text import triage

    text = F.when(F.col("doc_id") % 3 == 0, "this is wrong and misleading").when(F.col("doc_id") % 3 == 1, "it crashed with an exception").otherwise("the font and the margin")
    t = triage(F.concat(text, F.lit(" x"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.route", "t.category", "t.confidence")


@query("""SELECT label, i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2""")
def v10_running_centroids(spark, sf):
    """The centroid of each label; all 64 components."""
    from tessera.functions.vectors import centroids

    return centroids(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.col("i").cast("long").alias("i"), F.round("mean", 6).alias("mean"))


@query("SELECT source, CASE WHEN has THEN good ELSE first END AS pos FROM (SELECT source, min(doc_id) AS first, min(doc_id) FILTER (WHERE doc_id % 4 = 3) AS good, count(*) FILTER (WHERE doc_id % 4 = 3) > 0 AS has FROM documents GROUP BY source)")
def z24_pick_entity(spark, sf):
    d = table(spark, sf, "documents")
    site = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("https://www."), "source", F.lit("/about"))).otherwise("https://other.org")
    return ST.pick_entity(d.select("source", F.col("doc_id").alias("pos"), F.lit("Q1").alias("qid"), site.alias("site"))).select("source", "pos")


@query("SELECT doc_id, doc_id % 4 IN (0, 1) OR doc_id % 4 = 2 AS is_index FROM documents")
def p8_p9_index_pages(spark, sf):
    from tessera.functions.text import is_index_page

    n = F.col("doc_id") % 4
    title = F.when(n == 0, "Politics: News and Analysis").when(n == 1, "Acme Post | Top Stories").otherwise("A fire broke out at the mill")
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("[Story](https://x/"), i.cast("string"), F.lit(")"))), "\n")
    body = F.when(n == 2, links).otherwise("One line of plain prose that says what has happened at the mill today, in full.")
    return table(spark, sf, "documents").select("doc_id", is_index_page(title, body).alias("is_index"))


@query("SELECT DISTINCT doc_id // 6 AS id FROM documents EXCEPT SELECT DISTINCT doc_id // 6 FROM documents WHERE doc_id % 6 < 2 AND doc_id // 6 % 3 > 0")
def p8_clusters_of_index_pages_only(spark, sf):
    n = F.col("doc_id")
    d = table(spark, sf, "documents")
    c = d.groupBy(F.floor(n / 6).alias("id")).agg(F.collect_list("doc_id").alias("article_ids"))
    a = d.select(n.alias("id"), F.when((n % 6 < 2) & (F.floor(n / 6) % 3 > 0), "Rain in the south").otherwise("Archives").alias("title"))
    return feed.index_page_clusters(c, a)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 2 = 0")
def j8_j9_not_yet_judged(spark, sf):
    n = F.col("doc_id").alias("id")
    c = table(spark, sf, "documents").select(n, (F.col("doc_id") % 2 == 0).alias("has_primary"), F.lit(2).alias("independent_originators"), F.lit("notable").alias("extremity"))
    return ST.ground(c, table(spark, sf, "documents").select(n, F.lit("supported").alias("verdict")), table(spark, sf, "labels").select(n)).select(F.col("id").alias("doc_id"))


@query(ORACLES["k16_signups_by_email"])
def n17_signups_as_csv(spark, sf):
    """The table of signups, exported as CSV and read again."""
    rows = folds.acquisition_signups(log_queries.signup_log(spark, sf)).select("email", "hits", "beta", "platform", F.to_date("first_seen").alias("first_day"), F.to_date("last_seen").alias("last_day"))
    folder = _new_folder(spark)
    ST.write_csv(rows, folder)
    return spark.read.option("header", True).schema(rows.schema).csv(folder)


@query(f"""WITH c AS (SELECT DISTINCT event_id AS cluster_id, unnest(['k' || k % 40, 'u' || user_id % 30]) AS e FROM {SQL_EVENTS} WHERE event_type = 'purchase'),
    n AS (SELECT DISTINCT user_id AS id, unnest(['k' || k % 40, 'u' || user_id % 30]) AS e FROM {SQL_EVENTS} WHERE event_type = 'view' AND k < 20)
    SELECT cluster_id, id, count(*) AS shared FROM c JOIN n USING (e) GROUP BY 1, 2""")
def j12_candidates_by_entity(spark, sf):
    """Nodes (users by what they viewed) that share an entity with a cluster (a purchase)."""
    e = events(spark, sf).withColumn("spine", F.array(S("k", k() % 40), S("u", F.col("user_id") % 30)))
    clusters = e.where("event_type = 'purchase'").select(F.col("event_id").alias("cluster_id"), "spine")
    nodes = e.where("event_type = 'view' and k < 20").groupBy(F.col("user_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list("spine"))).alias("spine"))
    return G.entity_candidates(clusters, nodes)


def _measured(texts: list[str]) -> list[list[float]]:
    """Stands in for an embedding model: characters and blanks of a text."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS n_blanks FROM documents")
def s28_v12_cache_written_back(spark, sf):
    """Documents with their vectors through the cache: one half fills it, then all are asked for, so only the others are embedded."""
    from tessera.operators import cache

    d, name = table(spark, sf, "documents").select("doc_id", "text"), f"cache_{uuid.uuid4().hex}"
    cache.embedded(d.where("doc_id % 2 = 0"), name, _measured)
    rows = cut(cache.embedded(d, name, _measured).select("doc_id", F.col("vector")[0].alias("n_chars"), F.col("vector")[1].alias("n_blanks")))
    spark.sql(f"DROP TABLE {name}")
    return rows
