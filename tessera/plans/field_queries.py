"""Queries over single fields: normal forms, predicates, formulas and parsers, on written-out cases or on columns of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera.functions import identity as I, ids, scoring as S, text as T, times, vectors as V
from tessera.operators import health
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import connectors as C


def _sql(v) -> str:
    if v is None or isinstance(v, bool):
        return str(v).replace("None", "NULL")
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)


def cases(name: str, of: Callable[[Column], Column], known: list[tuple]) -> None:
    """Register a query that gives each supplier one of the inputs and shows what the function makes of it; known has (input, result)."""

    def run(spark, sf):
        inputs = F.array(*[F.lit(x).cast("string") for x, _ in known])
        s = table(spark, sf, "supplier").withColumn("given", F.element_at(inputs, (F.col("s_suppkey") % len(known) + 1).cast("int")))
        return s.select("s_suppkey", of(F.col("given")).alias("value"))

    run.__name__ = name
    results = " ".join(f"WHEN {i} THEN {_sql(v)}" for i, (_, v) in enumerate(known))
    query(f"SELECT s_suppkey, CASE s_suppkey % {len(known)} {results} END AS value FROM supplier")(run)


def _list(c: Column) -> Column:
    return F.array_join(c, "|")


cases("f2_normal_domains", I.normal_domain, [("https://www.bbc.co.uk/news/1", "bbc.co.uk"), ("m.lemonde.fr", "lemonde.fr"), ("news.example.com/a", "example.com"), ("amp.www.site.org", "site.org"), ("news.com", "news.com"), (None, "")])
cases("f3_normal_names", I.normal_name, [("The Guardian", "guardian"), ("Le Monde", "monde"), ("BBC News Agency", "bbc"), ("Acme, Inc. Media Group", "acme inc"), ("Der  Spiegel", "spiegel"), (None, "")])
cases("f8_archive_countries", I.archive_country, [("www.bbc.co.uk", "GB"), ("lemonde.fr", "FR"), ("fr", ""), ("co.uk", "GB"), ("example.com", ""), (None, "")])
cases("f11_brand_tokens", lambda c: _list(T.brand_tokens(c)), [("www.theguardian.com", "theguardian|guardian"), ("bbc.co.uk", "bbc"), ("news.example.org", "example"), ("ab.de", ""), (None, "")])
cases("f16_significant_tokens", lambda c: _list(T.significant_tokens(c)), [("Agence France Press", "agence|france"), ("The Daily Herald of London", "london"), ("A 1 b2", ""), ("Le Figaro", "le|figaro"), (None, "")])
cases("f20_bigrams", lambda c: _list(T.bigrams(F.split(c, " "))), [("a b c", "a b|b c"), ("one", ""), ("x y", "x y")])
cases("f21_interest_terms", lambda c: _list(T.interest_terms(c)), [("climate policy", "climate policy|climate|policy"), ("the", "the"), ("", ""), ("carbon-tax, Europe", "carbon tax|tax europe|carbon|tax|europe"), (None, "")])
cases("f30_primary_names", I.is_primary_name, [("Ministry of Trade", True), ("Official Gazette", True), ("data.gov", False), ("Reuters", False), (None, False)])
cases("p14_anonymous", I.is_anonymous, [("A person familiar with the talks said so", True), ("The ministry said so", False), (None, False)])
cases("p15_cites", lambda c: I.cites(c, F.array(F.lit("reuters"), F.lit("lemonde"))), [("Reuters reported it first", True), ("according to lemonde", True), ("Reuters is a company", False), ("reported elsewhere", False), (None, False)])
cases("p17_domains", I.is_domain, [("bbc.co.uk", True), ("Le Monde", False), ("https://bbc.co.uk", False), ("x.y", False), (" who.int ", True), (None, False)])
cases("p16_issue_worthy", lambda c: T_issue(c), [("auto-fix", True), ("review", False)])
cases("z17_p18_terminal_outcomes", S.is_terminal, [("confirmed", True), ("refuted", True), ("corroborating", False), ("unconfirmed", False)])
cases("z31_keyword_hits", lambda c: T.triage(c)["hits"], [("The page crashes with an error", 2), ("Nothing to see", 0), (None, 0)])
cases("f31_event_times", times.event_seconds, [("1700000000", 1700000000.0), ("1700000000.5", 1700000000.5), ("2023-11-14T22:13:20Z", 1700000000.0), ("2023-11-14T23:13:20+01:00", 1700000000.0), ("2023-11-14T22:13:20", 1700000000.0), ("soon", 0.0), (None, 0.0)])
cases("f32_parsed_times", lambda c: F.date_format(times.parse_time(c), "yyyy-MM-dd HH:mm:ss"), [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("20240102T030405Z", "2024-01-02 03:04:05"), ("20240102030405", "2024-01-02 03:04:05"), ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"), ("yesterday", None), (None, None)])
cases("n6_gate_replies", lambda c: C.gate_verdict(c)["accept"], [('Sure: {"accept": true, "kind": "news"} ok', True), ('{"accept": false}', False), ("no", None), (None, None)])
cases("f40_extremity_levels", C.extremity_level, [('{"extremity": "significant"}', "significant"), ('I say {"extremity": "huge"}', "notable"), ("none", "notable"), (None, "notable")])
cases("f39_salvaged_arrays", lambda c: _list(F.transform(C.salvaged_array(c, "array<struct<t:string>>"), lambda x: x["t"])), [('[{"t": "a"}, {"t": "b"}]', "a|b"), ('text [{"t": "a"}, {"t": "b"}, {"t": "c', "a|b"), ("nothing", ""), (None, "")])
cases("f41_f43_query_specs", lambda c: _list(C.json_reply(c, "terms array<string>, query string")["terms"]), [('{"terms": ["x", "y"], "query": "q"}', "x|y"), ('ok {"terms": []}', ""), ("{broken", None), (None, None)])
cases("f44_news_queries", lambda c: _list(C.news_queries(c, F.lit("fallback"))), [('["a", " b ", "", "c", "d", "e"]', "a|b|c|d"), ('Here: ["one"]', "one"), ("none", "fallback"), (None, "fallback")])
cases("n3_topics_query", lambda c: C.topics_query(F.split(c, ",")), [("a,b c", '"a" OR "b c"'), ("x", '"x"')])
cases("v11_vector_texts", lambda c: V.vector_text(V.parse_vector(c)), [("[1.0,2.5]", "[1.0,2.5]"), ("[1, -2]", "[1.0,-2.0]"), (None, None)])
cases("v9_name_overlap", lambda c: F.round(V.jaccard(F.split(I.normal_name(c), " "), F.array(F.lit("new"), F.lit("york"), F.lit("times"))), 6), [("The New York Times", 1.0), ("New York Post", 0.5), ("Le Monde", 0.0)])
cases("v8_entity_overlap", lambda c: F.round(V.jaccard(T.entity_spine(c), F.array(F.lit("paris"), F.lit("acme corp"))), 6), [("In Paris he met Acme Inc", 0.333333), ("we met Acme Corp near Paris", 1.0), ("nobody", 0.0), (None, 0.0)])
cases("z25_direct_owners", lambda c: _list(ST_owners(F.split(c, ","))), [("Q1,Q2,Q1", "Q1|Q2"), ("P5,Q7,x", "Q7"), ("", "")])
cases("s23_topics", lambda c: _list(C.topic_list(F.split(c, ";"))), [("# none;energy;; trade # late", "energy|trade"), ("# only", "news"), ("", "news")])


def T_issue(route: Column) -> Column:
    from tessera.operators.admin import issue_worthy

    return issue_worthy(route, F.lit(None).cast("boolean"))


def ST_owners(statements: Column) -> Column:
    from tessera.operators.stories import direct_owners

    return direct_owners(statements)


@query("SELECT c_custkey, CASE WHEN a IS NULL THEN 'never' WHEN a < 3600 THEN 'fresh' WHEN a < 86400 THEN 'stale' ELSE 'stalled' END AS freshness FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 50 * 3000 END AS a FROM customer)")
def f26_freshness(spark, sf):
    age = F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 50 * 3000)
    return table(spark, sf, "customer").select("c_custkey", S.freshness(age).alias("freshness"))


@query("""SELECT c_custkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)) AS clamped, round(greatest(b - 0.3, least(b + 0.3, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 5000)))), 4) AS preference FROM (SELECT *, (c_custkey % 10) / 10.0::DOUBLE AS b FROM customer)""")
def f33_f34_clamps(spark, sf):
    x, b = F.col("c_acctbal") / 5000, F.col("c_custkey") % 10 / 10.0
    return table(spark, sf, "customer").select("c_custkey", S.clamp(x).alias("clamped"), S.clamped_preference(b, x).alias("preference"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN false WHEN c_custkey % 4 = 1 THEN c_custkey % 3 = 0 ELSE true END AS independent FROM customer")
def m7_independence(spark, sf):
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", S.is_independent(n % 3 == 0, n % 4).alias("independent"))


@query("""SELECT c_custkey, round(r * CASE WHEN c >= 0.7 AND i >= 0.6 THEN 1.2 ELSE 1 END * CASE WHEN s > 0.25 THEN 0.6 ELSE 1 END, 6) AS score, round(s, 6) AS solo
    FROM (SELECT c_custkey, (c_custkey % 100) / 100.0::DOUBLE AS r, (c_custkey % 11) / 10.0::DOUBLE AS c, (c_custkey % 7) / 7.0::DOUBLE AS i, coalesce((c_custkey % 5) / nullif(CAST(c_custkey % 9 AS DOUBLE), 0), 0) AS s FROM customer)""")
def m11_z15_adjusted_preferences(spark, sf):
    n = F.col("c_custkey")
    solo = S.solo_ratio(n % 5, n % 9)
    return table(spark, sf, "customer").select("c_custkey", F.round(S.preference_adjusted(n % 100 / 100.0, n % 11 / 10.0, n % 7 / 7.0, solo), 6).alias("score"), F.round(solo, 6).alias("solo"))


@query("SELECT c_custkey, round(0.6 + 0.4 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 5000 END, 0.5))), 6) AS weight FROM customer")
def z16_group_weights(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.round(S.group_weight(F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal") / 5000)), 6).alias("weight"))


@query("""SELECT c_custkey, abs((c_custkey % 200 - 100) * 3600) <= 259200 AND c_custkey % 3 < 2 AS passes FROM customer""")
def p19_attachment_gate(spark, sf):
    n = F.col("c_custkey")
    other = F.when(n % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(n % 3 == 1, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    spine = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    return table(spark, sf, "customer").select("c_custkey", S.passes_gate(spine, other, (n % 200 * 3600).cast("double"), F.lit(360000.0)).alias("passes"))


@query("SELECT c_custkey, round(c_custkey % 4000 / 1e6 * 3 + c_custkey % 700 / 1e6 * 15, 8) AS usd FROM customer")
def z36_call_costs(spark, sf):
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.round(health.call_cost(n % 4000, n % 700, F.lit(3.0), F.lit(15.0)), 8).alias("usd"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN 0 ELSE round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) END AS sim FROM v a JOIN v b ON b.vec_id = a.vec_id // 2""")
def v1_v2_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", "embedding", F.floor(F.col("vec_id") / 2).alias("half"))
    b = e.select(F.col("vec_id").alias("half"), F.when(F.col("vec_id") >= 0, F.col("embedding")).alias("other"))
    other = F.when(F.col("vec_id") % 7 > 0, F.col("other")).otherwise(F.slice("other", 1, 3))  # another length: 0
    return a.join(b, "half").select("vec_id", F.round(V.cosine(F.col("embedding"), other), 6).alias("sim"))


@query("SELECT doc_id, 'rel-' || substr(sha1(least(lang, source) || '|' || greatest(lang, source) || '|near'), 1, 20) AS one, 'rel-' || substr(sha1(least(lang, source) || '|' || greatest(lang, source) || '|near'), 1, 20) AS other FROM documents")
def z22_relation_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.relation_id(F.col("source"), F.col("lang"), F.lit("near")).alias("one"), ids.relation_id(F.col("lang"), F.col("source"), F.lit("near")).alias("other"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def s10_search_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", C.search_stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("""SELECT user_id, k, strftime(now - (k + 1) * INTERVAL 7 DAY, '%Y%m%d%H%M%S') AS start_stamp, strftime(now - k * INTERVAL 7 DAY, '%Y%m%d%H%M%S') AS end_stamp
    FROM (SELECT user_id, max(ts) AS now FROM events GROUP BY user_id), (SELECT CAST(unnest(range(5)) AS INTEGER) AS k)""")
def s9_week_windows(spark, sf):
    """Five windows back from each user's last event."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("now"))
    return C.windows_back(last, 5).select("user_id", "k", "start_stamp", "end_stamp")


@query("""SELECT day, k, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month FROM (SELECT day, k, date_trunc('month', day) - k * INTERVAL 1 MONTH AS d
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), (SELECT unnest(range(5)) AS k))""")
def f45_months_back(spark, sf):
    """Five months back from each day that has events."""
    return C.months_before(table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct(), 5)
