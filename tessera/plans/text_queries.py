"""Queries over documents and other texts: normal forms, shingles, identity, ids, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import identity as I, ids, text as T, vectors as V
from tessera.operators import originators as O, similarity as S
from tessera.plans.registry import query
from tessera.plans.stand_ins import articles
from tessera.session import table

# Names of sources made from the supplier table, to have spellings to resolve.
SPELLINGS = ("Reuters", "www.reuters.com", "Thomson Reuters", "https://m.theguardian.com/uk", "The Guardian", "BBC News Agency", "bbc.co.uk", "Agence France-Presse", "Ministry of Trade", "data.gov", "news.example.co.uk", "Le Monde", "notwho.int", "wikipedia.org", "en.wikipedia.org", "who.int", "lemonde.fr")
CANONICAL = ("reuters", "reuters", "reuters", "guardian", "guardian", "bbc", "bbc", "afp", "ministry of trade", "data.gov", "example.co.uk", "le-monde", "notwho.int", "wikipedia.org", "wikipedia.org", "who.int", "le-monde")


def _names(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.element_at(F.array(*map(F.lit, SPELLINGS)), (F.col("s_suppkey") % len(SPELLINGS) + 1).cast("int")).alias("source"))


def _case(values: tuple) -> str:
    return "CASE s_suppkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


SQL_NAMES = f"(SELECT s_suppkey, {_case(SPELLINGS)} AS source FROM supplier)"
SQL_WORDS = "string_split(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')"
SQL_SHINGLES = f"""(SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM (SELECT doc_id, {SQL_WORDS} AS w FROM documents)))"""


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS fact FROM documents")
def f17_normal_facts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm_fact("text").alias("fact"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM documents")
def f15_alnum_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.alnum_key("text").alias("key"))


@query(f"SELECT doc_id, count(*) AS n, min(x) AS first, max(x) AS last FROM {SQL_SHINGLES} GROUP BY doc_id")
def v6_shingles(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.explode(T.shingles("text")).alias("x"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))


@query(f"""WITH s AS {SQL_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT a, b, CAST(c AS DOUBLE) / (na.n + nb.n - c) AS jaccard FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE CAST(c AS DOUBLE) / (na.n + nb.n - c) >= 0.4""")
def v7_shingle_overlap_pairs(spark, sf):
    return S.shingle_pairs(table(spark, sf, "documents"), "doc_id", "text", 0.4)


@query(f"""WITH RECURSIVE s AS {SQL_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE CAST(c AS DOUBLE) / (na.n + nb.n - c) >= 0.4), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(a, b) AS (SELECT a, a FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
    SELECT component, count(*) AS n FROM (SELECT a, min(b) AS component FROM r GROUP BY a) GROUP BY component""")
def c1_near_copy_components(spark, sf):
    return S.near_copies(table(spark, sf, "documents"), "doc_id", "text", 0.4).groupBy("component").agg(F.count("*").alias("n"))


@query(f"SELECT s_suppkey, {_case(CANONICAL)} AS canonical FROM supplier")
def f1_canonical_sources(spark, sf):
    return _names(spark, sf).select("s_suppkey", I.canonical_source("source").alias("canonical"))


@query(f"""SELECT s_suppkey, source IN ('Ministry of Trade', 'data.gov', 'who.int', 'notwho.int') AS is_primary, source IN ('wikipedia.org', 'en.wikipedia.org') AS is_rejected,
    CASE WHEN source LIKE '%.co.uk' THEN 'GB' WHEN source LIKE '%.fr' THEN 'FR' ELSE '' END AS country FROM {SQL_NAMES}""")
def p12_n5_f5_source_predicates(spark, sf):
    return _names(spark, sf).select("s_suppkey", I.is_primary_source("source").alias("is_primary"), I.is_hard_rejected("source").alias("is_rejected"), I.source_country("source").alias("country"))


@query(f"""SELECT canonical, count(*) AS n FROM (SELECT {_case(CANONICAL)} AS canonical FROM supplier) GROUP BY 1""")
def c8_sources_by_canonical_id(spark, sf):
    return _names(spark, sf).groupBy(I.canonical_source("source").alias("canonical")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host FROM pages""")
def f4_f46_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", I.host_of("url").alias("host"))


@query("""SELECT doc_id, sha256(text) AS fingerprint, 'rss-' || substr(sha1(source || '/' || doc_id), 1, 18) AS article_id, substr(sha1('a|b|' || source), 1, 24) AS cluster_id,
    'rel-' || substr(sha1(least(lang, source) || '|' || greatest(lang, source) || '|same'), 1, 20) AS relation_id, 'snap-' || substr(sha1(source || ':2024-01-01'), 1, 18) AS snapshot_id FROM documents""")
def f42_content_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id", ids.text_fingerprint(F.col("text")).alias("fingerprint"), ids.article_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), "rss").alias("article_id"),
        ids.cluster_id(F.array("source", F.lit("b"), F.lit("a"))).alias("cluster_id"), ids.relation_id(F.col("source"), F.col("lang"), F.lit("same")).alias("relation_id"), ids.snapshot_id(F.col("source"), F.lit("2024-01-01")).alias("snapshot_id"),
    )


@query("""SELECT lang, CASE lang WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' ELSE '' END AS country, lang = 'en' AS english, count(*) AS n FROM documents GROUP BY lang""")
def f9_p21_languages(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", I.language_country("lang").alias("country"), I.is_english("lang").alias("english"), "n")


@query("""SELECT count(*) FILTER (WHERE regexp_matches(lower(text), 'according to|said|says|told|reported|reports|stated|stating|announced|confirm|revealed|cited|citing|alleged|denied|wrote|source|sources|official|spokesperson|spokesman|statement|briefing|documents|filing|study|survey|data show|we found|this paper|our investigation|has learned|understands|interview|"|“')) AS sourced, count(*) AS n FROM documents""")
def p13_m2_provenance(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(I.has_provenance("text")).alias("sourced"), F.count("*").alias("n"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(CAST(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS DOUBLE), 5) AS sim
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id < b.vec_id
    WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.38""")
def v3_cosine_pairs(spark, sf):
    return S.cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.38).select("a", "b", F.round("sim", 5).alias("sim"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    n AS (SELECT a, b FROM p WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b DESC) <= 3) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM n""")
def v4_j13_nearest_pairs(spark, sf):
    return S.nearest_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", k=3, at_least=0.3).select("a", "b")


@query()
def v5_average_linkage_groups(spark, sf):
    g = S.group_by_similarity(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4)
    return g.groupBy("group").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))



@query("""SELECT doc_id, round(exp(1.0) / (exp(1.0) + exp(CAST(doc_id % 3 AS DOUBLE))), 9) AS p FROM documents""")
def v13_softmax(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(V.softmax(F.array(F.lit(1.0), (F.col("doc_id") % 3).cast("double")))[0], 9).alias("p"))


@query("""SELECT source, count(*) AS articles, count(DISTINCT lang) AS languages, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY source""")
def q4_articles_per_source(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("articles"), F.countDistinct("lang").alias("languages"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"""WITH s AS {SQL_SHINGLES}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), d AS (SELECT doc_id, lang AS cluster, source FROM documents),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b JOIN d da ON da.doc_id = a JOIN d db ON db.doc_id = b WHERE CAST(c AS DOUBLE) / (na.n + nb.n - c) >= 0.4 AND da.cluster = db.cluster
    UNION SELECT f.a, d.doc_id FROM d JOIN (SELECT cluster, source, min(doc_id) AS a FROM d GROUP BY 1, 2) f USING (cluster, source) WHERE f.a <> d.doc_id""")
def j11_originator_edges(spark, sf):
    m = articles(spark, sf).select(F.col("language").alias("cluster_id"), F.col("id").alias("article_id"), "source", "body")
    return O.originator_edges(m).select("a", "b")



@query()
def c6_m3_corroborate(spark, sf):
    m = articles(spark, sf).select(F.concat_ws("-", "language", (F.col("id") % 40).cast("string")).alias("cluster_id"), F.col("id").alias("article_id"), "source", "body")
    c = O.corroborate(m)
    return c.select("cluster_id", "independent_originators", "effective_originators", "has_primary", "confidence", F.array_join("sources", ",").alias("sources"))



@query("""SELECT conv_id, role FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) = 1""")
def a40_dominant_value(spark, sf):
    from tessera.operators.feed import dominant_language

    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("role").alias("language"), F.col("turn").alias("pos"))
    return dominant_language(c).select(F.col("id").alias("conv_id"), F.col("language").alias("role"))





@query("""SELECT source, max('https://www.' || source || '.com/' || doc_id) AS url FROM documents GROUP BY source""")
def q18_one_url_per_source(spark, sf):
    return articles(spark, sf).groupBy("source").agg(F.max("url").alias("url"))



@query("""SELECT doc_id, 'feedback::' || substr(sha1(array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'that', 'this', 'with', 'not', 'but', 'you', 'are', 'was')), 1, 8), ' ')), 1, 12) AS key FROM documents""")
def f23_feedback_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.feedback_key(F.lit(""), F.col("text")).alias("key"))


@query()
def f18_entity_spines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.entity_spine("text"), "|").alias("spine"))


@query()
def f19_f22_interest_terms(spark, sf):
    d = articles(spark, sf)
    return d.select("id", F.array_join(T.interest_terms("title"), "|").alias("terms"), T.interest_query("title").alias("query"))


@query("""SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'queen') AS hit FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'queen')""")
def p6_p7_topic_matches(spark, sf):
    from tessera.operators.feed import by_topics

    return by_topics(table(spark, sf, "documents"), [["the"], ["queen"]], F.col("text")).select("doc_id", F.lit(True).alias("hit"))


@query()
def f12_f14_clean_articles(spark, sf):
    a = articles(spark, sf)
    return a.select("id", T.clean_title("title", "source").alias("title"), F.length(T.clean_body("body", "title")).alias("n_chars"))


@query()
def f10_languages(spark, sf):
    """The language of every document, learned from lang of the rows that are not held out."""
    from tessera.operators import language

    d = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"))
    return language.detect(d, language.learn(d.where("not held_out"))).select("doc_id", "held_out", "language", "detected")


def _sql_row(*columns: str) -> str:
    return "concat_ws(',', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in sorted(columns)) + ")"


def _sql_digests(name: str, source: str, tenant: str, *columns: str) -> str:
    part = lambda at: f"CAST(sum(CAST(('0x' || substr(h, {at}, 15))::BIGINT AS HUGEINT)) AS DECIMAL(38, 0))"
    return f"SELECT '{name}' AS \"table\", tenant, count(*) AS n, CAST({part(1)} AS VARCHAR) AS a, CAST({part(17)} AS VARCHAR) AS b FROM (SELECT coalesce({tenant}, '') AS tenant, md5({_sql_row(*columns)}) AS h FROM {source}) GROUP BY tenant"


@query(_sql_digests("articles", "documents", "lang", "doc_id", "source", "text") + " UNION ALL " + _sql_digests("log", "events", "event_type", "event_id", "user_id", "props"))
def z52_tenant_digests(spark, sf):
    """Digests of two tables for each tenant (language, kind of event)."""
    from tessera.operators.digests import table_digests

    a = table(spark, sf, "documents").select("doc_id", "source", "text", F.col("lang").alias("tenant_id"))
    b = table(spark, sf, "events").select("event_id", "user_id", "props", F.col("event_type").alias("tenant_id"))
    return table_digests({"articles": a, "log": b}).withColumns({"a": F.col("a").cast("string"), "b": F.col("b").cast("string")})


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT a.vec_id AS q, b.vec_id AS id, round(CAST(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS DOUBLE), 5) AS sim
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.25""")
def l1_vector_search(spark, sf):
    """Vectors at least 0.25 alike to each of those whose id is divisible by 100, through the metric index."""
    from tessera.operators import metric

    e = table(spark, sf, "embeddings")
    found = metric.search(metric.build(e, "vec_id", "embedding"), e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.25)
    return found.select("q", F.col("k").alias("id"), F.round("sim", 5).alias("sim"))
