"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, fill_in_middle, html_crf, ngram_lm, packing_nnls, phrases, quality_rqda, secret_scan, simhash_bk, substring_dedup, token_shards, toxicity
from tessera.session import table


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.near_groups(table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.shard_documents(table(spark, sf_dir, "documents"))


def op6_quality_rqda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rqda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_nnls.pack(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_crf,
        op2_secret_scan,
        op3_toxicity_chain,
        op4_simhash_bk,
        op5_token_shards,
        op6_quality_rqda,
        op7_packing_nnls,
        op8_substring_dedup,
        op9_decontaminate,
        op10_exact_dedup,
        op11_ngram_trie,
        op12_fill_in_middle,
        op13_phrases,
    )
}

ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op12_fill_in_middle": """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x
            FROM documents
        ), k AS (
            SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2,
                   CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(x, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                        WHEN ('0x' || substr(x, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), p AS (
            SELECT *, substr(text, 1, least(c1, c2)) AS a, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS b, substr(text, greatest(c1, c2) + 1) AS c FROM k
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_phrases": r"""
        WITH d AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), p AS (
            SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
        ), w AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
        ), g AS (
            SELECT lang, k, w[i : i + k - 1] AS g
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4]) AS k)
            WHERE i + k - 1 <= len(w)
        ), f AS (
            SELECT lang, k, g, count(*)::HUGEINT AS a FROM g GROUP BY ALL
        ), n AS (
            SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang
        ), c AS (
            SELECT * FROM f WHERE k >= 2 AND a >= 30
        ), gone AS (
            SELECT DISTINCT x.lang, x.g
            FROM (SELECT lang, a, g[i : i + s - 1] AS g FROM (SELECT *, unnest(range(2, k)) AS s FROM c), (SELECT unnest([1, 2, 3]) AS i) WHERE i + s - 1 <= k) AS y
            JOIN c AS x ON x.lang = y.lang AND x.g = y.g
            WHERE 100 * y.a >= 80 * x.a
        ), s AS (
            SELECT c.lang, c.g, c.a, l.a AS l, r.a AS r, 2000000 * c.a // (l.a + r.a) AS score, row_number() OVER (PARTITION BY c.lang, c.g ORDER BY 2000000 * c.a // (l.a + r.a), c.j) AS o
            FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c
            JOIN f AS l ON l.lang = c.lang AND l.g = c.g[1 : c.j]
            JOIN f AS r ON r.lang = c.lang AND r.g = c.g[c.j + 1 : c.k]
        ), o AS (
            SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(s.g, ' ')) AS rank, array_to_string(s.g, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, score::BIGINT AS score
            FROM s ANTI JOIN gone ON gone.lang = s.lang AND gone.g = s.g
            WHERE o = 1
        )
        SELECT o.lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
    """,
}
