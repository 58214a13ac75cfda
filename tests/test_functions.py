import pytest
from pyspark.sql import functions as F

from tessera.functions import identity as I, ids, scoring as S, text as T, vectors as V


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Reuters", "reuters"), ("  www.reuters.com ", "reuters"), ("Thomson Reuters", "reuters"), ("https://www.reuters.com/world", "reuters"), ("Agence France-Presse", "afp"),
        ("m.theguardian.com", "guardian"), ("The Economist", "economist"), ("unknown-outlet.example.com", "unknown-outlet.example.com"), ("news.example.com", "example.com"),
        ("Le Quotidien Media Group", "quotidien"), ("新华社", "xinhua"), ("", ""), (None, ""),
    ],
)
def test_canonical_source(spark, raw, want):
    assert one(spark, I.canonical_source("v"), v=raw) == want


@pytest.mark.parametrize(("source", "want"), [("Ministry of Trade", True), ("data.gov", True), ("army.mil.example", True), ("governance.com", False), ("ecb.europa.eu", True), ("notwho.int", True), ("", False), (None, False)])
def test_primary_source(spark, source, want):
    assert one(spark, I.is_primary_source("v"), v=source) is want


@pytest.mark.parametrize(("source", "country"), [("bbc.co.uk", "GB"), ("lemonde.fr", "FR"), ("fr", "FR"), ("x.com", ""), ("", ""), ("globo.com.br", "BR")])
def test_source_country(spark, source, country):
    assert one(spark, I.source_country("v"), v=source) == country


def test_archive_country_and_language(spark):
    assert [one(spark, I.archive_country("v"), v=x) for x in ("a.co.uk", "co.uk", "a.de", "de", "")] == ["GB", "GB", "DE", "", ""]
    assert [one(spark, I.language_code("v"), v=x) for x in ("eng,fra", "DEU", "xyz", "", None)] == ["en", "de", "xy", "", ""]


def test_attribution_weights(spark):
    w = lambda body, source: one(spark, I.attribution_weight(F.lit(body), F.lit(source)))
    assert w("", "Ministry of X") == 1.0 and w("It rained.", "paper.com") == 0.3
    assert w("It rained, the mayor said.", "paper.com") == 1.0 and w("A person familiar with it said so, on condition of anonymity", "paper.com") == 0.6


def test_cites(spark):
    tokens = T.significant_tokens(F.lit("The Meridian Herald"))
    assert one(spark, I.cites(F.lit("As MERIDIAN reported on Monday"), tokens)) is True
    assert one(spark, I.cites(F.lit("Meridian is a city"), tokens)) is False


@pytest.mark.parametrize(("n", "primary", "level", "grounding", "want"), [(0, False, "notable", None, 0.0), (1, False, "notable", None, 0.45), (2, True, "routine", None, 0.94), (3, True, "notable", "contradicted", 0.33), (3, True, "notable", "not_addressed", 0.83), (20, True, "routine", None, 0.97), (-2, False, "x", None, 0.0)])
def test_confidence_read(spark, n, primary, level, grounding, want):
    assert one(spark, S.confidence_read(F.lit(n), F.lit(primary), F.lit(level), F.lit(grounding))) == pytest.approx(want)


def test_confidence_grows_and_stays_bounded(spark):
    rows = spark.range(12).select(*[S.confidence_read(F.col("id"), F.lit(p), F.lit(e)).alias(f"{p}{e}") for p in (True, False) for e in S.DECAY]).collect()
    for a, b in zip(rows, rows[1:]):
        assert all(0 <= x <= y <= 0.97 for x, y in zip(a, b))


def test_labels_name_what_is_missing(spark):
    label = lambda c, n, p, e: one(spark, S.confidence_label(F.lit(c), F.lit(n), F.lit(p), F.lit(e)))
    assert label(0.9, 1, False, "notable") == "Well corroborated" and label(0.3, 1, False, "significant") == "Single source · extraordinary claim"
    assert label(0.5, 3, False, "extraordinary") == "Not yet established · extraordinary claim" and label(0.5, 2, False, "notable") == "Thinly corroborated"
    assert one(spark, S.confidence_label(F.lit(0.5))) == "Limited corroboration"


def test_shingles(spark):
    get = lambda t: one(spark, T.shingles(F.lit(t)))
    assert get("A b  C d e") == ["a b c d", "b c d e"] and get("one two") == ["one two"] and get("") == [""] and get(None) == [""]
    assert get("x x x x x x") == ["x x x x"]


def test_entity_spine(spark):
    text = "The European Central Bank met on Monday. Christine Lagarde said Zürich Bank and the European Central Bank agree. In May"
    assert one(spark, T.entity_spine(F.lit(text))) == ["european central bank", "monday. christine lagarde", "zürich bank"]  # a full stop is part of a run


def test_interests(spark):
    assert one(spark, T.interest_terms(F.lit("Monetary policy in West-Africa!"))) == ["monetary policy", "policy west", "west africa", "monetary", "policy", "west", "africa"]
    assert one(spark, T.interest_query(F.lit("Monetary policy in West-Africa!"))) == "monetary policy west"
    assert one(spark, T.interest_terms(F.lit("the of"))) == ["the of"] and one(spark, T.interest_terms(F.lit(""))) == []


@pytest.mark.parametrize(
    ("title", "source", "want"),
    [
        ("Happy News: Stories to make you smile - BBC Newsround", "bbc.co.uk", "Happy News: Stories to make you smile"), ("Markets fall again | The Guardian", "theguardian.com", "Markets fall again"),
        ("War - what is it good for", "x.com", "War - what is it good for"), ("Trump signs the order - The New York Times", "nytimes.com", "Trump signs the order"),
        ("Happy News: Stories to make you smile", "bbc.co.uk", "Happy News: Stories to make you smile"), ("BBC: Floods displace thousands in the region", "bbc.co.uk", "Floods displace thousands in the region"),
        ("Apple unveils a thinner laptop - hands on first impressions", "example.com", "Apple unveils a thinner laptop - hands on first impressions"), ("A tale - of two | Daily Bugle", "x.io", "A tale - of two"), ("Reuters: Oil climbs on supply fears", "reuters.com", "Oil climbs on supply fears"), ("", "x.com", ""), (None, None, ""),
    ],
)
def test_clean_title(spark, title, source, want):
    assert one(spark, T.clean_title(F.lit(title).cast("string"), F.lit(source).cast("string"))) == want


def test_clean_body(spark):
    clean = lambda t, title="": one(spark, T.clean_body(F.lit(t).cast("string"), F.lit(title)))
    raw = "# A headline here\n\n![img](x.png)\n* First point is [linked](http://a.b/c).\r\n[Home](/home)\nShare\n1 day ago\nText.\nText.\n\n\n\nhttps://x.y/z\nEnd."
    once = clean(raw, "A headline here")
    assert once == "First point is linked.\nText.\n\nEnd." and clean(once, "A headline here") == once and clean(None) == ""
    wrapped = "A long label that goes on\n](/story/a-b/)\nBy A Writer [![Link](i.png)](/x) and [here](#top)\n[![Link](i.png)](http://e.f)\n\t \nДа\n2. Read more\n3 weeks ago\n12 weeks ago today"
    assert clean(wrapped) == "A long label that goes on\nBy A Writer and here\n\n12 weeks ago today".replace("Writer and", "Writer  and")
    prose = "The bank held rates on Thursday.\n\nOfficials cited costs (see page 2) and an array[3] of reasons."
    assert clean(prose) == prose


def test_index_pages(spark):
    page = lambda t, b="": one(spark, T.is_index_page(F.lit(t), F.lit(b)))
    assert page("AI | Latest News, Photos & Videos") and page("Energy | Top stories") and not page("Top stories of the war explained")
    assert page("x", "\n".join(["[a](b)"] * 9)) and not page("x", "\n".join(["[a](b)"] * 9 + ["This is a long line of prose that ends with a full stop here."] * 3))


def test_section_titles_and_brands(spark):
    page = lambda t, b="": one(spark, T.is_index_page(F.lit(t), F.lit(b)))
    assert page("Climate — News & Analysis") and page("Tech News Archives") and page("News,photos of the day") and not page("Fed holds rates steady", "Prose.")
    assert not page("Latest news on the merger talks emerges") and not page("Happy News: Stories to make you smile - BBC Newsround") and not page("The archivist resigns")
    brands = lambda s: one(spark, T.brand_tokens(F.lit(s).cast("string")))
    assert brands("www.theguardian.com/uk") == ["theguardian", "guardian"] and brands("bbc.co.uk") == ["bbc"] and brands("x.com") == [] and brands(None) == [] and brands("thesun.co.uk:80") == ["thesun", "sun"]


def test_triage(spark):
    got = lambda t, h="": one(spark, T.triage(F.lit(t), F.lit(h)))
    assert got("The page crashes with an error")["category"] == "bug" and got("The page crashes with an error")["route"] == "auto-fix"
    assert got("layout broken on mobile")["category"] == "ui" and got("nothing matches here", "bug")["route"] == "review"
    assert got("hello")["category"] == "veracity-dispute" and got("this is wrong", "veracity-dispute")["confidence"] == pytest.approx(0.93)


def test_ids(spark):
    import hashlib

    sha = lambda s, n: hashlib.sha1(s.encode()).hexdigest()[:n]
    assert one(spark, ids.cluster_id(F.array(F.lit("b"), F.lit("a")))) == sha("a|b", 24)
    assert one(spark, ids.node_id(F.array(F.lit("y"), F.lit("x")), F.lit("c"))) == "node:" + sha("x|y:c", 16)
    assert one(spark, ids.relation_id(F.lit("b"), F.lit("a"), F.lit("r"))) == "rel-" + sha("a|b|r", 20)


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, V.cosine(arr(0, 0), arr(1, 1))) == 0.0 and one(spark, V.cosine(arr(1), arr(1, 1))) == 0.0
    assert one(spark, V.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert sum(one(spark, V.softmax(arr(1, 2, 3)))) == pytest.approx(1.0)
    assert one(spark, V.moved_centroid(arr(1, 3), arr(3, 3), F.lit(2))) == [2.0, 3.0]


def test_arbitration_and_gates(spark):
    a = lambda *x: one(spark, S.arbitrate(*[F.lit(v) for v in x]))
    assert a("supported", 0.1, None, 0.9) == "b" and a(None, 0.2, None, 0.9) == "a" and a(None, 0.5, "", 0.6) is None and a("contradicted", 0.9, "not_addressed", 0.1) == "a"
    g = lambda x, y, s, t: one(spark, S.passes_gate(F.array(*map(F.lit, x)), F.array(*map(F.lit, y)), F.lit(float(s)), F.lit(float(t))))
    assert g(["a", "b"], ["a", "b"], 0, 72 * 3600) and not g(["a", "b"], ["a", "b"], 0, 72 * 3600 + 1) and not g(["a", "b", "c"], ["a", "d", "e"], 0, 0)
