import gzip
import json
import random

from pyspark.sql import Row, functions as F

from tessera.operators import folds, language, log as L, states
from tessera.sources import connectors as C
from tessera.streaming import keyed, stream
from tests.test_operators import log_of
from tests.test_states import random_log


def test_search_articles(spark):
    replies = [(json.dumps({"articles": [{"url": "https://a.b/1", "title": " T ", "domain": "a.b", "language": "French"}, {"url": "", "title": "x"}, {"title": "y"}]}),), ("<html>busy</html>",), (None,)]
    got = C.search_articles(spark.createDataFrame(replies, "reply string")).collect()
    assert [(x.url, x.title, x.language, x.country) for x in got] == [("https://a.b/1", "T", "French", "")]


def test_api_results_and_items(spark):
    long = "b" * 200
    reply = {"results": [{"link": "https://www.a.b/1", "content": "", "description": long, "country": ["fr", "de"], "language": "en"}, {"link": "https://a.b/2", "content": "short"}, {"link": "", "content": long}]}
    got = C.api_results(spark.createDataFrame([(json.dumps(reply),)], "reply string")).collect()
    assert [(x.url, x.source, x.country, x.language) for x in got] == [("https://www.a.b/1", "a.b", "fr", "en")]
    items = [{"metadata": {"url": "https://c.d/x", "title": "M", "languageCode": "de"}, "text": long}, {"searchResult": {"url": "https://e.f"}, "markdown": "no"}]
    got = C.fetched_items(spark.createDataFrame([(json.dumps(items),)], "reply string")).collect()
    assert [(x.url, x.title, x.language) for x in got] == [("https://c.d/x", "M", "de")]


RSS = """<rss><channel><language>FR-fr</language><item><title><![CDATA[A & B]]></title><link>https://www.x.fr/1</link></item><item><title>no link</title></item>
<item><title>Q &amp; A</title><link> https://x.fr/2 </link></item></channel></rss>"""
ATOM = """<feed><entry><title type="html">One</title><link rel="alternate" href="https://y.de/1"/></entry></feed>"""


def test_feeds(spark):
    rows = spark.createDataFrame([("https://x.fr/rss", "", RSS), ("https://y.de/atom", "de", ATOM)], "feed_url string, language string, xml string")
    got = [(x.url, x.title, x.source, x.language) for x in C.feed_entries(rows).orderBy("feed_url", "pos").collect()]
    assert got == [("https://www.x.fr/1", "A & B", "x.fr", "fr"), ("https://x.fr/2", "Q & A", "x.fr", "fr"), ("https://y.de/1", "One", "y.de", "de")]
    assert C.feed_entries(rows, limit=1).count() == 2


def test_feed_list_and_windows(spark):
    lines = spark.createDataFrame([("# feeds",), ("",), ("https://a.b/rss | FR | fr | state",), ("https://c.d/rss|DE|de|indep|The C",)], "value string")
    assert [(x.url, x.country, x.label) for x in C.parse_feed_list(lines).orderBy("url").collect()] == [("https://a.b/rss", "FR", "a.b"), ("https://c.d/rss", "DE", "The C")]
    w = C.week_windows(spark, "2024-03-15 00:00:00", 2).orderBy("k").collect()
    assert [(x.start_stamp, x.end_stamp) for x in w] == [("20240308000000", "20240315000000"), ("20240301000000", "20240308000000")]
    assert [(x.year, x.month) for x in C.months_back(spark, "2024-02-10", 3).orderBy("k").collect()] == [(2024, 2), (2024, 1), (2023, 12)]


def test_replies(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.gate_verdict(F.lit('Sure: {"accept": true, "kind": "news", "outlet": "X"} ok'))).kind == "news"
    assert one(C.extremity_level(F.lit('{"extremity": "significant"}'))) == "significant" and one(C.extremity_level(F.lit("no idea"))) == "notable"
    kind = "array<struct<text:string>>"
    assert [x.text for x in one(C.salvaged_array(F.lit('Here: [{"text": "a"}, {"text": "b"}]'), kind))] == ["a", "b"]
    assert [x.text for x in one(C.salvaged_array(F.lit('[{"text": "a"}, {"text": "b"'), kind))] == ["a"]
    assert one(C.salvaged_array(F.lit("nothing"), kind)) == []
    assert one(C.topics_query(F.array(F.lit("a b"), F.lit("c")))) == '"a b" OR "c"'


def record(uri, page, kind="response", mime="text/html", lang=""):
    body = f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n\r\n{page}".encode()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Identified-Content-Language: {lang}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    page = "<html><title>T</title><body><nav>menu</nav><p>" + "word " * 100 + "</p><p>é &amp; e</p></body></html>"
    data = record("https://www.a.co.uk/1", page, lang="eng,fra") + record("https://b.de/2", "short") + record("https://c.fr/3", page, kind="request") + record("https://d.fr/4", page, mime="image/png") + record("https://e.fr/5", page)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    got = C.warc_articles(spark, f"file://{tmp_path}/*.gz").orderBy("url").collect()
    assert [(x.url, x.source, x.language, x.country, x.title) for x in got] == [("https://e.fr/5", "e.fr", "", "FR", "T"), ("https://www.a.co.uk/1", "a.co.uk", "en", "GB", "T")]
    assert got[0].body.endswith("é & e") and "menu" not in got[0].body
    assert C.warc_articles(spark, f"file://{tmp_path}/*.gz", limit=1).count() == 1
    known = language.learn(spark.createDataFrame([("word and word", "en"), ("été et été", "fr")], "text string, language string"))
    assert [x.language for x in C.warc_articles(spark, f"file://{tmp_path}/*.gz", languages=known).orderBy("url").collect()] == ["en", "en"]


def log_rows(spark, ids):
    rows = [(i, f"c{i % 3}", "claim.related", json.dumps({"claim_a": "a", "claim_b": f"b{i % 4}", "relation": "r", "score": i / 10}), "default", 1_700_000_000 + i * 3600) for i in ids]
    df = spark.createDataFrame(rows, "id long, stream_id string, type string, data string, tenant_id string, t long")
    return df.select("id", "stream_id", "type", "data", "tenant_id", F.timestamp_seconds("t").alias("created_at"))


def test_stream_folds_once_and_equals_the_batch_fold(spark, tmp_path):
    src, state, cp = (f"file://{tmp_path}/{x}" for x in ("src", "state", "cp"))
    fold = states.FOLDS["claim_relations"]
    for part in (range(10), range(10, 25), range(25, 30)):
        log_rows(spark, part).coalesce(1).write.mode("append").parquet(src)
        stream.fold_batches(stream.read_log(spark, src, files_per_trigger=1), fold, state, cp).awaitTermination()
    got = stream.folded(spark, state, fold)
    assert sorted(got.select("claim_b", "score").collect()) == sorted(folds.claim_relations(log_rows(spark, range(30))).select("claim_b", "score").collect())
    assert len(stream._versions(spark, state)) == 2  # the last and the one that a repeated batch would start from


def test_stream_append_and_dedup(spark, tmp_path):
    src, out, cp = (f"file://{tmp_path}/{x}" for x in ("src", "out", "cp"))
    for part in ([1, 2, 2, 3], [2, 3, 4, None, None]):
        df = log_rows(spark, [i or 9 for i in part])
        df.withColumn("id", F.when(F.col("id") != 9, F.col("id"))).coalesce(1).write.mode("append").parquet(src)
        stream.append_batches(stream.read_log(spark, src), out, cp).awaitTermination()
    assert sorted(r.id or 0 for r in spark.read.schema(L.LOG_SCHEMA).parquet(out).collect()) == [0, 0, 1, 2, 3, 4]
    keyed.write_by_batch(stream.once(stream.read_log(spark, src).where("id is not null")), f"{out}2", f"{cp}2", "append").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}2").collect()) == [1, 2, 3, 4]


def test_stream_latest_state_and_daily_counts(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    log_rows(spark, range(50)).coalesce(1).write.parquet(src)
    last = keyed.run_to_table(stream.latest_state(stream.read_log(spark, src), "stream_id", "data"), ["stream_id"], f"file://{tmp_path}/last")
    assert {r.stream_id: r.id for r in last.collect()} == {"c0": 48, "c1": 49, "c2": 47}
    days = keyed.run_to_table(stream.daily_counts(stream.read_log(spark, src)), ["day", "type"], f"file://{tmp_path}/days")
    assert sum(r.n for r in days.collect()) == 50


def test_keyed_state_equals_the_batch_fold_at_any_cut(spark, tmp_path):
    seed = random.randrange(10**6)
    r = random.Random(seed)
    events = [e for e in random_log(r, 700) if e[1].split(".")[0] in ("cluster", "claims", "claim", "admin")]
    log = spark.createDataFrame(log_of(spark, events).collect(), L.LOG_SCHEMA)
    src, cuts = f"file://{tmp_path}/src", [0, *sorted(r.sample(range(1, len(events)), 2)), len(events)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for a, b in zip(cuts, cuts[1:]):
            log.where(f"id > {a} and id <= {b}").coalesce(1).write.mode("append").parquet(src)
            for f, name in ((keyed.cluster_rows, "clusters"), (keyed.claim_rows, "claims")):
                keyed.write_by_batch(f(stream.read_log(spark, src)), f"file://{tmp_path}/{name}", f"file://{tmp_path}/cp-{name}").awaitTermination()
        rows = lambda df, cols: sorted(map(repr, (x.asDict() for x in df.select(cols).collect())))
        cols = ["id", "fact", "independent_originators", "confidence", "grounding", "created_at"]
        assert rows(keyed.table_of(spark, f"file://{tmp_path}/clusters", ["id"]).where("alive"), cols) == rows(folds.clusters(log), cols), seed
        cols = ["claim_id", "article_id", "text", "kind", "voice", "speaker", "corrected", "laundering_flag", "disputed", "created_at"]
        assert rows(keyed.table_of(spark, f"file://{tmp_path}/claims", ["claim_id"]), cols) == rows(folds.claims(log), cols), seed
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_states_of_a_key_stay_short():
    event = lambda i, t, **d: Row(id=i, pos=0, type=t, data=json.dumps(d), created_at=i)
    events = [event(i, "cluster.corroborated", confidence=0.5) for i in range(100)] + [event(i, "cluster.grounded", grounding="x") for i in range(100, 200)]
    row, keep = keyed.fold_cluster("c", events)
    assert row["grounding"] == "x" and [e.id for e in keep] == [0, 99, 199]
    assert keyed.fold_cluster("c", [*events, event(300, "cluster.removed"), event(301, "cluster.grounded", grounding="y")]) == ({"id": "c", "alive": False}, [])
    assert keyed.fold_claim("k", [event(1, "claims.classified", kind="x")]) == (None, [])


def test_deliveries_die_once(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tries = [("s", 1, i, False, f"e{i}") for i in range(9)] + [("s", 2, i, i == 3, f"f{i}") for i in range(8)]
        for part in (tries[::2], tries[1::2][:0], [("s", 1, 20, True, None), ("s", 1, 21, False, "late")]):
            if part:
                spark.createDataFrame(part, "stage string, id long, at long, ok boolean, error string").coalesce(1).write.mode("append").parquet(src)
                rows = spark.readStream.schema("stage string, id long, at long, ok boolean, error string").parquet(src)
                keyed.write_by_batch(keyed.counted_deliveries(rows, 4), f"file://{tmp_path}/out", f"file://{tmp_path}/cp", "append").awaitTermination()
        got = sorted((x.id, x.attempt, x.dead, x.error) for x in spark.read.parquet(f"file://{tmp_path}/out").collect())
        assert [g for g in got if g[0] == 1] == [(1, 1, False, "e0"), (1, 2, False, "e2"), (1, 3, False, "e4"), (1, 4, True, "e6")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
