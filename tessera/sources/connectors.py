"""Landed connector files to article rows.

The network is not touched: a connector's replies land as files (or rows) and
are parsed here. Every parser gives (url, title, source, language, country, body)
and skips rows without a url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.operators.language import Languages, fill
from tessera.functions.identity import host_of, language_code

MIN_BODY = 200


def _text(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit(""))


def search_articles(replies: DataFrame, column: str = "reply") -> DataFrame:
    """News search replies: articles[] with url, title, domain, language, sourcecountry, seendate; replies that are not JSON give none."""
    schema = "articles array<struct<url:string,title:string,domain:string,language:string,sourcecountry:string,seendate:string,socialimage:string>>"
    rows = replies.select(F.explode(F.from_json(column, schema)["articles"]).alias("a")).select("a.*")
    return rows.where(_text("url") != "").select(
        "url", _text("title").alias("title"), _text("domain").alias("source"), _text("language").alias("language"), _text("sourcecountry").alias("country"), F.lit("").alias("body"), _text("seendate").alias("seendate"), F.col("socialimage").alias("image")
    )


def _first_or_text(c: str) -> Column:
    """A field that is a text or a list of texts: the text, or the list's first."""
    v = F.col(c)
    return F.coalesce(F.when(v.startswith("["), F.get(F.from_json(v, "array<string>"), 0)).otherwise(v), F.lit(""))


def api_results(replies: DataFrame, column: str = "reply", min_chars: int = MIN_BODY) -> DataFrame:
    """Paged API results[]: url and a body of min_chars needed; content, else description; list-or-text country and language."""
    schema = "results array<struct<link:string,title:string,source_id:string,content:string,description:string,language:string,country:string,image_url:string>>"
    rows = replies.select(F.explode(F.from_json(column, schema)["results"]).alias("a")).select("a.*")
    body = F.coalesce(F.nullif(_text("content"), F.lit("")), _text("description"))
    out = rows.select(_text("link").alias("url"), _text("title").alias("title"), host_of("link").alias("source"), _first_or_text("language").alias("language"), _first_or_text("country").alias("country"), body.alias("body"), F.col("image_url").alias("image"))
    return out.where((F.col("url") != "") & (F.length("body") >= min_chars))


def fetched_items(replies: DataFrame, column: str = "reply", min_chars: int = MIN_BODY) -> DataFrame:
    """Search-and-fetch items: [{url, metadata.title, markdown or text}]."""
    schema = "array<struct<url:string,searchResult:struct<url:string,title:string>,metadata:struct<url:string,title:string,languageCode:string>,markdown:string,text:string>>"
    rows = replies.select(F.explode(F.from_json(column, schema)).alias("a")).select("a.*")
    url = F.coalesce(F.nullif(F.col("metadata.url"), F.lit("")), F.nullif(F.col("searchResult.url"), F.lit("")), F.col("url"), F.lit(""))
    body = F.coalesce(F.nullif("text", F.lit("")), "markdown", F.lit(""))
    title = F.coalesce(F.nullif(F.col("metadata.title"), F.lit("")), F.col("searchResult.title"), F.lit(""))
    out = rows.select(url.alias("url"), title.alias("title"), host_of(url).alias("source"), F.coalesce("metadata.languageCode", F.lit("")).alias("language"), F.lit("").alias("country"), body.alias("body"))
    return out.where((F.col("url") != "") & (F.length("body") >= min_chars))


def feed_list(spark: SparkSession, path: str) -> DataFrame:
    """Feed file lines `url | country | language | alignment | label`; # starts a comment; the label is the domain by default."""
    return parse_feed_list(spark.read.text(path))


def parse_feed_list(lines: DataFrame) -> DataFrame:
    part = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(part.alias("p")).where(F.size("p") >= 4)
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    return rows.select(at(0).alias("url"), at(1).alias("country"), at(2).alias("language"), at(3).alias("alignment"), F.coalesce(F.nullif(at(4), F.lit("")), host_of(at(0))).alias("label")).where("url <> ''")


def locale_list(lines: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Locale lines `language | country | label | terms`; all but the language may be missing, terms then are the known ones of the language."""
    part = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(part.alias("p"))
    at = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(""))
    label = F.coalesce(F.nullif(at(2), F.lit("")), F.when(at(1) != "", F.concat(at(0), F.lit("/"), at(1))).otherwise(at(0)))
    terms = F.lit("")
    for lang, words in (known or {}).items():
        terms = F.when(at(0) == lang, F.lit(words)).otherwise(terms)
    return rows.select(at(0).alias("language"), at(1).alias("country"), label.alias("label"), F.coalesce(F.nullif(at(3), F.lit("")), terms).alias("terms")).where("language <> ''")


def feed_entries(feeds: DataFrame, column: str = "xml", limit: int = 0) -> DataFrame:
    """RSS items and Atom entries of landed feeds (feed_url, language, xml); a link is needed, at most `limit` per feed (0: all)."""
    atom = F.col(column).rlike(r"<entry[\s>]")
    item = F.when(atom, F.regexp_extract_all(column, F.lit(r"(?s)<entry[\s>](.*?)</entry>"), F.lit(1))).otherwise(F.regexp_extract_all(column, F.lit(r"(?s)<item[\s>](.*?)</item>"), F.lit(1)))
    rows = feeds.select("feed_url", "language", F.regexp_extract(column, r"(?s)<language>\s*(.*?)\s*</language>", 1).alias("own"), F.posexplode(item).alias("pos", "x"))

    def tag(name: str) -> Column:
        raw = F.regexp_extract("x", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        bare = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            bare = F.replace(bare, F.lit(entity), F.lit(char))
        return F.trim(bare)

    link = F.coalesce(F.nullif(tag("link"), F.lit("")), F.nullif(F.regexp_extract("x", r"<link[^>]*href=[\"']([^\"']+)", 1), F.lit("")), F.lit(""))
    lang = F.substring(F.lower(F.coalesce(F.nullif("own", F.lit("")), "language", F.lit(""))), 1, 2)
    out = rows.select("feed_url", "pos", link.alias("url"), tag("title").alias("title"), F.coalesce(F.nullif(host_of(link), F.lit("")), host_of("feed_url")).alias("source"), lang.alias("language")).where("url <> ''")
    if limit > 0:
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy("feed_url").orderBy("pos"))).where(F.col("nth") <= limit).drop("nth")
    return out


def golden_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles of every corpus file, with the file's name."""
    return spark.read.json(path, multiLine=True).select(F.input_file_name().alias("file"), F.explode("articles").alias("a")).select("file", "a.*").orderBy("file")


def week_windows(spark: SparkSession, now: str, weeks: int) -> DataFrame:
    """Consecutive windows of seven days back from now, with the search stamps."""
    return windows_back(spark.range(1).select(F.to_timestamp(F.lit(now)).alias("now")), weeks).drop("now")


def windows_back(times: DataFrame, weeks: int) -> DataFrame:
    """For each row's time `now`: consecutive windows of seven days back from it (k from 0), with the search stamps; other columns stay."""
    r = times.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    end, start = F.expr("now - make_interval(0, 0, k)"), F.expr("now - make_interval(0, 0, k + 1)")
    return r.select("*", start.alias("start"), end.alias("end")).select("*", search_stamp(F.col("start")).alias("start_stamp"), search_stamp(F.col("end")).alias("end_stamp"))


#: Parser of each connector's landed replies.
PARSERS = {"search": search_articles, "api": api_results, "items": fetched_items, "feeds": feed_entries}


def acquire(source: str, landed: DataFrame, **options) -> DataFrame:
    """Articles of a connector by its name."""
    return PARSERS[source](landed, **options)


def by_languages(queries: DataFrame, languages: DataFrame) -> DataFrame:
    """Every query once for each language asked for; both are short lists of parameters."""
    return queries.crossJoin(F.broadcast(languages))


def search_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def months_back(spark: SparkSession, now: str, n: int) -> DataFrame:
    return months_before(spark.range(1).select(F.to_date(F.lit(now)).alias("day")), n).drop("day")


def months_before(days: DataFrame, n: int) -> DataFrame:
    """For each row's `day`: its month and those before it, n in all (k from 0)."""
    r = days.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    m = F.add_months(F.trunc("day", "month"), -F.col("k").cast("int"))
    return r.select("day", "k", F.year(m).alias("year"), F.month(m).alias("month"))


def topics_query(topics: Column) -> Column:
    """Quoted topics joined by OR."""
    return F.array_join(F.transform(topics, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def topic_list(lines: Column, default: str = "news") -> Column:
    """Topics of a file's lines: # starts a comment, blank lines go; none: the default alone."""
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    return F.when(F.size(bare) > 0, bare).otherwise(F.array(F.lit(default)))


def news_queries(reply: Column, fallback: Column, most: int = 4) -> Column:
    """The first queries of a reply's JSON list that say something; none: the fallback."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<string>")
    kept = F.slice(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, kept).otherwise(F.array(fallback))


def json_reply(reply: Column, schema: str) -> Column:
    """The object between a model reply's first { and last }."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)


def gate_verdict(reply: Column) -> Column:
    return json_reply(reply, "accept boolean, kind string, outlet string")


def extremity_level(reply: Column) -> Column:
    level = F.coalesce(json_reply(reply, "extremity string")["extremity"], F.lit(""))
    return F.when(level.isin("routine", "ordinary", "notable", "significant", "extraordinary"), level).otherwise("notable")


def salvaged_array(reply: Column, schema: str) -> Column:
    """The objects of a JSON array in a reply; a reply that breaks off is cut after its last whole object."""
    whole = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    cut = F.concat(F.regexp_extract(reply, r"(?s)(\[.*\})", 1), F.lit("]"))
    return F.coalesce(F.from_json(F.nullif(whole, F.lit("")), schema), F.from_json(F.when(F.length(cut) > 1, cut), schema), F.from_json(F.lit("[]"), schema))


def page_articles(pages: DataFrame, min_chars: int = MIN_BODY) -> DataFrame:
    """Fetched pages (page_id, url, html) as articles with title, main text and lead image; too short ones are left out.

    title is what a reader sees; title_html is what stands between the first plain title tags, on one line, as it is written.
    """
    from tessera.sources.warc import parse_pages

    written = F.regexp_extract("html", r"<title>([^\n]*?)</title>", 1).alias("title_html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", written, "html")
    return rows.mapInArrow(parse_pages(min_chars), "page_id long, url string, title string, title_html string, body string, image string")


def warc_articles(spark: SparkSession, path: str, min_chars: int = 400, limit: int = 0, languages: Languages | None = None) -> DataFrame:
    """HTML responses of WARC files as articles; limit is per file (0: all).

    Where the header names no language it is that of the body by `languages` (operators/language.py), if given, else empty.

    Files come through Spark's file source, so any store Spark reads will do. A
    file (1 GB as a rule, 2 GB at most) is held once in its task as it lies in
    the store; it is unpacked record by record, and rows go on in small batches.
    """
    from tessera.sources.warc import parse_files

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = raw.mapInArrow(parse_files(min_chars, limit), "file string, url string, title string, body string, language_header string, seendate string")
    from tessera.functions.identity import archive_country

    out = rows.select("file", "url", "title", host_of("url").alias("source"), language_code("language_header").alias("language"), archive_country(host_of("url")).alias("country"), "body", "seendate")
    return out if languages is None else fill(out, languages)
