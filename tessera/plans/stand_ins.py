"""The domain's tables made from the driver's tables; each has its SQL twin.

Events become log rows whose payload is written from the event's number k; other
tables are renamed columns. Queries run the real operators on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import table

LEVELS = ("routine", "ordinary", "notable", "significant", "extraordinary")


def k_of() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def k() -> Column:
    """The number of an event."""
    return F.col("k")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events with their number k."""
    return table(spark, sf, "events").withColumn("k", k_of())


def log(spark: SparkSession, sf: str, kinds: dict[str, str], payload: dict[str, Column], stream: Column | None = None) -> DataFrame:
    """A log whose types are those that event types are mapped to and whose data has the payload's fields."""
    e = events(spark, sf).where(F.col("event_type").isin(list(kinds)))
    kind = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in kinds.items()])
    return e.select(
        F.col("event_id").alias("id"),
        (stream if stream is not None else F.col("user_id").cast("string")).alias("stream_id"),
        kind.alias("type"),
        F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()])).alias("data"),
        F.lit("default").alias("tenant_id"),
        F.col("ts").alias("created_at"),
    )


def level(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), k % 5 + 1)


#: SQL twins: events with k, and the level of a number.
SQL_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
SQL_LEVEL = "CASE k % 5 WHEN 0 THEN 'routine' WHEN 1 THEN 'ordinary' WHEN 2 THEN 'notable' WHEN 3 THEN 'significant' ELSE 'extraordinary' END"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Corroboration events: the fact is the user, k gives the counts, value the rest; see SQL_HISTORY."""
    e = events(spark, sf)
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Fact  "), (F.col("user_id") % 120).cast("string")).alias("fact"),
        F.array(F.concat(F.lit("src"), (F.col("k") % 20).cast("string")), F.when(F.col("k") % 3 == 0, "ministry of truth").otherwise(F.concat(F.lit("src"), (F.col("k") % 7).cast("string")))).alias("sources"),
        (F.col("k") % 4).alias("n_groups"),
        (F.col("k") % 4).alias("independent_originators"),
        (F.col("k") % 11 == 0).alias("has_primary"),
        level(F.col("k")).alias("extremity"),
        ((F.col("event_type") == "error") & (F.col("k") == 99)).alias("corrected"),
        F.when(F.col("k") % 13 == 0, "contradicted").alias("grounding"),
        F.col("ts"),
    )


SQL_HISTORY = f"""(SELECT event_id AS id, 'fact ' || CAST(user_id % 120 AS VARCHAR) AS fact, k % 4 AS n, k % 11 = 0 AS p, {SQL_LEVEL} AS extremity,
    event_type = 'error' AND k = 99 AS corrected, k % 13 = 0 AS contradicted, k, ts FROM {SQL_EVENTS})"""
SQL_FACTS = f"""(SELECT fact, CASE WHEN corrected OR last_contradicted THEN 'refuted' WHEN last_n >= 3 OR last_p THEN 'confirmed' WHEN last_n > first_n THEN 'corroborating' ELSE 'unconfirmed' END AS outcome,
    first_n, last_n, first_p, last_p, extremity, last_extremity, last_k, n_events, last_ts
    FROM (SELECT fact, arg_min(n, id) AS first_n, arg_max(n, id) AS last_n, arg_min(p, id) AS first_p, arg_max(p, id) AS last_p, arg_min(extremity, id) AS extremity,
          arg_max(extremity, id) AS last_extremity, arg_max(k, id) AS last_k, bool_or(corrected) AS corrected, arg_max(contradicted, id) AS last_contradicted, count(*) AS n_events,
          arg_max(ts, id) AS last_ts FROM {SQL_HISTORY} GROUP BY fact))"""
SQL_DECAY = "CASE extremity WHEN 'routine' THEN 0.35 WHEN 'ordinary' THEN 0.45 WHEN 'notable' THEN 0.55 WHEN 'significant' THEN 0.66 WHEN 'extraordinary' THEN 0.76 ELSE 0.55 END::DOUBLE"


def sql_read(n: str, p: str, decay: str = SQL_DECAY) -> str:
    """The confidence read in SQL, without grounding."""
    base = f"(1 - power({decay}, {n}))"
    return f"round(least(CASE WHEN {p} THEN {base} + (1 - {base}) * 0.5 ELSE {base} END, 0.97::DOUBLE), 2)"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """documents as articles."""
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), 0).alias("title"), "source", F.col("lang").alias("language"), F.col("text").alias("body"), F.concat(F.lit("https://www."), "source", F.lit(".com/"), F.col("doc_id").cast("string")).alias("url"))
