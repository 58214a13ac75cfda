"""Health of the pipeline and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.scoring import freshness

STAGES = {"acquire": "article.ingested", "extract": "claims.extracted", "classify": "claims.classified", "cluster": "cluster.corroborated"}
#: Stage: input tokens a call, output tokens a call, price per million of each; a parameter of every function here.
COSTS = {"extract": (1500, 600, 3.0, 15.0), "classify": (1800, 400, 3.0, 15.0), "extremity": (300, 150, 3.0, 15.0), "embeddings": (50, 0, 0.1, 0.0)}


def stage_health(events: DataFrame, now: Column, stages: dict[str, str] | None = None) -> DataFrame:
    """Count, newest event and freshness of each stage; stages without events stay."""
    table = events.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate((stages or STAGES).items())], "pos int, stage string, type string")
    e = events.groupBy("type").agg(F.count("*").alias("n"), F.max("created_at").alias("last_seen"))
    age = F.when(F.col("last_seen").isNotNull(), F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("last_seen")))
    return F.broadcast(table).join(e, "type", "left").select("pos", "stage", "type", F.coalesce("n", F.lit(0)).alias("n"), "last_seen", age.alias("age_s"), freshness(age).alias("freshness")).orderBy("pos")


def dead_letter_summary(dead: DataFrame, top: int = 10) -> DataFrame:
    """The newest dead letters with a short error, and the count of all."""
    total = dead.agg(F.count("*").alias("total"))
    text = F.coalesce("error", F.lit(""))
    short = F.concat(F.substring(text, 1, 200), F.when(F.length(text) > 200, "…").otherwise(""))
    return dead.orderBy(F.desc("created_at"), F.desc("id")).limit(top).crossJoin(F.broadcast(total)).withColumn("preview", short)


def dead_by_stage(dead: DataFrame, default: str = "kernel") -> DataFrame:
    return dead.groupBy(F.coalesce("stage", F.lit(default)).alias("stage")).agg(F.count("*").alias("n"))


def cluster_rollup(clusters: DataFrame) -> DataFrame:
    """Counts by confidence, mean, and bands at .85, .7 and .5."""
    c = F.col("confidence")
    return clusters.agg(
        F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean_confidence"), F.count_if(c >= 0.85).alias("high"), F.count_if((c >= 0.7) & (c < 0.85)).alias("good"), F.count_if((c >= 0.5) & (c < 0.7)).alias("fair"), F.count_if(c < 0.5).alias("weak"), F.count_if(F.col("has_primary")).alias("with_primary")
    )


def alerts(stages: DataFrame, dead: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (level, message): stalled or silent stages, dead letters, empty tables."""
    s = stages.where("freshness in ('stalled', 'never')").select(F.when(F.col("freshness") == "never", "warn").otherwise("critical").alias("level"), F.concat("stage", F.lit(" is "), "freshness").alias("message"))
    d = dead.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("warn").alias("level"), F.concat(F.col("n").cast("string"), F.lit(" dead letters")).alias("message"))
    e = sizes.where("n = 0").select(F.lit("warn").alias("level"), F.concat(F.col("table"), F.lit(" is empty")).alias("message"))
    return s.unionByName(d).unionByName(e)


def overall_status(stages: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: empty, stalled, degraded or healthy."""
    s = stages.agg(F.sum("n").alias("n"), F.count_if(F.col("freshness") == "stalled").alias("stalled"), F.count_if(F.col("freshness") == "stale").alias("stale"))
    return s.crossJoin(dead.agg(F.count("*").alias("dead"))).select(
        F.when(F.coalesce("n", F.lit(0)) == 0, "empty").when(F.col("stalled") > 0, "stalled").when((F.col("dead") > 0) | (F.col("stale") > 0), "degraded").otherwise("healthy").alias("status")
    )


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def spend(calls: DataFrame, costs: dict | None = None) -> DataFrame:
    """USD per stage of (stage, calls)."""
    table = calls.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in (costs or COSTS).items()], "stage string, tin double, tout double, pin double, pout double")
    each = call_cost(F.col("tin"), F.col("tout"), F.col("pin"), F.col("pout"))
    return calls.join(F.broadcast(table), "stage").select("stage", "calls", F.round(F.col("calls") * each, 4).alias("usd"))


def spend_by_provider(articles: DataFrame, claims_per_article: float, costs: dict | None = None) -> DataFrame:
    c = costs or COSTS
    one = lambda k: c[k][0] / 1e6 * c[k][2] + c[k][1] / 1e6 * c[k][3]
    each = one("extract") + claims_per_article * (one("classify") + one("embeddings"))
    n = articles.groupBy(F.coalesce(F.nullif("provider", F.lit("")), F.lit("untagged")).alias("provider")).agg(F.count("*").alias("articles"))
    return n.select("provider", "articles", F.round(F.col("articles") * each, 4).alias("usd")).orderBy(F.desc("usd"), "provider")
