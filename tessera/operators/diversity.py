"""How varied a set of articles or stories is, and weights that correct for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ANGLO, ANGLOSPHERE = ("US", "GB"), ("US", "GB", "CA", "AU")
TARGETS = {"anglo": 0.40, "hhi": 0.25, "countries": 10, "languages": 5, "top_language": 0.60}


def stratum(c: Column | str) -> Column:
    """A clean label of a stratum; blank or null is 'unknown'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))


def strata(df: DataFrame, language: str = "language", country: str = "country") -> DataFrame:
    return df.groupBy(stratum(language).alias("language"), stratum(country).alias("country")).agg(F.count("*").alias("n"))


def correction_weights(df: DataFrame, language: str = "language", country: str = "country") -> DataFrame:
    """Rows with `weight`: inverse to the size of the row's stratum, in sum the number of rows.

    Strata are counted first and joined back, so a large stratum is never one window.
    """
    s = strata(df, language, country)
    total = s.agg(F.sum("n").alias("all"), F.count("*").alias("k"))
    w = s.crossJoin(F.broadcast(total)).select(F.col("language").alias("_l"), F.col("country").alias("_c"), (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))
    return df.join(w, (stratum(language) == F.col("_l")) & (stratum(country) == F.col("_c"))).drop("_l", "_c")


def bias_summary(df: DataFrame, language: str = "language", country: str = "country") -> DataFrame:
    """One row: strata, raw and corrected entropy in bits, effective sample size of the weights."""
    s = strata(df, language, country)
    s = s.crossJoin(F.broadcast(s.agg(F.sum("n").alias("all"), F.count("*").alias("k"))))
    share = F.round(F.col("n") / F.col("all"), 6)
    w = F.col("all") / (F.col("k") * F.col("n"))
    even = F.col("n") * w / F.col("all")
    return s.agg(
        F.count("*").alias("strata"),
        F.max("all").alias("n"),
        F.round(F.sum(-share * F.log2(share)), 6).alias("entropy_raw"),
        F.round(F.sum(-even * F.log2(even)), 6).alias("entropy_corrected"),
        F.round(F.pow(F.sum(F.col("n") * w), 2) / F.sum(F.col("n") * w * w), 4).alias("effective_n"),
    )


def cap_per_stratum(df: DataFrame, cap: int, pos: str, language: str = "language", country: str = "country") -> DataFrame:
    """The first cap rows of each stratum in input order; cap 0 or less keeps all."""
    if cap <= 0:
        return df
    w = Window.partitionBy(stratum(language), stratum(country)).orderBy(pos)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= cap).drop("_nth")


def share_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Share of each known value."""
    c = df.select(key.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("all")))).select(name, "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


def country_share(df: DataFrame, country: str = "country") -> DataFrame:
    return share_by(df, F.col(country), "country")


def language_share(df: DataFrame, language: str = "language") -> DataFrame:
    return share_by(df, F.lower(F.col(language)), "language")


def diversity_score(df: DataFrame, country: str = "country", language: str = "language", t: dict | None = None) -> DataFrame:
    """One row: Anglo share, concentration, counts, and five axes with their mean."""
    t = TARGETS if t is None else t
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    fall = lambda c, top: F.when(c <= top, F.lit(1.0)).otherwise(clamp(1 - (c - top) / (1 - top)))
    c, lang = country_share(df, country), language_share(df, language)
    geo = c.agg(
        F.coalesce(F.round(F.sum(F.when(F.col("country").isin(*ANGLO), F.col("n")).otherwise(0)) / F.sum("n"), 4), F.lit(0.0)).alias("anglo_share"),
        F.coalesce(F.round(F.sum(F.col("share") * F.col("share")), 4), F.lit(0.0)).alias("hhi"),
        F.count("*").alias("countries"),
    )
    tongue = lang.agg(F.count("*").alias("languages"), F.max("share").alias("top_language"))
    one = df.agg((F.count("*") > 0).alias("any")).crossJoin(geo).crossJoin(tongue)
    axes = {
        "anglo": fall(F.col("anglo_share"), t["anglo"]),
        "concentration": fall(F.col("hhi"), t["hhi"]),
        "country_diversity": clamp(F.col("countries") / t["countries"]),
        "language_diversity": clamp(F.col("languages") / t["languages"]),
        "language_dominance": F.coalesce(fall(F.col("top_language"), t["top_language"]), F.lit(0.0)),
    }
    for k, v in axes.items():
        one = one.withColumn(k, F.round(F.when(F.col("any"), v).otherwise(0.0), 4))
    return one.withColumn("overall", F.round(sum(F.when(F.col("any"), v).otherwise(0.0) for v in axes.values()) / 5, 4)).drop("any")


def anglosphere_share(stories: DataFrame, country: str = "country") -> DataFrame:
    """Share of all stories, unknown countries among them."""
    return stories.agg(F.coalesce(F.avg(F.when(F.col(country).isin(*ANGLOSPHERE), 1.0).otherwise(0.0)), F.lit(0.0)).alias("share"))


def region_counts(stories: DataFrame, country: str = "country") -> DataFrame:
    return stories.groupBy(F.coalesce(F.col(country), F.lit("")).alias("country")).agg(F.count("*").alias("n"))
