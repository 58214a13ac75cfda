"""What a log of corroborations teaches: outcomes, reputation, calibration, preferences.

Events is a DataFrame (id, fact, sources array<string>, n_groups int,
independent_originators int, has_primary boolean, extremity string, corrected
boolean, grounding string, ts timestamp), oldest first by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import scoring as S
from tessera.functions.identity import attribution_weight, is_primary_source
from tessera.functions.text import norm_fact
from tessera.operators.ordering import numbered
from tessera.session import cut as checkpointed

# Edges of the reliability bins, and the decays that tuning tries.
EDGES = (0.0, 0.4, 0.6, 0.85, 1.01)
DECAY_GRID = (0.30, 0.40, 0.50, 0.55, 0.60, 0.66, 0.70, 0.76, 0.82)
DECAY_LOW, DECAY_HIGH, DECAY_REACH = 0.20, 0.90, 0.25


def facts(events: DataFrame) -> DataFrame:
    """One row per normalised fact: its first and last event, outcome, and how many events it has."""
    row = lambda c: F.struct(*[F.col(x) for x in ("sources", "n_groups", "independent_originators", "has_primary", "extremity", "grounding", "ts")]).alias(c)
    f = events.withColumn("key", norm_fact("fact")).groupBy("key").agg(
        F.min_by(row("f"), "id").alias("first"), F.max_by(row("l"), "id").alias("last"), F.bool_or(F.coalesce("corrected", F.lit(False))).alias("corrected"), F.count("*").alias("n_events")
    )
    n = lambda side: F.coalesce(F.col(f"{side}.independent_originators"), F.lit(0))
    return f.withColumn("outcome", S.resolve_outcome(n("first"), n("last"), F.col("last.has_primary"), F.col("corrected"), F.col("last.grounding")))


def observations(events: DataFrame) -> DataFrame:
    """The initial read's inputs of each fact and how it turned out."""
    return facts(events).select(
        "key", F.coalesce("first.independent_originators", F.lit(0)).alias("n"), F.coalesce("first.has_primary", F.lit(False)).alias("primary"), F.coalesce("first.extremity", F.lit("notable")).alias("extremity"), "outcome"
    )


def lifecycles(events: DataFrame, now: Column, stale_after: float = 86400.0) -> DataFrame:
    f = facts(events)
    silent = F.unix_timestamp(now) - F.unix_timestamp("last.ts")
    n = lambda side: F.coalesce(F.col(f"{side}.independent_originators"), F.lit(0))
    p = lambda side: F.coalesce(F.col(f"{side}.has_primary"), F.lit(False))
    return f.select("key", "outcome", S.lifecycle(F.col("outcome"), F.col("n_events"), n("first"), n("last"), p("first"), p("last"), silent, stale_after).alias("state"))


def reputation(events: DataFrame) -> DataFrame:
    """Per source, over the latest event of each fact it appears in."""
    f = facts(events).select("outcome", F.explode("last.sources").alias("source"), "last.*")
    f = f.withColumn("is_primary", is_primary_source("source"))
    f = f.withColumn("own", S.is_independent(F.col("is_primary"), F.coalesce("n_groups", F.lit(0))))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    weight = F.when(F.col("own"), attribution_weight(F.lit(""), F.col("source")))
    r = f.groupBy("source").agg(
        F.count("*").alias("appearances"),
        count(F.col("own"), "independent_appearances"),
        count(F.col("has_primary") & F.col("is_primary"), "primary_appearances"),
        F.round(F.coalesce(F.avg(weight), F.lit(0.0)), 3).alias("mean_attribution_weight"),
        count((F.col("independent_originators") == 1) & F.col("extremity").isin(*S.BIG), "solo_extraordinary"),
        count(F.col("outcome") == "confirmed", "facts_confirmed"),
        count(F.col("outcome") == "refuted", "facts_refuted"),
        count(~S.is_terminal(F.col("outcome")), "facts_unresolved"),
    )
    r = r.withColumn("independent_rate", F.round(F.col("independent_appearances") / F.col("appearances"), 3)).withColumn("outcome_n", F.col("facts_confirmed") + F.col("facts_refuted"))
    r = r.withColumn("confirmation_rate", F.round(F.try_divide("facts_confirmed", "outcome_n"), 3))
    r = r.withColumn("score", S.reputation_score(F.col("confirmation_rate"), F.col("independent_rate")))
    return r.withColumn("rank_key", F.round(S.reliability_rank(F.col("confirmation_rate"), F.col("independent_rate")), 4))


def reputation_series(events: DataFrame, buckets: int = 8) -> DataFrame:
    """(source, cut, score): reputation after growing parts of the history, cut at equal event counts.

    Each event is copied to the cuts it belongs to (at most `buckets` times), and
    the fold runs once over all cuts.
    """
    cuts, last = _cuts(events, buckets)
    kind = dict(events.dtypes)["id"]
    within = [F.when(F.col("id").isNull() | F.coalesce(F.col("id") <= F.lit(x).cast(kind), F.lit(False)), F.lit(c)) for c, x in zip(cuts, last)]
    parts = events.withColumn("cut", F.explode(F.array_compact(F.array(*within)) if cuts else F.array().cast("array<int>")))
    by_cut = parts.withColumn("fact", F.concat(F.col("cut").cast("string"), F.lit(" "), norm_fact("fact")))
    f = facts(by_cut).withColumn("cut", F.regexp_extract("key", r"^(\d+)", 1).cast("int")).select("cut", "outcome", F.explode("last.sources").alias("source"), "last.n_groups")
    own = S.is_independent(is_primary_source("source"), F.coalesce("n_groups", F.lit(0)))
    agg = f.groupBy("source", "cut").agg(F.count("*").alias("n"), F.count_if(own).alias("i"), F.count_if(F.col("outcome") == "confirmed").alias("c"), F.count_if(S.is_terminal(F.col("outcome"))).alias("t"))
    return agg.select("source", "cut", S.reputation_score(F.round(F.try_divide("c", "t"), 3), F.round(F.col("i") / F.col("n"), 3)).alias("score"))


def _cuts(events: DataFrame, buckets: int) -> tuple[list[int], list]:
    """Cuts by number of events and, for each, the last id whose rank (tied ids share it) is within the cut.

    Distinct ids are counted and dealt out by range, and kept, so that no task
    has all of them and sizes and numbers are of the same partitions.
    """
    ids = checkpointed(events.groupBy("id").agg(F.count("*").alias("n")).repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    sizes = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row per partition
    n = sum(r.n for r in sizes)
    cuts = sorted({max(1, round(n * i / buckets)) for i in range(1, buckets + 1)}) if n else []
    if not cuts:
        return [], []
    before, at = {}, 0
    for r in sizes:
        before[r.part], at = at, at + r.n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    w = Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ids.withColumn("rank", start + F.sum("n").over(w) - F.col("n") + 1)
    return cuts, list(ranked.agg(*[F.max(F.when(F.col("rank") <= c, F.col("id"))).alias(f"c{c}") for c in cuts]).first())


def read_of(obs: DataFrame, decay: dict[str, float] | None = None) -> Column:
    return S.confidence_read(F.col("n"), F.col("primary"), F.col("extremity"), decay=decay)


def scored(obs: DataFrame, decay: dict[str, float] | None = None) -> DataFrame:
    """Resolved observations with their read and target."""
    return obs.where(S.is_terminal(F.col("outcome"))).withColumn("read", read_of(obs, decay)).withColumn("target", (F.col("outcome") == "confirmed").cast("double"))


def mean_square(read: Column, target: Column, times: Column | None = None) -> Column:
    """Mean squared error to four digits. Reads have two, so squares are summed as whole numbers: sums of floats in another order of rows may fall on the other side of a half."""
    square = F.round(F.pow(read - target, 2) * 10_000).cast("long")
    times = F.when(square.isNotNull(), F.lit(1) if times is None else times)
    return F.round(F.sum(square * times) / (F.sum(times) * 10_000), 4)


def brier(obs: DataFrame, decay: dict[str, float] | None = None) -> DataFrame:
    return scored(obs, decay).agg(mean_square(F.col("read"), F.col("target")).alias("brier"), F.count("*").alias("n"))


def calibration_bins(obs: DataFrame, edges=EDGES) -> DataFrame:
    """Per confidence band: rows, mean read, share confirmed; empty bands are left out."""
    band = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        band = F.when(F.col("read") >= edges[k], F.lit(k)).otherwise(band) if k == len(edges) - 2 else F.when((F.col("read") >= edges[k]) & (F.col("read") < edges[k + 1]), F.lit(k)).otherwise(band)
    b = scored(obs).withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("read"), 3).alias("predicted"), F.round(F.avg("target"), 3).alias("actual"))
    low = F.element_at(F.array(*map(F.lit, edges)), F.col("band") + 1)
    high = F.element_at(F.array(*map(F.lit, edges)), F.col("band") + 2)
    return b.select(low.alias("lo"), high.alias("hi"), "n", "predicted", "actual")


def tuned_decay(obs: DataFrame, base: dict[str, float] | None = None, grid=DECAY_GRID) -> DataFrame:
    """(extremity, current, tuned): the decay of each level that would have been best, if strictly better than now.

    One join of the few resolved-observation groups with the grid; observations
    are first counted by what the read depends on, so the join stays small.
    """
    base = base or S.DECAY
    spark = obs.sparkSession
    groups = obs.where(S.is_terminal(F.col("outcome"))).groupBy("extremity", "n", "primary", "outcome").agg(F.count("*").alias("m"))
    options = [(lv, cur, v, k) for lv, cur in base.items() for k, v in enumerate([cur, *grid]) if k == 0 or max(DECAY_LOW, cur - DECAY_REACH) <= v <= min(DECAY_HIGH, cur + DECAY_REACH)]
    table = spark.createDataFrame(options, "extremity string, current double, v double, nth int")
    read = F.round(S.confidence_raw(F.col("n"), F.col("primary"), F.col("v")), 2)
    err = mean_square(read, (F.col("outcome") == "confirmed").cast("double"), F.col("m"))
    tried = groups.join(F.broadcast(table), "extremity").groupBy("extremity", "current", "v", "nth").agg(err.alias("brier"))
    best = tried.groupBy("extremity", "current").agg(F.min_by("v", F.struct("brier", "nth")).alias("tuned"), F.min("brier").alias("brier"))
    return table.select("extremity", "current").distinct().join(best, ["extremity", "current"], "left").select("extremity", "current", F.coalesce("tuned", "current").alias("tuned"), "brier")


def replay_ab(obs: DataFrame, candidate: dict[str, float], base: dict[str, float] | None = None) -> DataFrame:
    """Brier score before and after, and how many resolved facts change tier."""
    s = scored(obs, base).withColumn("after", read_of(obs, candidate))
    rank = lambda c: F.when(c >= 0.85, 3).when(c >= 0.60, 2).when(c >= 0.40, 1).otherwise(0)
    a, b = rank(F.col("read")), rank(F.col("after"))
    return s.agg(
        mean_square(F.col("read"), F.col("target")).alias("brier_base"),
        mean_square(F.col("after"), F.col("target")).alias("brier_candidate"),
        F.count("*").alias("n_scored"), F.count_if(a != b).alias("flips"), F.count_if(b > a).alias("promoted"), F.count_if(b < a).alias("demoted"),
    )


def tune_proposals(obs: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    t = tuned_decay(obs, base).where("tuned <> current")
    return t.select(F.concat(F.lit("decay."), "extremity").alias("key"), F.col("tuned").cast("string").alias("value"), F.format_string("auto-tune: %s to %s", F.col("current").cast("string"), F.col("tuned").cast("string")).alias("reason"))


def calibration_status(events: DataFrame, now: Column) -> DataFrame:
    """One row: score, counts by outcome, bias and age of the newest event."""
    o = observations(events)
    age = events.agg((F.unix_timestamp(now) - F.unix_timestamp(F.max("ts"))).alias("age_s"))
    gap = scored(o).agg(mean_square(F.col("read"), F.col("target")).alias("brier"), F.avg(F.col("read") - F.col("target")).alias("bias"), F.count("*").alias("n_scored"))
    n = o.agg(F.count("*").alias("n_facts"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("confirmed", "refuted", "corroborating", "unconfirmed")])
    flag = F.when(F.col("bias") > 0.10, "over-confident").when(F.col("bias") < -0.10, "under-confident").otherwise("calibrated")
    return n.crossJoin(gap).crossJoin(age).withColumn("flag", flag).withColumn("freshness", S.freshness(F.col("age_s")))


def preferences(rep: DataFrame) -> DataFrame:
    """Ranked acquisition weights: floored, capped, scaled to a sum of at most one."""
    raw = S.preference_raw(F.col("appearances"), F.col("confirmation_rate"), F.col("independent_rate"), F.col("mean_attribution_weight"))
    solo = S.solo_ratio(F.col("solo_extraordinary"), F.col("independent_appearances"))
    p = rep.withColumn("solo", solo).withColumn("score", S.preference_adjusted(raw, F.col("confirmation_rate"), F.col("independent_rate"), F.col("solo")))
    p = p.withColumn("bounded", F.greatest(F.lit(S.FLOOR_WEIGHT), F.least(F.lit(S.MAX_WEIGHT), F.col("score"))))
    p = p.crossJoin(F.broadcast(p.agg(F.sum("bounded").alias("total"))))
    p = p.withColumn("weight", F.round(F.col("bounded") * F.when(F.col("total") > 1, 1 / F.col("total")).otherwise(1.0), 4))
    p = numbered(p.withColumn("_score", F.round("score", 9)), F.desc("weight"), F.desc("_score"), "source", name="rank")
    return p.select("source", "rank", "weight", "score", (F.col("solo") > S.SOLO_SHARE).alias("solo_flag"), (F.col("appearances") < S.MIN_EVIDENCE).alias("low_evidence"), (F.col("rank") <= S.DIVERSITY_MINIMUM).alias("in_floor"))
