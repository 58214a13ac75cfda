"""Fold states that merge: a table of the log as of a watermark is a few events per key, and more log is folded onto them.

The state of a fold is the part of the log that can still matter: per key the
events that some value of the table, or some boundary (the first correction, a
life's first corroboration, a tenant's reset) comes from. So

    fold(log) = fold(state(head) + tail)    and    state(log) = state(state(head) + tail)

for any cut of the log into head and tail, and a state is of the log's own
schema: a snapshot is such a state with its watermark, whatever columns tables
get later. Events that can no longer matter (before a removal, after a
correction, overwritten) are gone from it. Counts can't be had from a few events;
the fold that has one keeps the sums beside (signups).

All of it is grouped aggregates that give event ids, and one semi join of the
log with these; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.operators import folds
from tessera.operators.folds import _CLAIM, _CLUSTER, _GRAPH, _events


def _ids(aggregated: DataFrame, *columns: str) -> DataFrame:
    """(id) of all events that these columns name."""
    return aggregated.select(F.explode(F.array_distinct(F.array(*columns))).alias("id")).where("id is not null")


def _kept(log: DataFrame, *ids: DataFrame) -> DataFrame:
    return log.join(reduce(DataFrame.union, ids).distinct(), "id", "left_semi").select(log.columns)


def _last(where: Column) -> Column:
    return F.max(F.when(where, F.col("id")))


def _first(where: Column) -> Column:
    return F.min(F.when(where, F.col("id")))


def article_events(log: DataFrame) -> DataFrame:
    """First and last event of each article, and the earliest by time."""
    e = log.where("type = 'article.ingested'").groupBy("stream_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min_by("id", F.struct("created_at", "id")).alias("c"))
    return _kept(log, _ids(e, "a", "b", "c"))


def claim_events(log: DataFrame) -> DataFrame:
    """Of each claim its first extraction; after it the first act that corrects it, the last ones that set a field, the last flag, a dispute; and the last classification before the first correction."""
    made = _events(log, "claims.extracted", _CLAIM).select("id", F.explode("d.claims.id").alias("claim_id")).where("claim_id is not null").groupBy("claim_id").agg(F.min("id").alias("made"))
    fields = "claim_id string, target string, kind string, voice string, speaker string"
    acts = log.where(F.col("type").isin("admin.classification.corrected", "admin.laundering.flagged", "claim.disputed")).withColumn("d", F.from_json("data", fields))
    claim = F.when(F.col("type") == "claim.disputed", F.coalesce("d.claim_id", "stream_id")).otherwise(F.col("d.target"))
    acts = acts.select("id", "type", claim.alias("claim_id"), "d.kind", "d.voice", "d.speaker").join(made, "claim_id").where("id > made")
    fix, flag = F.col("type") == "admin.classification.corrected", F.col("type") == "admin.laundering.flagged"
    acted = acts.groupBy("claim_id").agg(
        _first(fix | flag).alias("corrected"), _last(flag).alias("flag"), _first(F.col("type") == "claim.disputed").alias("dispute"),
        *[_last(fix & F.col(c).isNotNull()).alias(c) for c in ("kind", "voice", "speaker")],
    )
    sorts = _events(log, "claims.classified", "claims array<struct<id:string>>").select("id", F.explode("d.claims.id").alias("claim_id")).join(made, "claim_id").join(acted.select("claim_id", "corrected"), "claim_id", "left")
    sorts = sorts.where((F.col("id") > F.col("made")) & (F.col("corrected").isNull() | (F.col("id") < F.col("corrected")))).groupBy("claim_id").agg(F.max("id").alias("sorted"))
    return _kept(log, _ids(made, "made"), _ids(acted, "corrected", "flag", "dispute", "kind", "voice", "speaker"), _ids(sorts, "sorted"))


def cluster_events(log: DataFrame) -> DataFrame:
    """Of each cluster that lives, since its last removal: first and last corroboration, last grounding, last event with a confidence, earliest by time."""
    e = log.where(F.col("type").isin("cluster.corroborated", "cluster.grounded", "cluster.removed"))
    made, judged = F.col("type") == "cluster.corroborated", F.col("type") == "cluster.grounded"
    rows = e.select("id", "stream_id", "type", "created_at", F.get_json_object("data", "$.confidence").isNotNull().alias("sure"))
    gone = rows.groupBy("stream_id").agg(_last(F.col("type") == "cluster.removed").alias("gone"), F.count("*").alias("n"))
    since = folds.join_per_key(rows, gone, ["stream_id"]).where(F.col("gone").isNull() | (F.col("id") > F.col("gone"))).drop("n", "gone")
    born = since.groupBy("stream_id").agg(_first(made).alias("born"), F.count("*").alias("n")).where("born is not null")
    alive = folds.join_per_key(since, born, ["stream_id"]).where("id >= born").groupBy("stream_id").agg(
        F.min("id").alias("a"), _last(made).alias("b"), _last(judged).alias("c"), _last(F.col("sure")).alias("d"), F.min_by("id", F.struct("created_at", "id")).alias("e")
    )
    return _kept(log, _ids(alive, *"abcde"))


def snapshot_events(log: DataFrame) -> DataFrame:
    """The last daily snapshot of each cluster and day."""
    e = _events(log, "cluster.snapshot", _CLUSTER + ", cluster_id string")
    day = F.to_date(F.coalesce(F.try_to_timestamp("d.harvested_at"), "created_at"))
    return _kept(log, _ids(e.groupBy(F.coalesce("d.cluster_id", "stream_id").alias("c"), day.alias("day")).agg(F.max("id").alias("a")), "a"))


def relation_events(log: DataFrame) -> DataFrame:
    """The last event of each pair and relation."""
    e = _events(log, "claim.related", "claim_a string, claim_b string, relation string")
    return _kept(log, _ids(e.groupBy("d.claim_a", "d.claim_b", "d.relation").agg(F.max("id").alias("a")), "a"))


def graph_events(log: DataFrame) -> DataFrame:
    """Of each tenant the last reset and, since then, the first and last event of each node, its last embedding, and the first event of each edge and link."""
    e = log.where(F.col("type").isin("story.graph.rebuilt", "story.graph.delta")).withColumn("d", F.from_json("data", _GRAPH)).withColumn("tenant", F.coalesce("tenant_id", F.lit("")))
    reset = (F.col("type") == "story.graph.rebuilt") | F.coalesce("d.reset", F.lit(False))
    start = e.groupBy("tenant").agg(_last(reset).alias("start"), F.count("*").alias("n"))
    e = folds.join_per_key(e, start, ["tenant"]).where(F.col("start").isNull() | (F.col("id") >= F.col("start"))).drop("n", "start")
    n = e.select("tenant", "id", F.explode("d.nodes").alias("n")).groupBy("tenant", "n.id").agg(F.min("id").alias("a"), F.max("id").alias("b"), _last(F.col("n.topic_embedding").isNotNull()).alias("c"))
    lists = [_ids(e.select("tenant", "id", F.explode(f"d.{k}").alias("x")).groupBy("tenant", "x").agg(F.min("id").alias("a")), "a") for k in ("edges", "node_clusters", "claim_node_links")]
    return _kept(log, _ids(start, "start"), _ids(n, "a", "b", "c"), *lists)


def every_event(*kinds: str) -> Callable[[DataFrame], DataFrame]:
    """Tables with a row for each event need them all."""
    return lambda log: log.where(reduce(lambda a, b: a | b, [F.col("type").startswith(k) for k in kinds]))


_SIGNUP = "email string, hits long, beta boolean, first_id long, platform string, referrer string, utm string, first_seen timestamp, last_seen timestamp"


def signup_sums(log: DataFrame) -> DataFrame:
    """acquisition_signups with the id of the first event, by which two of them merge."""
    e = _events(log, "acquisition.notify_requested", "email string").where(F.coalesce("d.email", F.lit("")) != "").groupBy(F.col("d.email").alias("email")).agg(F.min("id").alias("first_id"))
    return folds.acquisition_signups(log).join(e, "email").select(*[f.split()[0] for f in _SIGNUP.split(", ")])


def merged_signups(old: DataFrame, tail: DataFrame) -> DataFrame:
    both = old.unionByName(signup_sums(tail))
    first = lambda c: F.min_by(F.struct(c), "first_id")[c].alias(c)
    return both.groupBy("email").agg(
        F.sum("hits").alias("hits"), F.bool_or("beta").alias("beta"), F.min("first_id").alias("first_id"), first("platform"), first("referrer"), first("utm"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


@dataclass(frozen=True)
class Fold:
    """A fold with its state: state(log), merge(state, tail), and finish(state), the table (or tables by name)."""

    state: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame | dict[str, DataFrame]]
    merged: Callable[[DataFrame, DataFrame], DataFrame] | None = None

    def merge(self, state: DataFrame, tail: DataFrame) -> DataFrame:
        """The state of head and tail together; tail's ids are larger than all of head's."""
        return self.merged(state, tail) if self.merged else self.state(state.unionByName(tail))


FOLDS: dict[str, Fold] = {
    "articles": Fold(article_events, folds.articles),
    "extracted_claims": Fold(claim_events, folds.extracted_claims),
    "claims": Fold(claim_events, folds.claims),
    "clusters": Fold(cluster_events, folds.clusters),
    "cluster_snapshots": Fold(snapshot_events, folds.cluster_snapshots),
    "claim_relations": Fold(relation_events, folds.claim_relations),
    "story_graph": Fold(graph_events, folds.story_graph_tables),
    "prompts": Fold(every_event("admin.prompt.updated"), folds.prompts),
    "acquisition_signals": Fold(every_event("acquisition."), folds.acquisition_signals),
    "acquisition_signups": Fold(signup_sums, lambda s: s.drop("first_id"), merged_signups),
}


def save(log: DataFrame, folder: str, names: list[str] | None = None) -> int:
    """Write the states of folds as of the log's last event below folder; gives the watermark, which names the snapshot."""
    mark = log.agg(F.max("id")).first()[0] or 0
    for name in names or FOLDS:
        FOLDS[name].state(log).write.mode("overwrite").parquet(f"{folder}/{mark}/{name}")
    return mark


def advance(spark: SparkSession, folder: str, mark: int, log: DataFrame, names: list[str] | None = None) -> int:
    """The next snapshot, from the one at mark and what the log has beyond it; nothing earlier of the log is read."""
    tail = log.where(F.col("id") > mark)
    now = tail.agg(F.max("id")).first()[0]
    if now is None:
        return mark
    for name in names or FOLDS:
        FOLDS[name].merge(spark.read.parquet(f"{folder}/{mark}/{name}"), tail).write.mode("overwrite").parquet(f"{folder}/{now}/{name}")
    return now


def rebuilt(spark: SparkSession, folder: str, mark: int, log: DataFrame, name: str) -> DataFrame | dict[str, DataFrame]:
    """A fold's table from a snapshot and the log's tail."""
    fold = FOLDS[name]
    return fold.finish(fold.merge(spark.read.parquet(f"{folder}/{mark}/{name}"), log.where(F.col("id") > mark)))
