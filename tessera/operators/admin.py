"""What operators of the system do and see: events they append, queues, prompts, knobs, pages of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.folds import last_of, prompts
from tessera.operators.log import latest, operator_event
from tessera.functions import scoring as S

#: Commands and the type of the event that each appends.
COMMANDS = {
    "flag-source": "admin.source.flagged", "group-sources": "admin.source.grouped", "correct-claim": "admin.classification.corrected", "flag-laundering": "admin.laundering.flagged", "remove-cluster": "cluster.removed",
    "set-clock": "admin.clock.set", "propose-knob": "admin.threshold.changed", "promote-knob": "admin.threshold.promoted", "update-prompt": "admin.prompt.updated", "review-prompt": "admin.prompt.reviewed",
    "triage-feedback": "feedback.triaged", "link-feedback": "feedback.linked", "start-run": "admin.run.requested",
}

#: Knobs of the decay of each level.
DECAY_KNOBS = [f"decay.{level}" for level in S.DECAY]


def command_events(rows: DataFrame, command: str, target: Column, reason: Column, actor: str = "operator", **fields: Column) -> DataFrame:
    """Log rows (stream_id, type, data) of a named command; rows without a target are refused (left out)."""
    data = F.to_json(operator_event(target.cast("string"), reason, actor, **fields))
    return rows.where(F.coalesce(target.cast("string"), F.lit("")) != "").select(target.cast("string").alias("stream_id"), F.lit(COMMANDS[command]).alias("type"), data.alias("data"))


def social_events(rows: DataFrame, kind: str) -> DataFrame:
    """Log rows of comments and pins from (user_id, cluster_id, comment_id, body); an id is made of the content if there is none."""
    made = F.coalesce("comment_id", F.concat(F.lit("cm-"), F.substring(F.sha1(F.concat_ws("|", "user_id", "cluster_id", "body")), 1, 16)))
    data = F.to_json(F.struct("user_id", "cluster_id", made.alias("comment_id"), "body"))
    return rows.select(F.col("cluster_id").alias("stream_id"), F.lit(kind).alias("type"), data.alias("data"))


def active_text(log: DataFrame, key: str, default: str) -> DataFrame:
    """The active text of a prompt, else the default: one row."""
    return prompts(log).where((F.col("key") == key) & F.col("active")).agg(F.coalesce(F.max("text"), F.lit(default)).alias("text"))


def reviewed_prompts(log: DataFrame) -> DataFrame:
    """Versions of prompts with whether someone has reviewed them."""
    seen = log.where("type = 'admin.prompt.reviewed'").select(F.get_json_object("data", "$.target").alias("key"), F.get_json_object("data", "$.version").cast("int").alias("version")).distinct().withColumn("reviewed", F.lit(True))
    return prompts(log).join(seen, ["key", "version"], "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def feedback_queue(log: DataFrame, top: int = 200) -> DataFrame:
    """Newest feedback first."""
    return log.where("type = 'feedback.submitted'").orderBy(F.desc("id")).limit(top)


def issue_worthy(route: Column, auto_fixable: Column) -> Column:
    return (route == "auto-fix") | F.coalesce(auto_fixable, F.lit(False))


def overrides(config: DataFrame) -> dict:
    """Scoring parameters from the promoted knobs (knob, value[, id]).

    Of several rows of a knob the one with the largest id counts (without ids the
    largest value). Knobs that no parameter has are left out and the others
    brought down to one row each before the driver reads them, a row a parameter.
    """
    names = [*DECAY_KNOBS, "primary_lift", "confidence_cap"]
    order = F.struct("id", "value") if "id" in config.columns else F.struct("value")
    rows = config.where(F.col("knob").isin(names) & F.col("value").isNotNull()).groupBy("knob").agg(F.max(order).getField("value").alias("value"))
    found = {r.knob: r.value for r in rows.collect()}
    return {
        "decay": {level: found.get(f"decay.{level}", d) for level, d in S.DECAY.items()},
        "lift": found.get("primary_lift", S.PRIMARY_LIFT),
        "cap": found.get("confidence_cap", S.CONFIDENCE_CAP),
    }


def knob_candidates(proposals: DataFrame) -> list[dict[str, float]]:
    """One decay table for each pending proposal (knob, value) of a level's decay, in order of knob and value.

    Equal proposals give one table; knobs of no known level give none. There are
    as many tables as different values are proposed, which people do one by one.
    """
    rows = proposals.where(F.col("knob").isin(DECAY_KNOBS) & F.col("value").isNotNull()).select("knob", "value").distinct().orderBy("knob", "value").collect()
    return [S.DECAY | {r.knob.removeprefix("decay."): float(r.value)} for r in rows]


def live_messages(log: DataFrame) -> DataFrame:
    """Log rows as messages of the live tail."""
    return log.select("id", F.to_json(F.struct("type", "stream_id", F.col("created_at").cast("string").alias("at"), F.substring("data", 1, 500).alias("data"))).alias("message"))


def history_of(log: DataFrame, name: str) -> DataFrame:
    """Events of one claim or cluster: by stream, or as the target."""
    return log.where((F.col("stream_id") == name) | (F.get_json_object("data", "$.target") == name)).orderBy("id")


def other_clusters(clusters: DataFrame, cluster: str) -> DataFrame:
    """What a cluster could be merged with."""
    return clusters.where(F.col("id") != cluster).orderBy(F.desc("confidence"), "id")


def latest_state_by(log: DataFrame, kind: str, key: str, value: str) -> DataFrame:
    """Latest value of a payload field for each value of another, for one event type."""
    e = log.where(F.col("type") == kind).select("id", F.get_json_object("data", f"$.{key}").alias(key), F.get_json_object("data", f"$.{value}").alias(value))
    return e.groupBy(key).agg(last_of(value).alias(value))


def dead_letters(log_errors: DataFrame, most: int = 6) -> DataFrame:
    """Deliveries (id, stage, n, error) that were tried too often, the last error of each."""
    return latest(log_errors.where(F.col("n") >= most), ["id", "stage"], [F.desc("n")])
