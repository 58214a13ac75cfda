"""Folds, deliveries and appends as keyed state of a stream: a batch reads its own rows and the state of their keys, nothing earlier.

A fold's state is a short list of events per key, those that still matter (as in
operators/states.py). A batch adds its events, folds the list in order of ids by
a small function on one key's events, and keeps what still matters. As ids are
kept, an event that comes late takes its place among the kept ones. Tables are
written by batch below a folder (a repeated batch replaces its own files), and
of a key the last batch counts, so no result goes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.operators.log import latest

#: Times are microseconds while they are in a state.
_EVENT = "id long, pos int, type string, data string, created_at long"
CLUSTER = "id string, alive boolean, fact string, independent_originators int, has_primary boolean, extremity string, confidence double, grounding string, created_at long"
CLAIM = "claim_id string, article_id string, text string, kind string, voice string, speaker string, corrected boolean, laundering_flag boolean, disputed boolean, created_at long"


def fold_cluster(key: str, events: list[Row]) -> tuple[dict | None, list[Row]]:
    """(row of the table, events that still matter) of one cluster's events in order."""
    life: list[tuple[Row, dict]] = []
    for e in events:
        if e.type == "cluster.removed":
            life = []
        elif life or e.type == "cluster.corroborated":
            life.append((e, json.loads(e.data)))
    if not life:
        return {"id": key, "alive": False}, []
    made = [(e, d) for e, d in life if e.type == "cluster.corroborated"]
    judged = [(e, d) for e, d in life if e.type == "cluster.grounded"]
    sure = [(e, d) for e, d in life if d.get("confidence") is not None]
    oldest = min(life, key=lambda x: (x[0].created_at is None, x[0].created_at or 0, x[0].id))
    keep = {x[0].id: x[0] for x in (life[0], made[-1], oldest, *judged[-1:], *sure[-1:])}
    d = made[-1][1]
    row = {"id": key, "alive": True, "created_at": oldest[0].created_at} | {k: d.get(k) for k in ("fact", "independent_originators", "has_primary", "extremity")}
    row["confidence"] = float(sure[-1][1]["confidence"]) if sure else None
    verdict = judged[-1][1] if judged else {}
    row["grounding"] = verdict.get("grounding") if verdict.get("grounding") is not None else verdict.get("verdict")
    return row, [keep[i] for i in sorted(keep)]


def fold_claim(key: str, events: list[Row]) -> tuple[dict | None, list[Row]]:
    """(row of the table, events that still matter) of one claim's events in order; their data is this claim's part of them."""
    born = next((e for e in events if e.type == "claims.extracted"), None)
    if born is None:
        return None, []
    row = {"claim_id": key, "corrected": False, "laundering_flag": False, "disputed": False, "created_at": born.created_at}
    d = json.loads(born.data)
    row |= {k: d.get(k) for k in ("article_id", "text", "kind", "voice", "speaker")}
    keep = {(born.id, born.pos): born}
    slots: dict[str, Row] = {}
    for e in events:
        if e.id <= born.id:
            continue
        d = json.loads(e.data)
        if e.type == "claims.classified" and not row["corrected"]:
            row["kind"] = d.get("kind")
            slots["sorted"] = e
        elif e.type == "admin.classification.corrected":
            slots.setdefault("corrected", e)
            row["corrected"] = True
            for k in ("kind", "voice", "speaker"):
                if d.get(k) is not None:
                    row[k], slots[k] = d[k], e
        elif e.type == "admin.laundering.flagged":
            slots.setdefault("corrected", e)
            row["corrected"], row["laundering_flag"], slots["flag"] = True, bool(d.get("flagged")), e
        elif e.type == "claim.disputed":
            slots.setdefault("disputed", e)
            row["disputed"] = True
    keep |= {(e.id, e.pos): e for e in slots.values()}
    return row, [keep[i] for i in sorted(keep)]


class KeyedFold(StatefulProcessor):
    """A fold of each key's events; gives the key's row whenever a batch has touched it."""

    def __init__(self, fold: Callable[[str, list[Row]], tuple[dict | None, list[Row]]], columns: list[str]) -> None:
        self.fold, self.columns = fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = [Row(id=i, pos=p, type=t, data=d, created_at=at) for i, p, t, d, at in self.kept.get()]
        events = {(e.id, e.pos): e for e in [*old, *(Row(id=r.id, pos=r.pos, type=r.type, data=r.data, created_at=r.created_at) for r in rows)]}
        row, keep = self.fold(key[0], [events[i] for i in sorted(events)])
        if keep:
            self.kept.put([(e.id, e.pos, e.type, e.data, e.created_at) for e in keep])
        else:
            self.kept.clear()
        if row is not None:
            yield Row(**{c: row.get(c) for c in self.columns})

    def close(self) -> None:
        pass


class Deliveries(StatefulProcessor):
    """Tries of a delivery counted: a failure comes back with its number until the last one allowed, which is a dead letter, once."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getValueState("tries", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = self.tries.get()[0] if self.tries.exists() else 0
        for r in sorted(rows, key=lambda r: r.at):
            if n >= self.most:  # dead: what comes after it is of no account
                break
            if r.ok:
                n = 0
                continue
            n += 1
            yield Row(stage=key[0], id=key[1], attempt=n, dead=n >= self.most, error=r.error)
        if n:
            self.tries.update((n,))
        else:
            self.tries.clear()

    def close(self) -> None:
        pass


def _with_state(events: DataFrame) -> None:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def cluster_rows(events: DataFrame) -> DataFrame:
    """The stream of cluster events as the stream of their table's rows."""
    _with_state(events)
    own = events.where(F.col("type").isin("cluster.corroborated", "cluster.grounded", "cluster.removed")).withColumn("pos", F.lit(0))
    names = [c.split()[0] for c in CLUSTER.split(", ")]
    own = own.withColumn("created_at", F.unix_micros("created_at"))
    return own.groupBy("stream_id").transformWithState(KeyedFold(fold_cluster, names), CLUSTER, "Update", "None").withColumn("created_at", F.timestamp_micros("created_at"))


def claim_events(events: DataFrame) -> DataFrame:
    """(claim_id, id, pos, type, data, created_at): each event that tells of claims once for each of them, with its part of the data."""
    item = "struct<id:string,text:string,voice:string,speaker:string,kind:string,is_synthesis:boolean,horizon:string>"
    d = events.where(F.col("type").isin("claims.extracted", "claims.classified", "admin.classification.corrected", "admin.laundering.flagged", "claim.disputed"))
    d = d.withColumn("d", F.from_json("data", f"article_id string, target string, claim_id string, claims array<{item}>"))
    listed = F.col("type").isin("claims.extracted", "claims.classified")
    of = F.when(F.col("type") == "claim.disputed", F.coalesce("d.claim_id", "stream_id")).otherwise(F.col("d.target"))
    article = F.coalesce("d.article_id", "stream_id")
    parts = F.when(listed, F.transform("d.claims", lambda c: F.struct(c["id"].alias("claim_id"), F.to_json(F.struct(article.alias("article_id"), c["text"].alias("text"), c["voice"].alias("voice"), c["speaker"].alias("speaker"), c["kind"].alias("kind"))).alias("data"))))
    parts = parts.otherwise(F.array(F.struct(of.alias("claim_id"), F.col("data").alias("data"))))
    rows = d.select("id", "type", "created_at", F.posexplode(parts).alias("pos", "p")).where("p.claim_id is not null")
    return rows.select("p.claim_id", "id", "pos", "type", "p.data", "created_at")


def claim_rows(events: DataFrame) -> DataFrame:
    """The stream of claim events as the stream of their table's rows."""
    _with_state(events)
    names = [c.split()[0] for c in CLAIM.split(", ")]
    rows = claim_events(events).withColumn("created_at", F.unix_micros("created_at"))
    return rows.groupBy("claim_id").transformWithState(KeyedFold(fold_claim, names), CLAIM, "Update", "None").withColumn("created_at", F.timestamp_micros("created_at"))


def counted_deliveries(tries: DataFrame, most: int = 6) -> DataFrame:
    """(stage, id, attempt, dead, error) of each failed try (stage, id, at, ok, error); the most-th is a dead letter and the last row of its delivery."""
    _with_state(tries)
    kind = dict(tries.dtypes)["id"]
    return tries.groupBy("stage", "id").transformWithState(Deliveries(most), f"stage string, id {kind}, attempt int, dead boolean, error string", "Append", "None")


def once_across_batches(new: DataFrame, key: str = "js_seq") -> DataFrame:
    """Rows of a stream, one for each key whatever the batch it comes in; rows without a key are all new. The state holds keys alone."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).union(new.where(F.col(key).isNull()))


def write_by_batch(rows: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run a stream over all that has landed; each batch writes files of its own, which a repeat replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of each key the row of the last batch that has it."""
    return latest(spark.read.parquet(folder), keys, [F.desc("batch")]).drop("batch")


def run_to_table(rows: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that has landed; its table, from files below folder."""
    write_by_batch(rows, f"{folder}/table", f"{folder}/checkpoint", mode).awaitTermination()
    return table_of(rows.sparkSession, f"{folder}/table", keys)
