import json

from pyspark.sql import functions as F

from tessera.operators import admin as A, stories as ST
from tests.test_operators import log_of


def test_commands_refuse_rows_without_a_target(spark):
    rows = spark.createDataFrame([("src1", "bad"), ("", "none"), (None, "none")], "target string, why string")
    got = A.command_events(rows, "flag-source", F.col("target"), F.col("why"), status=F.lit("deny")).collect()
    assert [(x.stream_id, x.type, json.loads(x.data)) for x in got] == [("src1", "admin.source.flagged", {"target": "src1", "actor": "operator", "reason": "bad", "status": "deny"})]


def test_prompts_and_knobs(spark):
    log = log_of(spark, [("p", "admin.prompt.updated", {"target": "x", "text": "v1"}), ("p", "admin.prompt.updated", {"target": "x", "text": "v2"}), ("p", "admin.prompt.reviewed", {"target": "x", "version": 1})])
    assert A.active_text(log, "x", "d").first().text == "v2" and A.active_text(log, "y", "d").first().text == "d"
    assert [(x.version, x.reviewed) for x in A.reviewed_prompts(log).orderBy("version").collect()] == [(1, True), (2, False)]
    o = A.overrides(spark.createDataFrame([("decay.notable", 0.5), ("confidence_cap", 0.9)], "knob string, value double"))
    assert o["decay"]["notable"] == 0.5 and o["decay"]["routine"] == 0.35 and o["cap"] == 0.9
    assert A.knob_candidates(spark.createDataFrame([("decay.notable", 0.4)], "knob string, value double"))[0]["notable"] == 0.4


def test_knobs_beyond_a_hundred_rows(spark):
    rows = [(f"unheard.of.{i}", 0.1, i) for i in range(150)] + [("decay.notable", 0.3, 150), ("decay.notable", 0.5, 151), ("primary_lift", None, 152)]
    config = spark.createDataFrame(rows, "knob string, value double, id long")
    o = A.overrides(config)
    assert o["decay"]["notable"] == 0.5 and o["lift"] == A.S.PRIMARY_LIFT
    many = spark.createDataFrame([("decay.notable", i / 300) for i in range(150)] + [("decay.notable", 0.0), ("decay.x", 1.0)], "knob string, value double")
    assert [c["notable"] for c in A.knob_candidates(many)] == [i / 300 for i in range(150)]


def test_social_events_and_history(spark):
    rows = spark.createDataFrame([("u", "c1", None, "hi"), ("u", "c1", None, "hi")], "user_id string, cluster_id string, comment_id string, body string")
    ids = {json.loads(x.data)["comment_id"] for x in A.social_events(rows, "comment.added").collect()}
    assert len(ids) == 1
    log = log_of(spark, [("c1", "a", {}), ("x", "b", {"target": "c1"}), ("x", "b", {"target": "c2"})])
    assert [r.id for r in A.history_of(log, "c1").collect()] == [1, 2]
    assert [json.loads(r.message)["type"] for r in A.live_messages(log).orderBy("id").collect()] == ["a", "b", "b"]


def test_regroup_recomputes_what_changed_and_names_the_empty(spark):
    rows = [("c1", "k1", "a1", "Alpha", "one body of text here said she"), ("c1", "k2", "a2", "Beta", "quite another body of text said he"), ("c2", "k3", "a3", "Gamma", "a third body altogether said they"), ("c3", "k4", "a4", "Delta", "left as it is said it")]
    members = spark.createDataFrame(rows, "cluster_id string, claim_id string, article_id string, source string, body string")
    now, empty = ST.regroup(members, spark.createDataFrame([("k3", "c1")], "claim_id string, to_cluster string"))
    assert {x.cluster_id: x.independent_originators for x in now.collect()} == {"c1": 3} and [x.cluster_id for x in empty.collect()] == ["c2"]


def test_small_story_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(ST.summary(F.lit("A fact"), F.array(F.lit("a fact "), F.lit("x"), F.lit("y"), F.lit("z")))) == "A fact x y"
    assert one(ST.direct_owners(F.array(F.lit("Q1"), F.lit("P2"), F.lit("Q1"), F.lit("Q3")))) == ["Q1", "Q3"]
    gate = lambda r, k, v: one(ST.gate(F.lit(r), F.lit(k), F.lit(v).cast("boolean")))
    assert gate(False, False, None) and not gate(True, True, True) and gate(False, True, False) and not gate(False, False, False)
    c = spark.createDataFrame([("s", 1, "Q1", "https://other.org"), ("s", 2, "Q2", "https://www.s/x"), ("t", 1, "Q3", "u")], "source string, pos int, qid string, site string")
    assert {x.source: x.qid for x in ST.pick_entity(c).collect()} == {"s": "Q2", "t": "Q3"}
