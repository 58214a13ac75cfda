"""Folds from a state and a tail equal folds of the whole log, at random cuts of random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, states as S
from tessera.operators.log import LOG_SCHEMA
from tests.test_operators import log_of


def random_log(r, n):
    c = lambda: f"c{r.randrange(6)}"
    claims = lambda *more: [{"id": c(), **{k: r.choice(["x", "y", None]) for k in more}} for _ in range(r.randrange(3))]
    node = lambda: {"id": c(), "headline": r.choice("hk"), "first_seen": r.random(), "last_updated": r.random(), "cluster_count": r.randrange(5), "topic_embedding": r.choice([None, [r.random()]])}
    edge = lambda: {"kind": r.choice("ab"), "from_id": c(), "to_id": c()}
    graph = lambda: {"nodes": [node() for _ in range(r.randrange(3))], "edges": [edge() for _ in range(r.randrange(2))]}
    make = [
        lambda: ("article.ingested", {"title": r.choice("pq"), "source": r.choice("st"), "url": c(), "body": r.choice(["b", None])}),
        lambda: ("claims.extracted", {"article_id": c(), "claims": claims("voice", "kind", "text")}),
        lambda: ("claims.classified", {"claims": claims("kind", "horizon")}),
        lambda: ("admin.classification.corrected", {"target": c(), "kind": r.choice(["k", None]), "voice": r.choice(["v", None])}),
        lambda: ("admin.laundering.flagged", {"target": c(), "flagged": r.random() < 0.5}),
        lambda: ("claim.disputed", {"claim_id": c()}),
        lambda: ("cluster.corroborated", {"fact": c(), "independent_originators": r.randrange(4), "confidence": r.choice([None, r.random()])}),
        lambda: ("cluster.grounded", {"grounding": r.choice(["supported", None]), "confidence": r.choice([None, r.random()])}),
        lambda: ("cluster.removed", {}),
        lambda: ("cluster.snapshot", {"cluster_id": c(), "confidence": r.random(), "harvested_at": r.choice([None, "2024-01-02"])}),
        lambda: ("claim.related", {"claim_a": c(), "claim_b": c(), "relation": "r", "score": r.random()}),
        lambda: ("story.graph.delta", graph()),
        lambda: ("story.graph.delta", graph()),
        lambda: ("story.graph.delta", graph() | {"reset": r.random() < 0.3}),
        lambda: ("admin.prompt.updated", {"target": c(), "text": str(r.random())}),
        lambda: ("acquisition.notify_requested", {"email": c(), "beta": r.random() < 0.3, "platform": r.choice(["web", None])}),
        lambda: ("acquisition.viewed", {"visitor_id": c()}),
        lambda: ("unheard.of", {}),
    ]
    return [(c(), *r.choice(make)()) for _ in range(n)]


def rows(table):
    tables = table if isinstance(table, dict) else {"": table}
    return {k: sorted(map(repr, (r.asDict(True) for r in t.collect()))) for k, t in tables.items()}


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # small logs, many folds
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_any_cut_gives_the_full_fold(spark, tmp_path, one_partition):
    seed = random.randrange(10**6)
    r = random.Random(seed)
    spark.createDataFrame(log_of(spark, random_log(r, 400)).collect(), LOG_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    plain = {"articles": folds.articles, "extracted_claims": folds.extracted_claims, "claims": folds.claims, "clusters": folds.clusters, "cluster_snapshots": folds.cluster_snapshots, "claim_relations": folds.claim_relations}
    plain |= {"story_graph": folds.story_graph_tables, "prompts": folds.prompts, "acquisition_signals": folds.acquisition_signals, "acquisition_signups": folds.acquisition_signups}
    folder = f"file://{tmp_path}/states"
    cuts = sorted(r.sample(range(1, 400), 2))
    mark = S.save(log.where(F.col("id") <= cuts[0]), folder)
    mark = S.advance(spark, folder, mark, log.where(F.col("id") <= cuts[1]))
    assert mark == cuts[1] and S.advance(spark, folder, mark, log.where(F.col("id") <= cuts[1])) == mark
    assert set(plain) == set(S.FOLDS)
    for name, fold in plain.items():
        assert rows(S.rebuilt(spark, folder, mark, log, name)) == rows(fold(log)), (name, seed, cuts)


def test_states_are_a_few_events_a_key(spark, one_partition):
    events = [("c1", "cluster.corroborated", {"confidence": i / 100}) for i in range(50)] + [("c2", "cluster.corroborated", {}), ("c2", "cluster.removed", {}), ("c2", "cluster.grounded", {"grounding": "x"})]
    events += [("k", "claims.classified", {"claims": [{"id": "k"}]})] * 5 + [("a", "claims.extracted", {"claims": [{"id": "k"}]})] * 5 + [("k", "claims.classified", {"claims": [{"id": "k", "kind": str(i)}]}) for i in range(5)]
    log = log_of(spark, events)
    assert sorted(x.id for x in S.cluster_events(log).collect()) == [1, 50]
    assert sorted(x.id for x in S.claim_events(log).collect()) == [59, 68]
    empty = log.where("id < 0")
    assert all(fold.state(empty).count() == 0 for fold in S.FOLDS.values())
