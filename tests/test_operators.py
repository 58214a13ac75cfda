import json
import os
import random
from collections import Counter
from functools import reduce
from itertools import permutations
from operator import add

import pytest
from pyspark.sql import functions as F

from tessera.operators import feed, folds, graph as G, history as H, log as L, similarity as S, steering
from tessera.operators.components import connected_components, forest
from tessera.functions.vectors import centroids
from tessera.operators.ordering import numbered
from tessera.operators.originators import alias_clusters, collapse_originators, corroborate


def log_of(spark, events):
    """events: (stream_id, type, payload); ids count up from 1, one a minute."""
    rows = [(i, s, t, json.dumps(d), "default", 1_700_000_000 + 60 * i) for i, (s, t, d) in enumerate(events, 1)]
    df = spark.createDataFrame(rows, "id long, stream_id string, type string, data string, tenant_id string, t long")
    return df.withColumn("created_at", F.timestamp_seconds("t")).drop("t")


def components_of(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_connected_components_against_union_find(spark):
    r = random.Random(5)
    for n, m in ((60, 30), (60, 80), (400, 300)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        df = spark.createDataFrame(edges + [(None, 3), (2, None)], "a long, b long").repartition(3)
        assert {x.node: x.component for x in connected_components(df).collect()} == components_of(n, edges)
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(4)
    assert {x.component for x in connected_components(chain).collect()} == {0}
    star = spark.createDataFrame([(0, i) for i in range(1, 500)], "a long, b long")
    assert connected_components(star).count() == 500
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []
    assert dict(forest([(3, 2), (2, 1), (5, 4)])) == {3: 1, 2: 1, 5: 4}


def test_cluster_fold_against_a_row_at_a_time_fold(spark):
    r = random.Random(9)
    for _ in range(3):
        events, state = [], {}
        for _ in range(120):
            c = f"c{r.randrange(8)}"
            kind = r.choice(["cluster.corroborated"] * 3 + ["cluster.grounded"] * 2 + ["cluster.removed"])
            if kind == "cluster.removed":
                d = {}
                state.pop(c, None)
            elif kind == "cluster.grounded":
                d = {"grounding": r.choice(["supported", "contradicted"]), "confidence": r.randrange(100) / 100}
                if c in state:
                    state[c] |= d
            else:
                d = {"fact": f"f{r.randrange(9)}", "independent_originators": r.randrange(5), "confidence": r.randrange(100) / 100}
                state[c] = {"grounding": None} | state.get(c, {}) | d
            events.append((c, kind, d))
        got = {x.id: (x.fact, x.independent_originators, x.confidence, x.grounding) for x in folds.clusters(log_of(spark, events)).collect()}
        assert got == {c: (s["fact"], s["independent_originators"], s["confidence"], s["grounding"]) for c, s in state.items()}


def test_claims_fold_against_a_row_at_a_time_fold(spark):
    r = random.Random(2)
    events, state = [], {}
    for _ in range(250):
        c, what = f"k{r.randrange(12)}", r.choice(["extract", "classify", "classify", "fix", "flag", "dispute"])
        known, kind = state.get(c), r.choice(["fact", "projection"])
        if what == "extract":
            events.append(("art", "claims.extracted", {"claims": [{"id": c, "text": "t", "voice": "own"}]}))
            state.setdefault(c, {"kind": None, "voice": "own", "corrected": False, "flag": False, "disputed": False})
        elif what == "classify":
            events.append((c, "claims.classified", {"claims": [{"id": c, "kind": kind}]}))
            if known and not known["corrected"]:
                known["kind"] = kind
        elif what == "fix":
            d = {"target": c} | ({"kind": kind} if r.random() < 0.5 else {"voice": "attributed"})
            events.append((c, "admin.classification.corrected", d))
            if known:
                known |= {"kind": d.get("kind") or known["kind"], "voice": d.get("voice") or known["voice"], "corrected": True}
        elif what == "flag":
            f = r.random() < 0.5
            events.append((c, "admin.laundering.flagged", {"target": c, "flagged": f}))
            if known:
                known |= {"flag": f, "corrected": True}
        else:
            events.append((c, "claim.disputed", {"claim_id": c}))
            if known:
                known["disputed"] = True
    got = {x.claim_id: (x.kind, x.voice, x.corrected, x.laundering_flag, x.disputed) for x in folds.claims(log_of(spark, events)).collect()}
    assert got == {c: (s["kind"], s["voice"], s["corrected"], s["flag"], s["disputed"]) for c, s in state.items()}


def test_article_prompt_and_signup_folds(spark):
    log = log_of(
        spark,
        [
            ("a", "article.ingested", {"title": "one", "source": "s1", "body": "b"}), ("a", "article.ingested", {"title": "two", "source": "s2"}), ("p", "admin.prompt.updated", {"target": "x", "text": "v1"}),
            ("p", "admin.prompt.updated", {"target": "x", "text": "v2"}), ("e", "acquisition.notify_requested", {"email": "m", "platform": "web"}), ("e", "acquisition.notify_requested", {"email": "m", "beta": True, "platform": "ios"}),
            ("e", "acquisition.notify_requested", {"email": ""}), ("z", "unheard.of", {"title": "x"}),
        ],
    )
    a = folds.articles(log).first()
    assert (a.title, a.source, a.body) == ("two", "s1", None)
    assert [(p.version, p.text, p.active) for p in folds.prompts(log).orderBy("version").collect()] == [(1, "v1", False), (2, "v2", True)]
    s = folds.acquisition_signups(log).collect()
    assert [(x.email, x.hits, x.beta, x.platform) for x in s] == [("m", 2, True, "web")]


def test_snapshot_and_tail_give_the_full_fold(spark, tmp_path):
    r = random.Random(4)
    events = [(f"c{r.randrange(5)}", "claim.related", {"claim_a": "a", "claim_b": f"b{r.randrange(4)}", "relation": "r", "score": r.random()}) for _ in range(40)]
    log = log_of(spark, events)
    folder = f"file://{tmp_path}/snap"
    head = log.where("id <= 25")
    for mark in (10, 25):
        L.snapshot(spark, {"relations": folds.claim_relations(log.where(F.col("id") <= mark))}, mark, folder, keep=1)
    assert [x.watermark for x in L.manifest(spark, folder, 1).collect()] == [25]
    old, mark = L.restore(spark, folder, "relations", folds.claim_relations(head).schema)
    assert mark == 25
    tail = folds.claim_relations(L.since(log, mark))
    both = tail.unionByName(old.join(tail, ["claim_a", "claim_b", "relation"], "left_anti"))
    assert sorted(both.collect()) == sorted(folds.claim_relations(log).collect())


def test_append_once_and_quarantine(spark):
    old = spark.createDataFrame([(1, "x")], "js_seq long, v string")
    new = spark.createDataFrame([(1, "again"), (2, "y"), (2, "y"), (None, "n"), (None, "n")], "js_seq long, v string")
    assert sorted(r.v for r in L.append_once(old, new).collect()) == ["n", "n", "y"]
    good, dead = L.quarantine(spark.createDataFrame([('{"k": 1}',), ("{bad",), (None,)], "data string"), "k int", "extract")
    assert [r.payload.k for r in good.collect()] == [1] and [r.stage for r in dead.collect()] == ["extract"] * 2


def upgma(sim, t):
    """Average linkage by the mean of all cross similarities, from scratch at every step."""
    groups = [[i] for i in range(len(sim))]
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                m = sum(sim[a][b] for a in groups[i] for b in groups[j]) / (len(groups[i]) * len(groups[j]))
                if m >= t and (best is None or m > best[0] + 1e-12):
                    best = (m, i, j)
        if not best:
            return sorted(sorted(g) for g in groups)
        groups[best[1]] += groups.pop(best[2])


def test_average_linkage(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == k) for k in set(labels))
    for n in (0, 1, 2, 9, 9, 9, 9, 9, 9, 9, 9, 14, 25, 40):
        v = r.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1)[:, None]
        for t in (0.2, 0.5, 0.8):
            assert groups(S.average_linkage(v, np.ones(n), t)) == upgma((v @ v.T).tolist(), t)
    # 500 pairs of equal vectors, orthogonal to each other
    pairs = np.repeat(np.eye(500), 2, axis=0)
    assert groups(S.average_linkage(pairs, np.ones(1000), 0.82)) == [[2 * i, 2 * i + 1] for i in range(500)]
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(99, [0.0] * 4)]
    rows += [(100 + i, [2 * x for x in rows[i % 3][1]]) for i in range(12)]  # copies in all but length
    df = spark.createDataFrame(rows, "id long, v array<double>")
    at = [i for i, _ in rows if i != 99]
    m = np.array([v for i, v in rows if i != 99])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = sorted(sorted(at[i] for i in g) for g in upgma((m @ m.T).tolist(), 0.7))
    for bound in (8192, 5):  # in one task, and in rounds on Spark
        monkeypatch.setattr(S, "GROUP_ROWS", bound)
        got = S.group_by_similarity(df, "id", "v", 0.7, blocks=3).collect()
        by = {}
        for x in got:
            by.setdefault(x.group, []).append(x.id)
        assert sorted(sorted(g) for g in by.values() if 99 not in g) == want and len(got) == 73 and all(min(g) == k for k, g in by.items())


def first_best(sim, t):
    """Merges the first of the best pairs in index order, by group averages kept in a matrix."""
    import numpy as np

    s, groups = np.array(sim, float), {i: [i] for i in range(len(sim))}
    np.fill_diagonal(s, -np.inf)
    while len(groups) > 1:
        a, b = divmod(int(np.argmax(np.round(s, 12))), len(s))
        if np.round(s[a, b], 12) < t:
            break
        a, b = min(a, b), max(a, b)
        s[a] = s[:, a] = (len(groups[a]) * s[a] + len(groups[b]) * s[b]) / (len(groups[a]) + len(groups[b]))
        s[a, a] = s[b] = s[:, b] = -np.inf
        groups[a] += groups.pop(b)
    return sorted(sorted(g) for g in groups.values())


def test_average_linkage_of_tied_rows(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(7)
    cases = [([[np.cos(2 * np.pi * i / 12), np.sin(2 * np.pi * i / 12)] for i in range(12)], 0.9, 0)]  # at equal angles
    cases += [(r.integers(-1, 2, (30, 3)).astype(float), t, 1) for t in (0.5, 0.8)]  # few directions, many equal angles
    cases += [(r.permutation(np.repeat(np.eye(6), 4, axis=0)) + 0.0, 0.82, 2)]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == k) for k in set(labels))
    for v, t, _ in cases:
        v = np.array(v)
        v = v[np.linalg.norm(v, axis=1) > 0]
        u = v / np.linalg.norm(v, axis=1)[:, None]
        want = first_best(u @ u.T, t)
        assert groups(S.average_linkage(u, np.ones(len(u)), t)) == want
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
        for bound in (8192, 3):  # in one task, and in rounds on Spark
            monkeypatch.setattr(S, "GROUP_ROWS", bound)
            by = {}
            for x in S.group_by_similarity(df, "id", "v", t, blocks=2).collect():
                by.setdefault(x.group, []).append(x.id)
            assert sorted(sorted(g) for g in by.values()) == want


def test_nearest_pairs_are_thinned_in_tasks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(120, 3))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    sim = u @ u.T
    want = set()
    for i in range(120):
        near = sorted(((sim[i, j], j) for j in range(120) if j != i and sim[i, j] >= 0.5), reverse=True)[:4]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "TILE", 7)
    got = [(x.a, x.b) for x in S.nearest_pairs(df, "id", "v", 4, 0.5, blocks=2).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_cosine_blocks_grow_with_the_rows(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    v = r.normal(size=(300, 6)).round(1)
    v[50:60] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if u[a] @ u[b] >= 0.8}
    monkeypatch.setattr(S, "BLOCK_ROWS", 20, raising=False)
    monkeypatch.setattr(S, "TILE", 3, raising=False)
    seen = []
    frame = type(df.groupBy("id"))
    real = frame.applyInArrow

    def spy(self, f, schema):
        seen.append(self._df.groupBy("i", "j").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0])
        return real(self, f, schema)

    monkeypatch.setattr(frame, "applyInArrow", spy)
    got = {(x.a, x.b): x.sim for x in S.cosine_pairs(df, "id", "v", 0.8).collect()}
    assert set(got) == want and all(abs(s - u[a] @ u[b]) < 1e-9 for (a, b), s in got.items())
    assert seen[0] <= 60  # two blocks of about 20; blocks fixed at eight give two of about 38


def test_scale_case_of_one_hot_vectors(spark):
    rows = [(i, [1.0 if k == i % 50 else 0.0 for k in range(50)]) for i in range(100)]
    got = S.group_by_similarity(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.82).collect()
    assert Counter(x.group for x in got) == {i: 2 for i in range(50)}


def test_shingle_pairs_against_all_pairs(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(30)] for _ in range(4)]
    docs = []
    for i in range(40):
        w = list(r.choice(base))
        for _ in range(r.randrange(6)):
            w[r.randrange(30)] = f"x{r.randrange(99)}"
        docs.append((i, " ".join(w[: r.randrange(1, 31)])))
    docs += [(100, ""), (101, ""), (102, None)]
    sets = {i: {" ".join(w[k : k + 4]) for k in range(len(w) - 3)} if len(w := (t or "").lower().split()) >= 4 else {" ".join(w)} for i, t in docs}
    for t in (0.3, 0.4, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(x.a, x.b) for x in S.shingle_pairs(spark.createDataFrame(docs, "id long, t string"), "id", "t", t).collect()} == want


@pytest.mark.parametrize("few, unit", [(64, 4096), (4, 5)])
def test_near_copies_against_all_pairs(spark, monkeypatch, few, unit):
    monkeypatch.setattr(S, "FEW", few)
    monkeypatch.setattr(S, "UNIT", unit)
    r = random.Random(few)
    base = [[f"w{r.randrange(60)}" for _ in range(30)] for _ in range(4)]
    docs = []
    for i in range(40):
        w = list(r.choice(base))
        for _ in range(r.randrange(9)):
            w[r.randrange(30)] = f"x{r.randrange(99)}"
        docs.append((i, " ".join(w[: r.randrange(1, 31)]), r.choice(["p", "q", None])))
    docs += [(100 + i, " ".join(base[0]), "p") for i in range(20)] + [(200, "", "p"), (201, None, "p"), (202, "", "q")]
    sets = {i: {" ".join(w[k : k + 4]) for k in range(len(w) - 3)} if len(w := (t or "").lower().split()) >= 4 else {" ".join(w)} for i, t, _ in docs}
    group = {i: g for i, _, g in docs}
    df = spark.createDataFrame(docs, "id long, t string, g string")
    for t in (0.4,):
        near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t]
        for within in ([], ["g"]):
            want = components_of(300, [(a, b) for a, b in near if not within or group[a] == group[b]])
            assert {x.node: x.component for x in S.near_copies(df, "id", "t", t, within=within).collect()} == want


def test_near_copies_make_no_pairs_of_pairs(spark, monkeypatch):
    """A third of the rows are copies but for one word: the pairs looked at are in proportion to rows."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:20] + [f"own{i}"] + base[20:])) for i in range(300)] + [(1000 + i, " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(300)]
    seen, real = [], S._verified
    monkeypatch.setattr(S, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    got = S.near_copies(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6).collect()
    assert {x.node for x in got} == set(range(300)) and {x.component for x in got} == {0}
    assert sum(seen) < 100 * 300  # all pairs would be 44,850, and grow with the square


@pytest.mark.parametrize("unit", [4096, 2])
def test_candidates_by_entity(spark, unit):
    r = random.Random(3)
    make = lambda n: [(i, [r.choice("abcdefgh") for _ in range(r.randrange(4))] + (["hot"] if i % 2 else [])) for i in range(n)]
    clusters, nodes = make(20), make(30)
    got = {(x.cluster_id, x.id): x.shared for x in G.entity_candidates(spark.createDataFrame(clusters, "cluster_id long, spine array<string>"), spark.createDataFrame(nodes, "id long, spine array<string>"), unit).collect()}
    assert got == {(c, n): len(set(a) & set(b)) for c, a in clusters for n, b in nodes if set(a) & set(b)}


def test_numbers_in_order_are_whole_and_dealt_out(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1.0, 2.0, 3.0]), "x" * (i % 3)) for i in r.sample(range(1000), 500)]
    df = spark.createDataFrame(rows, "id long, v double, s string").repartition(3)
    got = numbered(df, F.desc("v"), "id").collect()
    want = sorted(rows, key=lambda x: (-(x[1] or 0), x[0]))
    assert [x.id for x in sorted(got, key=lambda x: x.place)] == [x[0] for x in want] and sorted(x.place for x in got) == list(range(1, 501))
    assert numbered(df.where("id < 0"), "id").collect() == [] and "place" in numbered(df, "id").columns


def test_centroids_equal_running_means(spark):
    r = random.Random(2)
    rows = [(i % 3, [r.random() for _ in range(4)]) for i in range(30)]
    want = {}
    for k, v in rows:
        n, c = want.get(k, (0, [0.0] * 4))
        want[k] = n + 1, [(a * n + x) / (n + 1) for a, x in zip(c, v)]
    for x in centroids(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v").collect():
        assert abs(want[x.k][1][x.i] - x["mean"]) < 1e-12


def test_originators_collapse_reprints_cascades_and_one_outlet(spark):
    text = "the minister will resign on friday after a vote in the lower house said the speaker"
    rows = [
        ("c", 1, "Alpha Gazette", text), ("c", 2, "Beta Courier", text + " today"), ("c", 3, "Gamma Times", "According to Alpha Gazette the minister goes"), ("c", 4, "Delta", "We have learned of plans"),
        ("c", 5, "Reuters", "a first report of it"), ("c", 6, "reuters.com", "a second one, quite another"), ("c", 7, None, "no source here"), ("c", 8, None, "nor here at all"), ("d", 1, "Alpha Gazette", text),
    ]
    df = spark.createDataFrame(rows, "cluster_id string, article_id long, source string, body string")
    got = {(x.cluster_id, x.article_id): x.originator for x in collapse_originators(df).collect()}
    assert got == {("c", 1): 1, ("c", 2): 1, ("c", 3): 1, ("c", 4): 4, ("c", 5): 5, ("c", 6): 5, ("c", 7): 7, ("c", 8): 8, ("d", 1): 1}
    owners = spark.createDataFrame([("delta", "group"), ("reuters", "group")], "canonical string, owner_label string")
    assert {x.originator for x in collapse_originators(df, owners=owners).where("article_id in (4, 5, 6)").collect()} == {4}
    c = {x.cluster_id: x for x in corroborate(df).collect()}
    assert c["c"].independent_originators == 5 and c["d"].independent_originators == 1 and 0 < c["c"].confidence <= 0.97


def test_alias_clusters(spark):
    names = ["Reuters", "reuters.com", "Thomson Reuters", "AFP", "Agence France-Presse", "Metro Weekly East", "Metro Weekly West Side", "The Times"]
    got = {}
    for x in alias_clusters(spark.createDataFrame([(n,) for n in names], "source string")).collect():
        got.setdefault(x.alias_group, set()).add(x.source)
    assert {"AFP", "Agence France-Presse"} in got.values() and {"Reuters", "reuters.com", "Thomson Reuters"} in got.values() and {"The Times"} in got.values()


def events_of(spark, rows):
    schema = "id long, fact string, sources array<string>, n_groups int, independent_originators int, has_primary boolean, extremity string, corrected boolean, grounding string, ts timestamp"
    return spark.createDataFrame(rows, schema)


def test_history(spark):
    from datetime import datetime

    t = lambda d: datetime(2024, 1, d)
    rows = [
        (1, "A  Fact", ["s1"], 1, 1, False, "notable", None, None, t(1)), (2, "a fact", ["s1", "s2"], 3, 3, False, "notable", None, None, t(2)), (3, "b", ["s1"], 1, 1, False, "extraordinary", None, None, t(1)),
        (4, "b", ["s1"], 1, 1, False, "extraordinary", True, None, t(3)), (5, "c", ["ministry"], 1, 1, False, "notable", None, None, t(1)), (6, "d", ["s2"], 2, 1, False, "notable", None, None, t(1)), (7, "d", ["s2"], 2, 2, False, "notable", None, None, t(9)),
    ]
    e = events_of(spark, rows)
    assert {x.key: x.outcome for x in H.observations(e).collect()} == {"a fact": "confirmed", "b": "refuted", "c": "unconfirmed", "d": "corroborating"}
    state = {x.key: x.state for x in H.lifecycles(e, F.lit("2024-01-09 12:00:00").cast("timestamp")).collect()}
    assert state == {"a fact": "extended", "b": "resolved", "c": "decayed", "d": "resolving"}
    rep = {x.source: x for x in H.reputation(e).collect()}
    assert rep["s1"].appearances == 2 and rep["s1"].independent_appearances == 1 and rep["s1"].solo_extraordinary == 1 and rep["s1"].confirmation_rate == 0.5
    assert rep["ministry"].independent_appearances == 1 and rep["ministry"].confirmation_rate is None
    p = H.preferences(H.reputation(e)).collect()
    assert sum(x.weight for x in p) <= 1.001 and [x.rank for x in sorted(p, key=lambda x: x.rank)] == [1, 2, 3]
    assert H.brier(H.observations(e)).first().n == 2
    series = {(x.source, x.cut): x.score for x in H.reputation_series(e, buckets=2).collect()}
    assert set(series) == {("s1", 4), ("s2", 4), ("s1", 7), ("s2", 7), ("ministry", 7)}


def test_mean_squared_error_is_the_same_in_any_order_of_rows(spark):
    rows = [(3, True, "extraordinary", "refuted"), (0, False, "extraordinary", "refuted"), (0, True, "routine", "confirmed"), (2, False, "notable", "refuted"), (3, False, "ordinary", "confirmed"), (2, False, "routine", "refuted")]
    squares = [(0.78 - 0) ** 2, 0.0, (0.5 - 1) ** 2, (0.7 - 0) ** 2, (0.91 - 1) ** 2, (0.88 - 0) ** 2]  # their mean is 0.35515
    for below in (True, False):
        order = next(p for p in permutations(range(6)) if (reduce(add, [squares[i] for i in p]) / 6 < 0.35515) == below)
        obs = spark.createDataFrame([rows[i] for i in order], "n long, primary boolean, extremity string, outcome string").coalesce(1)
        again = H.replay_ab(obs, dict.fromkeys(H.S.DECAY, 0.5)).first()
        assert H.brier(obs).first() == (0.3552, 6) and again.brier_base == 0.3552
    assert H.brier(obs.where("n > 9")).first() == (None, 0)


def test_tied_ids_are_on_one_side_of_a_cut_at_any_size(spark):
    n, half = 1_000_004, 500_002
    rest = ["1 AS n_groups", "1 AS independent_originators", "false AS has_primary", "'notable' AS extremity", "false AS corrected", "cast(null AS string) AS grounding", "timestamp'2024-01-01' AS ts"]
    many = spark.range(half - 1).union(spark.range(half + 2, n)).selectExpr("id", "concat('f', id % 7) AS fact", "array('s') AS sources", *rest)
    tied = spark.range(3).selectExpr(f"{half - 1}L AS id", "concat('tied', id) AS fact", "array(concat('t', id)) AS sources", *rest)
    got = {(x.source, x.cut) for x in H.reputation_series(many.union(tied), buckets=2).collect()}
    assert got == {(s, c) for s in ("s", "t0", "t1", "t2") for c in (half, n)}
    few = tied.union(tied.withColumn("id", F.lit(None).cast("long"))).union(tied.withColumn("id", F.col("id") + 1))
    # null ids are counted first, but no latest event can be told from them
    assert {x.cut for x in H.reputation_series(few, buckets=3).collect()} == {6, 9}
    assert H.reputation_series(few.where("false")).collect() == []


def greedy(stories, country_cap=0.25, source_cap=0.2, band=0.2):
    n = len(stories)
    cc, sc = max(1, int(n * country_cap + 0.999)), max(1, int(n * source_cap + 0.999))
    left, out, used = sorted(stories, key=lambda s: -s[2]), [], Counter()
    while left:
        ok = [s for s in left if s[2] >= left[0][2] - band and (not s[3] or used["c", s[3]] < cc) and (not s[4] or used["s", s[4]] < sc)]
        s = ok[0] if ok else left[0]
        left.remove(s)
        out.append(s[0])
        used["c", s[3]] += 1
        used["s", s[4]] += 1
    return out


def test_diversified_feed(spark):
    r = random.Random(6)
    for n in (1, 7, 40):
        stories = [(i, i, r.randrange(20) / 20, r.choice(["US", "US", "US", "FR", ""]), r.choice(["a", "a", "b", ""])) for i in range(n)]
        df = spark.createDataFrame(stories, "id long, pos long, confidence double, country string, source string")
        assert [x.id for x in feed.diversified(df).orderBy("feed_rank").collect()] == greedy(stories)


def test_diversified_feeds_by_key(spark):
    r = random.Random(9)
    stories = {f: [(f * 1000 + i, i, r.randrange(30) / 30, r.choice(["US", "US", "FR", "DE", "", None]), r.choice(["a", "a", "b", "c", "d", "", None])) for i in range(r.randrange(1, 200))] for f in range(12)}
    df = spark.createDataFrame([(f, *x) for f, rows in stories.items() for x in rows], "feed long, id long, pos long, confidence double, country string, source string")
    got = feed.diversified(df, by="feed").orderBy("feed", "feed_rank").collect()
    for f, rows in stories.items():
        assert [x.id for x in got if x.feed == f] == greedy([(*x[:3], x[3] or "", x[4] or "") for x in rows])


def test_queries_take_all_documents(spark):
    from tessera.plans import QUERIES, story_queries

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert n > 400 and QUERIES["t1_t2_diversified_feed"](spark, sf).count() == n
    assert story_queries._claims(spark, sf).count() == n


def rounds(cands, weights, budget):
    """Fetch order by taking one of each source in turn, best source first."""
    groups = {}
    for s, pos in cands:
        groups.setdefault(s, []).append(pos)
    order, out = sorted(groups, key=lambda s: (-weights.get(s, 0.02), s)), []
    while any(groups.values()):
        out += [groups[s].pop(0) for s in order if groups[s]]
    return out[:budget]


def test_rank_for_fetch_takes_sources_in_turn(spark):
    r = random.Random(1)
    cands = [(f"s{r.randrange(5)}", i) for i in range(30)]
    weights = {"s0": 0.3, "s1": 0.1, "s2": 0.1}
    got = steering.rank_for_fetch(spark.createDataFrame(cands, "source string, pos long"), spark.createDataFrame(list(weights.items()), "source string, weight double"), 12)
    assert [x.pos for x in got.orderBy("fetch_rank").collect()] == rounds(cands, weights, 12)


def test_as_of_and_filters(spark):
    s = spark.createDataFrame([("a", 1, 10), ("a", 3, 30), ("b", 2, 20)], "k string, day int, v int")
    assert sorted((x.k, x.day, x.v) for x in feed.as_of(s, "k", "day").collect()) == [("a", 1, 10), ("a", 2, 10), ("a", 3, 30), ("b", 2, 20), ("b", 3, 20)]
    stories = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, [])], "id long, sources array<string>")
    assert sorted(x.id for x in feed.without_sources(stories, spark.createDataFrame([("x",)], "source string")).collect()) == [1, 3]


def test_credibility(spark):
    schema = "story_id string, id long, pos long, confidence double, independent_originators int, has_primary boolean, extremity string, originator_sources array<array<string>>, grounding string, disputed boolean"
    rows = [("s", 1, 1, 0.8, 3, True, "notable", [["a"], ["b"], ["c"]], "supported", False), ("s", 2, 2, 0.75, 1, False, "notable", [["a"]], None, False), ("t", 3, 1, 0.9, 5, True, "routine", [["n"]] * 5, None, False), ("u", 4, 1, 0.9, 3, True, "notable", [["a"]] * 3, None, True)]
    got = {x.story_id: x for x in feed.credibility(spark.createDataFrame(rows, schema), spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.5)], "source string, reputation double")).collect()}
    assert got["s"].score == 93 and got["s"].band == "established" and got["s"].why[0] == "3 independent originators, 3 with a track record"
    assert got["t"].score == 70 and got["t"].capped and got["u"].band == "disputed"


def test_story_graph_sessions_equal_one_fold(spark):
    r = random.Random(11)
    rows = [{"cluster_id": f"c{i:03d}", "spine": sorted(r.sample([f"e{k}" for k in range(14)], r.randrange(1, 4))), "vector": [r.random(), r.random()], "ts": float(r.randrange(40)) * 12 * 3600} for i in range(120)]
    rows.sort(key=lambda x: (x["ts"], x["cluster_id"]))
    nodes, edges = G.fold(rows)
    df = spark.createDataFrame([(x["cluster_id"], x["spine"], x["vector"], x["ts"]) for x in rows], "cluster_id string, spine array<string>, vector array<double>, ts double")
    got = G.story_graph(df).collect()
    assert {(x.id, tuple(x.members)) for x in got if x.kind == "node"} == {(n.id, tuple(n.clusters)) for n in nodes}
    assert Counter((x.kind, x.id, x.to_id) for x in got if x.kind != "node") == Counter(edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_rows_does_not_matter(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(30)]
    one = sorted(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    r.shuffle(edges)
    assert sorted(connected_components(spark.createDataFrame([(b, a) for a, b in edges], "a long, b long")).collect()) == one


def test_join_per_key_equals_a_join(spark):
    from tessera.operators.skew import join_per_key

    r = random.Random(2)
    rows = [(r.choice([None, 1, 1, 1, 2, *range(3, 40)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long")
    per = df.where("k % 5 > 0").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    want = sorted(map(tuple, df.join(per, "k").collect()))
    for top in (1, 4, 1000):
        assert sorted(map(tuple, join_per_key(df, per, ["k"], top=top).collect())) == want
    assert join_per_key(df.where("false"), per, ["k"]).collect() == []


def test_graph_extended_by_halves_is_the_graph_of_all(spark):
    r = random.Random(12)
    rows = [(f"c{i:03d}", sorted({f"e{r.randrange(12)}" for _ in range(2)}), [r.random(), r.random()], 3600.0 * r.randrange(400)) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster_id string, spine array<string>, vector array<double>, ts double")
    nodes = lambda g: {(x.id, tuple(x.members)) for x in g if x.kind == "node"}
    edges = lambda g: sorted((x.kind, x.id, x.to_id) for x in g if x.kind != "node")
    whole = G.story_graph(df).collect()
    first = G.story_graph(df.where("ts < 700000"))
    more = G.extend_graph(first, df.where("ts >= 700000")).collect()
    kept = [x for x in first.collect() if x.id not in {y.id for y in more if y.kind == "node"} or x.kind != "node"]
    assert nodes(whole) == nodes(kept + more) and edges(whole) == edges(kept + more)
    assert nodes(more) and len(nodes(more)) < len(nodes(whole))
