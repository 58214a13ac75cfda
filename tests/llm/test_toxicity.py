import random

import numpy as np

from tessera.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, toxic string, y string", "doc_id long, quality int, toxic int"


def corpus(n=600, seed=5):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice(["ta", "lo", "mi", "ré", "su", "no"]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(5, 120))]
        bad = i % 8 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(["Idiot", "scum", "worthless", "moron", "zzkrak" + r.choice(["en", "os", "ito"])])
        docs.append((i, " ".join(w), "clash", "clash"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_finds_unlabelled_toxic_documents_and_leaves_clean_ones(spark):
    docs, labels = corpus()
    known = [x for x in labels if x[0] % 3]
    got = {r.doc_id for r in tx.toxic_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(known, LABELS)).collect()}
    rest = [x for x in labels if x[0] % 3 == 0]
    assert sum(y and d in got for d, _, y in rest) >= 0.95 * sum(y for *_, y in rest)
    assert sum(not y and d in got for d, _, y in rest) <= 0.02 * len(rest)


def test_chain_feeds_earlier_probabilities(spark):
    """Kinds come from the evidence: documents of two vocabularies fall into two kinds."""
    docs, labels = corpus(300)
    r = random.Random(1)
    docs = [(d, t + " " + " ".join(r.sample(["quorf", "quelb", "quimp", "quast"] if d % 16 else ["zodd", "zund", "zarp", "zilk"], 3)) if y else t, a, b) for (d, t, a, b), (_, _, y) in zip(docs, labels)]
    chain = tx.learn(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert chain.names == ["kind_1", "kind_2", "toxic"] and [len(m.earlier) for m in chain.models] == [0, 1, 2]
    p = chain.predict(chain.rows(["quorf quelb quimp ta", "zodd zund zarp ta", "a calm text"]))
    assert abs(p[0, 0] - p[1, 0]) > 0.4 and abs(p[0, 1] - p[1, 1]) > 0.4 and min(p[0, 2], p[1, 2]) > 0.5 > p[2, 2]


def test_chain_against_a_plain_one():
    """Out-of-fold inputs, models and predictions equal those of a plain dense version."""
    r = np.random.default_rng(3)
    n, size = 60, 7
    dense = (r.random((n, size)) < 0.3).astype(float)
    y = np.column_stack([dense[:, 0], (dense[:, 0] + dense[:, 1] > 0) * 1.0])
    fold = np.arange(n) % tx.FOLDS
    chain = tx.fit_chain(["a", "b"], {str(i): i for i in range(size)}, tx.Rows.of([np.flatnonzero(v).tolist() for v in dense]), y, fold)

    def fit(x, t, l2=1e-4):
        """The minimum of the same loss, by damped Newton steps on the dense matrix."""
        one = np.column_stack([x, np.ones(len(x))])
        w, reg = np.zeros(one.shape[1]), np.diag([l2] * x.shape[1] + [0])
        weight = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
        loss = lambda w: weight @ np.logaddexp(0, np.where(t == 1, -1, 1) * (one @ w)) + w @ reg @ w / 2
        for _ in range(200):
            p = 1 / (1 + np.exp(-one @ w))
            step, rate = np.linalg.solve(one.T * (weight * p * (1 - p)) @ one + reg + 1e-12 * np.eye(len(w)), one.T @ ((p - t) * weight) + reg @ w), 1.0
            while loss(w - rate * step) > loss(w) and rate > 1e-9:
                rate /= 2
            w = w - rate * step
        return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))

    first = fit(dense, y[:, 0])
    out = np.zeros(n)
    for f in range(tx.FOLDS):
        out[fold == f] = fit(dense[fold != f], y[fold != f, 0])(dense[fold == f])
    second = fit(np.column_stack([dense, out]), y[:, 1])
    want = np.column_stack([first(dense), second(np.column_stack([dense, first(dense)]))])
    assert np.allclose(chain.predict(tx.Rows.of([np.flatnonzero(v).tolist() for v in dense])), want, atol=5e-3)


def test_features_by_hand():
    assert sorted(tx.features("Abcd abcd abce")) == ["abcd", "abce", "|abc1", "|abc2"]
    assert tx.features("abcd abce abcf abcg", {"|abc3": 0, "abcd": 1}) == ["abcd", "|abc3"] and tx.features("") == []


def test_nulls_repeats_long_and_degenerate_labels(spark):
    docs, labels = corpus(200)
    odd = [(None, None, "c", "c"), (900, "", "c", "c"), (901, "idiot " + "ta " * 100_000, "c", "c"), (1, docs[1][1], "c", "c")]
    d = spark.createDataFrame(docs + odd, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (3, 1, 0), (3, 1, 0)], LABELS)
    got = tx.score(d, tx.learn(d, marks)).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.p_toxic <= 1 for r in got)
    assert {r.toxic for r in got if r.doc_id == 901} == {1} and {r.toxic for r in got if r.doc_id == 900} == {0}
    assert {r.p_toxic for r in tx.score(d, tx.learn(d, spark.createDataFrame([(1, 1, 0)], LABELS))).collect()} == {0.0}
    assert tx.toxic_documents(spark.createDataFrame([], DOCS), marks).collect() == []
