import random
import zlib

from tessera.llm import quality_rqda as q

DOCS, LABELS = "doc_id long, text string, x string", "doc_id long, quality int, toxic int"


def corpus(n=400):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 200))]
        good = i % 4 != 0
        text = " ".join(w).capitalize() + "." if good else r.choice([" ".join(x + "***" for x in w), " ".join(x.upper() + "!!" for x in w[:5] * 10), " ".join([w[0]] * 60)])
        docs.append((i, text, "clash"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = {r.doc_id: r for r in q.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    held = [i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs, labels = corpus()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in q.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_nulls_repeats_and_long_texts(spark):
    docs, labels = corpus(100)
    odd = [(None, None, "x"), (500, "", "x"), (501, None, "x"), (502, "word " * 200_000, "x"), (1, docs[1][1], "x")]
    marks = labels + [(None, 1, 0), (3, None, None), (1, 1, 0)]
    got = q.quality_scores(spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)


def test_without_labels_everything_stays(spark):
    docs = spark.createDataFrame(corpus(20)[0], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in q.quality_scores(docs, none).collect()} == {1.0}
    assert q.keep_good(docs, none).count() == 20
    assert q.quality_scores(spark.createDataFrame([], DOCS), none).collect() == []


def test_keep_good_agrees_with_scores(spark):
    docs, labels = corpus(200)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    want = {r.doc_id for r in q.quality_scores(d, lab).collect() if r.predicted}
    kept = q.keep_good(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == want


def test_scores_equal_densities_computed_in_one_place(spark):
    """The discriminant from numpy's own covariances and determinants of all learned rows, without Spark or Cholesky factors."""
    import numpy as np

    docs, labels = corpus(200)
    x = {i: np.array(q.features(t.encode())) for i, t, _ in docs}
    learned = {k: np.array([x[i] for i, y, _ in labels if y == k and zlib.crc32(str(i).encode()) % 5]) for k in (0, 1)}
    n = {k: len(v) for k, v in learned.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in learned.items()}
    pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())
    log = {}
    for k in (0, 1):
        c = (1 - q.POOL) * cov[k] + q.POOL * pooled
        c = (1 - q.RIDGE) * c + q.RIDGE * (np.trace(pooled) / len(c) + 1e-9) * np.eye(len(c))
        gap = lambda v: v - learned[k].mean(0)  # noqa: E731,B023
        log[k] = {i: np.log(n[k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap(v) @ np.linalg.solve(c, gap(v)) for i, v in x.items()}
    for r in q.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect():
        want = 1 / (1 + np.exp(np.clip(log[0][r.doc_id] - log[1][r.doc_id], -500, 500)))
        assert abs(r.score - want) < 1e-6
