import random

import pytest

import corpus_pipeline as cp
from tessera.llm import decontaminate, exact_dedup, quality_rqda, simhash_bk
from tessera.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice(["ta", "lo", "mi", "re"]) for _ in range(r.randrange(1, 5))) for _ in range(n)).capitalize() + "."
    item = text(30)
    docs = []
    for i in range(200):
        t = text(r.randrange(40, 120))
        docs.append((i, " ".join(w.upper() + "!!" for w in t.split()[:6] * 8) if i % 5 == 0 else t))
    docs += [(300, docs[1][1]), (301, docs[2][1] + " tail"), (302, text(20) + " " + item + " " + text(20)), (303, None), (304, "")]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_against_the_operators(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    good = stages["quality classifier"](spark, docs, sf)
    assert good.columns == docs.columns
    assert ids(good) == ids(quality_rqda.quality_scores(docs, labels).where("predicted = 1"))
    once = stages["exact dedup"](spark, good, sf)
    assert once.columns == docs.columns and ids(once) == ids(exact_dedup.exact_groups(good).where("kept"))
    far = stages["SimHash near-dedup"](spark, once, sf)
    assert far.columns == docs.columns and ids(far) == sorted({r.component_id for r in simhash_bk.near_groups(once).collect()})
    clean = stages["benchmark decontamination"](spark, far, sf)
    hit = {r.doc_id for r in decontaminate.contamination(far, items).collect()}
    assert 302 in hit and ids(clean) == [d for d in ids(far) if d not in hit]
    packed = cp.run(spark, sf)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(clean)
    assert set(packed.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_a_broken_run_goes_on_and_leaves_one_stage(spark, tmp_path, monkeypatch):
    sf = f"file://{tmp_path}/sf"
    write(spark, sf)
    calls, stages = [], list(cp.STAGES)

    def named(k, f):
        def stage(*a):
            calls.append(k)
            if k == 3 and calls.count(3) == 1:
                raise RuntimeError("lost")
            return f(*a)

        return stage

    monkeypatch.setattr(cp, "STAGES", [(n, named(k, f)) for k, (n, f) in enumerate(stages)])
    with pytest.raises(RuntimeError, match="lost"):
        cp.run(spark, sf, run_id := f"test-{random.random()}")
    got = cp.run(spark, sf, run_id)
    assert calls == [0, 1, 2, 3, 3, 4]
    place = f"{shared_dir(spark)}/pipeline-{run_id}"
    assert [k for k in range(5) if cp._there(spark, f"{place}/{k}")] == [4] and got.count() > 0


def test_nulls_repeats_other_columns_and_no_rows(spark, tmp_path):
    sf = f"file://{tmp_path}/sf"
    write(spark, sf)
    long = " ".join(f"word{i % 977}" for i in range(30_000)) + "."
    more = [(None, "a row without an id, which stays as it is said here."), (None, None), (7, long), (7, long), (8, long + " x"), (9, ""), (9, "")]
    rows = [(d, t, i, "clash", b"f", [1], 0) for i, (d, t) in enumerate(more)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int, row string, fp binary, recipe array<int>, y int")
    for table in (docs, docs.where("false")):
        now = table
        for name, stage in cp.STAGES:
            now = stage(spark, now, sf)
            assert name == "packing" or now.columns == docs.columns
            now.write.parquet(f"{tmp_path}/{name}-{table is docs}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{table is docs}")
        assert (now.count() == 0) == (table is not docs)
