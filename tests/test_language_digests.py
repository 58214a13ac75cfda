import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import digests as D, language as L

WORDS = {"en": "the of and river stone with", "de": "der und nicht straße über mit", "fr": "le et où été avec pierre"}


def rows(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS[k].split(), k=r.randrange(3, 30))) + r.choice([".", " 12!", ""]), k) for i in range(n) for k in [r.choice(sorted(WORDS))]]


def test_detects_and_equals_a_plain_naive_bayes(spark):
    data = rows(300, 1)
    df = spark.createDataFrame([*data, (900, "unlabelled words", None), (901, None, "en"), (902, "12 34", "de"), (903, "zz", "")], "id long, text string, language string").repartition(4)
    model = L.learn(df)
    assert model.names == ["de", "en", "fr"]
    counts, texts = {k: Counter() for k in model.names}, Counter()
    for _, t, k in data:
        counts[k].update(L.grams(t).tolist())
        texts[k] += 1
    total = {k: sum(c.values()) + L.SMOOTH * L.BUCKETS for k, c in counts.items()}

    def plain(t):
        g = L.grams(t).tolist()
        return max(model.names, key=lambda k: sum(math.log((counts[k][b] + L.SMOOTH) / total[k]) for b in g) + math.log(texts[k] / 300)) if g else ""

    new = [*rows(60, 2), (500, None, "x"), (501, " 1 ! ", "x"), (502, "STRASSE ÜBER der", "x")]
    got = L.detect(spark.createDataFrame(new, "id long, text string, detected string"), model).collect()
    assert [x.detected for x in got] == [plain(t) for _, t, _ in new]
    assert sum(x.detected == k for x, (_, _, k) in zip(got, new[:60])) >= 59
    held = L.fill(spark.createDataFrame([("le été", ""), ("le été", None), ("le été", "en")], "body string, language string"), model).collect()
    assert [x.language for x in held] == ["fr", "fr", "en"]
    nothing = L.learn(df.where("false"))
    assert nothing.names == [] and nothing.of("the river") == ""


def test_digests_see_every_cell_and_no_order(spark):
    data = [("t1", 1, "a", None), ("t1", 2, "b", 0.5), ("t1", 2, "b", 0.5), ("t2", 2, "b", 0.5), ("t2", 1, "a", None), ("t2", 2, "b", 0.5), ("t3", 1, "a", None), ("t3", 2, "b", 0.25), ("t3", 2, "b", 0.5), ("t4", 1, "a", None), ("t4", 2, "b", 0.5), (None, 1, "a", None)]
    df = spark.createDataFrame(data, "tenant_id string, k int, s string, v double")
    got = D.table_digests({"x": df, "y": df.where("k = 1").select("s", "k", "tenant_id")})
    again = D.table_digests({"x": df.repartition(5).orderBy(F.rand(3)).select("v", "s", "tenant_id", "k")})
    one = lambda d: {(r["table"], r.tenant): (r.n, r.a, r.b) for r in d.collect()}
    assert one(again) == {k: v for k, v in one(got).items() if k[0] == "x"}
    same = lambda a, b: {r["table"]: r.same for r in D.differing(got, a, b).collect()}
    assert same("t1", "t2") == {"x": True, "y": True} and same("t1", "t3") == {"x": False, "y": True} and same("t1", "t4")["x"] is False
    odd = spark.createDataFrame([("p", "1:a", "b"), ("q", "1", "a:b"), ("r", None, "N"), ("s", "N", None)], "tenant_id string, x string, y string")
    assert len({(r.a, r.b) for r in D.table_digests({"o": odd}).collect()}) == 4
