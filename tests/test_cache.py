import uuid

from tessera.operators import cache as C


def test_texts_are_embedded_once_and_written_back(spark, tmp_path):
    seen = tmp_path / "seen"

    def embed(found):
        with seen.open("a") as f:
            f.writelines(f"{t}\n" for t in found)
        return [[float(len(t)), 1.0] for t in found]

    name = f"cache_{uuid.uuid4().hex}"
    first = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id long, text string")
    try:
        got = {r.id: r.vector for r in C.embedded(first, name, embed).collect()}
        assert got == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None, 5: [0.0, 1.0]}
        again = {r.id: r.vector for r in C.embedded(first.union(spark.createDataFrame([(6, "new")], "id long, text string")), name, embed).collect()}
        assert again == got | {6: [3.0, 1.0]}
        assert C.missing(first, spark.table(name)).count() == 0
        assert sorted(seen.read_text().split("\n")) == sorted(["", "", "aa", "b", "new"])
        assert spark.table(name).count() == 4
        # the cache is joined where it lies: one exchange, that of the asking side
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = C.embedded(first, name, embed)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
