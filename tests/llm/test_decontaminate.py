import random

from tessera.llm import decontaminate as dc


def best_distance(item, text):
    """Least edit distance of item to any part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != t))
    return min(row)


def edited(r, s, n):
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(s))
        s = s[:at] + (r.choice("abcé") if k else "") + s[at + (k != 1) :]
    return s


def corpus():
    r = random.Random(12)
    sentence = lambda n: " ".join("".join(r.choice("abcdé") for _ in range(r.randrange(1, 8))) for _ in range(n))
    items = [(i, sentence(r.randrange(6, 30))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny"), (53, "Upper CASE  and\nspaces here all right")]
    items.append((54, items[0][1]))
    docs = []
    for i in range(60):
        t = sentence(r.randrange(40))
        if i % 3:
            s = r.choice(items[:12])[1]
            t += " " + edited(r, s, r.choice([0, 1, 2, 4, 9])) + " " + sentence(r.randrange(20))
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "so tiny it is"), (103, "UPPER case and spaces HERE all\tright"), (104, sentence(20_000) + " " + items[3][1]), (None, items[4][1]), (1, docs[1][1]), (1, docs[1][1])]
    return items, docs


def test_myers_is_the_edit_distance():
    r = random.Random(1)
    for _ in range(200):
        item, text = ("".join(r.choice("ab") for _ in range(r.randrange(1, n))) for n in (90, 140))
        d = best_distance(item, text)
        got = dc.myers(item, text, 30)
        assert got is None and d > 30 or got[0] == d


def test_against_brute_force(spark):
    items, docs = corpus()
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    want = []
    for d, t in docs:
        text = dc.normal(t or "")
        for i, s in items:
            item = dc.normal(s or "")
            if item and len(text) < 20_000:
                dist = best_distance(item, text)
                if dist <= int(len(item) * dc.ERROR_RATE):
                    want.append((d, i, dist))
    assert [x for x in got if x[0] != 104] == sorted(want, key=repr)
    assert (104, items[3][0], 0) in got


def test_items_in_blocks_give_the_same(spark):
    items, docs = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(dc.contamination(d, i, block_chars=100)) == rows(dc.contamination(d, i))
    assert rows(dc.drop_contaminated(d, i, block_chars=100)) == rows(dc.drop_contaminated(d, i))


def test_drop_contaminated_keeps_the_rest_whole(spark):
    items, docs = corpus()
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, distance int")
    i = spark.createDataFrame(items, "item_id long, text string")
    hit = {r.doc_id for r in dc.contamination(d, i).collect()}
    kept = dc.drop_contaminated(d, i)
    assert kept.columns == d.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x for x, _ in docs if x not in hit), key=repr)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert dc.contamination(d, i).collect() == [] and dc.contamination(some, i).collect() == []
    assert dc.drop_contaminated(some, i).count() == 1
