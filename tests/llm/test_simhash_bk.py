import random

import xxhash

from tessera.llm import simhash_bk as sh

KINDS = "doc_id long, text string, fp string, component string"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [at] if at else []
            at = ""
        else:
            at += c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels_of(rows):
    """Fingerprints and the label of each row's component, by comparing all pairs until nothing changes."""
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[i] > label[j] and (fps[i] ^ fps[j]).bit_count() <= 4:
                    label[i], changed = label[j], True
    return fps, label


def brute(rows):
    fps, label = labels_of(rows)
    least = {}
    for lb, (d, *_) in zip(label, rows):
        if d is not None:
            least[lb] = min(least.get(lb, d), d)
    return sorted(((d, f"{f:016x}", least.get(lb)) for (d, *_), f, lb in zip(rows, fps, label)), key=repr)


def corpus(n=120):
    r = random.Random(3)
    base = [[f"word{r.randrange(900)}" for _ in range(150)] for _ in range(6)]
    rows = [(0, ""), (1, None), (2, "One"), (3, "one"), (4, "one two"), (5, " \n"), (None, "one two"), (6, "É é É é"), (7, "é " * 5000)]
    for i in range(10, n):
        w = list(r.choice(base))
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"other{r.randrange(99)}"
        rows.append((i, r.choice([" ", "  ", "\t"]).join(w)))
    rows += [(20, rows[30][1]), (20, rows[30][1]), (None, "nobody knows this text at all")]
    return [(d, t, "clash", "clash") for d, t in rows]


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_fingerprint():
    for t in ("", "a", "a b c", "A b C d", "x " * 500, "Äpfel UND Birnen, und mehr gehen"):
        assert sh.fingerprint(t.encode()) == slow_fingerprint(t)


def test_fingerprint_of_a_long_text_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 77}" for i in range(500))
    want = sh.fingerprint(text.encode())
    monkeypatch.setattr(sh, "_BLOCK", 7)
    assert sh.fingerprint(text.encode()) == want == slow_fingerprint(text)


def test_bk_tree_finds_what_a_scan_finds():
    r = random.Random(2)
    values = list({r.getrandbits(12) for _ in range(300)})
    tree = sh.BKTree()
    for v in values:
        tree.add(v)
    for x in range(0, 4096, 37):
        assert {tree.values[i] for i in tree.within(x, 2)} == {v for v in values if (v ^ x).bit_count() <= 2}


def test_against_brute_force(spark):
    rows = corpus()
    assert rows_of(sh.near_groups(spark.createDataFrame(rows, KINDS).repartition(3))) == brute(rows)


def test_hot_bucket_in_small_shards_gives_the_same_components(spark):
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:
        x = r.choice(sorted(fps))
        for _ in range(r.randrange(1, 8)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def parts(links):
        up = {f: f for f in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        return sorted(sorted(f for f in fps if find(f) == root) for root in {find(f) for f in fps})

    got = [(x.a % (1 << 64), x.b % (1 << 64)) for x in sh.fingerprint_links(df, shard=8).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    want = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert parts(got) == parts(want)


def test_drop_near_copies_keeps_one_of_each_group(spark):
    rows = corpus(60)
    got = sh.drop_near_copies(spark.createDataFrame(rows, KINDS).repartition(3))
    assert got.columns == ["doc_id", "text", "fp", "component"]
    kept = got.collect()
    assert len(kept) == len(set(labels_of(rows)[1]))
    assert {r.doc_id for r in kept} - {None} == {c for _, _, c in brute(rows)} - {None}


def test_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    assert sh.near_groups(df).collect() == [] and sh.drop_near_copies(df).collect() == []
