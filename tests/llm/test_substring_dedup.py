import hashlib
import random

from tessera.llm import substring_dedup as sd


def brute(rows):
    """(doc_id, n_words, n_removed, kept_sha256) per row, by a dictionary of all windows."""
    first = {}
    docs = [(-(1 << 63) if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, w in docs:
        for s in range(len(w) - sd.WINDOW + 1):
            k = tuple(w[s : s + sd.WINDOW])
            first[k] = min(first.get(k, (d, s)), (d, s))
    out = []
    for (d, w), (real, _) in zip(docs, rows):
        gone = set()
        for s in range(len(w) - sd.WINDOW + 1):
            if first[tuple(w[s : s + sd.WINDOW])] < (d, s):
                gone |= set(range(s, s + sd.WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((real, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda k=400: f"w{rng.randrange(k)}"
    shared = [[word() for _ in range(rng.choice([19, 20, 21, 35, 80]))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(30))]
            if rng.random() < 0.7:
                w += rng.choice(shared)
        rows.append((d, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(100 + k, rows[5][1]) for k in range(7)]  # copies
    rows += [(200, "a " * 70), (201, "a b " * 40), (202, " ".join(["x"] * 19)), (203, ""), (204, None), (205, "é ü " * 30)]
    rows += [(206, rows[7][1]), (206, rows[8][1]), (206, rows[8][1]), (None, rows[9][1] + " tail")]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert rows_of(sd.repeated_words(df)) == brute(rows)


def test_hot_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 2)
    rows = corpus(3)
    assert rows_of(sd.repeated_words(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_kept_text_and_clashing_columns(spark):
    w = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, w, 5, "x"), (2, "begin " + w + " end", 6, "y")], "doc_id long, text string, h int, found string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in sd.repeated_words(df, keep_text=True).collect()}
    assert got == {1: (0, w), 2: (25, "begin end")}


def test_empty_table(spark):
    assert sd.repeated_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_match_is_extended_both_ways_until_words_differ():
    a = [b"w%d" % i for i in range(30)]
    b = [*a[:4], b"other", *a[5:25], b"more", *a[26:]]
    assert sd.extended(a, list(a), 12) == (0, 30)
    assert sd.extended(a, b, 12) == (5, 25)
    assert sd.extended(a, [b"x"] * 30, 12) == (12, 12)


def test_windows_alike_by_hash_only_do_not_match(spark, monkeypatch):
    import numpy as np

    real = sd.window_hashes
    monkeypatch.setattr(sd, "window_hashes", lambda words: tuple(np.zeros_like(x) for x in real(words)))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(5)]
    places = [t.encode().split() for t in texts]
    zero = np.zeros(5, np.int64)
    found, inside = sd._Places(zero, zero, np.arange(5), np.arange(5), zero.astype(np.int32), lambda i, n: places[i]).matches()
    assert found == [] and not inside.any()


def test_repeats_are_maximal_and_the_words_of_an_earlier_place(spark):
    rows = corpus(4)
    words = {}
    for d, t in rows:
        words.setdefault(d, []).append((t or "").encode().split())
    got = sd.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    least = lambda d: -(1 << 63) if d is None else d
    assert len(got) > 20
    for r in got:
        assert (least(r.from_doc), r.from_start) < (least(r.doc_id), r.start) and r.n_words >= sd.WINDOW
        at = lambda ws, s: [w[s : s + r.n_words] for w in ws if len(w) >= s + r.n_words]
        assert any(x == y for x in at(words[r.doc_id], r.start) for y in at(words[r.from_doc], r.from_start))
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.from_doc, r.from_start - r.start), []).append((r.start, r.start + r.n_words))
    for spans in same.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
