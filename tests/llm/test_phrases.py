import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases as ph

KINDS = "doc_id long, text string, lang string, phrase string, n int"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, first):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f.update((lang, *p[i : i + k]) for k in range(1, 5) for i in range(len(p) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    gone = set()
    for g, a in candidates.items():
        for k in range(2, len(g) - 1):
            for i in range(1, len(g) - k + 1):
                inner = (g[0], *g[i : i + k])
                if 100 * a >= 80 * f[inner]:
                    gone.add(inner)
    out = []
    for g, a in candidates.items():
        if g not in gone:
            score, k = min((2000000 * a // (f[g[: k + 1]] + f[(g[0], *g[k + 1 :])]), k) for k in range(1, len(g) - 1))
            out.append((g[0], -score, -a, " ".join(g[1:]).encode(), f[g[: k + 1]], f[(g[0], *g[k + 1 :])]))
    got, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return got


def corpus():
    r = random.Random(8)
    words = ["new", "york", "city", "the", "of", "und", "é", "Ä", "x\x1cy", " ", "a1", "-"]
    out = []
    for i in range(400):
        t = []
        for _ in range(r.randrange(40)):
            t.append(r.choices(["New York City", "the end of the", r.choice(words), r.choice(words) + r.choice(".,;:!?\n\r\x0b\x0c")], [2, 1, 6, 1])[0])
        out.append((i, r.choice([" ", "  ", "\t", " \t"]).join(t), r.choice(["en", "en", "de", "d e", "", "und", None]), "clash", 1))
    return out + [(1, "", "en", "x", 1), (2, None, None, "x", 1), (3, "...", "en", "x", 1), (3, "one two", "rare", "x", 1), (None, " ".join(["la la land"] * 2000), "en", "x", 0), *[(9, "again and again", "en", None, None)] * 12]


@pytest.mark.parametrize("least, first, tokens", [(5, 2000, 1000), (12, 3, 50), (2, 10, 10**6)])
def test_against_brute_force(spark, least, first, tokens):
    rows = corpus()
    got = ph.collocations(spark.createDataFrame(rows, KINDS).repartition(5), least, first, tokens).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, least, first)) and got


def test_no_rows(spark):
    for rows in ([], [(1, None, "en", "x", 1)], [(1, "only once", "en", "x", 1)]):
        df = ph.collocations(spark.createDataFrame(rows, KINDS))
        assert df.collect() == [] and df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_suffix_counts():
    r = np.random.default_rng(2)
    ids = np.r_[r.integers(0, 4, 3000), [0] * 4]
    for depth in (2, 4):
        want = {k: Counter(tuple(ids[i : i + k].tolist()) for i in range(3000) if (ids[i : i + k] > 0).all()) for k in range(2, depth + 1)}
        got = ph.suffix_counts(ids, depth)
        assert {k: {tuple(ids[i : i + k].tolist()): n for i, n in zip(*(x.tolist() for x in v))} for k, v in got.items()} == want
