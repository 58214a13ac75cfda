import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_lm as lm

KINDS = "doc_id long, text string, held_out int, n_tokens string"


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Z\x1cy", " "]
    texts = [None, "", "w1", "W1 w1  w1\t\n", " ".join(r.choices(vocabulary, k=4000))]
    texts += [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=r.randrange(60))) for _ in range(120)]
    texts += [texts[20]] * 5 + ["only here are these"]
    return [(i, t, 1, "clash") for i, t in enumerate(texts)] + [(7, "again", 0, None), (7, "again", 0, None), (None, "w1 w2", 0, "x")]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Brute:
    """The same model by dictionaries, with exact numbers."""

    def __init__(self, texts, blocks=None):
        seen = [tokens(t) for t in texts]
        self.grams = [Counter(tuple(s[i : i + k]) for s in seen for i in range(len(s) - k + 1)) for k in (1, 2, 3)]
        self.n, self.v = sum(self.grams[0].values()), len(self.grams[0])
        self.contexts = [None]
        for k in (1, 2):
            counts = self.grams[k]
            d = dict(zip(counts, lm.discounts(np.array(list(counts.values())))))
            if k == 2:
                d |= {g: 1.0 for g, c in counts.items() if c == 1}
            by = {}
            for g, c in counts.items():
                t = by.setdefault(g[:-1], [0, 0.0, {}])
                t[0] += c
                t[1] += d[g]
                t[2][g[-1]] = c - d[g]
            self.contexts.append(by)

    def base(self, w):
        return (self.grams[0].get((w,), 0) + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, ctx, w):
        low = self.base(w) if not ctx else self.p(ctx[1:], w)
        if not ctx or ctx not in self.contexts[len(ctx)]:
            return low
        total, taken, words = self.contexts[len(ctx)][ctx]
        return words.get(w, 0) / total + taken / total * low

    def row(self, doc_id, text):
        s = tokens(text)
        base, score = (sum(math.log10(f(i)) for i in range(len(s))) for f in (lambda i: self.base(s[i]), lambda i: self.p(tuple(s[max(0, i - 2) : i]), s[i])))
        return doc_id, out(doc_id), len(s), sum((w,) in self.grams[0] for w in s), self.n, base, score


def same(got, want, loose):
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr)):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], abs_tol=1e-9, rel_tol=1e-12)
        assert abs(g[6] - w[6]) <= loose * g[2] + 1e-9


def test_against_brute_force(spark):
    rows = corpus()
    brute = Brute([t for d, t, *_ in rows if not out(d)])
    want = [brute.row(d, t) for d, t, *_ in rows]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one block a level: its discounts are those of all
    try:
        same(lm.scores(df).collect(), want, 0.002)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("parts, block, tokens", [(4, 40, 300), (3, 7, 1000), (7, 100_000, 100_000), (2, 30, 100_000)])
def test_contexts_over_many_blocks_add_up_to_one(spark, parts, block, tokens):
    texts = [t for _, t, *_ in corpus()]
    brute = Brute(texts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        model = lm.train(spark.createDataFrame(corpus(), KINDS).repartition(3), tokens=tokens, block=block)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    words = [w for (w,) in brute.grams[0]]
    ids = model.words.ids(*lm.digests([b"" if w is None else w.encode() for w in words]))
    assert sorted(ids) == list(range(brute.v)) and model.words.total == brute.n
    assert (model.words.counts(ids) == [brute.grams[0][w,] for w in words]).all()
    known = dict(zip(words, ids.tolist()))
    assert math.isclose(sum(model.base(ids)) + model.base(np.array([-1]))[0], 1)
    for level in (2, 3):
        contexts = list(brute.contexts[level - 1])
        keys = [known[c[0]] if level == 2 else 1 << 62 | known[c[0]] << 31 | known[c[1]] for c in contexts]
        ctx, w = np.repeat(keys, len(words) + 1), np.tile([*ids, lm.NO_WORD], len(keys))
        order = np.random.default_rng(1).permutation(len(ctx))
        alpha, weight = np.empty(len(ctx)), np.empty(len(ctx))
        alpha[order], weight[order] = model.level(level, ctx[order], w[order])
        alpha, weight = alpha.reshape(len(keys), -1), weight.reshape(len(keys), -1)
        assert (weight == weight[:, :1]).all() and np.allclose(alpha.sum(1) + weight[:, 0], 1, atol=2e-3)
        twice = lambda c, w: brute.grams[level - 1].get((*c, w), 0) >= level - 1  # noqa: E731, B023
        assert [[words[j] for j in np.flatnonzero(a > 1e-15)] for a in alpha] == [[x for x in words if twice(c, x)] for c in contexts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_tokens_of_odd_texts(kind):
    odd = [None, "", " ", "\x0b\r", " A\x00b  Éİ\x85\u2003Z\x1c \x0cb\n", "a", None, "x" * 5000, "a a b"] + [f"a{chr(i)}B" for i in range(300)]
    column = pa.array(odd * 3, kind)
    broken = pa.array([b"\xff A\xc3 b", b"\xe2\x82"] * 20, pa.large_binary() if kind == pa.large_string() else pa.binary()).view(kind)
    for texts in (column, column.slice(4, 350), broken, broken.slice(1, 5), pa.array([None] * 3, kind)):
        whole = texts.view(pa.large_binary() if kind == pa.large_string() else pa.binary()).to_pylist()
        cuts = [0, len(texts) // 3, len(texts)]
        batches = [pa.RecordBatch.from_arrays([texts.slice(x, y - x), pa.array(range(x, y))], ["text", "n"]) for x, y in zip(cuts, cuts[1:])]
        for tokens in (1, 100, 10**6):
            rows = 0
            for held, ids, start, words in lm.token_blocks(iter(batches), tokens):
                assert len(set(words)) == len(words)
                for x, y in zip(start, [*start[1:], len(ids)]):
                    assert [words[i] for i in ids[x:y]] == [*(whole[rows] or b"").lower().split(), b""]
                    rows += 1
                assert sum(b.num_rows for b in held) == len(start)
            assert rows == len(texts)


def test_no_call_of_python_for_each_text():
    texts = pa.RecordBatch.from_arrays([pa.array([f"some words of text {i}" for i in range(5000)])], ["text"])
    calls = 0

    def counts(_, event, __):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(counts)
    try:
        ((_, ids, start, _),) = lm.token_blocks(iter([texts]), 10**6)
    finally:
        sys.setprofile(None)
    assert len(ids) == 30_000 and len(start) == 5000 and calls < 1000


def test_packed_grams_come_back():
    r = np.random.default_rng(1)
    for k in (2, 3):
        for n in (1, 5, 100, 101, 5000):
            cols = [np.sort(r.integers(0, 1 << 31, n)), *(r.integers(0, 1 << 31, n) for _ in range(k - 1))]
            counts = r.integers(1, 1 << 20, n)
            assert all((x == y).all() for x, y in zip(lm.unpacked(lm.packed(cols, counts)), [*cols, counts]))


def test_unknown_contexts_leave_all_to_the_level_below(spark):
    model = lm.train(spark.createDataFrame([("a b c",)], "text string"))
    ids = model.words.ids(*lm.digests([b"a", b"b", b"c", b""]))
    alpha, weight = model.level(2, np.array([ids[0], ids[3]]), np.array([ids[1], ids[0]]))
    assert alpha[0] > 0 and weight[0] < 1 and (alpha[1], weight[1]) == (0, 1)


def test_no_rows_and_nothing_to_learn(spark):
    df = spark.createDataFrame([], KINDS)
    assert lm.scores(df).collect() == []
    held = next(i for i in range(100) if out(i))
    (r,) = lm.scores(spark.createDataFrame([(held, "a b", 1, "x")], KINDS)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.base_score == r.score == 0


def test_codes_are_close():
    p = np.array([1.0, 0.5, 1e-3, 1e-12, 1e-30])
    assert np.allclose(np.log10(lm.decoded(lm.code(p))), [0, math.log10(0.5), -3, -12, -16], atol=lm.STEP)
