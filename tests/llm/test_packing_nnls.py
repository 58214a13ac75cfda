import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import packing_nnls as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
KINDS = "doc_id long, text string, start string, length int"


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, window):
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    for d, t in rows:
        ids = ids_of(t)
        pieces = sorted(docs[d], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]]).tolist()[:-1]
        assert sum(p.length for p in pieces) == len(ids) and {p.doc_tokens for p in pieces} == {len(ids)}
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    padding = 0
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]]).tolist()[:-1]
        n = sum(r.length for r in s)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert padding == 0


def corpus(n=120, seed=6):
    r = random.Random(seed)
    rows = [(i, " ".join(f"{r.choice(['Word', 'é', 'x1', '.', '  ', '\n'])}{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 60, 300])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "a" * 20_000), (n + 3, "<|endoftext|> is a string here"), (n + 4, " " * 300)]


def test_every_id_lies_in_one_piece(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], KINDS).repartition(3)
    for window, block in ((64, 1 << 20), (64, 500), (2048, 1 << 20)):
        check(rows, pk.pack(df, window=window, block_tokens=block).collect(), window)


def test_ids_equal_those_of_the_json_vocabulary():
    from tessera.llm.encoding import default_pattern, encoder

    encode = encoder(PATH, default_pattern())
    for _, t in corpus(60, seed=9):
        assert encode(t or "").tolist() == ids_of(t)[:-1]


def test_repeat_counts_solve_the_histogram():
    histogram = {10: 5, 54: 5, 20: 8, 44: 8, 32: 6}
    patterns = pk.combinations_filling(sorted(histogram), histogram, 64)
    x = pk.repeat_counts(patterns, histogram)
    used = defaultdict(float)
    for p, k in zip(patterns, x):
        assert sum(p) == 64 and k >= 0
        for a in p:
            used[a] += k
    assert all(abs(used[a] - n) < 0.5 for a, n in histogram.items())


def test_pack_rests_uses_every_rest_once():
    r = random.Random(2)
    lengths = [r.randrange(0, 64) for _ in range(300)]
    full, tail = pk.pack_rests(lengths, 64)
    assert all(sum(n for _, _, n in w) == 64 for w in full) and sum(n for _, _, n in tail) < 64
    got = defaultdict(int)
    for w in [*full, tail]:
        for i, _, n in w:
            got[i] += n
    assert all(got[i] == n for i, n in enumerate(lengths))


def test_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text"), (None, None)], "doc_id long, text string")
    got = pk.pack(df).collect()
    assert sum(r.length for r in got) == 3 * len(ids_of("same text")) + 1


def test_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
