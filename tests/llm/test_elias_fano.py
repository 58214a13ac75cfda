import numpy as np
import pytest

from tessera.llm import elias_fano as ef

U = np.uint64


def read(values):
    arrays, meta = ef.encode("x", values)
    return ef.EliasFano(ef.Block(np.frombuffer(ef.block_bytes(arrays, meta), np.uint8)), "x")


@pytest.mark.parametrize("top, n", [(0, 1), (0, 500), (5, 1), (7, 3000), (1 << 20, 1), (1 << 20, 5000), (1 << 63, 2), ((1 << 64) - 1, 1000), (1 << 40, 20_000)])
def test_values_and_successors(top, n):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=U, endpoint=True))
    e = read(v)
    assert (e.value(np.arange(n)) == v).all()
    x = np.concatenate([v, v + U(1), v - U(1), r.integers(0, top, 500, dtype=U, endpoint=True), np.array([0, (1 << 64) - 1], U)])
    at, there = e.successor(x)
    assert (at == np.searchsorted(v, x)).all() and (there == np.isin(x, v)).all()
    b = r.integers(0, n, len(x))
    end = np.minimum(n, b + r.integers(0, 50, len(x)))
    at, there = e.successor(x, b, end)
    for q, lo, hi, p, t in zip(x, b, end, at, there):
        assert p == lo + np.searchsorted(v[lo:hi], q) and t == (p < hi and v[p] == q)


@pytest.mark.parametrize("top, n", [(0, 2), (7, 3000), (1 << 20, 2), (1 << 20, 5000), ((1 << 64) - 1, 1000)])
def test_neighbours_are_read_together(top, n):
    v = np.sort(np.random.default_rng(n).integers(0, top, n, dtype=U, endpoint=True))
    v[n // 2 :] |= U(top)  # a far step
    this, following = read(v).both(np.arange(n - 1))
    assert (this == v[:-1]).all() and (following == v[1:]).all()


def test_ones_of_a_word():
    r = np.random.default_rng(7)
    for share in (0.01, 0.5, 0.99, 1):
        bits = r.random((2000, 64)) < share
        bits[:, 63] |= ~bits.any(1)
        word = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
        for k in (np.zeros(2000, np.int64), bits.sum(1) - 1, r.integers(0, bits.sum(1))):
            assert ef._select(word, k).tolist() == [np.flatnonzero(b)[i] for b, i in zip(bits, k)]


def test_lexicon(spark):
    r = np.random.default_rng(3)
    words = sorted({bytes(r.integers(97, 123, r.integers(0, 6)).astype(np.uint8)) for _ in range(3000)})
    u, check = ef.digests(words)
    u[5] = u[6] = u[7]  # different words of one key
    rows = [(int(a), int(c), i + 1, w) for i, (a, c, w) in enumerate(zip(ef.sorted_order(u), check.view(np.int64), words))]
    df = spark.createDataFrame(rows, "u long, check long, n long, text binary").repartition(3)
    lex = ef.Lexicon.build(df, ef.new_folder(df, "lexicon"), block_keys=100)
    assert (lex.size, lex.total) == (len(words), sum(range(1, len(words) + 1)))
    ids = lex.ids(u, check)
    assert sorted(ids) == list(range(len(words)))
    assert (lex.counts(ids) == np.arange(1, len(words) + 1)).all() and list(lex.texts(ids)) == words
    by_id = lex.counts(np.arange(lex.size))
    assert (lex.before(np.arange(lex.size)) == np.cumsum(by_id) - by_id).all()
    assert (lex.ids(*ef.digests([b"not there", b"..."])) == -1).all() and (lex.ids(u, check + U(1)) == -1).all()
    ef.remove_folder(lex.folder)


def test_empty_lexicon(spark):
    df = spark.createDataFrame([], "u long, check long, n long")
    lex = ef.Lexicon.build(df, ef.new_folder(df, "lexicon"))
    assert lex.size == 0 and list(lex.ids(np.array([1, 2], U))) == [-1, -1] and len(lex.counts(np.array([], np.int64))) == 0
