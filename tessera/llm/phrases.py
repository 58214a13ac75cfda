"""Collocations: phrases of two to four words whose parts are rarely seen apart, per language.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and these into
words [^\\x20\\x09]+. A task turns a block of texts (a shard) into one sequence of
word ids with breaks between pieces, ranks its suffixes by numpy prefix doubling
(ranks of one word give those of two, these those of four), sorts them into a
suffix array, and reads the counts of all phrases from the intervals of common
prefixes (LCP). Counts of shards are summed by key on Spark.

A phrase can only be frequent if its parts are, so there are three such passes:
words, pairs of frequent words, then three and four words all of whose pairs are
frequent. What is frequent is kept in Lexicons: compact sorted keys in the shared
folder that tasks map and search. So no pass moves phrases that a shorter one has
ruled out, and counts of parts and the words' texts are looked up where they are
needed, without a join on words that may be hot. Counts are exact: every
occurrence in every text is counted.

Score of a phrase of count a, cut after k words into parts of counts l and r:
floor(2000000 a / (l + r)); the cut of least score counts (ties: the first).
Phrases within a longer one of at least four fifths of their count are dropped.
The first rows of each language are found in two steps, first among one of
SALTS parts, so no task holds a language.

Defined cases: a null text is an empty one, a null lang is `und`. Repeated rows
count each. Very long texts are counted as a whole. Ties are in order of phrase
(UTF-8 bytes). Other columns are not read, whatever their names. No rows in: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import batch, small, texts, utf8
from tessera.llm.elias_fano import U, Lexicon, digests, mixed, new_folder, remove_folder, sorted_order
from tessera.session import cut

MIN_COUNT, FIRST, SALTS = 30, 2000, 64
#: Words of a shard.
TOKENS = 400_000
#: All break marks become a full stop of its own.
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
#: A phrase's key: its word ids plus one, 32 bits each, in two longs; 0 where there is no word.
_KEY = U((1 << 32) - 1)


def shards(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(ids, names) of some texts after one another; id 0 is a break, id k the word names[k - 1]: lang, a space, word."""
    ids: list[np.ndarray] = []
    size, number = 0, {}
    ticket = count(1)

    def out():
        names = sorted(((k, lang + b" " + w) for lang, words in number.items() for w, k in words.items() if k), key=lambda x: x[0])
        return np.concatenate([*ids, np.zeros(4, np.int64)]), [n for _, n in names]

    for b in small(batches):
        for t, lang in zip(utf8(b.column(0)), texts(b.column(1))):
            if lang not in number:
                number[lang] = defaultdict(ticket.__next__, {b".": 0})
            words = t.lower().translate(_BREAKS).replace(b".", b" . ").split()
            words.append(b".")
            ids.append(np.fromiter(map(number[lang].__getitem__, words), np.int64, len(words)))
            size += len(words)
        if size >= tokens:
            number = {k.encode(): v for k, v in number.items()}
            yield out()
            ids, size, number, ticket = [], 0, {}, count(1)
    if size:
        number = {k.encode(): v for k, v in number.items()}
        yield out()


def suffix_counts(ids: np.ndarray, depth: int, at: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{k: (a place, count) of each phrase of k words} for 2 <= k <= depth (2 or 4); ids: 0 is a break, four breaks at the end; at: places to count from, all by default."""
    n = len(ids) - 4
    one = ids[: n + 4]
    nxt = np.r_[one[1:], 0]
    pair = np.where(one > 0, one * (int(one.max(initial=0)) + 1) + nxt, 0)
    if depth > 2:  # doubled: ranks of two words give keys of four
        two = np.unique(pair, return_inverse=True)[1]
        after = np.where(nxt[:n] > 0, two[2 : n + 2], 0)
        pair = two[:n] * (int(two.max(initial=0)) + 1) + after
    at = np.flatnonzero(ids[:n] > 0) if at is None else at
    order = at[np.argsort(pair[at], kind="stable")]  # the suffix array
    same = np.ones(max(0, len(order) - 1), bool)
    lcp = np.zeros(len(same), np.int64)
    for j in range(depth):
        w = ids[order + j]
        same &= (w[1:] == w[:-1]) & (w[1:] > 0)
        lcp += same
    found, long_enough = {}, ids[order] > 0
    for k in range(2, depth + 1):
        long_enough = long_enough & (ids[order + k - 1] > 0)
        start = np.flatnonzero(np.r_[True, lcp < k]) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(order)])
        keep = long_enough[start]
        found[k] = order[start[keep]], size[keep]
    return found


def _global(words: Lexicon, ids: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Ids of the lexicon plus one; breaks and words that are not in it are 0."""
    known = words.ids(*digests(names)) + 1 if names else np.zeros(0, np.int64)
    return np.r_[0, known][ids]


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in use, in order and with 0; each id's place among them)."""
    used, to = np.unique(np.r_[0, ids], return_inverse=True)
    return used, to[1:]


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first << 32 | second


def _triple(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return digests([x.tobytes() for x in np.stack([hi, lo], 1)]) if len(hi) else (np.zeros(0, U), np.zeros(0, U))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, first: int = FIRST, tokens: int = TOKENS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    folder = new_folder(docs, "phrases")
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names in shards(batches, tokens):
            n = np.bincount(ids, minlength=len(names) + 1)[1:]
            sums: dict[bytes, int] = defaultdict(int)  # of each language, as its word of no letters
            for name, c in zip(names, n.tolist()):
                sums[name.rpartition(b" ")[0] + b" "] += c
            names, n = [*names, *sums], np.r_[n, list(sums.values())].astype(np.int64)
            if names:
                u, check = digests(names)
                yield batch("u check n text", pa.array(sorted_order(u)), pa.array(check.view(np.int64)), pa.array(n), pa.array(names, pa.binary()))

    words_df = rows.mapInArrow(word_rows, "u long, check long, n long, text binary").groupBy("u", "check").agg(F.sum("n").alias("n"), F.any_value("text").alias("text")).where(F.col("n") >= min_count)
    words = Lexicon.build(words_df, f"{folder}/words")
    if words.size >= 1 << 31:
        raise ValueError(f"{words.size} frequent words do not fit ids of 31 bits")

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names in shards(batches, tokens):
            used, ids = _dense(_global(words, ids, names))
            at, n = suffix_counts(ids, 2)[2]
            yield batch("hi n", pa.array(_pair_key(used[ids[at]], used[ids[at + 1]])), pa.array(n))

    pairs_df = cut(rows.mapInArrow(pair_rows, "hi long, n long").groupBy("hi").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))

    def mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch("u check n", pa.array(sorted_order(mixed(b.column(0).to_numpy()))), pa.array(np.zeros(b.num_rows, np.int64)), b.column(1))

    pairs = Lexicon.build(pairs_df.mapInArrow(mixed_keys, "u long, check long, n long"), f"{folder}/pairs")

    def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names in shards(batches, tokens):
            used, ids = _dense(_global(words, ids, names))
            m = len(used)
            two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            seen, of = np.unique(ids[two] * m + ids[two + 1], return_inverse=True)
            frequent = np.zeros(len(ids) + 2, bool)
            frequent[two] = (pairs.ids(mixed(_pair_key(used[seen // m], used[seen % m]))) >= 0)[of]
            found = suffix_counts(ids, 4, np.flatnonzero(frequent[:-3] & frequent[1:-2])[: len(ids)])
            at, n = found[3]
            yield batch("hi lo n", pa.array(_pair_key(used[ids[at]], used[ids[at + 1]])), pa.array(used[ids[at + 2]] << 32), pa.array(n))
            at, n = found[4]
            at, n = at[frequent[at + 2]], n[frequent[at + 2]]
            yield batch("hi lo n", pa.array(_pair_key(used[ids[at]], used[ids[at + 1]])), pa.array(_pair_key(used[ids[at + 2]], used[ids[at + 3]])), pa.array(n))

    long_df = cut(rows.mapInArrow(long_rows, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))

    def triple_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, check = _triple(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield batch("u check n", pa.array(sorted_order(u)), pa.array(check.view(np.int64)), b.column(2))

    is_triple = F.col("lo").bitwiseAND(F.lit((1 << 32) - 1)) == 0
    triples = Lexicon.build(long_df.where(is_triple).mapInArrow(triple_keys, "u long, check long, n long"), f"{folder}/triples")

    def counts_of(w: np.ndarray) -> np.ndarray:
        """Counts of phrases of one to three words, all equally long; ids plus one, a row a phrase."""
        if w.shape[1] == 1:
            return words.counts(w[:, 0] - 1)
        if w.shape[1] == 2:
            return pairs.counts(pairs.ids(mixed(_pair_key(w[:, 0], w[:, 1]))))
        return triples.counts(triples.ids(*_triple(_pair_key(w[:, 0], w[:, 1]), w[:, 2] << 32)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hi, lo = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids = np.stack([hi >> 32, hi & 0xFFFFFFFF, lo >> 32, lo & 0xFFFFFFFF], 1)
            size = (ids > 0).sum(1)
            parts = np.zeros((3, 2, len(ids)), np.int64)
            for k in (2, 3, 4):
                own = np.flatnonzero(size == k)
                for j in range(1, k):
                    parts[j - 1, 0, own], parts[j - 1, 1, own] = counts_of(ids[own, :j]), counts_of(ids[own, j:k])
            named, to = np.unique(ids, return_inverse=True)
            name = [b"", *words.texts(named[named > 0] - 1)] if named.size and named[0] == 0 else list(words.texts(named - 1))
            split = [x.rpartition(b" ") for x in name]
            to = to.reshape(ids.shape)
            langs = [split[i][0] for i in to[:, 0].tolist()]
            total = dict(zip(found := sorted(set(langs)), words.counts(words.ids(*digests([x + b" " for x in found]))).tolist())) if langs else {}
            phrase = [b" ".join(split[i][2] for i in r[:k]) for r, k in zip(to.tolist(), size.tolist())]
            yield batch("hi lo a lang phrase total l1 r1 l2 r2 l3 r3", *b.columns, pa.array(langs, pa.binary()), pa.array(phrase, pa.binary()), pa.array([total[x] for x in langs], pa.int64()), *(pa.array(parts[j, s]) for j in range(3) for s in range(2)))

    phrases = pairs_df.select("hi", F.lit(0).cast("long").alias("lo"), "n").unionByName(long_df)
    # what is within a longer phrase, with the largest count of such a one
    w = [F.shiftright("hi", 32), F.col("hi").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright("lo", 32), F.col("lo").bitwiseAND(F.lit((1 << 32) - 1))]
    key = lambda i, k: F.struct(F.shiftleft(w[i], 32).bitwiseOR(w[i + 1]).alias("hi"), (F.shiftleft(w[i + 2], 32) if k == 3 else F.lit(0).cast("long")).alias("lo"))
    inner = F.when(is_triple, F.array(key(0, 2), key(1, 2))).otherwise(F.array(key(0, 2), key(1, 2), key(2, 2), key(0, 3), key(1, 3)))
    around = long_df.select(F.explode(inner).alias("x"), "n").groupBy("x.hi", "x.lo").agg(F.max("n").alias("longer"))
    kept = phrases.join(around, ["hi", "lo"], "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("n").cast("decimal(38,0)") * 80)).select("hi", "lo", "n")
    kinds = "hi long, lo long, a long, lang binary, phrase binary, total long, l1 long, r1 long, l2 long, r2 long, l3 long, r3 long"
    told = kept.mapInArrow(described, kinds)
    score = lambda j: F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l{j} as decimal(20,0)) + cast(r{j} as decimal(20,0)))")
    cuts = F.filter(F.array(*(F.when(F.col(f"l{j}") > 0, F.struct(score(j).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))) for j in (1, 2, 3))), lambda x: x.isNotNull())
    told = told.select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "a", F.array_min(cuts).alias("cut"), F.col("total").alias("n"))
    told = told.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    told = told.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= first)
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    out = cut(told.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    remove_folder(folder)
    return out
