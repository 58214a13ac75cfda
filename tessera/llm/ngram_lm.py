"""Log-probabilities of documents under an n-gram model kept as an Elias-Fano trie.

Words are lower-cased (A-Z) runs without ASCII white space; each document ends
with one end token, which counts as a token. The model has three levels:

1. words: a Lexicon of the training words with exact counts. A word's base
   probability is (c + 0.1) / (N + 0.1 (V + 1)), for unknown words too.
2. pairs: contexts of one word, 3. triples: contexts of two words. A level is a
   sorted run of (context, word, count) cut into blocks. A block holds its
   contexts and, by monotone pointers, the range of each context's successors.
   Successors are word ids made monotone over the block by adding what the
   range before ends with, so a word is found by a successor search relative to
   its context's range. With each successor goes its smoothed probability
   (c - d) / c(context), with each context the weight of the level below,
   (sum of d) / c(context), both as 16-bit codes of their logarithm. d is the
   discount of a count of 1, 2 or more, reckoned from the block's counts of counts;
   a triple seen once is discounted as a whole, so only its context's weight tells
   of it, and a context of nothing else needs no entry.

P3 = a3 + l3 P2, P2 = a2 + l2 P1, P1 = base: probabilities of a context add up to
one but for the codes' steps of 0.0002. The first words of a document have shorter contexts.

Work on Spark: words, then pairs and triples, are counted within blocks of text,
dealt out by key (n-grams packed, some thousands a row) and merged in order by
streaming tasks that write a block at a time. The n-grams' shares are ranges of (first, second, third word) cut by the
words' own cumulated counts, so a frequent word's contexts are spread over many
tasks, and a context that runs over blocks is put together by the index from the
sums that blocks tell at their ends (one row a block). Nothing is broadcast:
tasks map the blocks in the shared folder and read the words their queries touch.
Tasks lost are run again and write the same files. Scores are checkpointed, then
the model's folder is removed, unless the caller trains and scores by steps.

Defined cases: a null or empty text is its end token alone. A null doc_id counts
as an empty string for the hold-out. Repeated rows are scored (and learned from)
each. No rows to learn from: N and V are 0 and each token has base probability 1.
Very long texts are one document whatever their length. Other columns are not
read, whatever their names. No rows in: no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, runs, small, utf8
from tessera.llm.elias_fano import U, EliasFano, Lexicon, digests, encode, n_shards, new_folder, open_block, remove_folder, sorted_order, write_block
from tessera.session import cut

#: Tokens that a task counts or scores together, and n-grams that go into one block of a level.
TOKENS, NGRAMS = 1_000_000, 1 << 20
#: N-grams of a block of text that go into one row, about.
PACKED = 1000
#: A code is one of 65,536 steps of log10 p from -16 to 0.
STEP = 16 / 65535
BITS = 31  # of a word's id
NO_WORD = (1 << BITS) - 1


def split(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(number of words of each text, all words) of a column, without end tokens; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, cuts = lists.flatten(), lists.offsets.to_numpy()
    there = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word
    n = np.diff(np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False))][cuts - cuts[0]])
    found = words.filter(there).dictionary_encode()
    return n, pa.DictionaryArray.from_arrays(found.indices, found.dictionary.cast(pa.large_binary()))


def listed(words: pa.LargeBinaryArray) -> list[bytes]:
    """The words, which hold no white space, as bytes: joined by spaces and split, several times as fast as one by one."""
    if not len(words):
        return []
    cuts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    kept = np.ones(int(cuts[-1] - cuts[0]) + len(words), bool)
    kept[cuts[1:] - cuts[0] + np.arange(len(words))] = False
    joined = np.full(len(kept), ord(" "), np.uint8)
    joined[kept] = np.frombuffer(words.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    return joined[:-1].tobytes().split(b" ")


def token_blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, list[bytes]]]:
    """(rows, ids, first token of each row, words) of some documents after one another; ids are places in words, b"" is the end token. The text is the first column."""
    held, found, sizes, n = [], [], [], 0

    def out():
        size = np.concatenate(sizes)
        alike = pa.chunked_array(found).unify_dictionaries()
        words = listed(alike.chunk(0).dictionary)
        ids = np.full(int(size.sum()), len(words), np.int64)
        end = np.cumsum(size) - 1
        inner = np.ones(len(ids), bool)
        inner[end] = False
        ids[inner] = np.concatenate([c.indices.to_numpy() for c in alike.chunks])
        return held, ids, end + 1 - size, [*words, b""]

    for b in small(batches):
        size, words = split(b.column(0))
        found.append(words)
        sizes.append(size + 1)
        n += int(size.sum()) + len(size)
        held.append(b.select(range(1, b.num_columns)) if b.num_columns > 1 else b)
        if n >= tokens:
            yield out()
            held, found, sizes, n = [], [], [], 0
    if found:
        yield out()


def discounts(c: np.ndarray) -> np.ndarray:
    """What is taken from each count: for 1, 2 and more, from the numbers of n-grams seen once to four times; three quarters of one where these are lacking."""
    n = np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [min(i - 0.01, max(0.01, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] and n[0] else 0.75 for i in (1, 2, 3)]
    return np.array(d)[np.minimum(c, 3) - 1]


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-16)) / STEP), 0, 65535).astype("<u2")


def decoded(c: np.ndarray) -> np.ndarray:
    return 10.0 ** (c.astype(float) * -STEP)


def _level_block(level: int, ctx: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[dict, dict, list]:
    """(arrays, meta, line of the index) of a sorted run of one level."""
    new = np.r_[True, ctx[1:] != ctx[:-1]]
    start, of = np.flatnonzero(new), np.cumsum(new) - 1
    d = np.where(c == 1, 1.0, discounts(c)) if level == 3 else discounts(c)
    total, taken = np.add.reduceat(c, start), np.add.reduceat(d, start)
    keep = c > d
    for x, y in ((0, start[1] if len(start) > 1 else len(c)), (start[-1], len(c))):
        keep[x] |= not keep[x:y].any()  # the first and the last context may go on in other blocks, which count on their being here
    kept = np.add.reduceat(keep.astype(np.int64), start)
    there = kept > 0
    at = np.cumsum(there) - 1
    alpha, of, w = ((c - d) / total[of])[keep], at[of[keep]], w[keep]
    pointer = np.r_[0, np.cumsum(kept[there])]
    last = w[pointer[1:] - 1]
    base = np.cumsum(last) - last  # what the ranges before end with
    arrays, meta = {"alpha": code(alpha), "lambda": code((taken / total)[there])}, {}
    for name, values in (("context", ctx[start][there]), ("pointer", pointer), ("word", base[of] + w)):
        a, m = encode(name, values.astype(U))
        arrays |= a
        meta |= m
    return arrays, meta, [int(ctx[0]), int(w[0]), int(ctx[-1]), int(total[0]), float(taken[0]), int(total[-1]), float(taken[-1])]


def packed(ids: list[np.ndarray], n: np.ndarray) -> bytes:
    """Sorted n-grams and their counts: columns of 32 bits, the first as differences, byte by byte, and compressed if that pays."""
    from zstandard import ZstdCompressor

    cols = np.stack([np.diff(ids[0], prepend=0), *ids[1:], n]).astype("<u4")
    data = np.ascontiguousarray(cols.view(np.uint8).reshape(len(cols), -1, 4).transpose(0, 2, 1)).tobytes()
    return bytes([len(cols), len(n) > 100]) + (ZstdCompressor(level=1).compress(data) if len(n) > 100 else data)


def unpacked(data: bytes) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    k, small_one, data = data[0], not data[1], data[2:]
    data = data if small_one else ZstdDecompressor().decompress(data)
    cols = np.frombuffer(data, np.uint8).reshape(k, 4, -1).transpose(0, 2, 1).reshape(k, -1).copy().view("<u4").astype(np.int64)
    cols[0] = np.cumsum(cols[0])
    return list(cols)


_INDEX = "level long, part long, k long, context long, word long, last long, total double, taken double, last_total double, last_taken double"


def _write_levels(rows: DataFrame, folder: str, block: int) -> None:
    """From (part, level, sub, data): packed n-grams; parts and their subs are ranges in the order of n-grams of a level."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # merged runs of the part and level, in order
        here: list[bytes] = []  # of one sub
        now, k = (-1, -1, -1), 0

        def merged() -> list[np.ndarray]:
            cols = [np.concatenate(x) for x in zip(*map(unpacked, here))]
            ctx = cols[0] if len(cols) == 3 else 1 << 2 * BITS | cols[0] << BITS | cols[1]
            order = np.lexsort((cols[-2], ctx))
            ctx, w, n = ctx[order], cols[-2][order], cols[-1][order]
            new = np.flatnonzero(np.r_[True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])])
            return [ctx[new], w[new], np.add.reduceat(n, new)]

        def out() -> pa.RecordBatch:
            nonlocal k
            part, level, _ = now
            arrays, meta, line = _level_block(level, *(np.concatenate(x) for x in zip(*held)))
            write_block(folder, f"level-{part:06d}-{k:06d}", arrays, meta)
            held.clear()
            k += 1
            return batch("level part k context word last total taken last_total last_taken", *(pa.array([x]) for x in (level, part, k - 1, *line[:3])), *(pa.array([float(x)]) for x in line[3:]))

        for b in batches:
            for part, level, sub, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (part, level, sub) != now:
                    if here:
                        held.append(merged())
                        here.clear()
                    if held and ((part, level) != now[:2] or sum(len(x[0]) for x in held) >= block):
                        yield out()
                    if part != now[0]:
                        k = 0
                    now = (part, level, sub)
                here.append(data)
        if here:
            held.append(merged())
            yield out()

    dealt = rows.repartitionById(n_shards(rows), "part").sortWithinPartitions("part", "level", "sub")
    index = sorted(tuple(r) for r in dealt.mapInArrow(written, _INDEX).collect())  # one row a block
    for level in (2, 3):
        lines = [x for x in index if x[0] == level]
        number = lambda i, kind=np.int64: np.array([x[i] for x in lines], kind)  # noqa: E731, B023
        # contexts that stand in more than one block: their sums over all of them
        ends: dict[int, dict[int, tuple[float, float]]] = defaultdict(dict)
        for i, x in enumerate(lines):
            ends[x[3]][i] = x[6:8]
            ends[x[5]][i] = x[8:10]
        arrays = {"part": number(1), "k": number(2), "context": number(3), "word": number(4), "last": number(5)}
        for side, ctx in (("first", 3), ("end", 5)):
            share, weight = np.ones(len(lines)), np.full(len(lines), np.nan)
            for i, x in enumerate(lines):
                if len(parts := ends[x[ctx]]) > 1:
                    total = sum(t for t, _ in parts.values())
                    share[i], weight[i] = parts[i][0] / total, sum(d for _, d in parts.values()) / total
            arrays |= {f"{side}_share": share, f"{side}_weight": weight}
        write_block(folder, f"level-{level}", arrays, {})


@dataclass(frozen=True)
class Model:
    """A trained model: where its blocks are and what its words sum to."""

    folder: str
    words: Lexicon

    def base(self, ids: np.ndarray) -> np.ndarray:
        """Base probability of each word id; -1 is unknown."""
        c = np.zeros(len(ids))
        known = np.flatnonzero(ids >= 0)
        c[known] = self.words.counts(ids[known])
        return (c + 0.1) / (self.words.total + 0.1 * (self.words.size + 1))

    def level(self, level: int, ctx: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of the word itself, weight of the level below) for each context and word; 0 and 1 if the level does not know them."""
        alpha, weight = np.zeros(len(ctx)), np.ones(len(ctx))
        if not len(ctx) or not self.words.size:
            return alpha, weight
        index = open_block(self.folder, f"level-{level}")
        first, word = index["context"], index["word"]
        at = np.searchsorted(first, ctx, "right") - 1
        long = np.flatnonzero((at >= 0) & (first[at] == ctx) & (w < word[at]))  # blocks that begin within the context, after the word
        for x, y in runs([ctx[long]]):
            lo, hi = np.searchsorted(first, ctx[long[x]]), at[long[x]] + 1
            at[long[x:y]] = lo + np.searchsorted(word[lo:hi], w[long[x:y]], "right") - 1
        # a context that begins in the next block: its weight is there
        follows = np.flatnonzero((at + 1 < len(first)) & (first[np.minimum(at + 1, len(first) - 1)] == ctx))
        order = np.argsort(at, kind="stable")
        for x, y in runs([at[order]]):
            self._read(index, int(at[order[x]]), order[x:y], ctx, w, alpha, weight)
        late = follows[weight[follows] == 1]
        for x, y in runs([at[late]]):
            self._read(index, int(at[late[x]]) + 1, late[x:y], ctx, w, alpha, weight)
        return alpha, weight

    def _read(self, index, i: int, q: np.ndarray, ctx: np.ndarray, w: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> None:
        if i < 0:
            return
        b = open_block(self.folder, f"level-{index['part'][i]:06d}-{index['k'][i]:06d}")
        contexts, pointer, word = (EliasFano(b, x) for x in ("context", "pointer", "word"))
        # a context is looked for once, not for each of its words
        new = np.r_[True, ctx[q[1:]] != ctx[q[:-1]]]
        head, of = np.flatnonzero(new), np.cumsum(new) - 1
        place, there = contexts.successor(ctx[q[head]].astype(U))
        kept, to = np.flatnonzero(there), np.cumsum(there) - 1
        if not len(kept):
            return
        q, of = q[there[of]], to[of[there[of]]]
        place = place[kept]
        heavy, share = decoded(b["lambda"][place]), np.ones(len(place))
        for side, where in (("first", 0), ("end", contexts.n - 1)):
            if not np.isnan(index[f"{side}_weight"][i]):
                mine = place == where
                heavy[mine], share[mine] = index[f"{side}_weight"][i], index[f"{side}_share"][i]
        begin, end = (x.astype(np.int64) for x in pointer.both(place))
        base = np.where(begin > 0, word.value(np.maximum(begin - 1, 0)), U(0))
        at, found = word.successor(base[of] + w[q].astype(U), begin[of], end[of])
        weight[q] = heavy[of]
        alpha[q[found]] = decoded(b["alpha"][at[found]]) * share[of[found]]

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out (if docs have it), n_tokens, n_known, train_tokens, base_score and score of each document."""
        own = [c for c in ("doc_id", "held_out") if c in docs.columns]
        rows = docs.select("text", *own)
        kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in own)
        total = self.words.total

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, ids, start, words in token_blocks(batches, TOKENS):
                known = self.words.ids(*digests(words))
                kept, ids = _relabelled(known, ids)
                size = np.diff(np.r_[start, len(ids)])
                p1 = self.base(kept)
                p = p1[ids]
                base = np.add.reduceat(np.log10(p), start)
                n_known = np.add.reduceat((kept[ids] >= 0).astype(np.int64), start)
                first, second = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
                first[start] = True
                second[start[size > 1] + 1] = True
                two = np.flatnonzero(~first)  # tokens with a word before them
                pairs, of = np.unique(ids[two - 1] * len(kept) + ids[two], return_inverse=True)
                a, w = pairs // len(kept), pairs % len(kept)
                p2 = p1[w]
                q = np.flatnonzero(kept[a] >= 0)
                alpha, weight = self.level(2, kept[a[q]], np.where(kept[w[q]] < 0, NO_WORD, kept[w[q]]))
                p2[q] = alpha + weight * p2[q]
                p[two] = p2[of]
                pair_at = np.zeros(len(ids), np.int64)
                pair_at[two] = of
                three = np.flatnonzero(~first & ~second)
                triples, of3 = np.unique(pair_at[three - 1] * len(kept) + ids[three], return_inverse=True)
                pair, w = triples // max(1, len(kept)), triples % max(1, len(kept))
                a, m = kept[pairs[pair] // len(kept)], kept[pairs[pair] % len(kept)]
                alpha3, weight3 = np.zeros(len(triples)), np.ones(len(triples))
                q = np.flatnonzero((a >= 0) & (m >= 0))
                alpha3[q], weight3[q] = self.level(3, 1 << 2 * BITS | a[q] << BITS | m[q], np.where(kept[w[q]] < 0, NO_WORD, kept[w[q]]))
                p[three] = alpha3[of3] + weight3[of3] * p[three]
                score = np.add.reduceat(np.log10(p), start)
                at = 0
                for b in held:
                    n = b.num_rows
                    cols = [x[at : at + n] for x in (size, n_known, np.full(len(size), total), base, score)]
                    yield batch(" ".join(own) + " n_tokens n_known train_tokens base_score score", *(b.columns if own else []), *map(pa.array, cols))
                    at += n

        return rows.mapInArrow(scored, ", ".join(filter(None, (kinds, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))))


def _relabelled(known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids in order, and each token's place in them; all unknown words are the one id -1."""
    kept, to = np.unique(known, return_inverse=True)
    return kept, to[ids]


def train(docs: DataFrame, folder: str | None = None, tokens: int = TOKENS, block: int = NGRAMS) -> Model:
    """Learn from the texts of all rows; the model's blocks are in folder (a new one of the shared folder by default)."""
    folder = folder or new_folder(docs, "lm")
    rows, parts = docs.select("text"), n_shards(docs)
    subs = max(1, min(64, tokens // (PACKED * parts)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, words in token_blocks(batches, tokens):
            u, check = digests(words)
            yield batch("u check n", pa.array(sorted_order(u)), pa.array(check.view(np.int64)), pa.array(np.bincount(ids)))

    words = Lexicon.build(rows.mapInArrow(counted, "u long, check long, n long").groupBy("u", "check").agg(F.sum("n").alias("n")), f"{folder}/words")
    if words.size >= NO_WORD:
        raise ValueError(f"{words.size} words do not fit ids of {BITS} bits")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, start, words_here in token_blocks(batches, tokens):
            kept, ids = _relabelled(words.ids(*digests(words_here)), ids)
            if kept[0] < 0:
                raise RuntimeError("a training text has a word that the first pass has not seen: the input is not read alike twice")
            m = len(kept)
            # share of all tokens below each word, and up to it: the place of an n-gram in [0, 1) in the order of its words
            low = words.before(kept) / words.total
            high = (words.before(kept) + words.counts(kept)) / words.total
            within = lambda w, x: np.minimum(low[w] + (high[w] - low[w]) * x, high[w])  # noqa: E731, B023
            end = np.r_[start[1:], len(ids)] - 1
            more = np.ones(len(ids), bool)
            more[end] = False
            two = np.flatnonzero(more)
            if not len(two):
                continue
            pairs, of, n = np.unique(ids[two] * m + ids[two + 1], return_inverse=True, return_counts=True)
            a, w = pairs // m, pairs % m
            yield _gram_rows(within(a, low[w]), parts, subs, 2, [kept[a], kept[w]], n)
            pair_at = np.full(len(ids), -1, np.int64)
            pair_at[two] = of
            three = two[more[two + 1]]
            if len(three):
                triples, n = np.unique(pair_at[three] * m + ids[three + 2], return_counts=True)
                a, b, w = pairs[triples // m] // m, pairs[triples // m] % m, triples % m
                yield _gram_rows(within(a, within(b, low[w])), parts, subs, 3, [kept[a], kept[b], kept[w]], n)

    _write_levels(rows.mapInArrow(grams, "part int, level int, sub int, data binary"), folder, block)
    return Model(folder, words)


def _gram_rows(place: np.ndarray, parts: int, subs: int, level: int, ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    to = np.minimum((place * (parts * subs)).astype(np.int64), parts * subs - 1)
    cuts = runs([to])
    where = to[[x for x, _ in cuts]]
    data = [packed([i[x:y] for i in ids], n[x:y]) for x, y in cuts]
    return batch("part level sub data", pa.array((where // subs).astype(np.int32)), pa.array(np.full(len(cuts), level, np.int32)), pa.array((where % subs).astype(np.int32)), pa.array(data, pa.binary()))


def held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, text and held_out: crc32 of doc_id as text leaves no remainder by folds."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", (F.crc32(name.cast("binary")) % folds == 0).alias("held_out"))


def scores(docs: DataFrame) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    rows = held_out(docs)
    model = train(rows.where(~F.col("held_out")))
    out = cut(model.score(rows))
    remove_folder(model.folder)
    return out
