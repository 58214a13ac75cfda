"""Repeated passages by seed and extend.

A window is WINDOW consecutive words. Every window has one winnowed anchor: the
GRAM-word hash that is least in it. Equal windows have equal anchors at equal
places, so documents are joined on anchors alone (about one for seven words),
and only anchors that occur twice are seeds. Around a seed, each place that has
it as the anchor of its windows is paired with the earliest place whose window
is alike by its hash, one partner and not all of them, so copies make no pairs
of pairs. From the seed the match is then extended both ways, word by word,
as far as the two places agree, and kept if it has WINDOW words at least.
Matches of neighbouring seeds with one partner at one distance are joined into
maximal repeats (`repeats` gives them). Every word in a repeat goes, but for the
place where the sequence starts first.

Scale: equal texts take part once, by their smallest doc_id. The texts are dealt
out once, by a hash of doc_id and text, and that exchange is used by all three
passes over them. A task settles repeats among its own rows first, so a window
reaches the shuffle once per task at most; anchors with many occurrences are
split further by the window's hash, and the commonest anchors and texts are
joined without moving their rows. No group is ever held whole by one task.

Defined cases: null text: no words. A null doc_id counts as smaller than any
other. "Earlier" compares (doc_id, start) only: rows that share a doc_id are one
document in it, and equal rows do not remove each other's words. Documents of
fewer than WINDOW words lose nothing; very long texts are read whole. Other
columns are not read, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, utf8
from tessera.operators.skew import join_per_key
from tessera.session import cut, shared_dir

WINDOW, GRAM, HOT, BLOCK = 20, 8, 512, 1 << 20
_LEAST = -(1 << 63)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < size."""
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of width consecutive words."""
    n = len(h)
    up, down = _powers(base, max(1 << 16, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    x = (total[width:] - total[:-width]) * down[: n - width + 1]
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def window_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash, window hash) of every window, as signed longs; none for fewer than WINDOW words."""
    n = len(words)
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = _rolling(h, GRAM, _BASES[0])
    least = grams
    width = 1
    while width < WINDOW - GRAM + 1:  # least of growing stretches
        step = min(width, WINDOW - GRAM + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least.view(np.int64), _rolling(h, WINDOW, _BASES[1]).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, ...) to (h, key), each anchor hash once a text, and once more if a window of it repeats there."""
    for b in small(batches):
        hs, ids = [], []
        for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
            h, w = window_hashes(t.split())
            order = np.lexsort((w, h))
            twice = (np.diff(h[order]) == 0) & (np.diff(w[order]) == 0)
            h = np.concatenate([np.unique(h), np.unique(h[order][1:][twice])])
            hs.append(h)
            ids.append(np.full(len(h), d, np.int64))
        if hs:
            yield batch("h key", pa.array(np.concatenate(hs)), pa.array(np.concatenate(ids)))


def extended(late: list[bytes], early: list[bytes], seed: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around word `seed` in which two equally long stretches of words agree; empty if not there."""
    if late == early:
        return 0, len(late)
    start = end = seed
    while start and late[start - 1] == early[start - 1]:
        start -= 1
    while end < len(late) and late[end] == early[end]:
        end += 1
    return start, end


def _partners(h, w, d, s) -> tuple[np.ndarray, np.ndarray]:
    """The places that are not the first of their window, and the first place of each of these."""
    order = np.lexsort((s, d, w, h))
    h, w = h[order], w[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    late = (d[order] != d[first]) | (s[order] != s[first])
    return order[late], first[late]


def _streaks(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs in which the last key counts up by one and the others stay."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[-1][1:] != keys[-1][:-1] + 1
    for k in keys[:-1]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class _Places:
    """Windows by place: anchor hash, window hash, doc_id, key of the text, start, and the words of a stretch of windows."""

    def __init__(self, h, w, d, key, s, words) -> None:
        self.h, self.w, self.d, self.key, self.s, self.words = h, w, d, key, s, words

    def matches(self) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
        """(key, start, words, earlier doc_id, earlier start) of verified matches, and which windows lie in one."""
        late, early = _partners(self.h, self.w, self.d, self.s)
        order = np.lexsort((self.s[late], self.s[early] - self.s[late], self.key[early], self.key[late], self.h[late]))
        late, early = late[order], early[order]
        at = _streaks(self.h[late], self.key[late], self.key[early], self.s[early] - self.s[late], self.s[late])
        out, inside = [], np.zeros(len(self.h), bool)
        for x, end in zip(at.tolist(), [*at[1:].tolist(), len(late)]):
            n = end - x
            a, b = int(late[x]), int(early[x])
            # all windows of a streak have one anchor, so it lies in the words that all of them share
            start, stop = extended(self.words(a, n), self.words(b, n), n - 1)
            if stop - start >= WINDOW:
                out.append((int(self.key[a]), int(self.s[a]) + start, stop - start, int(self.d[b]), int(self.s[b]) + start))
                inside[late[x + start : x + stop - WINDOW + 1]] = True
        return out, inside


_RUN = "h long, salt int, doc_id long, key long, start int, n int, words binary, from_doc long, from_start int"


def _matched(found: list[tuple]) -> list[pa.Array]:
    """Columns of _RUN for verified matches; n counts words, and the text's key stands for the anchor, so they are dealt out evenly."""
    key, start, n, d, s = zip(*found) if found else [()] * 5
    zero, none, key = np.zeros(len(key), np.int64), pa.nulls(len(key), pa.binary()), pa.array(key, pa.int64())
    return [key, pa.array(zero.astype(np.int32)), pa.array(zero), key, pa.array(start, pa.int32()), pa.array(n, pa.int32()), none, pa.array(d, pa.int64()), pa.array(s, pa.int32())]


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their seeds to runs of windows to compare (with their words), and matches found within the task (without)."""
    held: list[tuple] = []
    texts: dict[int, list[bytes]] = {}
    size = 0

    def settle() -> pa.RecordBatch:
        h, salt, d, key, s, w = (np.concatenate(c) for c in zip(*held))
        places = _Places(h, w, d, key, s, lambda i, n: texts[int(key[i])][s[i] : s[i] + n - 1 + WINDOW])
        found, inside = places.matches()
        rows = np.flatnonzero(~inside)
        rows = rows[np.lexsort((s[rows], key[rows], salt[rows], h[rows]))]
        at = _streaks(h[rows], salt[rows], d[rows], key[rows], s[rows])
        n = np.diff(np.append(at, len(rows)))
        r = rows[at]
        words = pa.array([b" ".join(texts[k][x : x + m - 1 + WINDOW]) for k, x, m in zip(key[r].tolist(), s[r].tolist(), n.tolist())], pa.binary())
        runs = [pa.array(h[r]), pa.array(salt[r]), pa.array(d[r]), pa.array(key[r]), pa.array(s[r]), pa.array(n.astype(np.int32)), words, pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int32())]
        return batch("h salt doc_id key start n words from_doc from_start", *[pa.concat_arrays(x) for x in zip(runs, _matched(found))])

    for b in small(batches):
        for key, text, d, seeds in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), b.column(3)):
            words = text.split()
            h, w = window_hashes(words)
            seed = seeds.values.flatten()
            known = seed[0].to_numpy(zero_copy_only=False)
            parts = seed[1].to_numpy(zero_copy_only=False)
            order = np.argsort(known)
            known, parts = known[order], parts[order]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            s = np.flatnonzero(known[at] == h).astype(np.int32)
            if len(s):
                part = parts[at[s]]
                salt = ((w[s].view(np.uint64) >> np.uint64(17)) % part.astype(np.uint64)).astype(np.int32)
                held.append((h[s], salt, np.full(len(s), d, np.int64), np.full(len(s), key, np.int64), s, w[s]))
                texts[key] = words
                size += len(words)
                if size >= BLOCK:
                    yield settle()
                    held.clear()
                    texts.clear()
                    size = 0
    if held:
        yield settle()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (h, salt) to matches (key, start, n words, from_doc, from_start)."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> pa.RecordBatch:
        done = rows["words"].is_null().to_numpy()
        old = [c.combine_chunks() for c in rows.filter(pa.array(done)).select(["key", "start", "n", "from_doc", "from_start"]).columns]
        rows = rows.filter(pa.array(~done))
        h, d, key, start, n = (rows[c].to_numpy() for c in ("h", "doc_id", "key", "start", "n"))
        words = [x.split(b" ") for x in rows["words"].to_pylist()]
        home = np.repeat(np.arange(len(n)), n)
        nth = (np.arange(len(home)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        w = np.concatenate([window_hashes(x)[1] for x in words]) if words else np.empty(0, np.int64)
        places = _Places(h[home], w, d[home], key[home], start[home] + nth, lambda i, m: words[home[i]][nth[i] : nth[i] + m - 1 + WINDOW])
        new = _matched(places.matches()[0])[3:]
        return batch("key start n from_doc from_start", *[pa.concat_arrays(x) for x in zip(old, [*new[:3], *new[4:]])])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        h, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
        last = (h != h[-1]) | (salt != salt[-1])
        whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if whole:
            yield settle(pa.Table.from_batches([*held[:-1], b.slice(0, whole)]))
            held = [b.slice(whole)]
    if held:
        yield settle(pa.Table.from_batches(held))


def maximal(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """(start, words, from_doc, from_start): matches with one partner at one distance that touch or overlap become one."""
    out: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x["from_doc"], x["from_start"] - x["start"], x["start"])):
        s, n, d, f = x["start"], x["n"], x["from_doc"], x["from_start"]
        if out and out[-1][2] == d and out[-1][3] - out[-1][0] == f - s and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - out[-1][0])
        else:
            out.append([s, n, d, f])
    return sorted(map(tuple, out))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their matches to the figures and the words that stay."""
    for b in small(batches):
        out = []
        for text, found in zip(utf8(b.column(1)), b.column(5).to_pylist()):
            words = text.split()
            change = np.zeros(len(words) + 1, np.int64)
            for x in found or ():
                change[x["start"]] += 1
                change[x["start"] + x["n"]] -= 1
            stay = np.cumsum(change[:-1]) == 0
            kept = b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]) if found else b" ".join(words)
            out.append((len(words), len(words) - int(stay.sum()), kept))
        n, gone, kept = zip(*out) if out else ((), (), ())
        yield batch("s1 s2 n_words n_removed kept_text", b.column(3), b.column(4), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept(batches):
        yield batch("s1 s2 n_words n_removed kept_sha256", *b.columns[:4], pa.array([hashlib.sha256(t).hexdigest() for t in utf8(b.column(4))], pa.string()))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, *m) for d, found in zip(b.column(2).to_pylist(), b.column(5).to_pylist()) for m in maximal(found or [])]
        c = list(zip(*rows)) or [()] * 5
        yield batch("doc_id start n_words from_doc from_start", *[pa.array(x, pa.int64()) for x in c])


def _written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: a third of the size of a checkpoint."""
    place = f"{shared_dir(df.sparkSession)}/anchors-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def _leading(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without texts, the smallest doc_id and number of rows of each text, and the distinct texts with their matches."""
    doc_id, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), F.coalesce("text", F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("s1"), F.xxhash64(F.lit("second"), text).alias("s2"))
    narrow = rows.select("doc_id", "s1", "s2")
    leads = narrow.groupBy("s1", "s2").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"))
    key = lambda d: F.xxhash64(d, "s1", "s2").alias("key")
    same = leads.select(key("lead"), "lead", F.col("s1").alias("l1"), F.col("s2").alias("l2"))
    # told by exclusive or, so that it is no join key: texts are dealt out by key alone, as all joins below need them
    apart = (F.col("s1").bitwiseXOR(F.col("l1"))).bitwiseOR(F.col("s2").bitwiseXOR(F.col("l2"))).bitwiseOR(F.col("doc_id").bitwiseXOR(F.col("lead")))
    base = rows.select("*", key("doc_id")).join(same.hint("shuffle_hash"), "key").where(apart == 0).select("key", "text", "doc_id", "s1", "s2")
    anchors = _written(base.mapInArrow(_anchors, "h long, key long"))
    often = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    seeds = join_per_key(anchors, often, ["h"]).groupBy("key").agg(F.collect_list(F.struct("h", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))).alias("seeds"))
    runs = base.join(seeds.hint("shuffle_hash"), "key").select("key", "text", "doc_id", "seeds").mapInArrow(_seeded, _RUN)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = runs.repartition(n, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_compare, "key long, start int, n int, from_doc long, from_start int")
    found = late.groupBy("key").agg(F.collect_list(F.struct("start", "n", "from_doc", "from_start")).alias("found"))
    return narrow, leads, base.join(found.hint("shuffle_hash"), "key", "left").select("key", "text", "doc_id", "s1", "s2", "found")


def repeats(docs: DataFrame) -> DataFrame:
    """Maximal repeats of each distinct text, by its smallest doc_id: doc_id, start, n_words, and an earlier place of the same words (from_doc, from_start)."""
    null = lambda c: F.when(F.col(c) != _LEAST, F.col(c)).alias(c)
    rows = _leading(docs)[2].where("found is not null").mapInArrow(_spans, "doc_id long, start long, n_words long, from_doc long, from_start long")
    return rows.select(null("doc_id"), "start", "n_words", null("from_doc"), "from_start")


def repeated_words(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and kept_sha256 or (keep_text) kept_text."""
    narrow, leads, texts = _leading(docs)
    kept = "kept_text" if keep_text else "kept_sha256"
    done = texts.mapInArrow(_kept if keep_text else _digest, f"s1 long, s2 long, n_words long, n_removed long, {kept} string")
    done = cut(done.dropDuplicates(["s1", "s2"]).join(leads, ["s1", "s2"]))
    # texts have no bound, so they are not broadcast
    rows = narrow.join(done, ["s1", "s2"]) if keep_text else join_per_key(narrow, done, ["s1", "s2"])
    copy = (F.col("doc_id") != F.col("lead")) & (F.col("n_words") >= WINDOW)
    none = F.lit("") if keep_text else F.sha2(F.lit(""), 256)
    return rows.select(
        F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, none).otherwise(F.col(kept)).alias(kept),
    )
