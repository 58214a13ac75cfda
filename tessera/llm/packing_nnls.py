"""Packing of token sequences into fixed windows by non-negative least squares.

A document's ids, closed by an end id, are cut into full windows and one rest.
Rests are packed per block of at most BLOCK_TOKENS ids inside a task, so nothing
is shuffled and memory is bounded by the block: the block's histogram of rest
lengths is taken, shallow combinations (one complement pair per length, and
triples of frequent lengths with their complement) that fill a window exactly
are enumerated, their repeat counts are solved for by non-negative least
squares against the histogram, rounded down and carried out; what is left over
is packed greedily, longest first, cutting a piece where a window is full. The
one window per task that stays unfilled is cut into sequences whose lengths are
powers of two, which need no padding.

Sequence ids are unique, not dense: the task's partition number in the high
bits, a running number in the low 32.

Defined cases: a null or empty text is the end id alone. Null doc_ids and
repeated rows are packed like others. A very long text is cut into windows like
any other, and may make its block longer than BLOCK_TOKENS. Other columns are
not read, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, texts
from tessera.llm.encoding import default_pattern, default_vocabulary, encoder

WINDOW, END_ID, BLOCK_TOKENS, FREQUENT = 2048, 1, 1 << 23, 48
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations_filling(lengths: list[int], histogram: dict[int, int], window: int, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a window exactly.

    Which triples are tried decides only how many rests need no cut: what no pattern takes is packed greedily.
    """
    found = {tuple(sorted((a, window - a))) for a in lengths if histogram.get(window - a)}
    top = sorted(lengths, key=lambda a: (-histogram[a], a))[:frequent]
    found |= {tuple(sorted((a, b, c))) for i, a in enumerate(top) for b in top[i:] if (c := window - a - b) > 0 and histogram.get(c)}
    return sorted(found)


def repeat_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], near: float = 0.01) -> list[float]:
    """x >= 0 that minimises the squared gap between the lengths used and the histogram, by coordinate descent until no count moves by `near`."""
    gap = {k: float(v) for k, v in histogram.items()}
    uses = [{a: p.count(a) for a in set(p)} for p in patterns]
    x = [0.0] * len(patterns)
    moved = near
    while moved >= near:
        moved = 0.0
        for k, use in enumerate(uses):
            step = sum(gap[a] * m for a, m in use.items()) / sum(m * m for m in use.values())
            step = max(step, -x[k])
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for a, m in use.items():
                    gap[a] -= step * m
    return x


def pack_rests(lengths: list[int], window: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows and the last unfilled one, as pieces (index of the rest, start in it, length)."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        if n:
            by_length[n].append(i)
    histogram = {n: len(v) for n, v in by_length.items()}
    patterns = combinations_filling(sorted(histogram), histogram, window)
    full = []
    for p, x in zip(patterns, repeat_counts(patterns, histogram)):
        for _ in range(min(int(x), *(len(by_length[a]) // p.count(a) for a in p))):
            full.append([(by_length[a].pop(), 0, a) for a in p])
    now, room = [], window
    for n in sorted(by_length, reverse=True):
        for i in by_length[n]:
            at = 0
            while at < n:
                take = min(room, n - at)
                now.append((i, at, take))
                at += take
                room -= take
                if not room:
                    full.append(now)
                    now, room = [], window
    return full, now


def powers_of_two(n: int) -> list[int]:
    """n as a sum of powers of two, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Block:
    """Documents of a task that are packed together."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window, self.next, self.docs, self.tokens = window, first_sequence, [], 0

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        self.docs.append((doc_id, ids, start, len(ids) if total is None else total))
        self.tokens += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        rows: list[tuple] = []
        w = self.window

        def sequence(pieces: list[tuple[int, int, int]]) -> None:
            offset = 0
            for d, at, n in pieces:
                doc_id, ids, start, total = self.docs[d]
                rows.append((doc_id, start + at, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), total, self.next, offset))
                offset += n
            self.next += 1

        cut = []
        for d, (_, ids, _, _) in enumerate(self.docs):
            whole = len(ids) // w * w
            for at in range(0, whole, w):
                sequence([(d, at, w)])
            cut.append(whole)
        full, tail = pack_rests([len(x[1]) - c for x, c in zip(self.docs, cut)], w)
        for pieces in full:
            sequence([(d, cut[d] + at, n) for d, at, n in pieces])
        tail = [(d, cut[d] + at, n) for d, at, n in tail]
        if last:
            sizes, now = powers_of_two(sum(n for _, _, n in tail)), []
            for d, at, n in tail:
                while n:
                    take = min(n, sizes[0] - sum(x[2] for x in now))
                    now.append((d, at, take))
                    at, n = at + take, n - take
                    if sum(x[2] for x in now) == sizes[0]:
                        sequence(now)
                        now = []
                        sizes.pop(0)
            tail = []
        left = [(self.docs[d][0], self.docs[d][1][at : at + n], self.docs[d][2] + at, self.docs[d][3]) for d, at, n in tail]
        self.docs, self.tokens = [], 0
        for doc_id, ids, start, total in left:
            self.add(doc_id, ids, start, total)
        columns = list(zip(*rows)) or [()] * 7
        return batch("doc_id start length ids_crc32 doc_tokens sequence_id offset", *[pa.array(c, pa.int64()) for c in columns])


def pack(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, rule = vocabulary or default_vocabulary(), pattern or default_pattern()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, rule)
        block = _Block(window, TaskContext.get().partitionId() << 32)
        for b in small(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1))):
                ids = encode(text)
                block.add(doc_id, np.append(ids, np.uint32(end_id)))
                if block.tokens >= block_tokens:
                    yield block.flush(last=False)
        yield block.flush(last=True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, SCHEMA)
