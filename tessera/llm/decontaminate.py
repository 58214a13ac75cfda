"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with runs of white space as one
space. An item of m characters may differ by floor(m * ERROR_RATE) edits, its
budget e; it is split into e + 1 pieces, of which at least one must occur
unchanged in any match. One Aho-Corasick automaton finds all piece hits of a
text in one pass, and Myers' bit-parallel distance verifies each hit in the
stretch of text that the item could cover.

The items are the stated query set: they are read in blocks of at most
BLOCK_CHARS characters, one pass over the documents for each block, so what is
sent to the tasks has a fixed bound however large the benchmark is.

Defined cases: null or empty items and texts match nothing. Null doc_ids are
passed along. Repeated document rows give repeated matches, repeated items
match under each of their ids. Items shorter than 1 / ERROR_RATE characters
must occur exactly. No documents or no items: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, texts

ERROR_RATE, BLOCK_CHARS = 0.05, 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of nearly equal length, each with its place."""
    n = min(errors + 1, len(item))
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:])]


def myers(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole item ending anywhere in text, if within errors; the first of ties."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = ones, 0, m, None
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & ones
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | ~(xv | ph) & ones
        mv = ph & xv
        if score <= errors and (best is None or score < best[0]):
            best = (score, end)
            if not score:
                break
    return best


class Matcher:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for at, p in pieces(t, e):
                places.setdefault(p, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for p, found in places.items():
            self.automaton.add_word(p, (len(p), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item's best match in the text."""
        if not self.items:
            return []
        text = normal(text)
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, found) in self.automaton.iter(text):
            for k, at in found:
                item_id, item, e = self.items[k]
                start = last + 1 - size - at
                if k in best and best[k][0] == 0 or (k, start) in tried:
                    continue
                tried.add((k, start))
                if text.startswith(item, start) and start >= 0:
                    hit = (0, start + len(item))
                else:
                    low = max(0, start - e)
                    hit = myers(item, text[low : start + len(item) + e], e) if e else None
                    hit = hit and (hit[0], hit[1] + low)
                if hit and (k not in best or hit < best[k]):
                    best[k] = hit
                    if first_only:
                        return [(item_id, *hit)]
        return [(self.items[k][0], d, end) for k, (d, end) in best.items()]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The normalised items in blocks of bounded size, read one partition at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        held.append((r.item_id, normal(r.text)))
        size += len(held[-1][1])
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held



def contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs and item found in it: doc_id, item_id, distance, end_char (in the normalised text)."""
    schema = "doc_id long, item_id long, distance int, end_char long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def over(block: list[tuple[int, str]]) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in small(batches):
                out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))) for m in matcher.matches(t)]
                c = list(zip(*out)) or [()] * 4
                yield batch("doc_id item_id distance end_char", pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()))

        return rows.mapInArrow(go, schema)

    found = [over(b) for b in item_blocks(items, block_chars)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no item is found; filtered where they lie, without a join."""
    at = docs.columns.index("text")

    def without(df: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in small(batches):
                yield b.filter(pa.array([not matcher.matches(t, first_only=True) for t in texts(b.column(at))], pa.bool_()))

        return df.mapInArrow(go, docs.schema)

    return reduce(without, item_blocks(items, block_chars), docs)
