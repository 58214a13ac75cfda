"""Near-duplicates by SimHash fingerprints, found in BK-trees.

Words are longest runs without ASCII white space, A-Z in lower case; shingles
are `SHINGLE` words joined by one space, repeats included. Fingerprint bit i is
1 if bit i is set in over half the shingles' XXH64 (seed 42).

Fingerprints within RADIUS bits are linked. Distinct fingerprints only are
compared (any number of copies of a text is one fingerprint). Of six blocks of
the 64 bits, four changed bits leave two untouched, so two fingerprints within
the radius agree on one of the 15 pairs of blocks: each pair is a bucket key.
A bucket is dealt to shards of at most SHARD fingerprints; every pair of shards
of a bucket is one unit of work with a BK-tree over one shard, into which the
other's fingerprints are looked up, following only edges whose distance to the
parent is within the radius. So no task ever holds more than two shards, and a
hot bucket becomes many units. A unit gives a spanning forest of its links, not
all pairs; connected components then put the forests together.

Defined cases: a null or empty text has no shingles and fingerprint zero, which
is linked like any other; fewer words than a shingle: the whole sequence is the
one shingle. Null doc_ids take part; component_id is the smallest doc_id that
is not null, or null if there is none. Repeated rows stay repeated. Very long
texts are read whole, shingles in blocks. Other columns are not read, whatever
their names. No rows in, no rows out.

Trees are made in the task of a unit and not broadcast: their number grows with
the table, so broadcasting them would either send all fingerprints to every
executor or take a pass over all fingerprints for each group of trees; a shuffle
by unit brings each tree to just those that ask it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessera.llm.common import batch, rank_of, runs, small, utf8
from tessera.operators.components import connected_components
from tessera.operators.skew import join_per_key
from tessera.session import cut

SHINGLE, SEED, RADIUS, SHARD = 4, 42, 4, 2048
_WIDTHS = (11, 11, 11, 11, 10, 10)
_MASKS = [((1 << w) - 1) << sum(_WIDTHS[:i]) for i, w in enumerate(_WIDTHS)]
KEYS = [a | b for a, b in combinations(_MASKS, 2)]
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[SHINGLE - 1 :].tolist() or [len(line)]
    for at in range(0, n, _BLOCK):
        h = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : min(n, at + _BLOCK)])), np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row of docs; fp is the fingerprint as a signed long."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.fromiter(map(fingerprint, utf8(b.column(1))), np.uint64, b.num_rows)
            yield batch("doc_id fp", b.column(0), pa.array(fp.view(np.int64)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, fp long")


class BKTree:
    """Children hang under their parent by their integer distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        if len(self.values) > 1:
            at = 0
            while (below := self.children[at]).setdefault(d := (self.values[at] ^ x).bit_count(), new := len(self.values) - 1) != new:
                at = below[d]

    def within(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the values at most radius from x."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def spanning_links(tree_of: list[int], asking: list[int], own: bool, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join what was not joined before: within tree_of (own), or from asking into it."""
    tree, links, up = BKTree(), [], {}

    def find(x: int) -> int:
        while (r := up.setdefault(x, x)) != x:
            up[x] = x = up[r]
        return x

    parts = 0  # separate parts of the tree; one part needs one hit only
    for x in tree_of:
        parts += 1
        if own:
            for at in tree.within(x, radius):
                a, b = find(x), find(tree.values[at])
                if a != b:
                    up[a] = b
                    parts -= 1
                    links.append((x, tree.values[at]))
                if parts == 1:
                    break
        tree.add(x)
    for x in asking:
        hit = False
        for at in tree.within(x, radius):
            a, b = find(x), find(tree.values[at])
            if a != b:
                up[a] = b
                parts -= hit
                links.append((x, tree.values[at]))
            hit = True
            if parts == 1:
                break
    return links


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, v, i, j, home, fp) sorted by unit (k, v, i, j) to links (a, b)."""
    held: list[np.ndarray] | None = None

    def links_of(cols, spans):
        out = []
        for s, e in spans:
            if e - s > 1:
                fp, home = cols[5][s:e].view(np.uint64), cols[4][s:e]
                i, j = cols[2][s], cols[3][s]
                out += spanning_links(fp[home == i].tolist(), [] if i == j else fp[home == j].tolist(), bool(i == j), RADIUS)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return batch("a b", pa.array(pairs[:, 0]), pa.array(pairs[:, 1]))

    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if spans := runs(cols[:4]):
            last = spans.pop()[0]
            yield links_of(cols, spans)
            held = [c[last:].copy() for c in cols]
    if held:
        yield links_of(held, [(0, len(held[0]))])


def fingerprint_links(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b) of distinct fingerprints within RADIUS bits: links that join the same components as all of them."""
    keyed = fps.select("fp").distinct().select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("v")) for i, m in enumerate(KEYS)])))
    count = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    dealt = join_per_key(keyed, count, ["k", "v"]).select("k", "v", "fp", F.ceil(F.col("n") / shard).cast("int").alias("s"))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("fp", "k"), F.col("s")).cast("int"))
    unit = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select(
        "k", "v", F.least("home", "o").alias("i"), F.greatest("home", "o").alias("j"), "home", "fp"
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return unit.repartition(n, "k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j").mapInArrow(_units, "a long, b long")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) rows, and (fp, n, least, part, component_id) for each distinct fp."""
    rows = cut(fingerprints(docs))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    part = connected_components(fingerprint_links(fps))
    named = cut(fps.join(part, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("part")))
    best = named.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return rows, join_per_key(named, best, ["part"], "members").drop("members")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    rows, named = _labelled(docs)
    return join_per_key(rows, cut(named.select("fp", "n", "component_id")), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id.

    If several rows of a component have that doc_id, the one with the smallest
    fingerprint (as a signed number) stays, and of rows equal in both the one
    whose other columns have the least hash. Texts are shuffled once.
    """
    _, named = _labelled(docs)
    top = named.where(F.col("least").eqNullSafe(F.col("component_id"))).groupBy("part").agg(F.min("component_id").alias("k_id"), F.min("fp").alias("k_fp"))
    key = lambda doc_id, fp: F.concat_ws(":", doc_id, fp).alias("k")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.fromiter(map(fingerprint, utf8(b.column(1))), np.uint64, b.num_rows)
            yield batch("r_id r_fp r_of row", b.column(0), pa.array(fp.view(np.int64)), b.column(2), b.column(3))

    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    kind = T.StructType().add("r_id", "long").add("r_fp", "long").add("r_of", "long").add("row", docs.select(row).schema["row"].dataType)
    rows = docs.select(docs["doc_id"].cast("long").alias("r_id"), docs["text"], rank_of(docs, "doc_id").alias("r_of"), row).mapInArrow(go, kind)
    found = rows.select("row", "r_of", key("r_id", "r_fp")).join(top.select(key("k_id", "k_fp")), "k", "left_semi")
    first = F.row_number().over(Window.partitionBy("k").orderBy("r_of"))
    return found.withColumn("nth", first).where("nth = 1").select("row.*")
