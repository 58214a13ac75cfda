"""Exact duplicates by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 16 bytes has its
low bits at zero, so equal texts have equal cuts. Each distinct chunk is moved
once and gets an identifier that is verified: the (identifier, bytes) pairs of
all chunks are made distinct and no identifier may stand for two byte strings.
A document is then its ordered list of identifiers (its recipe), and only these
short lists are compared; the long texts are not moved again.

Should an identifier ever stand for two chunks, the next, longer kind is taken,
at last the chunk's bytes themselves, so equality of recipes is always equality
of texts.

Defined cases: a null text counts as empty; the empty text has the empty recipe
and its copies form one group. A null doc_id is smaller than any other. Of rows
that are equal in doc_id and text exactly one is kept. Very long texts are read
whole, as chunks of at most MAX_BYTES. Other columns, whatever their names, are
passed by untouched. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import batch, rank_of, small, utf8
from tessera.operators.skew import join_per_key
from tessera.session import cut

WINDOW = 16
MIN_BYTES, MAX_BYTES = 512, 16384
CUT_MASK = np.uint32((1 << 11) - 1)
_MIX = 0x9E3779B1
_OF_BYTE = (np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint64)).astype(np.uint32)


def _xxh(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _sha(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def _itself(chunk: bytes) -> bytes:
    return len(chunk).to_bytes(4, "big") + chunk


#: Kinds of identifier, in the order in which they are tried.
IDENTIFIERS = (_xxh, _sha, _itself)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last being its length."""
    n, ends, start = len(data), [], 0
    if n > MIN_BYTES:
        h = _OF_BYTE[np.frombuffer(data, np.uint8)]
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] * np.uint32(pow(_MIX, step, 1 << 32))
        for p in (np.flatnonzero((h & CUT_MASK) == 0) + 1).tolist():
            while p - start > MAX_BYTES:
                start += MAX_BYTES
                ends.append(start)
            if p - start >= MIN_BYTES:
                ends.append(p)
                start = p
        while n - start > MAX_BYTES:
            start += MAX_BYTES
            ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _distinct_chunks(docs: DataFrame, identify: Callable[[bytes], bytes]) -> DataFrame:
    """(id, chunk), each pair once in all: repeats within a task go before the shuffle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = {c for t in set(utf8(b.column(0))) for c in chunks_of(t)}
            yield batch("id chunk", pa.array(map(identify, found), pa.binary()), pa.array(found, pa.binary()))

    return docs.select("text").mapInArrow(go, "id binary, chunk binary").distinct()


def recipes(docs: DataFrame, identifiers=IDENTIFIERS) -> DataFrame:
    """(doc_id, text_sha256, recipe) per row of docs; equal recipes are equal texts."""
    for identify in identifiers:
        shared = _distinct_chunks(docs, identify).groupBy("id").count().where("count > 1")
        if identify is identifiers[-1] or shared.isEmpty():
            break

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            data = utf8(b.column(1))
            yield batch(
                "doc_id text_sha256 recipe",
                b.column(0),
                pa.array([hashlib.sha256(t).hexdigest() for t in data]),
                pa.array([b"".join(map(identify, chunks_of(t))) for t in data], pa.binary()),
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, "doc_id long, text_sha256 string, recipe binary")


def exact_groups(docs: DataFrame, identifiers=IDENTIFIERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    each = cut(recipes(docs, identifiers).groupBy("recipe", "text_sha256", "doc_id").agg(F.count("*").alias("m")))
    group = each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.count("*").alias("n"))
    return (
        join_per_key(each, group, ["recipe"])
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of equal texts the one with the largest doc_id.

    Of rows equal in doc_id and text the one whose other columns have the least
    hash stays. Rows and what stays meet by one key, so texts are shuffled once.
    """
    key = lambda doc_id, sha: F.concat_ws(":", doc_id, sha).alias("k")
    keep = exact_groups(docs).where("kept").select(key("doc_id", "text_sha256"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(row, key(docs["doc_id"].cast("long"), F.sha2(F.coalesce(docs["text"], F.lit("")), 256)), rank_of(docs, "doc_id", "text").alias("of"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("of"))
    return rows.join(keep, "k", "left_semi").withColumn("nth", first).where("nth = 1").select("row.*")
