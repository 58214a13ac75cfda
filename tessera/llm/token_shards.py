"""Token ids as binary shards in training order.

Each task turns its documents into one stream of ids, every document closed by
an end id, and cuts it into sequences of SEQUENCE ids; the last one of a task is
filled up with end ids. A byte-level vocabulary makes at most one id of a byte,
so the bytes of a task bound its sequences, and a sum of lengths is all that is
needed to number sequences through all tasks: texts are encoded once. (The exact
number of sequences would take a second encoding of every text, or the ids
written and moved once more than the disk bound allows.) A keyed Feistel
permutation of [0, bound) with cycle-walking gives each number its key, without
a table. Training order is key order. Keys are dealt out in ranges of
SPAN: one range is one shard file of fixed stride, sorted by key, so the n-th
sequence of a shard is at byte n * stride, and a reader resumes anywhere by one
seek. The global slot of a sequence is its place in that order, counted without
gaps over all shards (the files' sizes tell how many each one has).

Ids are little-endian, of `width` bytes each; a vocabulary with ids that do not
fit raises an error. A shard is written under a name of its own attempt and then
renamed, so a repeated or speculative task leaves whole files only; what failed
attempts left is removed at the end. The files are complete when write_shards
returns. If a task has more sequences than its bound (an input that
is not read alike twice), it fails rather than write a wrong order.

Defined cases: a null or empty text is its end id alone. Null doc_ids and
repeated rows are written like others. Very long texts run on through as many
sequences as they need. Other columns are not read, whatever their names. No
rows in: no shards, no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import batch, small, texts
from tessera.llm.encoding import default_pattern, default_vocabulary, encoder
from tessera.session import cut, shared_dir

SEQUENCE, SPAN, END_ID, KEY, ROUNDS = 1024, 10_240, 1, 20240607, 6
WIDTH = 2  # bytes an id
_SCHEMA = "key long, shard long, byte_offset long, first_doc_id long, n_docs long, n_tokens long, ids_crc32 long"


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    a, b = x >> bits, x & mask
    for k in keys:
        a, b = b, a ^ _round(b, k) & mask
    return a << bits | b


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Keyed permutation of [0, n), applied to each number of x; walks a cycle until it is back in [0, n)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    keys = [zlib.crc32(f"{key}:{r}".encode()) for r in range(ROUNDS)]
    out = np.asarray(x, np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        if not inverse:
            return _feistel(v, half, keys)
        swap = lambda u: (u & np.uint64((1 << half) - 1)) << np.uint64(half) | u >> np.uint64(half)
        return swap(_feistel(swap(v), half, keys[::-1]))

    out = once(out)
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], encode, sequence: int, end_id: int) -> Iterator[tuple[np.ndarray, object, int, int]]:
    """(ids, first doc_id, documents begun or continued in it, ids that are not filling) of each sequence of a task."""
    held: list[np.ndarray] = []
    owners: list[tuple[object, int]] = []  # doc_id and ids left of each document in held
    size = 0

    for b in small(batches):
        for d, t in zip(b.column(0).to_pylist(), texts(b.column(1))):
            ids = np.append(encode(t), np.uint32(end_id))
            held.append(ids)
            owners.append((d, len(ids)))
            size += len(ids)
            if size >= sequence:
                whole = np.concatenate(held)
                at = 0
                while size - at >= sequence:
                    room, n, first = sequence, 0, owners[0][0]
                    while room:
                        d0, left = owners[0]
                        take = min(left, room)
                        room -= take
                        n += 1
                        if left > take:
                            owners[0] = (d0, left - take)
                        else:
                            owners.pop(0)
                    yield whole[at : at + sequence], first, n, sequence
                    at += sequence
                held, size = [whole[at:]], size - at
    if size:
        ids = np.concatenate(held)
        yield np.append(ids, np.full(sequence - size, end_id, np.uint32)), owners[0][0], len(owners), size


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str | None = None, pattern: str | None = None, sequence: int = SEQUENCE, span: int = SPAN, key: int = KEY, end_id: int = END_ID, width: int = WIDTH
) -> DataFrame:
    """Write shard files below folder (a URI all executors share); one row per sequence tells its slot and where it is."""
    path, rule = vocabulary or default_vocabulary(), pattern or default_pattern()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows + (pc.sum(pc.binary_length(b.column(1))).as_py() or 0) for b in batches)
        yield batch("part n", pa.array([TaskContext.get().partitionId()]), pa.array([-(-n // sequence)]))

    bound = {r.part: r.n for r in rows.mapInArrow(bounded, "part long, n long").collect()}  # two numbers a task
    # ends[p]: numbers given to tasks before p; 8 bytes a task, sent to each executor once
    ends = np.zeros(max(bound, default=-1) + 2, np.int64)
    ends[[p + 1 for p in bound]] = list(bound.values())
    numbers = docs.sparkSession.sparkContext.broadcast(np.cumsum(ends))
    total = int(numbers.value[-1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, last = numbers.value[part : part + 2].tolist() if part + 1 < len(numbers.value) else (0, 0)
        n, held = 0, []

        def out() -> pa.RecordBatch:
            keys = permute(np.arange(first + n - len(held), first + n), total, key)
            ids, d, docs_in, real = zip(*held)
            return batch("key shard first_doc_id n_docs n_tokens ids", pa.array(keys), pa.array(keys // span), pa.array(d, pa.int64()), pa.array(docs_in, pa.int64()), pa.array(real, pa.int64()), pa.array(ids, pa.binary()))

        for ids, *rest in _sequences(batches, encoder(path, rule), sequence, end_id):
            if int(ids.max()) >> 8 * width:
                raise ValueError(f"id {ids.max()} does not fit {width} bytes")
            held.append((ids.astype(f"<u{width}").tobytes(), *rest))
            n += 1
            if n > last - first:
                raise RuntimeError(f"task {part} has more than {last - first} sequences, its bound in the first pass")
            if len(held) == 512:
                yield out()
                held.clear()
        if held:
            yield out()

    stride = sequence * width

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pf

        fs, root = pf.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        shard, stream, name, at = None, None, "", 0

        def close() -> None:
            if stream is not None:
                stream.close()
                fs.move(name, f"{root}/{_name(shard)}")

        for b in batches:
            payload, places = b.column(5).to_pylist(), []
            for s, ids in zip(b.column(1).to_pylist(), payload):
                if s != shard:
                    close()
                    shard, at, name = s, 0, f"{root}/.writing-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(name)
                stream.write(ids)
                places.append(at)
                at += stride
            yield batch(
                "key shard byte_offset first_doc_id n_docs n_tokens ids_crc32",
                b.column(0), b.column(1), pa.array(places, pa.int64()), *b.columns[2:5],
                pa.array([zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in payload], pa.int64()),
            )
        close()

    dealt = rows.mapInArrow(placed, "key long, shard long, first_doc_id long, n_docs long, n_tokens long, ids binary")
    n_shards = max(1, -(-total // span))
    # one shard is one partition: dealt by the shard's number itself, as a hash would put several into one task
    ranged = dealt.withColumn("to", F.col("shard").cast("int")).repartitionById(n_shards, "to").sortWithinPartitions("key")
    done = cut(ranged.mapInArrow(written, _SCHEMA))
    _sweep(folder)
    # slots: shards are counted, the counts of each thousand of shards summed, so no window holds more than a thousand rows of one thousand
    sizes = done.groupBy("shard").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("shard") / 1000))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("m"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("block", before(Window.orderBy("block"), "m").alias("base"))
    starts = sizes.join(blocks, "block").select("shard", (F.col("base") + before(Window.partitionBy("block").orderBy("shard"), "n")).alias("start"))
    return done.join(starts, "shard").select((F.col("start") + F.col("byte_offset") / stride).cast("long").alias("slot"), *done.columns)


def _sweep(folder: str) -> None:
    """Remove what attempts that failed have left."""
    import pyarrow.fs as pf

    fs, root = pf.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pf.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(".writing-"):
            fs.delete_file(info.path)


def _name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(folder: str, start: int, n: int, sequence: int = SEQUENCE, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The ids of n sequences in training order from slot start: file sizes, one seek, then sequential reads."""
    import pyarrow.fs as pf

    fs, root = pf.FileSystem.from_uri(folder)
    stride, at, end = sequence * width, 0, start + n
    for info in sorted((x for x in fs.get_file_info(pf.FileSelector(root)) if x.base_name.startswith("shard-")), key=lambda x: x.base_name):
        here = info.size // stride
        low, high = max(start, at), min(end, at + here)
        if low < high:
            with fs.open_input_file(info.path) as f:
                f.seek((low - at) * stride)
                for _ in range(high - low):
                    yield np.frombuffer(f.read(stride), f"<u{width}")
        at += here


def shard_documents(docs: DataFrame) -> DataFrame:
    """write_shards into a new folder of the shared one."""
    return write_shards(docs, f"{_uri(shared_dir(docs.sparkSession))}/shards-{uuid.uuid4().hex}")


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"
