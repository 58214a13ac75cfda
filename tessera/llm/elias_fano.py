"""Monotone numbers in Elias-Fano form, in files that are mapped and read in place.

A number is split into low bits, packed side by side, and a high part, written
in unary into one bit vector: the i-th one stands at high(i) + i. A directory of
the ones before each 64-bit word gives select by one binary search and six
halvings of a word. All reads are vectorised over queries, and touch only the
words they need. An EliasFano has value(i) and successor search, over all of it
or within a range [begin, end) for each query.

A block is one file: a header and named arrays. Lexicon is a set of 64-bit keys
in blocks, each key with its rank (its id), a check, a count and perhaps a text;
it is written by Spark tasks, a block at a time, and only an index of one line a
block goes through the driver, into a block of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, runs
from tessera.session import shared_dir

U = np.uint64
#: Keys of a lexicon that go into one block.
KEYS = 1 << 20


#: Bits, pairs, nibbles and bytes of a word; one and the highest bit in each byte.
_M1, _M2, _M4, _L8, _H8 = (U(int(x * 8, 16)) for x in ("55", "33", "0F", "01", "80"))
#: The place of the k-th one of a byte, at byte * 8 + k.
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of one number k (from 0) in each word, which has more than k of them: its byte by sums of ones up to each byte, then by a table."""
    k = k.astype(U)
    ones = words - (words >> U(1) & _M1)
    ones = (ones & _M2) + (ones >> U(2) & _M2)
    ones = (ones + (ones >> U(4)) & _M4) * _L8
    at = np.bitwise_count((k * _L8 | _H8) - ones & _H8).astype(U) << U(3)
    k -= (ones << U(8)) >> at & U(255)
    return at.astype(np.int64) + _PLACES[((words >> at & U(255)) << U(3) | k).astype(np.int64)]


def encode(name: str, values: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, list[int]]]:
    """(arrays, meta) of numbers that do not decrease; at least one."""
    v = np.asarray(values, U)
    n, top = len(v), int(v[-1] - v[0])
    bits = min(56, max(0, ((top + 1) // n).bit_length() - 1))
    rel = v - v[0]
    low, at = rel & U((1 << bits) - 1), (rel >> U(bits)).astype(np.int64) + np.arange(n)
    ones = np.zeros(-(-(int(at[-1]) + 2) // 64) * 64, bool)  # a zero follows the last one
    ones[at] = True
    high = np.packbits(ones, bitorder="little").view("<u8")
    rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype("<u4")
    start = np.arange(n, dtype=np.int64) * bits
    word, shift = start >> 6, (start & 63).astype(U)
    packed = np.zeros(n * bits // 64 + 2, "<u8")
    if bits:
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        packed[word[first]] = np.bitwise_or.reduceat(low << shift, first)
        over = np.flatnonzero((start & 63) + bits > 64)  # one a word at most
        packed[word[over] + 1] |= low[over] >> (U(64) - shift[over])
    return {f"{name}.low": packed, f"{name}.high": high, f"{name}.rank": rank}, {name: [n, int(v[0]), int(v[-1]), bits]}


class EliasFano:
    """Reads what encode() has written, from the arrays of a block."""

    def __init__(self, b: Block, name: str):
        self.n, self.first, self.last, self.bits = b.meta[name]
        self.low, self.high, self.rank = (b[f"{name}.{x}"] for x in ("low", "high", "rank"))

    def _ones(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.rank, i, "right") - 1
        return word * 64 + _select(self.high[word], i - self.rank[word])

    def _zeros(self, k: np.ndarray) -> np.ndarray:
        before = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank
        word = np.searchsorted(before, k, "right") - 1
        return word * 64 + _select(~self.high[word], k - before[word])

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[begin, end) of the places with high part h: the ones after the zero before them, which most often end within 64 bits."""
        zero = np.where(h > 0, self._zeros(np.maximum(h - 1, 0)), -1)
        at = zero + 1
        word, shift = at >> 6, (at & 63).astype(U)
        after = np.minimum(word + 1, len(self.high) - 1)
        window = self.high[word] >> shift | np.where(word < len(self.high) - 1, (self.high[after] << U(1)) << (U(63) - shift), U(0))
        n = np.bitwise_count(window & ~(window + U(1))).astype(np.int64)  # ones before the first zero
        begin = zero - h + 1
        end = begin + n
        far = np.flatnonzero(n == 64)
        end[far] = self._zeros(h[far]) - h[far]
        return begin, end

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        return (self.low[word] >> shift | (self.low[word + 1] << U(1)) << (U(63) - shift)) & U((1 << self.bits) - 1)

    def value(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        return ((self._ones(i) - i).astype(U) << U(self.bits) | self._low(i)) + U(self.first)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at places i and i + 1, which must be there too: the next one bit most often follows in the same word."""
        i = np.asarray(i, np.int64)
        at = self._ones(i)
        rest = self.high[at >> 6] >> (at & 63).astype(U) >> U(1)
        then = at + 1 + np.bitwise_count(~rest & (rest - U(1)))
        far = np.flatnonzero(rest == 0)
        then[far] = self._ones(i[far] + 1)
        return tuple(((one - j).astype(U) << U(self.bits) | self._low(j)) + U(self.first) for one, j in ((at, i), (then, i + 1)))

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first place in [begin, end) whose number is x or more, or end; whether it is x)."""
        x = np.asarray(x, U)
        begin = np.zeros(len(x), np.int64) if begin is None else begin
        end = np.full(len(x), self.n, np.int64) if end is None else end
        inside = (x >= U(self.first)) & (x <= U(self.last))
        rel = np.where(inside, x - U(self.first), U(0))
        h, want = (rel >> U(self.bits)).astype(np.int64), rel & U((1 << self.bits) - 1)
        low, high = self._bucket(h)  # places with the same high part
        low = np.maximum(begin, low)
        high = np.maximum(np.minimum(end, high), low)
        stop, todo = high, np.flatnonzero(low < high)
        lo, hi, find = low[todo], high[todo], want[todo]
        while len(todo):
            mid = (lo + hi) >> 1
            less = self._low(mid) < find
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            more = lo < hi
            if not more.all():
                low[todo] = lo
                todo, lo, hi, find = todo[more], lo[more], hi[more], find[more]
        there = inside & (low < stop)
        there[there] = self._low(low[there]) == want[there]
        return np.where(inside, np.minimum(low, end), np.where(x < U(self.first), begin, end)), there


class Block:
    """Named arrays of one file."""

    def __init__(self, data: np.ndarray):
        size = int(data[:8].view("<u8")[0])
        head = json.loads(bytes(data[8 : 8 + size]))
        self.meta, self._places, self._data = head["meta"], head["arrays"], data

    def __getitem__(self, name: str) -> np.ndarray:
        kind, start, n = self._places[name]
        return self._data[start : start + n].view(kind)


def block_bytes(arrays: dict[str, np.ndarray], meta: dict) -> bytes:
    """A block's file."""
    arrays = {k: np.ascontiguousarray(a) for k, a in arrays.items()}
    places, at = {}, 0
    for k, a in arrays.items():
        places[k] = (a.dtype.str, at, a.nbytes)
        at += -(-a.nbytes // 8) * 8
    size = 0  # the header says where arrays are, so its own length counts
    while True:
        head = json.dumps({"meta": meta, "arrays": {k: (kind, start + 8 + size, n) for k, (kind, start, n) in places.items()}}).encode()
        fill = -len(head) % 8
        if len(head) + fill <= size:
            break
        size = len(head) + fill
    head += b" " * (size - len(head))
    return np.array([size], "<u8").tobytes() + head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays.values())


def write_block(folder: str, name: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """Write under a name of this attempt, then rename: a repeated task leaves one whole file."""
    import pyarrow.fs as pf

    fs, root = pf.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.writing-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(block_bytes(arrays, meta))
    fs.move(own, f"{root}/{name}")


@lru_cache(maxsize=256)
def open_block(folder: str, name: str) -> Block:
    """A block, mapped if its folder is on a mounted file system, else read; the latest 256 of a worker stay open."""
    import pyarrow.fs as pf

    fs, root = pf.FileSystem.from_uri(folder)
    if fs.type_name == "local":
        return Block(np.memmap(f"{root}/{name}", np.uint8, "r").view(np.ndarray))
    with fs.open_input_file(f"{root}/{name}") as f:
        return Block(np.frombuffer(f.read(), np.uint8))


def new_folder(df: DataFrame, kind: str) -> str:
    """A URI of a new folder below the shared one."""
    base = shared_dir(df.sparkSession)
    return f"{base if ':/' in base else f'file://{base}'}/{kind}-{uuid.uuid4().hex}"


def remove_folder(folder: str) -> None:
    import pyarrow.fs as pf

    fs, root = pf.FileSystem.from_uri(folder)
    if fs.get_file_info(root).type != pf.FileType.NotFound:
        fs.delete_dir(root)


def n_shards(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sorted_order(u: np.ndarray) -> np.ndarray:
    """Unsigned keys as signed longs of the same order."""
    return (u ^ U(1 << 63)).view(np.int64)


def shard_of(u: np.ndarray, n: int) -> np.ndarray:
    """The shard of evenly spread keys; shards are ranges of keys."""
    return ((u >> U(32)) * U(n) >> U(32)).astype(np.int32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of 64-bit numbers that spreads them evenly."""
    x = np.asarray(x, U)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> U(shift)) * U(by)
    return x ^ x >> U(31)


def digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of byte strings, 64 bits each; together they stand for the string."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), ">u8").astype(U).reshape(-1, 2)
    return both[:, 0], both[:, 1]


@dataclass(frozen=True)
class Lexicon:
    """Keys in blocks; ids are ranks of keys, counted over all blocks."""

    folder: str
    size: int  # keys
    total: int  # sum of counts

    @classmethod
    def build(cls, keys: DataFrame, folder: str, block_keys: int = KEYS) -> Lexicon:
        """From (u: a key as of sorted_order, check, n[, text]), each (u, check) once."""
        parts = n_shards(keys)
        has_text = "text" in keys.columns

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                u = b.column(0).to_numpy().view(U) ^ U(1 << 63)
                yield batch("part u check n" + " text" * has_text, pa.array(shard_of(u, parts)), *b.columns)

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            part, k = -1, 0

            def out(rows: pa.RecordBatch) -> pa.RecordBatch:
                u, n = rows.column(1).to_numpy().view(U) ^ U(1 << 63), rows.column(3).to_numpy()
                arrays, meta = encode("u", u)
                arrays |= {"check": rows.column(2).to_numpy(), "n": n, "before": np.cumsum(n) - n}
                if has_text:
                    text = rows.column(4).cast(pa.large_binary())
                    data = text.to_pylist()
                    arrays |= {"text": np.frombuffer(b"".join(data), np.uint8), "at": np.cumsum([0, *map(len, data)])}
                write_block(folder, f"keys-{part:06d}-{k:06d}", arrays, meta)
                return batch("part k u rows total", *(pa.array([x]) for x in (part, k, int(u[0]) - (1 << 63), len(u), int(n.sum()))))

            def pending() -> pa.RecordBatch:
                return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

            for b in batches:
                for x, y in runs([b.column(0).to_numpy()]):
                    piece = b.slice(x, y - x)
                    if held and piece.column(0)[0].as_py() != part:
                        yield out(pending())
                        held.clear()
                    if piece.column(0)[0].as_py() != part:
                        part, k = piece.column(0)[0].as_py(), 0
                    held.append(piece)
                    if sum(h.num_rows for h in held) >= block_keys:
                        rows = pending()
                        u = rows.column(1).to_numpy()
                        cut = int(np.searchsorted(u, u[-1]))  # keys alike stay in one block
                        if cut:
                            yield out(rows.slice(0, cut))
                            k += 1
                            held[:] = [rows.slice(cut)]
            if held:
                yield out(pending())

        kinds = "u long, check long, n long" + ", text binary" * has_text
        rows = keys.select("u", "check", F.col("n").cast("long").alias("n"), *["text"] * has_text)
        by_part = rows.mapInArrow(dealt, "part int, " + kinds).repartitionById(parts, "part").sortWithinPartitions("part", "u", "check")
        index = sorted(by_part.mapInArrow(written, "part long, k long, u long, rows long, total long").collect())  # one row a block
        lines = np.array(index, np.int64).reshape(-1, 5)
        write_block(
            folder, "keys", {"part": lines[:, 0], "k": lines[:, 1], "u": lines[:, 2], "id": np.cumsum(lines[:, 3]) - lines[:, 3], "before": np.cumsum(lines[:, 4]) - lines[:, 4]}, {}
        )
        return cls(folder, int(lines[:, 3].sum()), int(lines[:, 4].sum()))

    def _by_block(self, at: np.ndarray) -> Iterator[tuple[int, Block, np.ndarray]]:
        """(number, block, places of the queries) for each block that has queries; at: block of each query."""
        index = open_block(self.folder, "keys")
        order = np.argsort(at, kind="stable")
        for x, y in runs([at[order]]):
            i = int(at[order[x]])
            yield i, open_block(self.folder, f"keys-{index['part'][i]:06d}-{index['k'][i]:06d}"), order[x:y]

    def ids(self, u: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
        """The id of each key, -1 if it is none."""
        out = np.full(len(u), -1, np.int64)
        if not self.size:
            return out
        index = open_block(self.folder, "keys")
        at = np.searchsorted(index["u"], sorted_order(u), "right") - 1
        for i, b, q in self._by_block(at):
            if i < 0:
                continue
            keys = EliasFano(b, "u")
            place, there = keys.successor(u[q])
            q, place = q[there], place[there]
            while len(q):  # one turn, unless different strings have the same key
                same = np.ones(len(q), bool) if check is None else b["check"].view(U)[place] == check[q]
                out[q[same]] = place[same] + index["id"][i]
                q, place = q[~same], place[~same] + 1
                more = place < keys.n
                more[more] = keys.value(place[more]) == u[q[more]]
                q, place = q[more], place[more]
        return out

    def gather(self, ids: np.ndarray, read: Callable[[Block, np.ndarray, int], np.ndarray], kind: object) -> np.ndarray:
        """read(block, places, counts before the block) for each id, in the order of ids."""
        out = np.empty(len(ids), kind)
        if len(ids):
            index = open_block(self.folder, "keys")
            for i, b, q in self._by_block(np.searchsorted(index["id"], ids, "right") - 1):
                out[q] = read(b, ids[q] - index["id"][i], int(index["before"][i]))
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.gather(ids, lambda b, at, _: b["n"][at], np.int64)

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Counts of all smaller ids together."""
        return self.gather(ids, lambda b, at, base: b["before"][at] + base, np.int64)

    def texts(self, ids: np.ndarray) -> np.ndarray:
        def read(b: Block, at: np.ndarray, _: int) -> np.ndarray:
            data, ends = b["text"], b["at"]
            out = np.empty(len(at), object)
            out[:] = [data[x:y].tobytes() for x, y in zip(ends[at].tolist(), ends[at + 1].tolist())]
            return out

        return self.gather(ids, read, object)
