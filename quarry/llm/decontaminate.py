"""Benchmark decontamination: exact n-word windows of test items looked up in training texts.

The windows of the test items are hashed into one table that is broadcast; every window of every
document is hashed with the same rolling kernel, looked up, and each hit is verified word by word.

Size bound of the broadcast: at most ``block_bytes`` of item text at a time (twice that where a hash
deals unevenly, one item at least).  The table is flat arrays: the folded text, 8 bytes a word for its place, 22 to
24 bytes a distinct window and 4 for each item that has it, so some 6 bytes for each byte of usual
text, 16 at worst (words of one letter).  A larger benchmark is cut into that many blocks by a hash of
the item; each block makes one pass over the documents, and the state of a document (hit words,
items) is carried in a table in the shared folder.

Defined cases: a null or empty text has no words and is never hit; a text of any length is scanned
whole; an item without words is ignored; an item of fewer than n words is one window of its own
length; windows that several items have name them all; repeated items count once by id; a null item
id is reported as ``null``; repeated documents are each judged; an empty table, or a benchmark
without items, gives what there is without hits; extra columns pass through ``decontaminate`` in a
struct, whatever their names, and are ignored by ``contamination``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Bytes of item text that one broadcast table is made of.
BLOCK = 16 << 20


def _folded(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(32)


def _equal(one: np.ndarray, a: np.ndarray, b: np.ndarray, two: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the bytes a to b of ``one`` are the bytes c to d of ``two``, for each of many ranges."""
    size = b - a
    out = size == d - c
    some = np.flatnonzero(out & (size > 0))
    if len(some):
        n = size[some]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1]))
        differ = one[step + np.repeat(a[some] - (ends - n), n)] != two[step + np.repeat(c[some] - (ends - n), n)]
        out[some] = ~np.logical_or.reduceat(differ, ends - n)
    return out


class Windows:
    """Distinct windows of one length: sorted hashes, a place of each, and the items that have it."""

    def __init__(self, size: int, h: np.ndarray, place: np.ndarray, item: np.ndarray, words_equal):
        self.size = size
        order = np.lexsort((place, h))
        h, place, item = h[order], place[order], item[order]
        begins = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(begins)
        of = np.cumsum(begins) - 1
        alien = np.flatnonzero(~words_equal(place, place[first[of]], size))
        if len(alien):  # another window of the same hash: told apart by its words
            known: dict[int, list[tuple[int, int]]] = {}
            extra = len(first)
            for k in alien.tolist():
                same = [g for p, g in known.setdefault(int(of[k]), []) if words_equal(place[k : k + 1], np.array([p]), size)[0]]
                if not same:
                    known[int(of[k])].append((int(place[k]), extra))
                    same, extra = [extra], extra + 1
                of[k] = same[0]
            order = np.lexsort((place, of, h))
            h, place, item, of = h[order], place[order], item[order], of[order]
            begins = np.concatenate([[True], of[1:] != of[:-1]])
            first, of = np.flatnonzero(begins), np.cumsum(begins) - 1
        self.hash, self.place = h[first], place[first].astype(np.int32)
        order = np.lexsort((item, of))
        of, item = of[order], item[order]
        keep = np.concatenate([[True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])])
        self.items = item[keep].astype(np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(first)))]).astype(np.int32)
        self.bits = max(16, int(8 * len(first) - 1).bit_length())
        flags = np.zeros(1 << self.bits, bool)
        flags[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.flags = np.packbits(flags, bitorder="little")

    def among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``h``, window) of all equal hashes."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        maybe = np.flatnonzero((self.flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        low, high = np.searchsorted(self.hash, h[maybe]), np.searchsorted(self.hash, h[maybe], side="right")
        n = high - low
        ends = np.cumsum(n)
        return np.repeat(maybe, n), np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - n), n)


class WindowTable:
    """Lookup of item windows, by window length."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.names = [name for name, _ in items]
        w = kernels.words(pa.array([text for _, text in items], pa.large_string()), kernels.ALNUM_WORDS)
        self.data, self.start, self.end = _folded(w.data), w.start.astype(np.int32), w.end.astype(np.int32)
        hashes, counts = kernels.word_hashes(w), np.diff(w.first)
        sizes = np.minimum(counts, n)
        self.windows = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            some = np.flatnonzero(sizes == size)
            many = counts[some] - size + 1
            ends = np.cumsum(many)
            place = np.arange(int(ends[-1])) + np.repeat(w.first[some] - (ends - many), many)
            self.windows.append(Windows(size, kernels.window_hashes(hashes, size)[place], place, np.repeat(some, many), self._same))

    def _same(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows at words a and b of the items have the same words."""
        out = np.ones(len(a), bool)
        differ = np.flatnonzero(a != b)
        for k in range(size):
            x, y = a[differ] + k, b[differ] + k
            out[differ] &= _equal(self.data, self.start[x].astype(np.int64), self.end[x], self.data, self.start[y].astype(np.int64), self.end[y])
        return out

    @property
    def nbytes(self) -> int:
        own = [self.data, self.start, self.end]
        return sum(x.nbytes for x in own) + sum(x.nbytes for t in self.windows for x in (t.hash, t.place, t.items, t.offsets, t.flags))

    def hits(self, w: kernels.Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each document that is hit: word ranges (its own numbering) and the items."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        hashes, data = kernels.word_hashes(w), None
        for table in self.windows:
            at, which = table.among(kernels.window_hashes(hashes, table.size))
            doc = np.searchsorted(w.first, at, side="right") - 1
            inside = at + table.size <= w.first[doc + 1]
            at, which, doc = at[inside], which[inside], doc[inside]
            if not len(at):
                continue
            data = _folded(w.data) if data is None else data
            good = np.ones(len(at), bool)
            for k in range(table.size):
                x, y = at + k, table.place[which] + k
                good &= _equal(data, w.start[x], w.end[x], self.data, self.start[y].astype(np.int64), self.end[y])
            for a, d, k in zip(at[good].tolist(), doc[good].tolist(), which[good].tolist()):
                ranges, names = out.setdefault(d, ([], set()))
                ranges.append((a - int(w.first[d]), a - int(w.first[d]) + table.size))
                names.update(self.names[i] for i in table.items[table.offsets[k] : table.offsets[k + 1]].tolist())
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, n: int, block_bytes: int):
    """Window tables one after the other, none built from much more than ``block_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    while count > 1:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
        if items.groupBy(block.alias("b")).agg(F.sum(F.octet_length("text").cast("long")).alias("s"), F.count("*").alias("n")).where(f"s > {2 * block_bytes} and n > 1").isEmpty():
            break
        count *= 2
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield spark.sparkContext.broadcast(WindowTable([(r.item, r.text) for r in part.collect()], n)), k == count - 1


def _scan(frame: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, finish, schema: str) -> DataFrame:
    """Pass over ``frame`` (row, text) once a block; ``finish`` turns batch and hits into the result."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    state = f"{columns}, ranges array<array<bigint>>, items array<string>"

    for table, last in _blocks(benchmark, n, block_bytes):
        carried = "ranges" in frame.columns

        def run(batch, table=table, last=last, carried=carried):
            w = kernels.words(batch.column("text"), kernels.ALNUM_WORDS)
            hits = table.value.hits(w)
            if carried:
                for k, (ranges, items) in enumerate(zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist())):
                    if ranges:
                        own = hits.setdefault(k, ([], set()))
                        own[0].extend(map(tuple, ranges))
                        own[1].update(items)
            hits = {k: (merged(r), i) for k, (r, i) in hits.items()}
            if last:
                yield finish(batch, w, hits)
            else:
                rows = range(batch.num_rows)
                ranges = pa.array([[list(x) for x in hits[k][0]] if k in hits else [] for k in rows], pa.list_(pa.list_(pa.int64())))
                items = pa.array([sorted(hits[k][1]) if k in hits else [] for k in rows], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), ranges, items], ["row", "text", "ranges", "items"])

        frame = common.map_arrow(frame, run, schema if last else state)
        if not last:
            frame = common.materialize(frame, "decontaminate")
    return frame


REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<array<bigint>>"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK) -> DataFrame:
    """Report per document: words, hit words, items, and the hit word ranges (``spans``, end exclusive)."""
    nothing = hashlib.sha256(b"").hexdigest()

    def finish(batch, w, hits):
        rows = range(batch.num_rows)
        none: tuple[list, set] = ([], set())
        each = [hits.get(k, none) for k in rows]
        counts = np.diff(w.first)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row").cast(pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([sum(b - a for a, b in r) for r, _ in each], pa.int64()),
                pa.array([len(i) for _, i in each], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() if i else nothing for _, i in each]),
                pa.array([bool(r) for r, _ in each]),
                pa.array([sorted(i) for _, i in each], pa.list_(pa.string())),
                pa.array([[list(x) for x in r] for r, _ in each], pa.list_(pa.list_(pa.int64()))),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )

    return _scan(docs.select(F.col("doc_id").cast("long").alias("row"), "text"), benchmark, n, block_bytes, finish, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", block_bytes: int = BLOCK) -> DataFrame:
    """``docs`` without the hit documents, or (``remove="spans"``) without the hit passages.

    A span is cut from the first byte of its first word to the first byte of the word after it; the
    other bytes of the text stay as they are.  All columns and types are those of ``docs``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")

    others = [c for c in docs.columns if c != "text"]
    frame = docs.select((F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)).alias("row"), "text")

    def finish(batch, w, hits):
        if remove == "documents":
            return batch.select(["row", "text"]).filter(pa.array([k not in hits for k in range(batch.num_rows)], pa.bool_()))
        texts = batch.column("text").to_pylist()
        for k, (ranges, _) in hits.items():
            start, out, at = w.start[w.first[k] : w.first[k + 1]], [], int(w.texts[k])
            for a, b in ranges:
                out.append(w.data[at : start[a]].tobytes())
                at = int(start[b]) if b < len(start) else int(w.end[w.first[k] + b - 1])
            out.append(w.data[at : w.texts[k + 1]].tobytes())
            texts[k] = b"".join(out).decode()
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.column("text").type)], ["row", "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    out = _scan(frame, benchmark, n, block_bytes, finish, schema)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
