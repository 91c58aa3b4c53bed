"""Token-ID files: one zstandard frame a document, a document index and a trailing seek table.

File format (all integers little-endian):

    frame*          independent zstandard frames; each holds at most FRAME_IDS ids as unsigned 32-bit
                    integers; a document has one frame, a longer one several in a row
    index           skippable frame 0x184D2A50: document count (u64), then for each document its id
                    (i64), number of ids (u64), number of frames (u32) and whether it has an id (u8;
                    if not, the id reads -2**63), as four packed columns
    seek table      skippable frame 0x184D2A5E of the public seekable zstandard format: for each frame
                    compressed size, plain size, checksum (u32 each); footer: number of frames (u32),
                    descriptor byte 0x80 (checksums present), magic 0x8F92EAB1

The checksum is the low half of xxh64 of the plain bytes, as the public format says.  A reader takes
the footer, the seek table and the index, and then only the frames of the documents it wants.

Documents are range-partitioned by id, so file k holds smaller ids than file k + 1; a task writes a
temporary file and renames it, so a repeated task leaves the same bytes.

Tokenising: the pre-tokeniser begins a new piece at a blank unless white space stands on both sides
of it, and takes a line break between two other characters as a piece.  So the ids of a text are those
of its units, cut before such blanks and around such breaks, and each distinct unit of a batch is
encoded once.  Texts with a blank inside white space are encoded whole, and so are texts with an added
token of the tokenizer file (as ``<|endoftext|>``), which gets its own id as a plainly loaded tokenizer
gives it.

Defined cases: null text counts as empty and gives the end id alone; documents without an id come
first; repeated ids are kept, in the order of their texts; no documents give no files.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

FRAME_IDS = 1 << 22
INDEX, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 2
NO_ID = -(1 << 63)
#: Units whose ids a worker keeps between batches; a bound of memory, results don't depend on it.
KNOWN, SLOTS = 700_000, 21
#: Units a call of the tokenizer takes as one text.
JOINED = 200

#: Stands for a line break while a text is cut into units.
BREAK = "\x00"
#: White-space characters beyond ASCII's 0x09-0x0D, 0x1C-0x1F and 0x20.
WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[c.encode()[0] for c in WIDE]] = True
_WIDE = {c.encode() for c in WIDE}


def white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes that begin, and of those that end, a white-space character."""
    begin = _ASCII[data]
    end = begin
    maybe = np.flatnonzero(_LEADS[data])
    if len(maybe):
        size = np.where(data[maybe] == 0xC2, 2, 3)
        maybe, size = maybe[maybe + size <= len(data)], size[maybe + size <= len(data)]
        found = np.array([data[k : k + n].tobytes() in _WIDE for k, n in zip(maybe.tolist(), size.tolist())], bool)
        if found.any():
            end = begin.copy()
            begin[maybe[found]] = True
            end[maybe[found] + size[found] - 1] = True
    return begin, end


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts with `` BREAK `` for each line break between two other characters, and the rows to encode whole.

    Those have a blank with white space on both sides, or at the end after white space: there a piece
    may hold the blank.
    """
    data, offsets = kernels.buffers(column)
    if not len(data):
        return _strings(data, offsets), np.zeros(len(column), bool)
    begin, end = white(data)
    full = np.flatnonzero(np.diff(offsets))
    before, after = np.zeros(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = end[:-1], begin[1:]
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = True
    bad = np.flatnonzero(((data == 0x20) & before & after) | (data == 0))
    odd = np.zeros(len(column), bool)
    odd[np.searchsorted(offsets, bad, side="right") - 1] = True
    breaks = np.flatnonzero((data == 0x0A) & ~before & ~after)
    if len(breaks):
        data = data.copy()
        data[breaks] = 0
        data = np.insert(data, np.concatenate([breaks, breaks + 1]), 0x20)
        offsets = offsets + 2 * np.searchsorted(breaks, offsets)
    return _strings(data, offsets), odd


class Encoder:
    """Batch encoder of a byte-level BPE file of the tokenizers library.

    With ``added``, the file's added tokens get their own ids where a text has them; else they are spelled out.
    """

    def __init__(self, path: str, added: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.stop = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known, self.slots = pa.array([], pa.large_string()), np.full(1 << SLOTS, -1, np.int32)
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        return flat, sizes

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids``, with the ids of added tokens."""
        self.tokenizer.encode_special_tokens = not self.added
        try:
            return self._ids(texts)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_ids`` for units without white space but a blank in front: whole lists, a line break between two.

        Such a break is a piece of its own, so its id marks the borders.
        """
        lists = [units[k : k + JOINED] for k in range(0, len(units), JOINED)]
        flat, sizes = self._ids(["\n".join(x) for x in lists])
        flat = np.insert(flat, np.cumsum(sizes), self.stop[0])
        cut = np.flatnonzero(flat == self.stop[0])
        if len(cut) != len(units):
            raise AssertionError("a unit has a line break")
        return np.delete(flat, cut), np.diff(cut, prepend=-1) - 1

    def _units(self, units: pa.Array, unit_hashes: np.ndarray, codes: np.ndarray, simple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes into (ids, sizes) that hold the units of this batch; the first KNOWN units stay for later batches.

        A unit is looked for in one slot, by hash, and compared; one that lost its slot is encoded again.
        """
        slot = (unit_hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        at = self.slots[slot].astype(np.int64)
        maybe = np.flatnonzero(at >= 0)
        same = pc.equal(self.known.take(pa.array(at[maybe])), units.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        at[maybe[~same]] = -1
        new = np.flatnonzero(at < 0)
        plain = simple[new] if len(self.stop) == 1 else np.zeros(len(new), bool)
        new = np.concatenate([new[plain], new[~plain]])
        at[new] = len(self.sizes) + np.arange(len(new))
        added = units.take(pa.array(new))
        fresh = added.to_pylist()
        border = int(plain.sum())
        one, two = self._joined(fresh[:border]), self._ids(fresh[border:])
        flat, sizes = np.concatenate([self.flat, one[0], two[0]]), np.concatenate([self.sizes, one[1], two[1]])
        if len(sizes) <= KNOWN:
            self.slots[slot[new]] = np.arange(len(self.sizes), len(sizes))
            self.known = pa.concat_arrays([self.known, added])
            self.flat, self.sizes = flat, sizes
        return at[codes], flat, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order, and the number of ids of each row."""
        texts, mask = cut(column)
        for token in self.added:
            mask |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~mask)) if mask.any() else texts
        split = pc.split_pattern(plain, " ")
        words, bounds = split.values, split.offsets.to_numpy()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = len(coded.dictionary)
        # A unit has its blank in front, but for the first of a text and those around a line break.
        stop = pc.index(coded.dictionary, pa.scalar(BREAK, pa.large_string())).as_py()
        breaks = np.flatnonzero(codes == stop)
        bare = np.zeros(len(words) + 1, bool)
        bare[bounds[:-1]] = True
        bare[breaks] = bare[breaks + 1] = True
        first = np.flatnonzero(bare[:-1])
        opening, where = np.unique(codes[first], return_inverse=True)
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary, pa.scalar(" ", pa.large_string()))
        units = pa.concat_arrays([led, pc.replace_substring(coded.dictionary.take(pa.array(opening)), BREAK, "\n")])
        codes[first] = known + where
        data, ends = kernels.buffers(units)
        inner = np.concatenate([[0], np.cumsum(white(data)[0])])
        blank = np.zeros(len(units), np.int64)
        blank[:known] = 1
        simple = (inner[ends[1:]] - inner[ends[:-1]] == blank) & (np.diff(ends) > blank)
        hashes = kernels.word_hashes(kernels.Words(data, ends, ends[:-1], ends[1:], ends), fold=False)
        codes, flat, sizes = self._units(units, hashes, codes, simple)
        starts = np.cumsum(sizes) - sizes
        per_unit = sizes[codes]
        out = flat[_ranges(starts[codes], per_unit)]
        total = np.concatenate([[0], np.cumsum(per_unit)])
        counts = total[bounds[1:]] - total[bounds[:-1]]
        if not mask.any():
            return out, counts
        whole, whole_counts = self._whole(column.cast(pa.large_string()).fill_null("").filter(pa.array(mask)).to_pylist())
        total = np.empty(len(column), np.int64)
        total[~mask], total[mask] = counts, whole_counts
        source = np.empty(len(column), np.int64)
        source[~mask] = np.cumsum(counts) - counts
        source[mask] = len(out) + np.cumsum(whole_counts) - whole_counts
        return np.concatenate([out, whole])[_ranges(source, total)], total


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    kind = np.int32 if total + int(starts.max(initial=0)) < 2**31 else np.int64
    out = np.repeat((starts - at).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


class Writer:
    """Streams documents into one file; the index and seek table follow at ``close``."""

    def __init__(self, out, level: int = 1):
        self.out, self.coder = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames, self.docs = io.BytesIO(), []
        self.n_frames = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        pieces = max(1, -(-len(ids) // FRAME_IDS))
        for k in range(pieces):
            plain = ids[k * FRAME_IDS : (k + 1) * FRAME_IDS].astype("<u4").tobytes()
            packed = self.coder.compress(plain)
            self.out.write(packed)
            self.frames.write(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.docs.append((doc_id, len(ids), pieces))
        self.n_frames += pieces
        self.n_ids += len(ids)

    def close(self) -> None:
        ids, sizes, pieces = zip(*self.docs) if self.docs else ((), (), ())
        numbers = np.array([NO_ID if k is None else k for k in ids], "<i8")
        given = np.array([k is not None for k in ids], "u1")
        body = struct.pack("<Q", len(ids)) + numbers.tobytes() + np.array(sizes, "<u8").tobytes() + np.array(pieces, "<u4").tobytes() + given.tobytes()
        self.out.write(struct.pack("<II", INDEX, len(body)) + body)
        table = self.frames.getvalue() + struct.pack("<IBI", self.n_frames, 0x80, FOOTER)
        self.out.write(struct.pack("<II", SEEK, len(table)) + table)


class Reader:
    """Random access to the documents of one file (any seekable binary file object)."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER or flags != 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(end - 9 - 12 * count - 8)
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SEEK or size != 12 * count + 9:
            raise ValueError("broken seek table")
        self.frames = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0].astype(np.int64))])
        source.seek(int(self.offsets[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        if magic != INDEX:
            raise ValueError("no document index")
        body = source.read(size)
        n = struct.unpack_from("<Q", body)[0]
        self.doc_ids = np.frombuffer(body, "<i8", n, 8)
        self.n_ids = np.frombuffer(body, "<u8", n, 8 + 8 * n).astype(np.int64)
        pieces = np.frombuffer(body, "<u4", n, 8 + 16 * n).astype(np.int64)
        self.has_id = np.frombuffer(body, "u1", n, 8 + 20 * n).astype(bool)
        self.first = np.concatenate([[0], np.cumsum(pieces)])
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, plain, check = (int(x) for x in self.frames[k])
        self.source.seek(int(self.offsets[k]))
        out = self.coder.decompress(self.source.read(packed), max_output_size=plain) if plain else b""
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return np.frombuffer(b"".join(self.frame(f) for f in range(self.first[k], self.first[k + 1])), "<u4")

    def find(self, doc_id: int) -> Iterator[np.ndarray]:
        """Ids of every document with this id; only its frames are read."""
        a, b = np.searchsorted(self.doc_ids, doc_id), np.searchsorted(self.doc_ids, doc_id, side="right")
        yield from (self.document(k) for k in range(a, b) if self.has_id[k])


MANIFEST = "part int, path string, n_docs bigint, n_ids bigint, bytes bigint, first_id bigint, last_id bigint"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Tokenise ``docs`` and write the files; returns the manifest, one row a file, as a table."""
    spark = docs.sparkSession
    folder = common.run_location(spark, folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        out = writer = None
        fs, base = common.shared_fs(folder)
        own = f"{base}/.part-{part:06d}-{context.taskAttemptId()}"
        last = np.array([end_id], np.uint32)
        for batch in batches:
            for piece in common.slices(batch, 4 << 20):
                if writer is None:
                    out = fs.open_output_stream(own)
                    writer = Writer(out)
                flat, counts = encoder(tokenizer).encode(piece.column("text"))
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    writer.add(doc_id, np.concatenate([flat[a:b], last]))
                del flat, counts, ends
                common.give_back()
        if writer is None:
            return
        writer.close()
        size = out.tell()
        out.close()
        path = f"part-{part:06d}.ids.zst"
        fs.move(own, f"{base}/{path}")
        row = (part, path, len(writer.docs), writer.n_ids, size, writer.docs[0][0], writer.docs[-1][0])
        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]]), *(pa.array([x], pa.int64()) for x in row[2:])], ["part", "path", "n_docs", "n_ids", "bytes", "first_id", "last_id"])

    manifest = rows.mapInArrow(common.trimmed(run), MANIFEST)
    with common.frugal(spark):
        manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_index(spark, folder: str, buckets: int | None = None) -> DataFrame:
    """Reads every file back, checks every frame, and returns per document: doc_id, start, n_tokens, ids_crc32."""
    folder = common.run_location(spark, folder, make=False)
    files = [(r.path, r.n_ids) for r in spark.read.parquet(f"{folder}/manifest").orderBy("part").select("path", "n_ids").collect()]
    bases = np.concatenate([[0], np.cumsum([n for _, n in files])]).astype(int).tolist()
    if not files:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    listed = spark.createDataFrame([(p, b) for (p, _), b in zip(files, bases)], "path string, base bigint").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.shared_fs(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{path}") as source:
                    reader = Reader(source)
                    for a in range(0, len(reader.doc_ids), 4096):
                        some = range(a, min(a + 4096, len(reader.doc_ids)))
                        sizes, crcs = [], []
                        for k in some:
                            ids = reader.document(k)
                            sizes.append(len(ids))
                            crcs.append(zlib.crc32(ids.tobytes()))
                        sizes = np.array(sizes, np.int64)
                        start = base + np.cumsum(sizes) - sizes
                        base += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[some.start : some.stop], mask=~reader.has_id[some.start : some.stop]), pa.array(start), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(common.trimmed(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
