"""Line deduplication with an edit bound, by a deletion-neighbourhood join.

A line is its sequence of words; lines without words are left alone.  An occurrence is dropped if an
earlier occurrence (by doc_id, then line number) has the same words, or if it is within one edit
(insertion, deletion or substitution) of a different line that first occurs earlier.  The earliest line
of each kind stays.

Units of an edit.  Lines of ``words`` words or more (5) are compared by words.  A shorter line is
compared by characters (code points of its words, one blank between two), where one changed word would
be too much of it; the two kinds don't meet.  A line of fewer than ``chars`` characters (5) has no
edit to spare and is dropped as an exact copy only, so the bound is one unit in five everywhere.

Neighbourhood.  A line of k units has k + 1 variants within the bound: itself and k deletions.  Equal
deletions at the same place mean a substitution; a deletion equal to a whole line means an insertion.
So a variant hash with the place of the deletion decides the case, and for each variant only its
earliest line matters: an aggregate, no pairs.

Half keys.  One edit leaves the first or the second half of the shorter line intact.  A line that
shares no half with another different line has no partner, and its variants need not be made.  The
lines that do are marked in a bitmap of fixed size, which lets some more through; results don't
depend on it.

Each (line, earlier line) found is verified on its units.  Defined cases: null text has no lines; a
text or line of any length is taken whole; a null doc_id sorts last; rows that repeat id and text are
one document (their lines don't drop each other); of lines that first occur at the same place under
equal ids the one of the smaller hash is earlier; empty tables give empty results; extra columns are
ignored, and pass through ``dedupe`` in a struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

U = np.uint64
MIN_WORDS, MIN_CHARS = 5, 5
SHARE = 64 << 20  # bytes of keys that a task of the join holds, about
BITMAP = 25
SALTS = 16
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
LAST = (1 << 63) - 1


class Units:
    """Sequences of hashed units: offsets of the sequences, and the id of the line that each stands for."""

    def __init__(self, h: np.ndarray, first: np.ndarray, ids: np.ndarray | None, least: int, seed: int):
        self.first, self.size, self.least, self.seed = first, np.diff(first), least, U(seed)
        n = len(h)
        steps = np.full(n + 1, _STEP & (2**64 - 1), U)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps = np.full(n + 1, _BACK, U)
        steps[0] = 1
        self.down = np.multiply.accumulate(steps)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:n])])
        self.id = self.span(first[:-1], first[1:]).view(np.int64) if ids is None else ids

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the units a to b (end exclusive), wherever they stand."""
        return kernels.mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(U) + self.seed)

    def halves(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(half key, line id) for lines that may have partners."""
        keys, of = [], []
        for less in (0, 1):
            some = lines[self.size[lines] - less >= self.least]
            a, b, m = self.first[some], self.first[some + 1], self.size[some] - less
            half = m // 2
            for side, key in ((0, self.span(a, a + half)), (1, self.span(b - (m - half), b))):
                keys.append(kernels.mix(key + m.astype(U) * U(2) + U(side)))
                of.append(self.id[some])
        return np.concatenate(keys), np.concatenate(of)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(variant, place of the deletion or -1, line id)."""
        some = lines[self.size[lines] >= self.least]
        a, b, m = self.first[some], self.first[some + 1], self.size[some]
        ends = np.cumsum(m)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(a - (ends - m), m)
        of = np.repeat(some, m)
        left = self.sums[at] - self.sums[self.first[of]]
        right = (self.sums[self.first[of + 1]] - self.sums[at + 1]) * U(_BACK)
        deleted = kernels.mix((left + right) * self.down[self.first[of]] + (self.size[of] - 1).astype(U) + self.seed)
        place = (at - self.first[of]).astype(np.int32)
        return np.concatenate([deleted, self.span(a, b)]), np.concatenate([place, np.full(len(some), -1, np.int32)]), self.id[np.concatenate([of, some])]

    def distinct(self) -> np.ndarray:
        return np.unique(self.id, return_index=True)[1]


class Lines(Units):
    """Lines with words of a batch: their words, line numbers and texts' numbers."""

    def __init__(self, column: pa.Array, words: int = MIN_WORDS, chars: int = MIN_CHARS):
        w = self.w = kernels.words(column)
        breaks = np.flatnonzero(w.data == 0x0A)
        row = np.searchsorted(breaks, w.start)  # line breaks before each word
        doc = w.doc
        new = np.ones(len(w.start), bool)
        new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
        super().__init__(kernels.word_hashes(w, fold=False), np.append(np.flatnonzero(new), len(w.start)), None, words, 0)
        lead = self.first[:-1]
        self.doc = doc[lead]
        self.number = row[lead] - np.searchsorted(breaks, w.texts[self.doc]) if len(lead) else np.zeros(0, np.int64)
        self.chars = chars

    def short(self) -> Units:
        """The distinct lines of fewer words, by characters."""
        some = self.distinct()
        some = some[self.size[some] < self.least]
        n = self.size[some]
        ends = np.cumsum(n)
        word = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[some] - (ends - n), n)
        size = self.w.end[word] - self.w.start[word] + 1  # with a blank behind
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        data = np.append(self.w.data, np.uint8(0))[np.arange(total) + np.repeat(self.w.start[word] - (stop - size), size)]
        data[stop - 1] = 0x20
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        lead = lead[~np.isin(lead, stop[ends - 1] - 1)]  # no blank behind the last word
        code, mine = data[lead].astype(U), np.ones(len(lead), bool)
        for k in range(1, 4):
            at = np.minimum(lead + k, max(total - 1, 0))
            mine &= (lead + k < total) & ((data[at] & 0xC0) == 0x80)
            code = np.where(mine, code * U(256) + data[at].astype(U), code)
        first = np.searchsorted(lead, np.concatenate([[0], stop[ends - 1]]))
        return Units(kernels.mix(code + U(0x7F4A7C15)), first, self.id[some], self.chars, 0x2545F491)

    def text(self, k: int) -> bytes:
        return self.w.data[self.w.start[self.first[k]] : self.w.end[self.first[k + 1] - 1]].tobytes()

    def both(self, take, chosen=lambda ids: np.ones(len(ids), bool)) -> list[np.ndarray]:
        """What ``take`` (halves or variants) gives for the distinct lines chosen by id, by words and by characters."""
        parts = [take(u, some[chosen(u.id[some])]) for u in (self, self.short()) for some in (u.distinct(),)]
        return [np.concatenate(x) for x in zip(*parts)]


def _dealt(sig: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Packed blobs, one row a bucket of the signature's high bits."""
    bucket = (sig >> U(32)) * U(buckets) >> U(32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order].astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    end = np.append(cut[1:], len(bucket))
    packed = [pa.array([x[a:b].tobytes() for a, b in zip(cut, end)], pa.binary()) for x in (c[order] for c in (sig, *columns))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *packed], ["bucket", *(f"b{k}" for k in range(len(packed)))])


def _gathered(batches: Iterator[pa.RecordBatch], kinds: tuple) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            parts[k] += [np.frombuffer(x, kind) for x in batch.column(f"b{k}").to_pylist()]
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds)]


def _bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the ids' top BITMAP bits, as bytes: a fixed size however many ids there are."""
    place = F.shiftrightunsigned(column, 64 - BITMAP) + 1
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    flags = np.zeros(1 << (BITMAP - 3), np.uint8)
    for r in maps:
        at = (r.b - 1) * 4096
        flags[at : at + 4096] |= np.frombuffer(r.bits, np.uint8)
    return flags


def _marked(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = (ids.view(U) >> U(64 - BITMAP)).astype(np.int64)
    return ((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def units(line: bytes, words: int, chars: int) -> tuple[bool, list]:
    """By words or not, and the units of a line; none for a line that has no edit to spare."""
    split = line.split()
    if len(split) >= words:
        return True, split
    plain = b" ".join(split).decode()
    return False, list(plain) if len(plain) >= chars else []


def within_one(a: list, b: list) -> bool:
    """Whether two sequences are at most one insertion, deletion or substitution apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, twin (hash that tells rows with one id apart), number, line, words of every line with words."""

    def run(batch):
        lines = Lines(batch.column("text"))
        take = pa.array(lines.doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), batch.column("twin").take(take), pa.array(lines.number, pa.int64()), pa.array(lines.id), pa.array(lines.size, pa.int64())],
            ["doc_id", "twin", "number", "line", "words"],
        )

    return common.map_arrow(_keyed(docs), run, "doc_id bigint, twin bigint, number bigint, line bigint, words bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")


def near_links(docs: DataFrame, first: DataFrame, size: int, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """line, earlier: verified lines that are within one edit of a line that comes earlier.

    ``first``: line and ``at``, the place of its first occurrence; ``size``: number of all words.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-40 * size // SHARE))
    buckets = 8 * parts

    def halves(batch):
        key, line = Lines(batch.column("text"), words, chars).both(Units.halves)
        if len(key):
            yield _dealt(key, buckets, line)

    def shared(batches):
        key, line = _gathered(batches, (U, np.int64))
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        differ = (key[1:] == key[:-1]) & (line[1:] != line[:-1])
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else start
        many = np.zeros(len(start), bool)
        many[group[1:][differ]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(line[many[group]]))], ["line"])

    blobs = common.map_arrow(texts, halves, "bucket int, b0 binary, b1 binary").repartition(parts, "bucket")
    candidates = common.materialize(blobs.mapInArrow(common.trimmed(shared), "line bigint"), "line-candidates")
    marks = spark.sparkContext.broadcast(_bitmap(candidates, "line"))

    def variants(batch):
        v, place, line = Lines(batch.column("text"), words, chars).both(Units.variants, lambda ids: _marked(marks.value, ids))
        if len(v):
            yield _dealt(v, buckets, place, line)

    def meet(batches):
        v, place, line = _gathered(batches, (U, np.int32, np.int64))
        order = np.argsort(v)
        v, place, line = v[order], place[order], line[order]
        same = v[1:] == v[:-1]
        near = np.zeros(len(v), bool)
        near[1:] |= same
        near[:-1] |= same
        v, place, line = v[near], place[near], line[near]
        order = np.lexsort((line, place, v))
        v, place, line = v[order], place[order], line[order]
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (place[1:] != place[:-1]) | (line[1:] != line[:-1])
        v, place, line = v[keep], place[keep], line[keep]
        if len(v):  # a variant counts if it has a whole line and a deletion, or one deletion of two lines
            new = np.concatenate([[True], v[1:] != v[:-1]])
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            whole = place[start] == -1
            size = np.diff(np.append(start, len(v)))
            twice = np.zeros(len(start), bool)
            twice[group[1:][(v[1:] == v[:-1]) & (place[1:] == place[:-1])]] = True
            good = (twice | (whole & (size > 1)))[group]
            v, place, line = v[good], place[good], line[good]
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(place), pa.array(line)], ["variant", "place", "line"])

    blobs = common.map_arrow(texts, variants, "bucket int, b0 binary, b1 binary, b2 binary").repartition(parts, "bucket")
    met = common.materialize(blobs.mapInArrow(common.trimmed(meet), "variant bigint, place int, line bigint"), "line-variants")
    rows = common.materialize(met.join(first, "line").select("variant", "place", "line", F.struct("at", "line").alias("who")), "line-placed")

    whole = rows.where("place = -1").select("variant", F.col("who").alias("other"))
    deleted = rows.where("place >= 0")
    # Written first, so that a join reads plain shuffles on both sides and a hot variant can be split.
    substituted = common.materialize(deleted.groupBy("variant", "place").agg(F.min("who").alias("other")), "line-least")
    lengthened = common.materialize(deleted.groupBy("variant").agg(F.min("who").alias("other")), "line-least")
    one = deleted.join(substituted, ["variant", "place"])
    two = deleted.join(whole, "variant")
    three = rows.where("place = -1").join(lengthened, "variant")
    found = [x.where("other.at < who.at").select("line", F.col("other.line").alias("earlier")) for x in (one, two, three)]
    links = common.materialize(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "line-links")

    needed = common.materialize(links.select(F.explode(F.array("line", "earlier")).alias("line")).distinct(), "line-needed")
    wanted = spark.sparkContext.broadcast(_bitmap(needed, "line"))

    def contents(batch):
        lines = Lines(batch.column("text"))
        some = lines.distinct()
        some = some[_marked(wanted.value, lines.id[some])]
        yield pa.RecordBatch.from_arrays([pa.array(lines.id[some]), pa.array([lines.text(k) for k in some.tolist()], pa.binary())], ["line", "words"])

    full = common.map_arrow(texts, contents, "line bigint, words binary").dropDuplicates(["line"]).join(needed, "line", "left_semi")
    full = common.materialize(full, "line-contents")
    pairs = common.materialize(links.join(full, "line"), "line-half").join(full.select(F.col("line").alias("earlier"), F.col("words").alias("others")), "earlier")

    def verify(batch):
        keep = []
        for a, b in zip(batch.column("words").to_pylist(), batch.column("others").to_pylist()):
            (one, a), (two, b) = units(a, words, chars), units(b, words, chars)
            keep.append(bool(one == two and a and b and within_one(a, b)))
        yield batch.select(["line", "earlier"]).filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(pairs.select("line", "earlier", "words", "others"), verify, "line bigint, earlier bigint")


def dropped(docs: DataFrame, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """Per occurrence of a line with words: doc_id, twin, number, reason ('exact', 'near' or null: it stays)."""
    rows = common.materialize(occurrences(docs), "line-rows")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("twin").alias("t"), F.col("number").alias("n"))
    first = common.materialize(rows.groupBy("line").agg(F.min(place).alias("at"), F.count("*").alias("times")), "line-first")
    size = rows.agg(F.sum("words")).first()[0] or 0
    near = common.materialize(near_links(docs, first.drop("times"), size, words, chars).select("line").distinct().withColumn("near", F.lit(True)), "line-near")
    # Most lines stand once and near none; only the others are joined back, copied to the salts.
    marked = first.join(near, "line", "left").where("times > 1 or near").select("line", "at", "near")
    copied = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "number"), F.lit(SALTS)).cast("int"))
    each = dealt.join(copied, ["line", "salt"], "left")
    reason = F.when(place != F.col("at"), "exact").when(F.col("near"), "near")
    return each.select("doc_id", "twin", "number", reason.alias("reason"))


def report(docs: DataFrame, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines (with words), n_exact, n_near, removed (line numbers from 0, comma-joined)."""
    lines = dropped(docs, words, chars).distinct()
    each = lines.groupBy("doc_id", "twin").agg(
        F.count("*").alias("n_lines"),
        F.count(F.when(F.col("reason") == "exact", 1)).alias("n_exact"),
        F.count(F.when(F.col("reason") == "near", 1)).alias("n_near"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.col("number")))), lambda x: x.cast("string")), ",").alias("removed"),
    )
    all_docs = _keyed(docs).select(F.col("doc_id").alias("d"), F.col("twin").alias("t"))
    joined = all_docs.join(each, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("twin")), "left")
    return joined.select(F.col("d").alias("doc_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_lines", "n_exact", "n_near")), F.coalesce("removed", F.lit("")).alias("removed"))


def dedupe(docs: DataFrame, words: int = MIN_WORDS, chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines cut from ``text``; a document whose lines all go keeps an empty text."""
    lines = dropped(docs, words, chars).where("reason is not null").distinct()
    gone = lines.groupBy("doc_id", "twin").agg(F.collect_set("number").alias("gone"))
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "text", F.col("doc_id").cast("long").alias("own"), F.xxhash64("text").alias("mine"))
    joined = keyed.join(gone, keyed["own"].eqNullSafe(gone["doc_id"]) & (keyed["mine"] == gone["twin"]), "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda k: F.get("lines", k.cast("int"))), "\n")
    cut = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*((cut if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
