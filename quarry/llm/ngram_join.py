"""Exact Jaccard self-join on word n-grams by a universe partition, and its connected components.

Sets.  A text's set holds the 64-bit hashes of its distinct n-word shingles (of the whole sequence,
if it has fewer words).  Equal sets are one *set* from here on, known by a 64-bit id; copies are
never paired.

Size bands.  Band edges grow by 1 / threshold, so two linked sets lie in one band or in neighbouring
ones.  Band k handles the pairs whose smaller set is in it: a set takes part in its own band and, if
it can have smaller partners there, in the one below.

Universe partition and pigeonhole.  In band k linked sets differ in at most H elements.  The hash
range is cut into m segments; a set's elements in a segment are a *segment subset*.
 - exact allocation: m = H + 1 + x.  Linked sets agree on x + 1 segments at least.  A subset of at
   most t elements is *light*: many unrelated sets share it.  A set with at most x light segments
   indexes only the others, since of x + 1 shared segments one is not light; a set with more
   light ones indexes all of them (then so does every partner that is only met there).
 - one-deletion allocation: m = ceil((H + 1) / 2).  On one segment linked sets differ by one element
   at most, so each subset is indexed together with all its one-deletion neighbours.
The cheaper allocation is chosen for each band from its sizes: deletion neighbourhoods where the sets
are small, exact subsets with the x and t that cost the fewest signatures elsewhere.

Index.  Signatures are dealt by hash in packed blobs and sorted in each task, so many tasks that a
task's share is bounded; a signature with two sets or more gives one row with its members.  No pair is
emitted.  A signature of more than GROUP sets (a family of near copies, or sets that happen to share
a poor segment) gives rows of half as many.

Checks.  Each set has a parity sketch (bit = parity of the elements that hash to it).  Two sketches
differ in no more bits than the sets differ in elements, so a pair whose sketches differ in more than
the allowed number is no link: an exact filter that needs some bytes a set.  The pairs that stay
are joined into a spanning forest in each group, by rising sketch distance, and the forest's edges
are verified on the full sets.  A second round verifies every remaining pair that passes the sketch
and lies in different components.  So no link between components is lost, and links inside one aren't
all spelled out.

Large groups.  Up to BLOCKS blocks are looked at in pairs of blocks.  Of more, the first round looks
at the first block with each of the others, which joins most of a family; in the second round such a
group that still has several components is dealt anew by a universe partition of another seed (linked
sets share a signature in every one of them).  A part that is large again, and a group that doesn't
become cheaper by it, is compared block by block, blocks of one and the same component left out.

Defined cases: null texts and texts without words have an empty set and link with nothing; a text of
any length is one set; a null doc_id takes part, and gives way to any other id as component id; rows
that repeat an id, with whatever text, are documents of their own; repeated rows are copies; an empty
table gives an empty result; extra columns are ignored (``dedupe`` passes them through in a struct,
whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

U = np.uint64
GROUP = 1024
BLOCKS = 16  # of GROUP / 2 sets: groups of more are not paired out block by block at once
SALTS = 32
SHARE = 64 << 20  # bytes of signatures that a task of the index holds, about
BITMAP = 25  # bits of the hash that select contents to fetch


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    w = kernels.words(column)
    h = kernels.word_hashes(w)
    counts = np.diff(w.first)
    texts = len(counts)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), U)
    full = kernels.window_hashes(h, n)
    long = np.flatnonzero(counts >= n)
    out[_spread(offsets[long], sizes[long])] = full[_spread(w.first[long], sizes[long])]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            out[offsets[short]] = kernels.window_hashes(h, size)[w.first[short]]
    for k in np.flatnonzero(sizes > 1).tolist():
        out[offsets[k] : offsets[k + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[offsets[:-1][sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[offsets]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Id of each set, as signed 64 bits; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(kernels.mix(h ^ U(0x5851F42D4C957F2D)))])
    sizes = np.diff(offsets).astype(U)
    ids = kernels.mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes * U(0x9E3779B97F4A7C15))
    ids[sizes == 0] = 0
    return ids.view(np.int64)


@dataclass(frozen=True)
class Band:
    lo: int
    hi: int
    differ: int  # most elements in which linked sets of the band differ
    segments: int
    spare: int
    light: int  # -1: one-deletion allocation


class Bands:
    """Bands of a threshold p / q, made as sizes come up."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.made = p, q, []

    def most(self, a, b):
        """Most elements in which linked sets of sizes a and b differ."""
        return a + b - 2 * (-(-self.p * (a + b) // (self.p + self.q)))

    def upto(self, size: int) -> list[Band]:
        while not self.made or self.made[-1].hi <= size:
            lo = self.made[-1].hi if self.made else 1
            hi = max(lo + 1, -(-lo * self.q // self.p))
            a = hi - 1
            differ = (a + a * self.q // self.p) * (self.q - self.p) // (self.q + self.p)
            self.made.append(Band(lo, hi, differ, *self._allocate(lo, differ)))
        return self.made

    @staticmethod
    def _allocate(lo: int, differ: int) -> tuple[int, int, int]:
        pairs = -(-(differ + 1) // 2)
        if lo + 2 * pairs <= 48:
            return pairs, 0, -1
        options = []
        for light in (0, 1):
            m = differ + 2
            for _ in range(6):
                mean = lo / m
                few = m * math.exp(-mean) * (1 + mean * light)
                m = differ + 1 + math.ceil(few + 3 * math.sqrt(few) + 1)
            options.append((m, m - differ - 1, light))
        return options[1] if options[1][0] <= 1.15 * options[0][0] else options[0]


def reseeded(h: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """The sets under another hash, each sorted again."""
    other = kernels.mix(h + U(seed) * U(0xD1342543DE82EF95))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return other[np.lexsort((other, of))]


def signatures(h: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set id) of all sets; each set once, whatever its copies."""
    sizes = np.diff(offsets)
    if not len(sizes) or not sizes.max():
        return np.zeros(0, U), np.zeros(0, np.int64)
    made = bands.upto(int(sizes.max()))
    edges = np.array([b.lo for b in made])
    _, first = np.unique(ids, return_index=True)
    first = first[sizes[first] > 0]
    own = np.searchsorted(edges, sizes[first], side="right") - 1
    least = -(-bands.p * sizes[first] // bands.q)
    below = (own > 0) & (least < edges[own])
    sets, band = np.concatenate([first, first[below]]), np.concatenate([own, own[below] - 1])
    use = np.array([b.differ > 0 for b in made])[band]
    sets, band = sets[use], band[use]
    if not len(sets):
        return np.zeros(0, U), np.zeros(0, np.int64)
    count = sizes[sets]
    elements = h[_spread(offsets[sets], count)]
    m = np.array([b.segments for b in made])[band]
    light = np.array([b.light for b in made])[band]
    spare = np.array([b.spare for b in made])[band]
    of = np.repeat(np.arange(len(sets)), count)
    segment = ((elements >> U(32)) * m[of].astype(U)) >> U(32)
    new = np.ones(len(elements), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(new)
    value = kernels.mix(elements ^ U(0xA0761D6478BD642F))
    total = np.add.reduceat(value, run)
    length = np.diff(np.append(run, len(elements)))
    run_set, run_segment = of[run], segment[run]

    seed = kernels.mix((band.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))

    def signature(which, segment, total):
        return kernels.mix(seed[which] + segment * U(0x8EBC6AF09C88C6E3) + kernels.mix(total))

    heavy = length > light[run_set]
    lights = m - np.bincount(run_set[heavy], minlength=len(sets))
    every = (light < 0) | (lights > spare)  # sets that index light and empty segments, too
    take = heavy | every[run_set]
    out_sig, out_set = [signature(run_set[take], run_segment[take], total[take])], [run_set[take]]

    deleting = light[of] < 0
    if deleting.any():
        run_of = np.cumsum(new) - 1
        which = np.flatnonzero(deleting)
        out_sig.append(signature(of[which], segment[which], total[run_of[which]] - value[which]))
        out_set.append(of[which])
    empties = np.flatnonzero(every & (np.bincount(run_set, minlength=len(sets)) < m))
    if len(empties):
        begin = np.searchsorted(run_set, empties)
        end = np.searchsorted(run_set, empties, side="right")
        for s, a, b in zip(empties.tolist(), begin.tolist(), end.tolist()):
            missing = np.setdiff1d(np.arange(m[s], dtype=U), run_segment[a:b], assume_unique=True)
            where = np.full(len(missing), s)
            out_sig.append(signature(where, missing, np.zeros(len(missing), U)))
            out_set.append(where)
    return np.concatenate(out_sig), ids[sets[np.concatenate(out_set)]]


def sketches(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: 64 bits to 2**17, at least two an element below that."""
    sizes = np.diff(offsets)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64), 64, 1 << 17)
    base = np.concatenate([[0], np.cumsum(bits)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    place = base[of] + (kernels.mix(h ^ U(0x2545F4914F6CDD1D)) & (bits[of] - 1).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def near_pairs(ns: np.ndarray, sketch: list[bytes], bands: Bands) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member (by rising size): the later members that may be linked, with their sketch distances."""
    rows = [np.frombuffer(s, U) for s in sketch]
    by_width: dict[int, np.ndarray] = {}
    for i in range(len(rows) - 1):
        width = len(rows[i])
        if width not in by_width:
            table = np.zeros((len(rows), width), U)
            for j in range(i, len(rows)):
                table[j] = np.bitwise_xor.reduce(rows[j].reshape(-1, width), axis=0)
            by_width[width] = table
        table = by_width[width]
        end = int(np.searchsorted(ns, ns[i] * bands.q // bands.p, side="right"))
        if end > i + 1:
            distance = np.bitwise_count(table[i + 1 : end] ^ table[i]).sum(axis=1).astype(np.int64)
            near = distance <= bands.most(ns[i], ns[i + 1 : end])
            if near.any():
                yield i, i + 1 + np.flatnonzero(near), distance[near]


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray, distance: np.ndarray, step: int = 512) -> np.ndarray:
    """Numbers of the pairs (i, j) that join different components, nearest pairs first.

    Members with one label are joined from the start.  After every ``step`` pairs looked at one by one,
    those that lie inside one component by now are dropped together.
    """
    order = np.argsort(distance, kind="stable")
    root = labels.copy()
    kept: list[int] = []
    while len(order):
        order = order[root[i[order]] != root[j[order]]]
        for k in order[:step].tolist():
            a, b = root[i[k]], root[j[k]]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                kept.append(k)
        order = order[step:]
    return np.array(kept, np.int64)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label of every node that has an edge (u, v); the label is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and
    contracts; at least half the nodes of each component go.  Only small tables of ids are moved.
    """
    spark = edges.sparkSession
    edges = common.materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), name)
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = common.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up")), name)
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hooks_next = common.materialize(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), name)
            done = hooks_next.where("moved").isEmpty()
            hooks = hooks_next.select("node", "up")
            if done:
                break
        a = hooks.select(F.col("node").alias("u"), F.col("up").alias("a"))
        b = hooks.select(F.col("node").alias("v"), F.col("up").alias("b"))
        edges = common.materialize(edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), name)
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("label"))
        else:
            later = hooks.select(F.col("node").alias("label"), F.col("up").alias("then"))
            labels = common.materialize(labels.join(later, "label", "left").select("node", F.coalesce("then", "label").alias("label")), name)
    return labels if labels is not None else spark.createDataFrame([], "node bigint, label bigint")


def _groups(docs: DataFrame, n: int, bands: Bands, elements: int) -> DataFrame:
    """gid, block, members: the sets that share a signature; block is -1 but for groups of several rows."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-32 * elements // SHARE))
    buckets = 8 * parts
    p, q = bands.p, bands.q

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bands(p, q)
        sigs, ids, held = [], [], 0

        def flush():
            sig, of = np.concatenate(sigs), np.concatenate(ids)
            bucket = (sig >> U(32)) * U(buckets) >> U(32)
            order = np.argsort(bucket, kind="stable")
            sig, of, bucket = sig[order], of[order], bucket[order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.append(cut[1:], len(sig))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), pa.array([sig[a:b].tobytes() for a, b in zip(cut, end)], pa.binary()), pa.array([of[a:b].tobytes() for a, b in zip(cut, end)], pa.binary())],
                ["bucket", "sigs", "ids"],
            )

        for batch in batches:
            for piece in common.slices(batch):
                h, offsets = sets_of(piece.column("text"), n)
                sig, of = signatures(h, offsets, set_ids(h, offsets), own)
                if len(sig):
                    sigs.append(sig)
                    ids.append(of)
                    held += len(sig)
                if held > 1_000_000:
                    yield flush()
                    sigs, ids, held = [], [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids = [], []
        for batch in batches:
            sigs += [np.frombuffer(x, U) for x in batch.column("sigs").to_pylist()]
            ids += [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
        if not sigs:
            return
        sig, of = np.concatenate(sigs), np.concatenate(ids)
        del sigs, ids
        order = np.argsort(sig)
        sig, of = sig[order], of[order]
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        sig, of = sig[shared], of[shared]
        order = np.lexsort((of, sig))
        sig, of = sig[order], of[order]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
        sig, of = sig[keep], of[keep]
        if not len(sig):
            return
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        gid = kernels.mix(np.add.reduceat(kernels.mix(of.view(U)), start)).view(np.int64)
        some = np.flatnonzero(size > 1)
        some = some[np.unique(gid[some], return_index=True)[1]]
        small = some[size[some] <= GROUP]
        for a in range(0, len(small), 4096):
            g = small[a : a + 4096]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[g])]), pa.int32()), pa.array(of[_spread(start[g], size[g])]))
            yield pa.RecordBatch.from_arrays([pa.array(gid[g]), pa.array(np.full(len(g), -1, np.int32)), lists], ["gid", "block", "members"])
        half = GROUP // 2
        for g in some[size[some] > GROUP].tolist():
            for k, a in enumerate(range(0, int(size[g]), half)):
                members = of[start[g] + a : start[g] + min(a + half, int(size[g]))]
                yield pa.RecordBatch.from_arrays([pa.array(gid[g : g + 1]), pa.array([k], pa.int32()), pa.array([members], pa.list_(pa.int64()))], ["gid", "block", "members"])

    blobs = docs.select("text").mapInArrow(common.trimmed(index), "bucket int, sigs binary, ids binary")
    return blobs.repartition(parts, "bucket").mapInArrow(common.trimmed(meet), "gid bigint, block int, members array<bigint>").dropDuplicates(["gid", "block"])


def _first_look(groups: DataFrame) -> DataFrame:
    """gid, set_id of the groups as the first round sees them: large ones in pairs of blocks, very large ones as their first block with each other one."""
    small = groups.where("block < 0").select("gid", F.explode("members").alias("set_id"))
    hot = groups.where("block >= 0")
    top = hot.groupBy("gid").agg(F.max("block").alias("top"))
    one, two = hot.select("gid", F.col("block").alias("i"), F.col("members").alias("first")), hot.select("gid", F.col("block").alias("j"), F.col("members").alias("second"))
    several = two.join(top.where(F.col("top") < BLOCKS), "gid").join(one, "gid").where("i < j")
    many = two.join(top.where(F.col("top") >= BLOCKS), "gid").join(one.where("i = 0"), "gid").where("i < j")
    return small.unionByName(several.unionByName(many).select(F.xxhash64("gid", "i", "j").alias("gid"), F.explode(F.concat("first", "second")).alias("set_id")))


def _labelled(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """gid, set_id, label of the members of ``groups``; a set without a label is its own."""
    member = groups.select("gid", F.explode("members").alias("set_id"))
    return member.join(labels, F.col("set_id") == F.col("node"), "left").select("gid", "set_id", F.coalesce("label", "set_id").alias("label"))


def _mixed_small(member: DataFrame) -> DataFrame:
    """The groups, of at most GROUP members each, that have several labels; put together once, so a group crosses the shuffle in few rows."""
    whole = member.groupBy("gid").agg(F.collect_list(F.struct("set_id", "label")).alias("m"), F.min("label").alias("a"), F.max("label").alias("b"))
    return whole.where("a <> b").select("gid", F.inline("m"))


def _mixed_large(member: DataFrame) -> DataFrame:
    """The groups, of any size, that have several labels."""
    mixed = member.groupBy("gid").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gid")
    return member.join(mixed, "gid", "left_semi")


def _second_look(docs: DataFrame, n: int, groups: DataFrame, labels: DataFrame, bands: Bands) -> DataFrame:
    """gid, set_id, label of groups that hold every pair of sets that share a signature and differ in label."""
    p, q = bands.p, bands.q
    found = _mixed_small(_labelled(groups.where("block < 0"), labels))
    large = common.materialize(_mixed_large(_labelled(groups.where("block >= 0"), labels)), "join-large")
    sizes = common.materialize(large.groupBy("gid").agg(F.count("*").alias("n")), "join-sizes")
    if sizes.isEmpty():
        return found
    huge = sizes.where(F.col("n") > BLOCKS * (GROUP // 2)).select("gid")
    if huge.isEmpty():
        return found.unionByName(_paired(large))
    rest, large = large.join(huge, "gid", "left_anti"), large.join(huge, "gid", "left_semi")
    contents = common.materialize(_contents(docs, n, large.select("set_id").distinct()), "join-large-sets")

    def again(batch):
        own, sizes = Bands(p, q), [len(x) // 8 for x in batch.column("hashes").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        h = reseeded(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), U), offsets, 1)
        sig, of = signatures(h, offsets, np.arange(len(sizes)), own)  # by row: a set may stand in several groups
        take = pa.array(of)
        yield pa.RecordBatch.from_arrays([batch.column("gid").take(take), pa.array(sig.view(np.int64)), batch.column("set_id").take(take), batch.column("label").take(take)], ["gid", "sig", "set_id", "label"])

    dealt = common.map_arrow(large.join(contents, "set_id").select("gid", "set_id", "label", "hashes"), again, "gid bigint, sig bigint, set_id bigint, label bigint")
    dealt = common.materialize(dealt.select(F.col("gid").alias("whole"), F.xxhash64("gid", "sig").alias("gid"), "set_id", "label").distinct(), "join-dealt")
    parts = dealt.groupBy("whole", "gid").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    parts = common.materialize(parts.select("whole", "gid", "n"), "join-parts")
    # A group whose parts together cost as much as itself is left whole.
    cost = parts.groupBy("whole").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    dense = cost.join(large.groupBy(F.col("gid").alias("whole")).agg(F.count("*").alias("n")), "whole").where("cost >= n * n").select("whole")
    dense = common.materialize(dense, "join-dense")
    parts = parts.join(dense, "whole", "left_anti")
    found = found.unionByName(dealt.join(parts.where(F.col("n") <= GROUP).select("gid"), "gid", "left_semi").select("gid", "set_id", "label"))
    large = large.join(dense.withColumnRenamed("whole", "gid"), "gid", "left_semi").unionByName(dealt.join(parts.where(F.col("n") > GROUP).select("gid"), "gid", "left_semi").select("gid", "set_id", "label"))
    return found.unionByName(_paired(rest.unionByName(large)))


def _paired(large: DataFrame) -> DataFrame:
    """Large groups block by block: members in order of their labels, pairs of blocks that have two labels."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("gid").orderBy("label", "set_id")) - 1
    blocks = common.materialize(large.withColumn("b", F.floor(place / (GROUP // 2)).cast("int")), "join-blocks")
    about = blocks.groupBy("gid", "b").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    about = about.join(about.groupBy("gid").agg(F.max("b").alias("top")), "gid")
    one, two = about.toDF("gid", "i", "lo", "hi", "top"), about.select("gid", F.col("b").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = one.join(two, "gid").where("(i < j or (i = j and top = 0)) and not (lo = hi and lo2 = hi2 and lo = lo2)").select("gid", F.explode(F.array_distinct(F.array("i", "j"))).alias("b"), F.xxhash64("gid", "i", "j").alias("pair"))
    return blocks.join(pairs, ["gid", "b"]).select(F.col("pair").alias("gid"), "set_id", "label")


def _met(member: DataFrame, meta: DataFrame) -> DataFrame:
    """Groups (from gid, set_id and maybe label) with what each member needs for the sketch filter."""
    if "label" not in member.columns:
        member = member.withColumn("label", F.col("set_id"))
    member = member.join(meta, "set_id")
    return member.groupBy("gid").agg(F.collect_list(F.struct("n", "set_id", "label", "sketch")).alias("m")).select(F.col("m.set_id").alias("ids"), F.col("m.n").alias("ns"), F.col("m.label").alias("labels"), F.col("m.sketch").alias("sketches"))


def _edges(met: DataFrame, bands: Bands, forest: bool) -> DataFrame:
    """u, v: pairs that pass the sketch; a spanning forest of them, or all between different labels."""
    p, q = bands.p, bands.q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bands(p, q)
        for batch in batches:
            us, vs = [], []
            for ids, ns, labels, sketch in zip(*(batch.column(c).to_pylist() for c in ("ids", "ns", "labels", "sketches"))):
                order = sorted(range(len(ids)), key=lambda k: (ns[k], ids[k]))
                ids = np.array([ids[k] for k in order])
                labels = np.unique([labels[k] for k in order], return_inverse=True)[1]
                found = list(near_pairs(np.array([ns[k] for k in order]), [sketch[k] for k in order], own))
                if not found:
                    continue
                i = np.concatenate([np.full(len(js), k) for k, js, _ in found])
                j, distance = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
                if forest:
                    pick = spanning(labels, i, j, distance)
                else:
                    pick = np.flatnonzero(labels[i] != labels[j])
                us.append(np.minimum(ids[i[pick]], ids[j[pick]]))
                vs.append(np.maximum(ids[i[pick]], ids[j[pick]]))
            us, vs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return met.mapInArrow(common.trimmed(run), "u bigint, v bigint").distinct()


def _contents(docs: DataFrame, n: int, needed: DataFrame) -> DataFrame:
    """set_id, hashes of the needed sets.

    A bitmap of fixed size (2**BITMAP bits), built by an aggregate, lets the scan drop most other
    sets early; the join decides.
    """
    spark = docs.sparkSession
    place = F.shiftrightunsigned("set_id", 64 - BITMAP)
    maps = needed.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    flags = np.zeros(1 << (BITMAP - 3), np.uint8)
    size = 4096
    for r in maps:
        at = (r.b - 1) * size
        if at >= 0:
            flags[at : at + size] |= np.frombuffer(r.bits, np.uint8)[: len(flags) - at]
        else:  # position 0 is in bucket 0
            flags[0] |= 1
    shared = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for piece in common.slices(batch):
                h, offsets = sets_of(piece.column("text"), n)
                ids = set_ids(h, offsets)
                at = (ids.view(U) >> U(64 - BITMAP)).astype(np.int64)
                at = np.maximum(at - 1, 0)  # bitmap_bit_position counts from 1
                hit = np.flatnonzero(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) & (ids != 0))
                hit = [k for k in hit.tolist() if not (int(ids[k]) in seen or seen.add(int(ids[k])))]
                if hit:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array([h[offsets[k] : offsets[k + 1]].tobytes() for k in hit], pa.binary())], ["set_id", "hashes"])

    found = docs.select("text").mapInArrow(common.trimmed(run), "set_id bigint, hashes binary")
    return found.join(needed, "set_id", "left_semi").dropDuplicates(["set_id"])


def _verified(edges: DataFrame, contents: DataFrame, p: int, q: int) -> DataFrame:
    """The edges whose full sets meet q * |intersection| >= p * |union|."""
    one = contents.select(F.col("set_id").alias("u"), F.col("hashes").alias("hu"))
    two = contents.select(F.col("set_id").alias("v"), F.col("hashes").alias("hv"))

    def run(batch):
        keep = []
        for a, b in zip(batch.column("hu").to_pylist(), batch.column("hv").to_pylist()):
            a, b = np.frombuffer(a, U), np.frombuffer(b, U)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(q * both >= p * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(edges.join(one, "u").join(two, "v").select("u", "v", "hu", "hv"), run, "u bigint, v bigint")


def _classes(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, twin (hash of the text), n, and of the row's component the least (nobody, doc_id, twin) as ``best``.

    ``best`` is null for rows without words.
    """
    bands = Bands(*threshold)

    def describe(batch):
        h, offsets = sets_of(batch.column("text"), n)
        ids, sizes = set_ids(h, offsets), np.diff(offsets)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("twin"), pa.array(sizes, pa.int64()), pa.array(ids, mask=sizes == 0), pa.array(sketches(h, offsets), pa.binary())], ["doc_id", "twin", "n", "set_id", "sketch"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("twin"), "text")
    rows = common.materialize(common.map_arrow(texts, describe, "doc_id bigint, twin bigint, n bigint, set_id bigint, sketch binary"), "join-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nobody"), "doc_id", "twin")).alias("first")
    meta = rows.where("set_id is not null").groupBy("set_id").agg(best, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    meta = common.materialize(meta, "join-sets")
    groups = common.materialize(_groups(docs, n, bands, meta.agg(F.sum("n")).first()[0] or 0), "join-groups")
    about = meta.select("set_id", "n", "sketch")
    forest = common.materialize(_edges(_met(_first_look(groups), about), bands, True), "join-forest")
    needed = common.materialize(forest.select(F.explode(F.array("u", "v")).alias("set_id")).distinct(), "join-needed")
    contents = common.materialize(_contents(docs, n, needed), "join-contents")
    good = common.materialize(_verified(forest, contents, *threshold), "join-good")
    labels = components(good)
    rest = common.materialize(_edges(_met(_second_look(docs, n, groups, labels, bands), about), bands, False).join(forest, ["u", "v"], "left_anti"), "join-rest")
    lacking = rest.select(F.explode(F.array("u", "v")).alias("set_id")).distinct().join(needed, "set_id", "left_anti")
    lacking = common.materialize(lacking, "join-lacking")
    if not lacking.isEmpty():  # sets that only meet in a later block of a large group
        contents = contents.unionByName(common.materialize(_contents(docs, n, lacking), "join-contents"))
    more = common.materialize(_verified(rest, contents, *threshold), "join-more")
    if not more.isEmpty():
        labels = components(good.unionByName(more))

    of_set = meta.select("set_id", "first").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    lowest = of_set.groupBy("label").agg(F.min("first").alias("best"))
    salted = _salted_join(of_set, lowest, "label", "set_id").select("set_id", "best")
    linked = _salted_join(rows.where("set_id is not null").select("doc_id", "twin", "n", "set_id"), salted, "set_id", "doc_id")
    alone = rows.where("set_id is null").select("doc_id", "twin", F.lit(0).cast("long").alias("n"), F.lit(None).cast(lowest.schema["best"].dataType).alias("best"))
    return linked.select("doc_id", "twin", "n", "best").unionByName(alone)


def join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Sets link when q * |intersection| >= p * |union| for threshold (p, q).  ``component_id`` is the
    smallest doc_id reachable by links.
    """
    own = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return _classes(docs, n, threshold).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _salted_join(many: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """Join on a key that may be hot in ``many`` and is unique in ``one``."""
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copied = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [key, "__salt"]).drop("__salt")


def dedupe(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each component; the columns stay.

    It is the row of the smallest doc_id (a null id comes last); of several texts with that id, the one
    of the smallest hash; of rows with that id and text, the one whose other columns have the smallest
    hash.  Rows without words all stay.
    """
    classes = common.materialize(_classes(docs, n, threshold).where("best is not null").select("doc_id", "twin", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("twin") == F.col("best.twin"))).alias("stays")), "join-classes")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("twin"))

    def same(keys: DataFrame):
        return keyed["id"].eqNullSafe(keys["doc_id"]) & (keyed["twin"] == keys["twin"])

    gone = classes.where("not stays").select("doc_id", "twin").distinct()
    kept = keyed.join(gone, same(gone), "left_anti")
    repeated = common.materialize(classes.where("stays").groupBy("doc_id", "twin").count().where("count > 1").select("doc_id", "twin"), "join-repeated")
    if not repeated.isEmpty():
        several = keyed.join(repeated, same(repeated), "left_semi").groupBy("id", "twin").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(repeated, same(repeated), "left_anti").select("row").unionByName(several.select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
