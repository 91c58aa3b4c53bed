"""Mixing sources to target weights with a low-discrepancy schedule.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; together they get as many
   words as the corpus holds; none more than ``epochs`` times its own size, the excess goes to the
   others by weight.
2. Schedule: each slot of the mixture holds one block of a source.  A source's blocks have B words, or
   fewer where its target would not be SERVED blocks of B, so a small source is cut as finely at any
   size of the corpus; it has target / block slots, three at least.  The golden-ratio point
   frac(k * phi), in exact 64-bit integers, is mapped through the cumulative slot counts to a source,
   and the slots of each source are ranked.  B follows the size of the corpus (2**20 blocks), and each
   source is served within a few of its own blocks of its target.  The points leave no gap of three
   slots, so a source with a target is never missed.
3. Blocks: each source's documents are shuffled by a seeded hash, laid end to end, repeated up to
   ``epochs`` times and cut into its blocks.  The slot of rank r takes block r: an equi-join on
   (source, rank).

Neither ranks nor offsets sort a whole source in one task: both are sums inside buckets (schedule
chunks, hash ranges of documents) plus prefix sums over the bucket totals.

Driver state is one row a source (its name and size).  Defined cases: null or empty texts have size 0
and are never taken; a text of any length is laid out whole and may fill many blocks; equal hashes are
ordered by id; rows that are equal in all columns are told apart by a running number, and it doesn't
matter which has which; an empty table gives an empty result; extra columns pass through ``mix`` in a
struct, whatever their names, and only tell rows apart elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

GOLDEN = 0x9E3779B97F4A7C15  # 2**64 / golden ratio, odd
CHUNK = 1 << 14
SERVED = 256


def targets(sizes: list[int], weights: list[float], epochs: int) -> list[float]:
    """Shares of sum(sizes) by weight, none above epochs * its size; the excess is shared again."""
    left, free, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        total = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / total > epochs * sizes[k]]
        for k in over or free:
            out[k] = float(epochs * sizes[k]) if over else left * weights[k] / total
        if not over:
            break
        free.difference_update(over)
        left -= sum(out[k] for k in over)
    return out


def _row_hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row, nulls told apart; maps, which have no order, as JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*plain, *(F.col(f"`{c}`").isNull() for c in docs.columns))


def _numbered(keyed: DataFrame) -> DataFrame:
    """``keyed`` (doc_id, source, __hash, ...) with a running number of equal rows: what a second scan finds again."""
    return keyed.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "source", "__hash").orderBy(F.lit(0))))


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: int = 3, slots: int = 1 << 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(entries, spans): one row a document with its source's target; and which words fill which slot.

    spans: slot, block, epoch, key columns, start and end (words of the document, end exclusive);
    documents that fill no slot have one row with a null slot.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD))
    rows = common.materialize(_numbered(docs.select("doc_id", "source", size.cast("long").alias("__size"), _row_hash(docs).alias("__hash"))), "mix-rows")
    found = {r.source: r for r in rows.groupBy("source").agg(F.sum("__size").alias("size"), F.count("*").alias("n")).collect()}
    names = sorted((s for s in found if s is not None)) + [None] * (None in found)
    sizes = [found[s].size for s in names]
    want = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], epochs)
    total = sum(sizes)
    largest = max(1, -(-total // slots))
    blocks = [max(1, min(largest, int(t // SERVED))) for t in want]
    shares = [max(3.0, t / b) if t > 0 else 0.0 for t, b in zip(want, blocks)]
    whole = sum(shares)
    slots = math.ceil(whole)

    edges, at = [], 0.0
    for share in shares[:-1]:
        at += share
        edges.append(min(2**64 - 1, int(at / whole * 2**64)) if total else 0)
    edges = np.array(edges, np.uint64)

    def fill(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                k = np.arange(chunk * CHUNK, min(slots, (chunk + 1) * CHUNK), dtype=np.uint64)
                source = np.searchsorted(edges, (k + np.uint64(1)) * np.uint64(GOLDEN), side="right")
                order = np.argsort(source, kind="stable")
                ranks = np.empty(len(k), np.int64)
                counts = np.bincount(source, minlength=len(names))
                ranks[order] = np.arange(len(k)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(k.astype(np.int64)), pa.array(source.astype(np.int32)), pa.array(ranks)], ["chunk", "slot", "six", "within"])

    chunks = -(-slots // CHUNK)
    # Written, so that the planner knows their size: an estimate from the range would call them small.
    served = spark.range(0, chunks, 1, max(1, min(chunks, 4096))).mapInArrow(common.trimmed(fill), "chunk bigint, slot bigint, six int, within bigint")
    served = common.materialize(served, "mix-served")
    before = Window.partitionBy("six").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = served.groupBy("chunk", "six").agg(F.count("*").alias("n"))
    counts = common.materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-slots")
    given = {r.six: r.n for r in counts.groupBy("six").agg(F.sum("n").alias("n")).collect()}
    ranked = common.materialize(served.join(counts.select("chunk", "six", "base"), ["chunk", "six"]).select("slot", "six", (F.col("base") + F.col("within")).alias("block")), "mix-ranked")

    table = spark.createDataFrame(
        [(s, k, int(sizes[k]), float(want[k]), int(blocks[k]), int(given.get(k, 0))) for k, s in enumerate(names)],
        "__name string, six int, source_size bigint, target double, __words bigint, __slots bigint",
    )
    entries = rows.join(table, rows.source.eqNullSafe(table["__name"])).drop("__name")

    buckets = 1 << max(4, int(sum(r.n for r in found.values()) // 2048).bit_length())
    order = F.xxhash64(F.lit(seed), "doc_id", "__hash", "__copy")
    placed = entries.withColumn("__order", order).withColumn("__bucket", F.pmod("__order", F.lit(buckets)).cast("int"))
    sums = placed.groupBy("six", "__bucket").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy("six").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("six", "__bucket", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("six", "__bucket").orderBy("__order", "doc_id", "__hash", "__copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(sums, ["six", "__bucket"]).withColumn("__offset", F.col("__base") + F.col("__inside"))
    placed = common.materialize(placed.drop("__base", "__inside", "__bucket", "__order"), "mix-placed")

    lap = F.explode_outer(F.expr(f"filter(sequence(0, {epochs - 1}), e -> __size > 0 and e * source_size + __offset < __slots * __words)"))
    laps = placed.withColumn("epoch", lap).withColumn("__at", F.col("epoch") * F.col("source_size") + F.col("__offset"))
    cut = F.explode_outer(F.expr("sequence(__at div __words, least((__at + __size - 1) div __words, __slots - 1))"))
    pieces = laps.withColumn("block", cut)
    spans = pieces.join(ranked, ["six", "block"], "left").withColumns(
        {
            "start": F.when(F.col("slot").isNotNull(), F.greatest(F.col("block") * F.col("__words") - F.col("__at"), F.lit(0))),
            "end": F.when(F.col("slot").isNotNull(), F.least((F.col("block") + 1) * F.col("__words") - F.col("__at"), F.col("__size"))),
        }
    )
    return placed, spans


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken words, copies begun."""
    _, spans = plan(docs, **how)
    keys = ["doc_id", "source", "__hash", "__copy"]
    return (
        spans.groupBy(*keys)
        .agg(
            F.first("__size").alias("size"),
            F.first("source_size").alias("source_size"),
            F.first("target").alias("target"),
            F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("taken"),
            F.count(F.when(F.col("start") == 0, 1)).alias("copies"),
        )
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mixture holds them: each row as often as the mix begins it (0 to ``epochs`` times)."""
    keys = ("doc_id", "source", "__hash", "__copy")
    counts = taken(docs, **how).where("copies > 0").select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), "copies")
    own = _numbered(docs.select("doc_id", "source", _row_hash(docs).alias("__hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    same = [own[c].eqNullSafe(counts[f"k{i}"]) for i, c in enumerate(keys)]
    joined = own.join(counts, same[0] & same[1] & same[2] & same[3]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
