"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors.  Items of a text are runs of letters, runs of digits and runs of one and the same
symbol, case kept.  Each item falls into one of WORDS buckets by hash; each bucket has a fixed sparse
ternary index vector of DIMS dimensions, derived from its number.  The context vector of a bucket is
the sum of the index vectors of its neighbours (REACH items to either side) over the whole corpus:
integer sums, added up in blocks, so the result depends on no order.  Vectors have unit length.

Pooling.  A document is the frequency-damped mean and deviation of its items' vectors, drawn towards
the corpus's as if PRIOR more items stood in it (short texts say little), and the mean likeness of the
vectors of items one and two apart, with the share of items equal to the one before.

Network.  INPUTS inputs, HIDDEN rectified units, one logit; Adam on log loss; a temperature is then
fitted on rows kept out of the training, and the score is sigmoid(logit / temperature).

Bounds: the vector table has WORDS * DIMS numbers whatever the corpus (it is broadcast); the network
is fitted on the driver on at most ``sample`` labelled rows (a stated parameter, chosen by hash).
Everything else covers all rows.

Defined cases: null or empty texts pool to zeros and are scored like others; rows of ``labels`` with a
null id or label are ignored, of repeated ones the largest label holds; without labels every score is
0.5; a null doc_id counts as held out; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, kernels

U = np.uint64
WORDS, DIMS, NONZERO, REACH, HIDDEN = 1 << 13, 64, 4, 2, 32
PRIOR, INPUTS = 4.0, 2 * DIMS + 3
BLOCKS = 64
SAMPLE = 20_000
THRESHOLD = 0.3

_kind = np.zeros(256, np.int16)  # 0: white space
_kind[:] = np.arange(256)
_kind[[0x20, *range(0x09, 0x0E)]] = 0
_kind[0x30:0x3A] = 256
_kind[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 257


def items(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each item in order, and the offsets of the texts."""
    data, texts = kernels.buffers(column)
    kind = _kind[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    cuts = texts[1:-1]
    new[cuts[cuts < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(data))[: len(start)]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    w = kernels.Words(data, texts, start, end, np.searchsorted(start, texts))
    return (kernels.word_hashes(w, fold=False) >> U(64 - 13)).astype(np.int64), w.first


def index_table() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the nonzero entries of each bucket's index vector."""
    h = kernels.mix(np.arange(WORDS * NONZERO, dtype=U) + U(0x1234567)).reshape(WORDS, NONZERO)
    return (h % U(DIMS)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


def contexts(bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Context sums of a slice: WORDS rows of DIMS numbers and the bucket's count."""
    out = np.zeros((WORDS, DIMS + 1), np.int64)
    out[:, DIMS] = np.bincount(bucket, minlength=WORDS)
    dims, signs = index_table()
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.zeros(WORDS * DIMS)
    for step in range(1, REACH + 1):
        same = np.flatnonzero(of[step:] == of[:-step])
        for here, there in ((same, same + step), (same + step, same)):
            base, other = bucket[here] * DIMS, bucket[there]
            for k in range(NONZERO):
                total += np.bincount(base + dims[other, k], weights=signs[other, k], minlength=WORDS * DIMS)
    out[:, :DIMS] = total.reshape(WORDS, DIMS)
    return out


def vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors and damped weights of all buckets, and the corpus's mean and mean square."""
    rows = WORDS // BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for piece in common.slices(batch):
                own = contexts(*items(piece.column("text")))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([total[k * rows : (k + 1) * rows].tobytes() for k in range(BLOCKS)], pa.binary())], ["block", "sums"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                own = np.frombuffer(sums, np.int64)
                total[block] = total[block] + own if block in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "sums"])

    parts = docs.select("text").mapInArrow(common.trimmed(add), "block int, sums binary")
    sums = parts.repartition(BLOCKS, "block").mapInArrow(common.trimmed(combine), "block int, sums binary").collect()
    table = np.zeros((BLOCKS, rows * (DIMS + 1)), np.int64)
    for r in sums:
        table[r.block] = np.frombuffer(r.sums, np.int64)
    table = table.reshape(WORDS, DIMS + 1)
    count = table[:, DIMS].astype(float)
    v = table[:, :DIMS].astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    weight = 1e-2 / (1e-2 + count / max(1.0, count.sum()))
    share = weight * count / max(1e-9, (weight * count).sum())
    return v.astype(np.float32), weight.astype(np.float32), np.stack([share @ v, share @ v**2]).astype(np.float32)


def pooled(column: pa.Array, v: np.ndarray, weight: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Inputs of the network for each text; ``usual``: mean and mean square of the corpus's item vectors."""
    bucket, first = items(column)
    out = np.zeros((len(first) - 1, INPUTS), np.float32)
    out[:, :DIMS] = usual[0]
    out[:, DIMS : 2 * DIMS] = np.sqrt(np.maximum(usual[1] - usual[0] ** 2, 0))
    full = np.flatnonzero(np.diff(first))
    step = 256
    for a in range(0, len(full), step):
        some = full[a : a + step]
        low, high = first[some[0]], first[some[-1] + 1]
        b = bucket[low:high]
        w, plain = weight[b], v[b]
        x = plain * w[:, None]
        at = first[some] - low
        mass = np.add.reduceat(w, at)[:, None] + PRIOR
        mean = (np.add.reduceat(x, at) + PRIOR * usual[0]) / mass
        x *= plain
        square = (np.add.reduceat(x, at) + PRIOR * usual[1]) / mass
        out[some, :DIMS] = mean
        out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
        size = np.diff(np.append(at, len(b)))
        of = np.repeat(np.arange(len(some)), size)
        for lag in (1, 2):
            same = of[lag:] == of[:-lag]
            like = np.einsum("ij,ij->i", plain[lag:], plain[:-lag]) * same
            out[some, 2 * DIMS + lag - 1] = np.bincount(of[lag:], like, len(some)) / (size + PRIOR)
        out[some, 2 * DIMS + 2] = np.bincount(of[1:], (b[1:] == b[:-1]) & (of[1:] == of[:-1]), len(some)) / (size + PRIOR)
    return out


class Network:
    """Two-layer network with standardised inputs and a temperature."""

    def __init__(self, seed: int = 11):
        r = np.random.RandomState(seed)
        self.mean, self.scale = np.zeros(INPUTS), np.ones(INPUTS)
        self.parts = [r.normal(0, (2 / INPUTS) ** 0.5, (INPUTS, HIDDEN)), np.zeros(HIDDEN), r.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.random = 1.0, r

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, size: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        order = self.random.permutation(len(x))
        held = order[: len(x) // 8]
        train = order[len(x) // 8 :]
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        step = 0
        for _ in range(epochs):
            for at in range(0, len(train), size):
                rows = self.random.choice(train, min(size, len(train)), replace=False)
                a, b, c, d = self.parts
                pre = z[rows] @ a + b
                hid = np.maximum(pre, 0)
                err = (1 / (1 + np.exp(-np.clip(hid @ c + d[0], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(err, c) * (pre > 0)
                slopes = [z[rows].T @ back + decay * a, back.sum(0), hid.T @ err + decay * c, np.array([err.sum()])]
                step += 1
                for k, g in enumerate(slopes):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.parts[k] = self.parts[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(held) >= 20:
            logit, target = self.logit(x[held]), y[held]
            options = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
            losses = [np.mean(np.logaddexp(0, logit / t) - target * logit / t) for t in options]
            self.temperature = float(options[int(np.argmin(losses))])
        return self


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> tuple[tuple, Network | None]:
    """Tables of the corpus (see ``vectors``) and the network fitted on at most ``sample`` labelled rows that aren't held out."""
    tables = vectors(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("__label"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample).collect()
    if not chosen:
        return tables, None
    spark = docs.sparkSession
    asked = spark.createDataFrame([(r["__id"], r["__label"]) for r in chosen], "__id long, __label double")
    rows = docs.select("doc_id", "text").join(F.broadcast(asked), F.col("doc_id") == F.col("__id")).select("doc_id", "__label", "text")
    shared = spark.sparkContext.broadcast(tables)

    def pool(batch):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("__label"), pa.array([r.tobytes() for r in pooled(batch.column("text"), *shared.value)], pa.binary())], ["doc_id", "label", "x"])

    found = sorted((r.doc_id, r.label, bytes(r.x)) for r in common.map_arrow(rows, pool, "doc_id bigint, label double, x binary").collect())
    if not found:
        return tables, None
    x = np.stack([np.frombuffer(f[2], np.float32) for f in found]).astype(float)
    return tables, Network(seed).fit(x, np.array([f[1] for f in found]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (probability of label 1), predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def rate(batch):
        tables, network = model.value
        x = pooled(batch.column("text"), *tables)
        score = network.score(x.astype(float)) if network else np.full(len(x), 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    rated = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rate, "doc_id bigint, score double, predicted int")
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
