"""Word vectors and pooling of the quality classifier against plain loops."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality_classifier as C

ITEM = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|([^\x00A-Za-z0-9\x80-\xff\x20\x09-\x0d])\1*")


def plain_items(text):
    """Buckets of the runs of letters, of digits and of one symbol, each item hashed by itself."""
    return [int(C.items(pa.array([m.group().decode()]))[0][0]) for m in ITEM.finditer((text or "").encode())]


def plain_vectors(runs):
    dims, signs = C.index_table()
    index = np.zeros((C.WORDS, C.DIMS))
    np.add.at(index, (np.arange(C.WORDS)[:, None], dims), signs)
    sums, counts = np.zeros((C.WORDS, C.DIMS)), np.zeros(C.WORDS)
    for run in runs:
        for i, b in enumerate(run):
            counts[b] += 1
            for j in range(max(0, i - C.REACH), min(len(run), i + C.REACH + 1)):
                if j != i:
                    sums[b] += index[run[j]]
    length = np.sqrt((sums**2).sum(1))
    v = np.array([s / n if n else s for s, n in zip(sums, length)])
    return v, 0.01 / (0.01 + counts / counts.sum())


def plain_pooled(run, v, weight, usual):
    mass, first, second = C.PRIOR, C.PRIOR * usual[0], C.PRIOR * usual[1]
    for b in run:
        mass, first, second = mass + weight[b], first + weight[b] * v[b], second + weight[b] * v[b] ** 2
    like = [sum(v[run[i]] @ v[run[i - lag]] for i in range(lag, len(run))) / (len(run) + C.PRIOR) for lag in (1, 2)]
    same = sum(run[i] == run[i - 1] for i in range(1, len(run))) / (len(run) + C.PRIOR)
    mean = first / mass
    return np.concatenate([mean, np.sqrt(np.maximum(second / mass - mean**2, 0)), like, [same]])


@pytest.fixture(scope="module")
def texts(odd):
    return [r.text for r in odd.select("text").collect()] + ["a1!!b?? ?!x", "Ünï 12ab", "-" * 50, "7"]


def test_items_are_the_runs_of_one_kind(texts):
    bucket, first = C.items(pa.array(texts))
    assert [bucket[a:b].tolist() for a, b in zip(first, first[1:])] == [plain_items(t) for t in texts]


def test_vectors_and_pooling_are_those_of_plain_loops(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    runs = [plain_items(t) for t in texts]
    v, weight = plain_vectors(runs)
    found, weights, usual = C.vectors(docs)
    assert np.allclose(found, v, atol=1e-6) and np.allclose(weights, weight, atol=1e-6)

    every = [b for run in runs for b in run]
    share = weight[every] / weight[every].sum()
    assert np.allclose(usual, [share @ v[every], share @ v[every] ** 2], atol=1e-5)

    pooled = C.pooled(pa.array(texts), found, weights, usual)
    assert np.allclose(pooled, [plain_pooled(run, v, weight, usual) for run in runs], atol=2e-3)
