import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, p, q):
    """(doc_id, size, smallest id reachable) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and q * both >= p * (len(a) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted(((d, len(s), low.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("n,p", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_components_are_those_of_all_pairs(spark, odd, n, p):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.join(odd, n, (p, 100)).collect()), key=repr)
    assert got == brute(rows, n, p, 100)


def test_families_of_near_copies(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(150):
        copy = list(words)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, p in ((3, 90), (5, 80), (3, 70)):
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.join(df, n, (p, 100)).collect()), key=repr)
        assert got == brute(rows, n, p, 100)


def test_linked_sets_always_share_a_signature():
    r = np.random.RandomState(1)
    for p in (60, 80, 90):
        bands = J.Bands(p, 100)
        for _ in range(400):
            size = int(r.choice([2, 5, 9, 12, 20, 35, 60, 150, 500]))
            a = r.randint(0, 2**63 - 1, size, dtype=np.int64).astype(np.uint64)
            b = a.copy()
            # change as much as a link allows
            while True:
                c = np.append(b[1:], r.randint(0, 2**63 - 1)).astype(np.uint64) if r.rand() < 0.5 else b[1:]
                both = len(np.intersect1d(a, c))
                if 100 * both < p * (len(a) + len(c) - both) or not len(c):
                    break
                b = c
            h = np.concatenate([np.sort(a), np.sort(b)])
            offsets = np.array([0, len(a), len(a) + len(b)])
            sig, of = J.signatures(h, offsets, np.array([1, 2]), bands)
            if set(a.tolist()) != set(b.tolist()):
                assert set(sig[of == 1].tolist()) & set(sig[of == 2].tolist())
                near = list(J.near_pairs(np.sort([len(a), len(b)]), [x for _, x in sorted(zip([len(a), len(b)], J.sketches(h, offsets)), key=lambda y: y[0])], bands))
                assert near


@pytest.mark.parametrize("blocks", [1, 16])
def test_groups_above_the_block_size_lose_no_pair(spark, monkeypatch, blocks):
    rows = [(k, " ".join(f"w{j}" for j in range(40)) + f" tail{k}") for k in range(40)]
    rows += [(100 + k, " ".join(f"w{j}" for j in range(34)) + f" other{k} more{k} end{k}") for k in range(20)]
    rows += [(200 + k, " ".join(f"w{j}" for j in range(20)) + "".join(f" u{k}.{j // 2 if k % 3 else j}" for j in range(20))) for k in range(40)]
    monkeypatch.setattr(J, "GROUP", 8)
    monkeypatch.setattr(J, "BLOCKS", blocks)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, p in ((3, 80),):
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.join(df, n, (p, 100)).collect()), key=repr)
        assert got == brute(rows, n, p, 100)


def test_a_signature_of_many_sets_is_not_paired_out(spark):
    """20,000 sets on one signature: rows of the first round grow with the sets, not with their pairs."""
    half = J.GROUP // 2
    many = list(range(20_000))
    rows = [(1, k, many[a : a + half]) for k, a in enumerate(range(0, len(many), half))]
    groups = spark.createDataFrame(rows, "gid long, block int, members array<long>")
    assert J._first_look(groups).count() == len(many) - half + half * (len(rows) - 1)
    one = spark.createDataFrame([(k, 0) for k in many], "node long, label long")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J._second_look(docs, 3, groups, one, J.Bands(80, 100)).count() == 0  # one family: nothing is left to compare


def test_dedupe_keeps_one_row_of_each_component_and_the_columns(spark, odd, empty):
    out = J.dedupe(odd, 3, (90, 100))
    assert out.columns == odd.columns
    rows = odd.collect()
    kept = out.collect()
    lowest = {c for d, s, c in brute([(r.doc_id, r.text) for r in rows], 3, 90, 100) if d == c and d is not None}
    assert {r.doc_id for r in kept} - {None} == lowest
    assert len(kept) == len([r for r in rows if not shingles(r.text, 3)]) + len(classes([(r.doc_id, r.text) for r in rows], 3, 90, 100))
    assert J.dedupe(empty).count() == 0 and J.join(empty).count() == 0


def classes(rows, n, p, q):
    """Components of the rows with words, as lists of (doc_id, text), by all pairs."""
    rows = [r for r in rows if shingles(r[1], n)]
    sets, out = [shingles(t, n) for _, t in rows], []
    left = set(range(len(rows)))
    while left:
        todo, part = [left.pop()], []
        while todo:
            k = todo.pop()
            part.append(rows[k])
            near = {j for j in left if q * len(sets[k] & sets[j]) >= p * len(sets[k] | sets[j])}
            left -= near
            todo += near
        out.append(part)
    return out


def test_dedupe_goes_by_row_where_ids_repeat_or_lack(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "all other words are in this one")
    names = ["row", "id", "twin", "best", "stays", "__gone", "__copy", "set_id", "n"]
    texts = [(1, a), (5, a), (5, b), (None, a), (None, b), (None, c), (None, c), (7, c.upper()), (7, c), (8, ""), (8, ""), (None, None), (9, a + " x" * 9), (9, a + " x" * 9)]
    for rows in (texts, texts[:3], [t for t in texts if t[0] is None]):
        full = [(*r, k, *range(len(names))) for k, r in enumerate(rows)]
        df = spark.createDataFrame(full, "doc_id long, text string, k int, " + ", ".join(f"`{x}` int" for x in names)).repartition(3)
        out = J.dedupe(df, 3, (90, 100))
        assert out.columns == df.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(full) and got and sorted(got, key=repr) == sorted((tuple(r) for r in J.dedupe(df.repartition(2), 3, (90, 100)).collect()), key=repr)
        want = []
        for part in classes(rows, 3, 90, 100):
            least = min(((d is None, d or 0) for d, _ in part))
            want.append(None if least[0] else least[1])
        want += [d for d, t in rows if not shingles(t, 3)]
        assert sorted(map(repr, (r[0] for r in got))) == sorted(map(repr, want))
        for part in classes(rows, 3, 90, 100):
            assert sum((r[0], r[1]) in part for r in got) == 1


def test_sets_of_folds_ascii_only():
    h, offsets = J.sets_of(pa.array(["A b", "a B", "É b", "é b", None, ""]), 2)
    ids = J.set_ids(h, offsets)
    assert ids[0] == ids[1] and ids[2] != ids[3] and ids[4] == ids[5] == 0
