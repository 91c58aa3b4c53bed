"""Mixing, line dedup, rollups and the classifier."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import line_dedup as L
from quarry.llm import mixing as M
from quarry.llm import quality_classifier as C
from quarry.llm import token_rollup as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, cap):
    """Targets by bisection on the price of a unit of weight: another way to the same shares."""
    total, low, high = sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 10], [5, 0, 7, 900], [1], [1000, 1, 1, 1, 1, 1]])
def test_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    got = M.targets(sizes, weights, 3)
    assert got == pytest.approx(filled(sizes, weights, 3), rel=1e-6, abs=1e-6) and sum(got) == pytest.approx(sum(sizes))


def test_mix_meets_targets_and_never_exceeds_three_laps(spark, odd, empty):
    rows = M.taken(odd).collect()
    again = M.taken(odd.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert len(rows) == odd.count()
    sources: dict = {}
    texts = {}
    for r in odd.collect():
        texts.setdefault((r.doc_id, r.source), []).append(len(WORD.findall(r.text or "")))
    for r in rows:
        assert r.size in texts[(r.doc_id, r.source)] and 0 <= r.taken <= 3 * r.size
        s = sources.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    order = sorted(s for s in sources if s is not None) + [None]
    want = M.targets([sources[s][0] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    for s, t in zip(order, want):
        size, taken, target, said = sources[s]
        assert said == size and target == pytest.approx(t) and abs(taken - target) <= max(12, 0.01 * target)
    assert M.taken(empty).count() == 0 and M.mix(empty).count() == 0
    out = M.mix(odd)
    assert out.columns == odd.columns
    count = {(r.doc_id, r.source, r.text): r["n"] for r in out.groupBy("doc_id", "source", "text").agg(F.count("*").alias("n")).collect()}
    begun: dict = {}
    for r in rows:
        begun[(r.doc_id, r.source)] = begun.get((r.doc_id, r.source), 0) + r.copies
    assert {k: v for k, v in begun.items() if v} == {k: sum(n for (d, s, _), n in count.items() if (d, s) == k) for k in {(d, s) for d, s, _ in count}}


def brute_taken(placed, slots, epochs=3):
    """Words taken of each row by laying out each source lap by lap, slot by slot; ``placed``: (key, source, size, order)."""
    names = sorted({s for _, s, _, _ in placed if s is not None}) + ([None] if any(s is None for _, s, _, _ in placed) else [])
    sizes = [sum(n for _, s, n, _ in placed if s == name) for name in names]
    want = M.targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], epochs)
    largest = max(1, -(-sum(sizes) // slots))
    block = [max(1, min(largest, int(t // M.SERVED))) for t in want]
    share = [max(3.0, t / b) if t > 0 else 0.0 for t, b in zip(want, block)]
    count = int(np.ceil(sum(share)))
    edges, at = [], 0.0
    for x in share[:-1]:
        at += x
        edges.append(min(2**64 - 1, int(at / sum(share) * 2**64)))
    given = [0] * len(names)
    for k in range(1, count + 1):
        point = k * M.GOLDEN % 2**64
        given[sum(point >= e for e in edges)] += 1
    out = {}
    for name, words, n in zip(names, block, given):
        room = n * words
        rows = sorted((order, key, size) for key, s, size, order in placed if s == name)
        for _, key, _ in rows:
            out[key] = 0
        for _ in range(epochs):
            for _, key, size in rows:
                use = min(size, room)
                out[key] += use
                room -= use
    return out


@pytest.mark.parametrize("slots", [50, 1000, 1 << 20])
def test_taken_is_what_a_plain_layout_takes(spark, odd, slots):
    extra = spark.createDataFrame([(5000 + k, "w " * (k % 50), f"t{k % 5}") for k in range(300)], "doc_id long, text string, source string")
    docs = odd.select("doc_id", "text", "source").unionByName(extra)
    rows = M.taken(docs, slots=slots).collect()
    buckets = 1 << max(4, (len(rows) // 2048).bit_length())
    keyed = spark.createDataFrame([(k, r.doc_id, r["__hash"], r["__copy"]) for k, r in enumerate(rows)], "k int, d long, h long, c int")
    order = {x.k: x.o for x in keyed.select("k", F.xxhash64(F.lit(7), "d", "h", "c").alias("o")).collect()}
    placed = [(k, r.source, r.size, (order[k] % buckets, order[k], r.doc_id or -1, r["__hash"], r["__copy"])) for k, r in enumerate(rows)]
    want = brute_taken(placed, slots)
    assert {k: r.taken for k, r in enumerate(rows)} == want


def test_mix_leaves_any_column_alone(spark):
    names = ["__size", "__hash", "__copy", "__copies", "__lap", "__k0", "k0", "row", "copies", "col", "target", "six", "slot"]
    rows = [(k // 2, "one two three", "s", 77 + k, *range(len(names) - 1), {"a": k}) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names) + ", m map<string,int>")
    got = sorted(map(repr, M.mix(df).collect()))
    assert M.mix(df).columns == df.columns and set(got) == set(map(repr, df.collect())) and len(got) >= 20
    assert got == sorted(map(repr, M.mix(df.repartition(5)).collect()))


def test_each_slot_is_filled_once(spark, odd):
    _, spans = M.plan(odd, slots=200)
    used = spans.where("slot is not null").groupBy("slot").agg(F.countDistinct("source", "block").alias("n"), F.sum(F.col("end") - F.col("start")).alias("words"))
    assert used.where("n > 1").count() == 0


def test_small_sources_are_served_where_blocks_are_large(spark):
    """64 slots: a block of the large sources is longer than the small sources, as it is in a large corpus."""
    sizes = {"a": 30000, "b": 300, "c": 1000, "d": 9, "e": 1, "f": 20000}
    rows = [(k, "w " * min(30, n - at), s) for s, n in sizes.items() for k, at in enumerate(range(0, n, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    served = {r.source: r for r in M.taken(docs, slots=64).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    block = -(-sum(sizes.values()) // 64)
    for s in sizes:
        target = served[s].target
        assert target > 0 and abs(served[s].taken - target) <= (4 * block if s in "af" else max(6, 0.03 * target))
    begun = {(r.source, r.doc_id) for r in M.mix(docs, slots=64).collect()}
    assert all((s, k) in begun for k, _, s in rows if s in "bcde")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    lines = []
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = WORD.findall(line)
            if w:
                lines.append((d, n, tuple(w)))
    lines.sort(key=lambda x: (x[0], x[1]))
    first: dict = {}
    for d, n, w in lines:
        first.setdefault(w, (d, n))
    long = [(w, w, p) for w, p in first.items() if len(w) >= 5]
    short = [(w, " ".join(w), p) for w, p in first.items() if len(w) < 5 and len(" ".join(w)) >= 5]
    near = {w for some in (long, short) for w, x, p in some for _, y, q in some if q < p and abs(len(x) - len(y)) < 2 and edits(x, y) <= 1}
    return {(d, n): "exact" if first[w] != (d, n) else "near" if w in near else None for d, n, w in lines}


def test_lines_dropped_are_those_of_all_pairs(spark, empty):
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(12)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = [r.choice(vocabulary) for _ in range(r.randint(0, 9))]
            if r.random() < 0.6:
                line = ["the", "one", "line", "that", "all", "texts", "have"]
                for _ in range(r.randint(0, 2)):
                    k = r.randrange(len(line))
                    line[k : k + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
            if r.random() < 0.4:
                line = list(r.choice(["Kapitel ä1", "menu", "a b", "all rights", "x 😀😀 yz"]))
                for _ in range(r.randint(0, 2)):
                    k = r.randrange(len(line))
                    line[k : k + r.randint(0, 1)] = [r.choice("ab é😀")] * r.randint(0, 1)
                line = "".join(line).split()
            lines.append(r.choice(["", " "]) + r.choice([" ", "  "]).join(line))
        rows.append((d, "\n".join(lines) if d % 17 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.number): x.reason for x in L.dropped(df).collect()}
    assert got == brute_lines(rows)
    report = {x.doc_id: x for x in L.report(df).collect()}
    out = {x.doc_id: x.text for x in L.dedupe(df).collect()}
    for d, t in rows:
        gone = sorted(n for (e, n), reason in got.items() if e == d and reason)
        assert report[d].removed == ",".join(map(str, gone))
        assert out[d] == (t if not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    assert L.report(empty).count() == 0 and L.dedupe(empty).count() == 0


def test_lines_of_any_length_and_null_ids(spark):
    rows = [(2, "page 12\npage 13\nab\nac"), (1, "page 11\nab\n" + "w " * 70_000 + "end"), (None, "page 1\nnew line here"), (3, "w " * 70_000 + "fin"), (None, "page 1\nnew line here"), (1, "page 1x")]
    names = ["own", "mine", "gone", "row", "lines", "twin", "__gone", "doc"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.dedupe(df)
    assert out.columns == df.columns and {tuple(r)[2:] for r in out.collect()} == {tuple(range(len(names)))}
    got = sorted((r.doc_id or 99, r.text[:30]) for r in out.collect())
    first = [t for d, t in got if d == 1]
    assert sorted(t[:7] for t in first) in (["page 11", "page 1x"], ["ab\nw w ", "page 1x"], ["", "page 11"])  # the two texts of id 1: one page line stays
    assert [t for d, t in got if d == 2] == ["ac"] and [t for d, t in got if d == 3] == [""] and [t for d, t in got if d == 99] == ["new line here"] * 2


def test_lines_of_odd_rows(spark, odd):
    out = L.dedupe(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert L.report(odd).count() == odd.count()


def test_word_edit_bound():
    for a, b in (("a b c", "a c"), ("a b", "a b"), ("a b c", "a x c"), ("a", ""), ("a b c", "c a b"), ("a b", "b c"), ("a b c d", "a b")):
        assert L.within_one(a.encode().split(), b.encode().split()) == (edits(a.split(), b.split()) <= 1)


def changes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "op string, doc_id long, source string, lang string, version string, n_tokens long, docs string")


def test_rollup_follows_any_history(spark):
    r = random.Random(4)
    store = R.Store(spark, common.scratch(spark, "roll"))
    held: dict = {}
    for b in range(5):
        rows = []
        for _ in range(30):
            op = r.choice(["insert", "insert", "revise", "delete"])
            rows.append((op, r.choice([*range(12), None]), r.choice(["s", "t", None]), r.choice(["en", None]), f"v{r.randint(0, 1)}", r.choice([None, *range(9)])))
        for op, d, *_ in rows:
            if op != "insert" and d is not None:
                held.pop(d, None)
        for op, d, s, lang, v, n in rows:
            if op != "delete":
                held.setdefault(d, []).append((s, lang, v, n or 0))
        assert store.commit(f"b{b}", changes(spark, rows))
        before = sorted(map(repr, store.totals().collect()))
        assert not store.commit(f"b{b}", changes(spark, rows))
        assert sorted(map(repr, store.totals().collect())) == before
        want: dict = {}
        for entries in held.values():
            for s, lang, v, n in entries:
                a = want.setdefault((s, lang, v), [0, 0])
                a[0] += 1
                a[1] += n
        assert {(x.source, x.lang, x.version): [x.n_docs, x.n_tokens] for x in store.totals().collect()} == want
    assert R.Store(spark, store.folder).committed() == [f"b{b}" for b in range(5)]


def test_rollup_ignores_what_has_no_mark(spark):
    store = R.Store(spark, common.scratch(spark, "roll"))
    rows = changes(spark, [("insert", 1, "s", "en", "v", 5)])
    lost = rows.selectExpr("doc_id", "source", "lang", "version", "1L as docs", "99L as tokens")
    store._write("a-lost", lost)  # written, never marked
    assert store.totals().count() == 0 and store.commit("a", rows)
    assert [tuple(x) for x in store.totals().collect()] == [("s", "en", "v", 1, 5)]
    assert store.commit("nothing", rows.limit(0)) and store.totals().count() == 1
    assert not store._claim("commits/a", "a-lost") and store.totals().first().n_tokens == 5  # a second writer


def test_compaction_changes_no_total(spark):
    store = R.Store(spark, common.scratch(spark, "roll"))
    batches = [[("insert", k, f"s{k % 2}", "en", "v", k) for k in range(20)], [("revise", 3, "s1", "en", "w", 50)], [("delete", 4, None, None, None, None), ("insert", None, "s0", None, "v", 1)]]
    for k, rows in enumerate(batches):
        store.commit(f"b{k}", changes(spark, rows))
    before, held = sorted(map(repr, store.totals().collect())), sorted(map(repr, store.state().collect()))
    for _ in range(2):
        store.compact()
        assert len(store._folders()) == 1 and store.committed() == ["b0", "b1", "b2"]
        assert sorted(map(repr, store.totals().collect())) == before and sorted(map(repr, store.state().collect())) == held
    assert not store.commit("b1", changes(spark, batches[1]))
    assert store.commit("b3", changes(spark, [("delete", 3, None, None, None, None)]))
    assert {(r.source, r.lang, r.version, r.n_docs) for r in store.totals().collect()} == {("s0", "en", "v", 9), ("s1", "en", "v", 9), ("s0", None, "v", 1)}
    assert len(store._folders()) == 2


def test_registered_rollup_is_a_recount(spark, odd, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    from quarry.llm.queries import QUERIES

    rows = [r for r in odd.collect() if r.doc_id is not None and r.doc_id != 7]
    spark.createDataFrame(rows, odd.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first: dict = {}
    for r in rows:
        first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    want: dict = {}
    for r in rows:
        if first[r.text or ""] == r.doc_id:
            a = want.setdefault((r.source, r.lang), [0, 0])
            a[0] += 1
            a[1] += len(t.encode(r.text or "", add_special_tokens=False).ids)
    got = QUERIES["op9_token_rollup"](spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in got} == want
    assert {r.version for r in got} == {R.version_of(public_tokenizers.path("byte_bpe_50k.json"))}


def test_counts_of_both_kinds_of_file(spark, odd):
    import public_tokenizers
    import tiktoken

    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    got = R.counted(odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, len(coder.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == want


def test_classifier_learns_and_keeps_to_its_bounds(spark, odd, empty):
    r = random.Random(1)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 7)))
    rows = []
    for k in range(900):
        n, good = r.randint(1, 60), r.random() < 0.7
        text = " ".join(word() + ("" if good else r.choice(["###", "$$$", "!!"])) for _ in range(n))
        rows.append((k, text, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality")
    got = {x.doc_id: x for x in C.classify(docs.drop("quality"), labels).collect()}
    again = {x.doc_id: x for x in C.classify(docs.drop("quality").repartition(5), labels).collect()}
    assert all(got[k].score == pytest.approx(again[k].score, abs=1e-6) for k in got)
    import zlib

    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for k, x in got.items())
    held = [(x.predicted, q) for (k, _, q), x in ((row, got[row[0]]) for row in rows) if x.held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = {x.doc_id: x for x in C.classify(docs.drop("quality"), turned).collect()}
    assert all(got[k].score == pytest.approx(other[k].score, abs=1e-9) for k in got)
    assert C.classify(odd, labels).count() == odd.count()
    assert {x.score for x in C.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert C.classify(empty, labels).count() == 0


def test_context_sums_do_not_cross_texts():
    import pyarrow as pa

    one = C.contexts(*C.items(pa.array(["a b c", "d e"])))
    two = C.contexts(*C.items(pa.array(["a b c"]))) + C.contexts(*C.items(pa.array([None, "d e", ""])))
    assert np.array_equal(one, two)
