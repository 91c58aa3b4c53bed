"""Secret scan, quality rules and decontamination against plain loops over the same rows."""

import hashlib
import re
from collections import Counter

import pytest

from quarry.llm import decontaminate as D
from quarry.llm import quality_rules as Q
from quarry.llm import secrets as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SECRET = "aB3" * 14
TEXTS = [
    None, "", "nothing here", "password = abc", "PassWord: 'abcdef'", "secret=token=abcdef token: x", "password: token: abcdefgh",
    "é ü api_key=\"0123456789\" AKIA" + "Q" * 16 + " tail", "AKIA" + "A" * 15, "AKIAKIA" + "B" * 20,
    "f" * 23 + " " + "0" * 24 + "g" + "ab" * 20, f"AKIA{'C' * 17} {SECRET} https://x.example/y", f"{SECRET} https://x.example/y",
    f"AKIA{'C' * 17} https://x.example/y", f"AKIA{'C' * 17} {'word ' * 200} {SECRET}", "token=abcdef " * 500,
    "apikey := abcdefg, apikey=\"hijklmn", "😀 token=abcdef 😀 " + "a1" * 12,
]


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_spans(spark, odd, empty):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        spans = base_spans(t or "")
        text = ",".join(f"{S.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (t, got[k].spans, text)
        assert [got[k].n_assign, got[k].n_access, got[k].n_hex] == [sum(s[1] == i for s in spans) for i in range(3)]
        assert set(text.split(",")) <= set(got[k].spans.split(",")) or not text
    assert "secret:22:64" in got[11].spans and "endpoint:65:" in got[11].spans  # all three together
    assert got[12].spans == "" and "endpoint" not in got[13].spans  # no access identifier; no secret
    assert "secret" not in got[14].spans  # too far away
    assert S.scan(odd).count() == odd.count() and S.scan(empty).count() == 0


def linked_spans(text, scope):
    """All spans by comparing every span with every other one."""
    found = [(a, k, b) for a, k, b in base_spans(text)]
    found += [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9/+=]{40,}", text) if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    found += [(m.start(), 4, m.end()) for m in re.finditer(r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+""", text)]
    found += [(m.start(), 5, m.end()) for m in re.finditer(r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", text, re.ASCII)]
    out = []
    for a, k, b in found:
        near = {j for c, j, _ in found if abs(a - c) <= scope}
        named, secret = bool(near & {1, 5}), bool(near & {0, 3})
        if k < 3 or (k == 3 and named) or (k == 4 and named and secret) or (k == 5 and secret):
            out.append((a, k, b))
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_links_depend_on_distance_alone(spark):
    """The same parts at every distance around the scope, behind a lead of any length."""
    access, url, user = "AKIA" + "D" * 16, "https://h.example/p", "Login: someone"
    rows = []
    for lead in (0, 1, 57, 199, 200, 201, 399):
        for gap in (0, 150, 201, 300, 357, 358, 378, 379, 380, 385, 386, 399, 400, 401, 600):
            for parts in ((access, SECRET), (SECRET, user), (user, "token=abcdefg"), (access, url, SECRET), (url, user, SECRET), (url, user), (access, url)):
                rows.append((len(rows), "é" * lead + " " + (" " + "." * gap + " ").join(parts)))
    for scope in (S.SCOPE, 150):
        got = {r.doc_id: r.spans for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), scope).collect()}
        for k, text in rows:
            assert got[k] == linked_spans(text, scope), text


def test_links_agree_with_sql(spark, tmp_path):
    """The registered SQL on texts that do hold multipart credentials."""
    from quarry.llm.oracles import ORACLE_SQL

    import duckdb

    texts = [*TEXTS, *(f"USER=ann {'x ' * n} password: abcdefgh {'y ' * n} ftp://h/ {SECRET}" for n in range(90, 320, 13))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    want = {r[0]: r[1:] for r in con.sql("select doc_id, n_assign, n_access, n_hex, base_sha256, spans from (" + ORACLE_SQL["op5_secret_scan"] + ")").fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in S.scan(spark.read.parquet(f"{tmp_path}/documents")).collect()}
    assert got == want and any("user:" in r[4] for r in got.values())


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark, odd, empty):
    extra = spark.createDataFrame([(900, "a b c d e f g h i " * 9), (901, "😀 é# ## $ " * 12), (902, "l one\nl one\n\nl two\n \nl one"), (903, "w " * 20), (904, "a b c d e f g h a b c d e f g h x")], "doc_id long, text string")
    for df in (odd, extra.selectExpr("*", "cast(null as string) as source")):
        want = sorted((r.doc_id, *measures(r.text)) for r in df.collect() if r.doc_id is not None)
        got = Q.report(df).collect()
        assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    out = Q.filter_documents(odd)
    assert out.columns == odd.columns and out.count() == sum(r.kept for r in Q.report(odd).collect())
    assert Q.report(empty).count() == 0 and Q.filter_documents(empty).count() == 0


def judged(rows):
    """Kept ids by plain arithmetic: the prior by moments, shrunk rates, and limits scaled by host."""
    found = {}
    for k, text, host in rows:
        n, chars, symbols, dups, again = measures(text)
        lines = sum(1 for x in (text or "").split("\n") if WORD.search(x))
        found[k] = (host, n < 20 or 100 * again > 30 * n, chars < 2 * n or chars > 20 * n, symbols, n, dups, lines)

    def fails(k, strict):
        _, base, length, symbols, n, dups, lines = found[k]
        return base or length or 10 * symbols * strict > 100 * n or 2 * dups * strict > 100 * lines

    docs, bad = Counter(found[k][0] for k in found), Counter(found[k][0] for k in found if fails(k, 100))
    m = sum(bad.values()) / len(found)
    spread = sum(n * (bad[h] / n - m) ** 2 - m * (1 - m) for h, n in docs.items()) / len(found)
    weight = m * (1 - m) / spread - 1 if 1e-9 < spread < m * (1 - m) else 1e6
    strict = {h: max(50, min(200, round(100 * (bad[h] + m * weight) / (n + weight) / m))) if m else 100 for h, n in docs.items()}
    return {k for k in found if not fails(k, strict[found[k][0]])}, strict


def test_host_verdict_decides_its_documents(spark, monkeypatch):
    """Texts near a limit are kept or not by how often their host fails."""
    clean = " ".join(f"w{k}" for k in range(100))
    many, some, few = (clean + " #" * n for n in (40, 13, 7))
    rows = [(k, (many, many, many, some, few, clean)[k % 6], "bad") for k in range(120)]
    rows += [(200 + k, (some if k == 7 else few if k % 9 == 0 else clean), f"fine{k % 3}") for k in range(300)]
    rows += [(900 + k, clean, None) for k in range(50)] + [(960, many, None), (961, None, "lone"), (962, "", "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, strict = judged(rows)
    assert strict["bad"] == 200 and strict["fine0"] == 50
    assert not {4, 10} & want and 200 in want and 207 in want  # few symbols in the bad host, more in a clean one
    for limit in (100_000, 0):  # broadcast, salted
        monkeypatch.setattr(Q, "BROADCAST_HOSTS", limit)
        got = Q.report(df).collect()
        assert {r.doc_id for r in got if r.kept} == want
        assert {r.host_strict for r in got if r.doc_id < 120} == {200}


def test_quality_rules_leave_any_column_alone(spark):
    names = ["row", "host", "t", "w", "n", "chars", "symbols", "lines", "win", "again", "sorted", "at", "named", "salt", "own", "strict", "shrunk", "fails", "kept", "base_failed", "n_words", "__t"]
    rows = [(1, " ".join(f"w{k}" for k in range(30)), "s", *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    assert [tuple(r) for r in Q.filter_documents(df).collect()] == rows


def test_hosts_may_be_domains(spark):
    from pyspark.sql import functions as F

    urls = ["http://A.example/x", "https://u:p@a.example:80/y", "ftp://b.example", "no url", None]
    got = [r.d for r in spark.createDataFrame(list(enumerate(urls)), "k int, u string").orderBy("k").select(Q.domain(F.col("u")).alias("d")).collect()]
    assert got == ["a.example", "a.example", "b.example", None, None]
    df = spark.createDataFrame([(k, "one " * 3, u) for k, u in enumerate(urls)], "doc_id long, text string, url string")
    assert Q.report(df, Q.domain(F.col("url"))).count() == 5


def contaminated(text, items, n=10):
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, names = set(), set()
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(n, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if windows and tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "short item"), (10, "Short ITEM!"), (3, None), (4, "..."), (2, "repeated id with another text of many more words than ten in it"), (5, "é à ü one two three four five six seven")]
PASSAGES = [
    "x the QUICK brown-fox jumps over the lazy dog, again y", "the quick brown fox jumps over the lazy dog", "a short, item b", "shortitem", None, "",
    "pre the quick brown fox jumps over the lazy dog again and again today post short item", "É à ü one two three four five six seven", "é à ü one two three four five six seven",
    "repeated id with another text of many more words than ten in it " * 3,
]


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_contamination(spark, odd, empty, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(PASSAGES)), "doc_id long, text string").unionByName(odd.where("doc_id is not null").selectExpr("doc_id + 1000 as doc_id", "text"))
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.contamination(df, bench, block_bytes=block).collect()}
    assert got == {(r.doc_id, *contaminated(r.text, ITEMS)) for r in df.collect()}
    assert D.contamination(empty, bench).count() == 0
    assert D.contamination(df, bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("block", [32 << 20, 60])
def test_decontaminate_documents_and_spans(spark, odd, block):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(PASSAGES)), "doc_id long, text string")
    clean = D.decontaminate(df, bench, block_bytes=block)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, t in enumerate(PASSAGES) if not contaminated(t, ITEMS)[4]}
    cut = {r.doc_id: r.text for r in D.decontaminate(df, bench, remove="spans", block_bytes=block).collect()}
    assert cut[0] == "x y" and cut[2] == "a b" and cut[3] == "shortitem" and cut[4] is None and cut[1] == PASSAGES[1] and cut[9] == " "
    again = D.decontaminate(odd, bench)
    assert again.columns == odd.columns and again.count() == odd.count()


def test_decontamination_leaves_any_column_alone(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    names = ["ranges", "items", "row", "__ranges", "__items", "doc"]
    rows = [(k, t, *range(len(names))) for k, t in enumerate(PASSAGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    clean = sorted(tuple(r) for r in D.decontaminate(df, bench, block_bytes=60).collect())
    assert repr(clean) == repr(sorted(r for r in rows if not contaminated(r[1], ITEMS)[4]))
    alone = D.decontaminate(df.select("text"), bench)
    assert alone.columns == ["text"] and alone.count() == len(clean)


def test_window_table_is_as_small_as_it_says():
    import random

    import pyarrow as pa

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    items = [(str(k), " ".join(r.choice(vocabulary) for _ in range(300))) for k in range(2000)]
    items += [(f"again{k}", items[5][1]) for k in range(50)]
    table = D.WindowTable(items, 10)
    assert table.nbytes <= 7 * sum(len(t) for _, t in items)
    w = D.kernels.words(pa.array([items[5][1].upper(), "nothing of it", " ".join(items[7][1].split()[40:52])]), D.kernels.ALNUM_WORDS)
    hits = table.hits(w)
    assert D.merged(hits[0][0]) == [(0, 300)] and hits[0][1] == {"5", *(f"again{k}" for k in range(50))}
    assert D.merged(hits[2][0]) == [(0, 12)] and hits[2][1] == {"7"} and set(hits) == {0, 2}


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of three values every lookup collides; words decide."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(D.kernels, "window_hashes", lambda h, n: (h[: max(0, len(h) - n + 1)] % np.uint64(3)) << np.uint64(60))
    table = D.WindowTable([(str(i), t or "") for i, t in ITEMS], 10)
    hits = table.hits(D.kernels.words(pa.array(PASSAGES, pa.large_string()), D.kernels.ALNUM_WORDS))
    for k, text in enumerate(PASSAGES):
        n_words, n_hit, n_items, *_ = contaminated(text, ITEMS)
        ranges, names = hits.get(k, ([], set()))
        assert (sum(b - a for a, b in D.merged(ranges)), len(names)) == (n_hit, n_items)
