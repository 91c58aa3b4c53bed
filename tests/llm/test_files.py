"""Token files and WARC archive: exact round trips."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common
from quarry.llm import token_files as T
from quarry.llm import warc as W

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts(plain):
    r = random.Random(2)
    pieces = ["a", "Bc", "'s", "12", "!", "##", " ", " ", "  ", "\n", "\t", " ", "　", "\x1d", "é", "ß", "漢字", "😀", "<|endoftext|>"]
    texts = [None, "", " ", "  ", "a  b   c", "x \n y\n z", " lead", "trail "] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 15))) for _ in range(3000)]
    coder = T.Encoder(PATH)
    for part in (texts, texts[::-1]):  # the second time with known units
        flat, counts = coder.encode(pa.array(part))
        at = 0
        for text, n in zip(part, counts):
            assert flat[at : at + n].tolist() == plain(text), text
            at += n
        assert at == len(flat)


def test_added_tokens_get_the_ids_of_a_plainly_loaded_tokenizer(spark):
    t = tokenizers.Tokenizer.from_file(PATH)
    assert t.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    texts = ["hello <|endoftext|> world", "no such token", "<|endoftext|>", "a <|endoftext|><|endoftext|>\nb  c", "<|endoftext", None, "", "end <|endoftext|>"]
    folder = common.scratch(spark, "t")
    T.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), folder, PATH)
    want, start = [], 0
    for k, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in T.read_index(spark, folder).orderBy("start").collect()] == want


def test_reader_takes_only_what_is_asked_and_finds_damage(monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 10)
    out = io.BytesIO()
    w = T.Writer(out)
    docs = [(1, np.arange(3, dtype=np.uint32)), (4, np.arange(25, dtype=np.uint32)), (4, np.zeros(0, np.uint32)), (9, np.array([2**32 - 1], np.uint32))]
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    data = out.getvalue()

    class Watched(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Watched.taken += max(n, 0)
            return super().read(n)

    reader = T.Reader(Watched(data))
    assert [reader.document(k).tolist() for k in range(4)] == [ids.tolist() for _, ids in docs]
    assert [x.tolist() for x in reader.find(4)] == [docs[1][1].tolist(), []] and not list(reader.find(5))
    Watched.taken = 0
    list(reader.find(9))
    assert Watched.taken == int(reader.frames[-1, 0])
    broken = bytearray(data)
    broken[8] ^= 0xFF
    with pytest.raises(Exception):
        T.Reader(io.BytesIO(bytes(broken))).document(0)
    with pytest.raises(ValueError):
        T.Reader(io.BytesIO(data[:-1] + b"x"))


def test_written_files_hold_every_document_in_order(spark, odd, empty, plain):
    docs = odd
    folder = common.scratch(spark, "t")
    manifest = T.write(docs, folder, PATH, partitions=5)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or "")):
        ids = [*plain(r.text), 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in T.read_index(spark, folder).orderBy("start").collect()] == want
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(want)
    folder = common.scratch(spark, "t")
    T.write(empty, folder, PATH)
    assert T.read_index(spark, folder).count() == 0


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "<p>two é</p>"), (4, "http://a/\r\nX: y", ""), (5, "u", None),
    (6, "u", "<p>one</p>"), (7, "u", "x" * 50000), (7, "u", "x" * 50000), (8, "u", "tail\r\n\r\nWARC/1.1\r\n"), (None, "u", "nobody"), (None, "u", "<p>one</p>"),
]


def pages(spark):
    return spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, size int, digest string").repartition(3)


def said(spark, rows, least=0, packed=True):
    """The page records that go through the archive's files."""
    folder, target = common.scratch(spark, "w"), common.scratch(spark, "f")
    W.pack(spark.createDataFrame([(*r, 1, "d", "g") for r in rows], "page_id long, url string, html string, size int, digest string, giver string").repartition(3), folder, least)
    files = W.write_warc(spark, folder, target, packed=packed)
    return folder, sorted(map(tuple, W.read_files(spark, target, files).collect()), key=repr)


def wanted(rows, least=0):
    best = {}
    for k, _, html in rows:
        if k is not None:
            best[html or ""] = max(best.get(html or "", k), k)
    want, seen = [], set()
    for k, _, html in rows:
        data, first = (html or "").encode(), best.get(html or "")
        response = len(data) < least or first is None or (k == first and (k, data) not in seen)
        seen.add((k, data))
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first))
    return sorted(want, key=repr)


@pytest.mark.parametrize("least", [0, 5, 10**6])
@pytest.mark.parametrize("packed", [False, True])
def test_files_say_what_the_pages_are(spark, least, packed):
    rows = [*PAGES, (None, "u", "nobody"), (9, "u", "same"), (9, "u", "other"), (9, "u", "same"), (-3, "u", "long " * 400_000)]
    folder, got = said(spark, rows, least, packed)
    assert got == wanted(rows, least)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in rows})


def test_many_pages_of_one_payload(spark):
    rows = [(k, "u", "one page") for k in range(700)] + [(1000 + k, "u", f"page {k}") for k in range(50)]
    for least in (0, 100):
        assert said(spark, rows, least)[1] == wanted(rows, least)


def test_payloads_move_once(spark):
    """Records are rebuilt where the store lies: the plan has one exchange, that of the headers."""
    folder = common.scratch(spark, "w")
    W.pack(pages(spark).where("page_id is not null"), folder)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = W.records_of(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount" in plan, plan


def test_records_can_be_rebuilt_and_parsed(spark):
    folder, target = common.scratch(spark, "w"), common.scratch(spark, "f")
    W.pack(pages(spark), folder)
    files = W.write_warc(spark, folder, target)
    assert files.agg({"records": "sum"}).first()[0] == len(PAGES)
    root = common.shared_fs(target)[1]
    seen = []
    for r in files.collect():
        for fields, http, payload in W.read_warc(open(f"{root}/{r.path}", "rb").read()):
            assert http.startswith(b"HTTP/1.1 200")
            seen.append((fields["X-Page-ID"], fields["WARC-Type"]))
            if fields["WARC-Type"] == "response":
                assert W.sha1_base32(payload) == fields["WARC-Payload-Digest"][5:] and len(payload) == int(fields["X-Payload-Length"])
            else:
                assert not payload and "WARC-Refers-To" in fields
    assert sorted(x for x, _ in seen) == sorted("" if k is None else str(k) for k, _, _ in PAGES)


def test_registered_query_writes_and_parses_warc_files(spark, tmp_path, monkeypatch):
    from quarry.llm.queries import QUERIES

    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    written, write = [], W.write_warc
    monkeypatch.setattr(W, "write_warc", lambda *a, **b: written.append(write(*a, **b)) or written[-1])
    assert QUERIES["op4_warc"](spark, str(tmp_path)).count() == len(PAGES)
    assert written[0].agg({"records": "sum"}).first()[0] == len(PAGES)


def test_cut_files_are_noticed():
    record = W.header(1, "u", 3, W.sha1_base32(b"abc")) + b"abc" + W.CRLF * 2
    assert [p for _, _, p in W.read_warc(record * 2)] == [b"abc"] * 2
    for n in (1, 4, 6, len(record) - 20):
        with pytest.raises(ValueError):
            list(W.read_warc(record + record[:-n]))


def test_damaged_payload_is_noticed(spark):
    folder = common.scratch(spark, "w")
    W.pack(pages(spark), folder)
    rows = [(bytes(r.digest), r.giver, r.size, bytes(r.payload) + b"!") for r in spark.read.parquet(f"{folder}/payloads").collect()]
    spark.createDataFrame(rows, "digest binary, giver long, size long, payload binary").write.option("path", f"{folder}/payloads").mode("overwrite").bucketBy(4, "digest", "giver").saveAsTable("broken_store")
    with pytest.raises(Exception, match="damaged"):
        W.records_of(spark, folder).collect()
    spark.sql("drop table broken_store")


def test_damaged_files_break_the_query(spark, tmp_path, monkeypatch):
    from quarry.llm.queries import QUERIES

    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    write = W.write_warc

    def spoil(spark, folder, target, packed=False):
        files = write(spark, folder, target, packed=False)
        for r in files.collect():
            path = f"{common.shared_fs(target)[1]}/{r.path}"
            data = open(path, "rb").read()
            open(path, "wb").write(data.replace(b"<p>", b"<q>"))
        return files

    monkeypatch.setattr(W, "write_warc", spoil)
    with pytest.raises(Exception, match="fit its payload"):
        QUERIES["op4_warc"](spark, str(tmp_path)).collect()


def test_no_pages(spark):
    assert said(spark, [])[1] == []
