"""The pipeline on a small corpus, every stage against a plain version of itself."""

import random
import zlib

import numpy as np
import pytest

from . import test_ngram_join as near
from . import test_text_scans as scans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    texts = [text(r.randint(30, 90)) for _ in range(60)]
    texts += [texts[4] + " # $ % &" * k for k in (1, 2, 3, 9)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2] + " " + items[0][1], items[3][1] + " " + texts[3], None, "", "short", "same words " * 40]
    rows = [(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, folder).cache()
        after = docs.collect()
        assert docs.columns == columns and set(after) <= set(before)
        ids = sorted(r.doc_id for r in after)
        if name == "quality_rules":
            assert ids == sorted(scans.judged([(r.doc_id, r.text, r.source) for r in before])[0])
        elif name == "ngram_join":
            assert ids == sorted(d for d, _, c in near.brute([(r.doc_id, r.text) for r in before], 5, 80, 100) if d == c)
            assert len(ids) < len(before)
        elif name == "decontamination":
            assert ids == sorted(r.doc_id for r in before if not scans.contaminated(r.text, items)[4])
            assert len(ids) < len(before)
        else:
            assert max(map(ids.count, ids)) <= 3
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text)):
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()] == want
    assert [tuple(r) for r in corpus_pipeline.run(spark, folder).orderBy("start").collect()] == want


def test_empty_corpus(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_corpus(spark, odd, folder, tmp_path):
    """Nulls in any column, blank and long texts, repeated rows and ids, extra columns."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == odd.columns and docs.count() > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.count() == docs.count() and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
