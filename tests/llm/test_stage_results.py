"""What each stage of the pipeline makes of hard tables, and of texts of megabytes."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cambium.llm import huffman, quality, rules, tokens, winnow

from .helpers import hard_docs
from .test_joins import WORD, hits

DIR = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_classifier_judges_equal_texts_alike_and_keeps_whole_rows(spark):
    docs = hard_docs(spark)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    known = docs.unionByName(spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id > 30"), allowMissingColumns=True)
    out, names = quality.score(spark, known, labels)
    verdicts = {}
    for r in out.collect():
        verdicts.setdefault(r["text"] or "", set()).add((r[names[1]], r[names[2]]))
    assert all(len(v) == 1 for v in verdicts.values())
    good = {t for t, v in verdicts.items() if next(iter(v))[1] == 1}
    assert 0 < len(good) < len(verdicts)
    want = Counter(tuple(r) for r in known.collect() if (r["text"] or "") in good)
    assert rows(STAGES["quality classifier"](spark, known, DIR)) == want


def test_rules_drop_texts_of_few_words(spark):
    # Every text of the table has fewer than 50 words, or repeats one word 3,000 times.
    assert rows(STAGES["quality rules"](spark, hard_docs(spark), DIR)) == Counter()


def test_near_duplicates_keep_rows_without_words_or_id(spark):
    docs = hard_docs(spark)
    first, want = set(), Counter()
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        if r.doc_id is None or not (r.text or "").strip(" \t\n"):
            want[tuple(r)] += 1
        elif r.text not in first:
            first.add(r.text)
            want[tuple(r)] += 1
    assert rows(STAGES["n-gram Jaccard join"](spark, docs, DIR)) == want


def test_decontamination_keeps_repeats_and_rows_without_words(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    passage = max((t for _, t in items if t), key=len)
    docs = hard_docs(spark)
    dirty = docs.where("doc_id = 4").limit(1)
    docs = docs.unionByName(spark.createDataFrame([tuple(passage if c == "text" else 99 if c == "doc_id" else v for c, v in zip(docs.columns, dirty.first(), strict=True))] * 2, docs.schema))
    want = Counter()
    for r in docs.collect():
        n, h, _ = hits(r.text, items)
        if not (h and 20 * h >= n):
            want[tuple(r)] += 1
    assert not any(99 in r for r in want)
    assert rows(STAGES["benchmark decontamination"](spark, docs, DIR)) == want


def window_hits(text, items):
    """Words, and words in a shared window, as hits() has them, by look-ups: for texts too long for it."""
    w, hit = WORD.findall(text.encode().lower()), set()
    wanted = {}
    for _, item in items:
        x = WORD.findall((item or "").encode().lower())
        size = min(13, len(x))
        for a in range(len(x) - size + 1) if size else ():
            wanted.setdefault(size, set()).add(tuple(x[a : a + size]))
    for size, windows in wanted.items():
        for p in range(len(w) - size + 1):
            if tuple(w[p : p + size]) in windows:
                hit |= set(range(p, p + size))
    return len(w), len(hit)


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of a megabyte, a copy, a near copy, an unlike one, and one with a benchmark passage amid it."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(60_000)}" for _ in range(160_000)]
    near = [w if rng.random() > 0.005 else f"y{rng.randrange(9)}" for w in base]
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    passage = max((r.text for r in items if r.text), key=len)
    other = [f"z{rng.randrange(60_000)}" for _ in range(150_000)]
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(other), " ".join([*other[:100], passage, *other[75_000:]])]
    return spark.createDataFrame([(k + 10, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string"), texts, items


def test_long_texts_in_filters(spark, long_docs):
    docs, texts, items = long_docs
    assert sorted(r.doc_id for r in STAGES["n-gram Jaccard join"](spark, docs, DIR).collect()) == [10, 13, 14]
    assert sorted(r.doc_id for r in STAGES["benchmark decontamination"](spark, docs, DIR).collect()) == [10, 11, 12, 13, 14]
    spark_items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    out, (n_words, spans, _) = winnow.overlaps(spark, docs, spark_items, ["doc_id"])
    got = {r[0]: (r[1], r[2]) for r in out.select("doc_id", n_words, winnow.n_hit(spans)).collect()}
    assert got == {k + 10: window_hits(t, [(r.item_id, r.text) for r in items]) for k, t in enumerate(texts)}
    assert got[14][1] >= 13
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, names = rules.judge(spark, docs, none, ["doc_id"])
    assert {r["doc_id"]: (r[names["n_words"]], r[names["word_chars"]]) for r in out.collect()} == {k + 10: (len(t.split()), sum(map(len, t.split()))) for k, t in enumerate(texts)}


def test_long_texts_as_tokens(spark, long_docs, tmp_path):
    docs, texts, _ = long_docs
    e = tokens.Encoder(tokens.default_path())
    want = {k + 10: np.frombuffer(x, "<u4") for k, x in enumerate(e.ids(texts))}
    got = {k: [] for k in want}
    for r in STAGES["packing"](spark, docs, DIR).collect():
        assert r.doc_tokens == len(want[r.doc_id]) + 1 and r.offset + r.length <= 2048
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for k, pieces in got.items():
        ids = np.append(want[k], 1).astype("<u4")
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)
    folder = f"file://{tmp_path}/long"
    huffman.write_corpus(spark, docs, folder, end_id=0)
    back = {r.doc_id: bytes(r.ids) for r in huffman.read_corpus(spark, folder).collect()}
    assert back == {k: np.append(x, 0).astype("<u4").tobytes() for k, x in want.items()}
