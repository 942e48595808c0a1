"""The pipeline stage by stage against brute force, on the smallest tables."""

import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from cambium.llm import quality, rules, tokens

from .helpers import hard_docs
from .test_joins import brute, hits

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, items = spark.read.parquet(f"{DIR}/labels.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = step
        out = stage(spark, before, DIR)
        out.write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert step.columns == docs.columns
            got = sorted(r.doc_id for r in step.collect())
            texts = {r.doc_id: r.text for r in before.collect()}
            if k == 0:
                want = [r.doc_id for r in quality.score(spark, before, labels)[0].collect() if r.predicted == 1]
            elif k == 1:
                want = [r.doc_id for r in rules.judge(spark, before, labels)[0].collect() if r.kept]
            elif k == 2:
                want = [i for i, (_, c) in brute(list(texts.items()), 5, 80).items() if i == c]
            else:
                bench = [(r.item_id, r.text) for r in items.collect()]
                judged = {i: hits(t, bench) for i, t in texts.items()}
                want = [i for i, (n, h, _) in judged.items() if not (h and 20 * h >= n)]
            assert got == sorted(want)
    e = tokens.Encoder(tokens.default_path())
    kept = {r.doc_id: np.frombuffer(e.ids([r.text or ""])[0], "<u4").tolist() + [1] for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    seen = {i: 0 for i in kept}
    for r in step.orderBy("doc_id", "start").collect():
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(kept[r.doc_id])
        part = kept[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in kept.items()}
    whole = entry.queries()["pipeline"](spark, DIR)
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, step.select("doc_id", "start", "ids_crc32").collect()))


def test_stages_on_hard_and_empty_tables(spark):
    for docs in (hard_docs(spark), hard_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_registered(spark):
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
