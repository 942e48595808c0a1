import random
import re

import pytest

from cambium.llm import jaccard, winnow
from cambium.llm.common import Scratch
from cambium.llm.components import components

from .helpers import empty_docs, hard_docs


def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, size, copies, change):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    return [" ".join(w if rng.random() > change else f"x{rng.randrange(400)}" for w in base) for _ in range(copies)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = ["", None, "a", "a b", "A  B", "a b c", " "]
    for size in (9, 12, 40, 150, 300):
        texts += family(rng, size, 12, 0.01) + family(rng, size, 8, 0.03) + [f"{t} {shared}" for t in family(rng, size, 5, 0.02)]
    texts += texts[20:25]
    rows = list(enumerate(texts))
    got = jaccard.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, n, percent)


def test_links_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, "a b c d e f"]
    for size in (40, 150):
        texts += family(rng, size, 8, 0.01) + family(rng, size, 6, 0.03)
    texts += texts[5:9]
    rows = list(enumerate(texts))
    links, members = jaccard.jaccard_links(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    members = members.collect()
    assert len(members) == len(rows)
    of = {r.doc_id: r["class"] for r in members}
    got = {(r.a, r.b) for r in links.collect()}
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows if len(w := (t or "").split()) >= 5}
    want = {tuple(sorted((of[a], of[b]))) for a in sets for b in sets if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and got == want and all((of[a] == of[b]) == (sets[a] == sets[b]) for a in sets for b in sets)


def test_ids_that_repeat_with_unlike_texts(spark):
    rng = random.Random(8)
    x, y, z = (" ".join(rng.choices("abcdefghij", k=60)) for _ in range(3))
    docs = spark.createDataFrame([(1, x), (1, y), (2, y), (3, z), (3, z), (None, x)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(spark, docs).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(spark, docs).collect()) == sorted([(0, x), (1, x), (1, y), (3, z)])


def test_jaccard_on_hard_tables(spark):
    docs = hard_docs(spark)
    got = jaccard.jaccard_components(spark, docs).collect()
    assert len(got) == docs.count()
    kept = jaccard.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {0, 2, 3, 4, 5} <= set(ids) and 14 not in ids
    assert jaccard.jaccard_components(spark, empty_docs(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items):
    w = WORD.findall((text or "").encode().lower())
    hit, names = set(), set()
    for name, item in items:
        x = WORD.findall((item or "").encode().lower())
        size = min(13, len(x))
        for a in range(len(x) - size + 1) if size else ():
            for p in range(len(w) - size + 1):
                if w[p : p + size] == x[a : a + size]:
                    hit |= set(range(p, p + size))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_overlaps_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(winnow, "BLOCK_WORDS", block)
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    items = [(i, say(rng.choice([3, 8, 13, 14, 30]))) for i in range(14)] + [(99, ""), (98, None), (97, "a A a a a a a a a a a a a a a a")]
    docs = [(i, f"{say(rng.randrange(40))} {rng.choice(items)[1] or ''}! {say(rng.randrange(20))}") for i in range(60)] + [(100, None), (101, ""), (102, "A-a " * 9)]
    out, (n, spans, names) = winnow.overlaps(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    got = {r.doc_id: (r[n], sum(s.end - s.start for s in r[spans]), r[names]) for r in out.collect()}
    assert got == {i: hits(t, items) for i, t in docs}


def test_overlaps_on_hard_tables(spark):
    docs = hard_docs(spark)
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (None, "unicode")], "item_id long, text string")
    out = winnow.decontaminate(spark, docs, items)
    assert out.columns == docs.columns and 4 not in {r.doc_id for r in out.collect()}
    assert out.count() == docs.count() - 3
    assert winnow.decontaminate(spark, docs, items.limit(0)).count() == docs.count()
    assert winnow.decontaminate(spark, empty_docs(spark), items).count() == 0


def test_repeated_words_and_copies_of_items(spark):
    """A document of a million equal words against a long item of them, and one item in very many copies."""
    docs = spark.createDataFrame([(1, "same " * 1_000_000), (2, "one " + " ".join(f"w{k}" for k in range(20))), (3, "other")], "doc_id long, text string")
    items = [(10, "same " * 5_000), (11, "same " * 13)] + [(k, " ".join(f"w{k}" for k in range(20))) for k in range(1000, 6000)]
    out, (n, spans, names) = winnow.overlaps(spark, docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    got = {r.doc_id: (r[n], [(x.start, x.end) for x in r[spans]], len(r[names])) for r in out.collect()}
    assert got == {1: (1_000_000, [(0, 1_000_000)], 2), 2: (21, [(1, 21)], 5000), 3: (1, [], 0)}


def test_long_items_are_taken_in_segments(spark, monkeypatch):
    monkeypatch.setattr(winnow, "SEGMENT_WORDS", 7)
    item = " ".join(f"w{k}" for k in range(60))
    docs = [(k, " ".join(f"w{j}" for j in range(k, k + 13))) for k in range(48)] + [(99, " ".join(f"w{j}" for j in range(12)))]
    out, (n, spans, names) = winnow.overlaps(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"), ["doc_id"])
    assert {r.doc_id: (sum(x.end - x.start for x in r[spans]), r[names]) for r in out.collect()} == {k: (13, ["5"]) for k in range(48)} | {99: (0, [])}


@pytest.mark.parametrize("name", ["op5_ngram_jaccard_join", "op9_benchmark_decontamination"])
def test_joins_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, folder)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
