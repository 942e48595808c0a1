import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cambium.functions import hashing as H
from cambium.operators import matching as M
from cambium.operators import ordered as O
from cambium.operators import similarity as S


def sequential(edges):
    used1, used2, out = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in edges):
        if a not in used1 and b not in used2:
            used1.add(a)
            used2.add(b)
            out.add((a, b, -s))
    return out


def test_greedy_rounds_equal_the_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        edges = list({(rng.randrange(9), rng.randrange(9)): rng.randrange(4) for _ in range(40)}.items())
        edges = [(a, b, s) for (a, b), s in edges]
        got = M.greedy(spark.createDataFrame(edges, "i1 long, i2 long, score long"), [-F.col("score")])
        assert {tuple(r) for r in got.collect()} == sequential(edges)


def test_greedy_of_nothing(spark):
    assert M.greedy(spark.createDataFrame([], "i1 long, i2 long, score long"), [-F.col("score")]).count() == 0


def test_reciprocal_best(spark):
    rows = [(1, 1, 9000), (1, 2, 5000), (2, 1, 7000), (2, 2, 8800), (3, 3, 7300), (3, 4, 7000), (4, 5, 7100)]
    got = {r.i1: (r.i2, r.decision, r.confidence) for r in M.reciprocal_best(spark.createDataFrame(rows, "i1 long, i2 long, score long")).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "accepted", 2: "accepted", 3: "abstained", 4: "abstained"}
    assert got[1] == (1, "accepted", "high") and got[3][2] == "low"


def test_gate_is_lossless(spark):
    rng = random.Random(5)
    rows = [(i, sorted({rng.randrange(60) for _ in range(20)})) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<long>").select("id", H.minhash(F.col("features"), 16).alias("minhash"))
    sig = {r.id: r.minhash for r in df.collect()}
    want = {(a, b) for a in sig for b in sig if a < b and sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) >= 5}
    assert {(r.i1, r.i2) for r in S.gate_pairs(df, 16, 5).collect()} == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=12), st.lists(st.integers(1, 300), max_size=12))
def test_size_window(spark, left, right):
    l = spark.createDataFrame([(i, n) for i, n in enumerate(left)], "id long, size long")
    r = spark.createDataFrame([(i, n) for i, n in enumerate(right)], "id long, size long")
    got = {x.id: x.partners for x in S.partners_in_window(l, r).collect()}
    assert got == {i: sum(max(1, n // 2) <= m <= n * 3 // 2 for m in right) for i, n in enumerate(left)}


def test_asof_ties_and_misses(spark):
    q = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 9, 3)], "k string, at long, q long")
    p = spark.createDataFrame([("a", 3, "x"), ("a", 3, "y"), ("a", 7, "z")], "k string, at long, v string")
    got = sorted((r.q, r.found, r.v) for r in O.asof_rows(q, p, ["k"], "at").collect() if r.v is not None)
    assert got == [(1, 3, "x"), (1, 3, "y")]
    assert {r.q: r.found for r in O.asof_position(q, p.select("k", "at"), ["k"], "at").collect()} == {1: 3, 2: None, 3: None}


def test_simhash_and_scores(spark):
    df = spark.createDataFrame([([5, 7, -1],), ([],)], "f array<long>")
    got = [r[0] for r in df.select(H.simhash(F.col("f"))).collect()]
    votes = [sum(1 if (x >> k) & 1 else -1 for x in (5, 7, -1)) for k in range(64)]
    want = sum(1 << k for k, v in enumerate(votes) if v >= 0)
    assert got == [want - (1 << 64) if want >> 63 else want, None]


def test_digest_id_tells_parts_apart(spark):
    df = spark.range(1).select(H.digest_id("d", F.lit("ab"), F.lit("c")).alias("x"), H.digest_id("d", F.lit("a"), F.lit("bc")).alias("y"))
    r = df.first()
    assert r.x != r.y and len(r.x) == 64


@pytest.mark.parametrize(("least", "most"), [(0, 2_000_000), (560, 10)])
def test_greedy_takes_long_chains_and_large_components(spark, least, most):
    """One chain of edges, whose best is last: whole components in order, and rounds for those with over `most` edges."""
    edges = [(k, k, 2 * k) for k in range(300)] + [(k, k + 1, 2 * k + 1) for k in range(299)]
    edges = [e for e in edges if e[2] > least]
    got = M.greedy(spark.createDataFrame(edges, "i1 long, i2 long, s long"), [-F.col("s")], most_edges=most)
    assert {tuple(r) for r in got.collect()} == sequential(edges)


def test_asof_spread_equals_one_task_a_key(spark):
    q = spark.range(2000).selectExpr("id % 2 AS k", "id * 3 AS at", "id AS q")
    p = spark.range(900).selectExpr("id % 2 AS k", "id * 7 AS at")
    both = [sorted(map(tuple, O.asof_position(q, p, ["k"], "at", spread=s).select("k", "q", "found").collect()), key=repr) for s in (False, True)]
    assert both[0] == both[1]


def test_deep_scopes_and_wide_intervals(spark):
    chain = spark.range(700).selectExpr("id AS scope", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    closure = O.scope_closure(chain)
    assert closure.count() == 700 * 701 // 2 and closure.where("scope = 699 AND ancestor = 0").first().distance == 699
    with pytest.raises(ValueError):
        O.scope_closure(spark.createDataFrame([(1, 2), (2, 1)], "scope long, parent long"))
    intervals = spark.createDataFrame([(1, 0, 1 << 40, 0), (2, 5, 6, 1), (3, 100, 1 << 39, 1), (4, 7, 7, 9)], "interval long, lo long, hi long, depth long")
    found = {r["at"]: r.interval for r in O.innermost(spark.createDataFrame([(0,), (5,), (6,), (100,), ((1 << 39) - 1,), (1 << 39,), (1 << 40,)], "at long"), intervals).collect()}
    assert found == {0: 1, 5: 2, 6: 1, 100: 3, (1 << 39) - 1: 3, 1 << 39: 1, 1 << 40: None}


def test_feature_hash_equals_the_parser_side(spark):
    from cambium.functions.js_analysis import digest_id, hash64

    row = spark.range(1).select(H.feature_hash("a", F.lit("é"), F.lit(3)).alias("h"), H.digest_id("node", F.lit(None).cast("string"), F.lit(0), F.lit("x")).alias("d")).first()
    assert row.h == hash64("a", "é", "3") and row.d == digest_id("node", None, 0, "x")


def test_copies_in_the_other_version_are_matched(spark, tmp_path):
    """Each copy is a row of its own: copies take each other first, and what is left goes to what resembles it."""
    from cambium.plans import queries

    lines = lambda a, b: "\n".join(f"line {k}" for k in range(a, b))
    texts = {0: lines(0, 20), 1: lines(0, 20), 2: lines(30, 50), 4: lines(30, 50), 6: lines(30, 50), 7: lines(30, 50), 9: lines(30, 51), 11: lines(31, 51), 13: lines(60, 80), 15: lines(60, 80), 20: lines(60, 81), 21: "", 22: None}
    texts |= {100 + 2 * k: lines(200 + k // 3, 230) for k in range(12)} | {101 + 2 * k: lines(201 + k // 2, 231) for k in range(9)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {k: set(t.split("\n")) for k, t in texts.items() if t}
    rows = queries.line_hashes(spark, str(tmp_path)).select("id", H.minhash(F.col("features"), 16).alias("m"))
    lanes = {r.id: r.m for r in rows.collect()}
    gated = lambda a, b: sum(x == y for x, y in zip(lanes[a], lanes[b], strict=True)) >= 5
    edges = [(a, b, len(sets[a] & sets[b]) * 10_000 // len(sets[a] | sets[b])) for a in sets for b in sets if a % 2 == 0 and b % 2 == 1 and gated(a, b)]
    taken = {x for a, b, _ in sequential(edges) for x in (a, b)}
    got = {(r.id, r.change) for r in queries.added_removed(spark, str(tmp_path)).collect()}
    assert {0, 1, 2, 4, 7, 20} <= taken and got == {(k, "added" if k % 2 else "removed") for k in sets if k not in taken}
