"""What keeps many texts out of one task, one worker's memory and the driver."""

import pyarrow as pa
from pyspark.sql import functions as F

from cambium.operators import graph, integrity
from cambium.operators import matching as M
from cambium.operators import similarity as S
from cambium.operators.scratch import cut
from cambium.plans import diff, lineage
from cambium.sources import javascript


def _pairs(spark, n):
    """Of one partition, as of one small file."""
    text = lambda name, step: F.format_string("function " + name + "%d(x){return x+%d}\nfunction twin(){go(" + step + ")}", "pair_id", "pair_id")
    return spark.range(n).coalesce(1).withColumnRenamed("id", "pair_id").select("pair_id", text("f", "1").alias("old"), text("g", "2").alias("new"))


def _tasks(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_texts_of_one_file_are_dealt_to_many_tasks(spark):
    sources = _pairs(spark, 64).select("pair_id", F.col("old").alias("source"))
    assert _tasks(sources) == 1
    assert _tasks(javascript.analyze(sources)) > 1
    assert _tasks(javascript.outline(sources)) > 1


def test_slices_hold_all_texts_in_order_and_few_characters():
    texts = ["x"] * 150 + [None, "y" * javascript.SLICE_CHARS, "z" * 3 * javascript.SLICE_CHARS, ""] + ["é" * 1000] * 300
    parts = list(javascript.slices(pa.record_batch({"source": pa.array(texts, pa.string())}), 0))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= javascript.SLICE_ROWS and sum(len(t or "") for t in p.column(0).to_pylist()) <= javascript.SLICE_CHARS for p in parts)
    assert list(javascript.slices(pa.record_batch({"source": pa.array([], pa.string())}), 0)) == []


def test_tables_that_cut_lineage_are_not_broadcast(spark):
    """Equal rows are a few bytes of a file, and as many rows in the driver."""
    a, b = cut(spark.range(5000).withColumn("x", F.array(F.lit("same"))), "a"), cut(spark.range(5000).withColumn("y", F.lit("same")), "b")
    assert "Broadcast" not in a.join(b.where("y = 'same'").select("id", "y"), "id")._jdf.queryExecution().toString()
    assert a.join(b, "id").count() == 5000


def test_small_pairs_meet_by_one_key_with_the_same_candidates(spark, monkeypatch):
    decls = diff.declarations(_pairs(spark, 8))
    old, new = decls.where("side = 'old'"), decls.where("side = 'new'")
    found = lambda: sorted(map(str, diff.candidates(old, new).collect()))
    few = found()
    assert any("name_match=False" in x for x in few)
    monkeypatch.setattr(S, "gate_key_count", lambda lanes, least: 0)
    assert found() == few


def test_contexts_of_one_file_are_made_in_many_tasks(spark):
    rows = lineage.contexts(_pairs(spark, 64))
    assert len(rows.inputFiles()) > 1
    assert rows.select("pair_id", "side").distinct().count() == 128


def test_rules_of_an_analysis_share_their_joins(spark):
    """A join for each rule is a plan that the driver's memory doesn't hold."""
    which = ["nodes", "scopes", "symbols", "references", "calls"]
    made = cut(javascript.analyze(_pairs(spark, 12).select("pair_id", F.col("old").alias("source")), which), "made")
    tables = {t: javascript.rows_of(made, t, ["pair_id"]) for t in which}

    def spoil(table, column, where, value):
        tables[table] = tables[table].withColumn(column, F.when(F.expr(where), value).otherwise(F.col(column)))

    spoil("scopes", "end_byte", "pair_id = 1 AND scope_ix = 1", F.lit(99_999))
    spoil("scopes", "kind", "pair_id = 2 AND scope_ix = 0", F.lit("block"))
    spoil("symbols", "scope_ix", "pair_id = 3 AND symbol_ix = 0", F.lit(99))
    spoil("symbols", "node_ix", "pair_id = 4 AND symbol_ix = 0", F.lit(9999))
    spoil("symbols", "scope_ix", "pair_id = 5 AND symbol_ix = 0", F.lit(2))
    spoil("symbols", "reference_count", "pair_id = 6 AND symbol_ix = 0", F.lit(7))
    spoil("references", "resolution", "pair_id = 7 AND symbol_ix IS NOT NULL", F.lit("unresolved"))
    spoil("calls", "callee_ref", "pair_id = 8", F.lit(99))
    tables["symbols"] = tables["symbols"].unionByName(tables["symbols"].where("pair_id = 9 AND symbol_ix = 0"))
    found = integrity.violations(tables, ["pair_id"])
    rules = {}
    for r in found.collect():
        rules.setdefault(r.pair_id, set()).add(r.rule)
    assert {1: {"scope leaves its parent", "scope's identity"}, 4: {"symbol without a node"}, 7: {"resolution and symbol disagree"}, 9: {"symbols repeat a row number", "symbols share a node"}}.items() <= rules.items()
    want = {2: "global scope", 3: "symbol without a scope", 5: "symbol outside its scope", 6: "range of another length", 8: "call of no reference"}
    assert all(rule in rules[k] for k, rule in want.items()) and set(rules) == set(range(1, 10))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8


def test_frequent_keys_meet_in_blocks_with_the_same_pairs(spark):
    """All rows share keys, in one block and in many; candidates are neither shuffled nor joined with the rows again."""
    rows = spark.range(120).select("id", F.array([F.lit(k).cast("long") if k < 6 else F.col("id") % (k - 3) for k in range(16)]).alias("minhash"), F.sequence(F.lit(1).cast("long"), F.col("id") + 1).alias("features"))
    rows = cut(rows.union(rows.selectExpr("id + 1000", "transform(minhash, x -> if(x < 3, null, x))", "features")), "rows")
    held = {r.id: r for r in rows.collect()}
    want = {(a, b): sum(x == y for x, y in zip(held[a].minhash, held[b].minhash, strict=True)) for a in range(120) for b in range(a + 1, 120)}
    for block_rows in (2000, 7):
        pairs = S.gate_pairs(rows, 16, 5, block_rows=block_rows)
        assert sorted((r.i1, r.i2, r.equal_lanes) for r in pairs.collect()) == sorted((*k, n) for k, n in want.items() if n >= 5)
    scored = S.scored_pairs(rows, 16, 5)
    assert {(r.i1, r.i2, r.similarity_bps, r.size1) for r in scored.collect()} == {(a, b, (a + 1) * 10_000 // (b + 1), a + 1) for (a, b), n in want.items() if n >= 5}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate [i1" not in plan


def test_more_lanes_than_a_word_has_bits(spark):
    lanes = [F.when(F.col("id") % (k % 9 + 2) < 2, F.lit(k)).otherwise(F.col("id") + 1000 * k).cast("long") for k in range(70)]
    rows = cut(spark.range(1, 40).select("id", F.array(lanes).alias("minhash")), "rows")
    held = {r.id: r.minhash for r in rows.collect()}
    want = {(a, b) for a in held for b in held if a < b and sum(x == y for x, y in zip(held[a], held[b], strict=True)) >= 30}
    assert want and {(r.i1, r.i2) for r in S.gate_pairs(rows, 70, 30).collect()} == want


def test_only_rows_of_unlike_sides_meet(spark):
    rows = cut(spark.range(120).select("id", F.array([F.lit(k).cast("long") if k < 6 else F.col("id") % (k - 3) for k in range(16)]).alias("minhash"), F.sequence(F.lit(1).cast("long"), F.col("id") + 1).alias("features")), "rows")
    every = {(r.i1, r.i2): r.similarity_bps for r in S.scored_pairs(rows, 16, 5).collect()}
    want = sorted((a, b, n) if a % 3 == 0 else (b, a, n) for (a, b), n in every.items() if (a % 3 == 0) != (b % 3 == 0))
    for block_rows in (2000, 7):
        pairs = S.gate_pairs(rows, 16, 5, ["id"], block_rows, F.col("id") % 3 == 0)
        assert sorted((r.i1, r.i2) for r in pairs.collect()) == [w[:2] for w in want]
    assert sorted((r.i1, r.i2, r.similarity_bps) for r in S.scored_pairs(rows, 16, 5, first=F.col("id") % 3 == 0).collect()) == want


def test_best_edges_first_equal_the_loop_and_ties_make_few_rounds(spark, monkeypatch):
    """Each old row ties with each new one: rounds of mutual best edges took one pair each."""
    seen, real = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df, name: seen.append(name) or real(df, name))
    monkeypatch.setattr(graph, "components", None)
    monkeypatch.setattr(M, "LOOKED_AT", 500)
    tied = spark.range(1600).selectExpr("id % 40 AS i1", "id DIV 40 AS i2", "if(id % 40 + id DIV 40 = 3, 9, 5) AS s")
    got = {(r.i1, r.i2, r.s) for r in M.best_first(tied, [-F.col("s")], most_edges=300).collect()}
    # Edges of 9 first, then the least of both sides.
    assert got == {(k, 3 - k, 9) for k in range(4)} | {(k, k, 5) for k in range(4, 40)}
    assert seen.count("won") <= 8
    for limit in (0, 500_000):
        monkeypatch.setattr(M, "HELD_ENDS", limit)
        named = tied.selectExpr("struct(i1 AS x) AS i1", "struct(i2 AS x) AS i2", "s")
        assert {(r.i1.x, r.i2.x, r.s) for r in M.best_first(named, [-F.col("s")], most_edges=700).collect()} == got


def test_added_removed_seeks_no_components_and_pairs_no_rows_of_one_version(spark, tmp_path, monkeypatch):
    """Near copies, all alike: components and pairs within a version cost more than the match."""
    from cambium.plans import queries

    monkeypatch.setattr(graph, "components", None)
    written, real = {}, M.cut
    monkeypatch.setattr(M, "cut", lambda df, name: written.setdefault(name, real(df, name)))
    lines = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("line "), k.cast("string"))), F.concat(F.lit("own "), (F.col("doc_id") % 30).cast("string")))
    spark.range(91).withColumnRenamed("id", "doc_id").withColumn("text", lines).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries.added_removed(spark, str(tmp_path)).collect()] == [(90, "removed")]
    # All copies of a text are of one version, 46 rows old and 45 new, so the first set has one too many.
    assert {(r.i1 % 2, r.i2 % 2) for r in written["across"].collect()} == {(0, 1)}
