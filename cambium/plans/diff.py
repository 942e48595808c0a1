"""Structural comparison of many pairs of sources in one job: candidates, scores, assignment, classes of change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions import hashing as H
from cambium.operators import matching as M
from cambium.operators import similarity as S
from cambium.sources import javascript

LANES, GATE = 128, 39


def declarations(pairs: DataFrame) -> DataFrame:
    """Declarations of both sides of pairs (pair_id, old, new): pair_id, side, id, and the declaration's columns."""
    sides = pairs.select("pair_id", F.explode(F.create_map(F.lit("old"), "old", F.lit("new"), "new")).alias("side", "source"))
    rows = javascript.rows_of(javascript.analyze(sides, ["declarations"]), "declarations", ["pair_id", "side"])
    rows = rows.withColumn("id", F.struct("pair_id", "decl_ix")).withColumn("size", F.size("hashes"))
    lane = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, k))))
    return M.cut(rows.withColumn("minhash", lane), "declarations")


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """(i1, i2, name_match): pairs of one name and compatible kinds; and others whose sizes and signatures are near.

    A pair that passes the gate agrees in two lanes that make a key (see gate_keys). Where all declarations of both sides
    are fewer pairs than rows with keys, all meet by one key instead.
    """
    a, b = old.alias("a"), new.alias("b")
    kinds = S.compatible_kinds(F.col("a.kind"), F.col("b.kind"))
    named = a.join(b, (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.name") == F.col("b.name")) & kinds).select(F.col("a.id").alias("i1"), F.col("b.id").alias("i2"), F.lit(True).alias("name_match"))
    many = S.gate_keys(F.col("minhash"), LANES, GATE)
    one = F.array(F.struct(F.lit(-1).alias("key"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    n = lambda t, name: t.groupBy("pair_id").agg(F.count(F.lit(1)).alias(name))
    few = n(old, "n").join(n(new, "m"), "pair_id").select("pair_id", (F.col("n") * F.col("m") <= S.gate_key_count(LANES, GATE) * (F.col("n") + F.col("m"))).alias("few"))
    keys = lambda t: t.join(few, "pair_id").select("pair_id", "id", "name", "kind", "size", F.explode(F.when(F.col("few"), one).otherwise(many)).alias("key"))
    x, y = keys(old).alias("a"), keys(new).alias("b")
    same = (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.key") == F.col("b.key"))
    near = x.join(y, same & (F.col("a.name") != F.col("b.name")) & kinds & S.size_window(F.col("a.size"), F.col("b.size")))
    near = near.select(F.col("a.id").alias("i1"), F.col("b.id").alias("i2")).distinct()
    m1, m2 = old.select(F.col("id").alias("i1"), F.col("minhash").alias("m1")), new.select(F.col("id").alias("i2"), F.col("minhash").alias("m2"))
    gated = near.join(m1, "i1").join(m2, "i2").where(H.equal_lanes(F.col("m1"), F.col("m2")) >= GATE).select("i1", "i2", F.lit(False).alias("name_match"))
    return named.unionByName(gated)


#: What a shared string of each context weighs.
CONTEXT_WEIGHT = {"error": 1.2, "path": 1.1, "command": 1.0, "config": 0.9, "endpoint": 1.0, "regular": 0.7}


def weights(decls: DataFrame) -> DataFrame:
    """(side, id, w_strings, w_constants, w_api): maps from what a declaration holds to its weight, by rarity in both files."""
    out = decls.select("side", "id")
    for family, column, value in (("string", "strings", F.col("v")), ("constant", "constants", F.col("v")), ("api", "api", F.col("v.key"))):
        each = decls.select("pair_id", "side", "id", F.explode(column).alias("v")).select("pair_id", "side", "id", value.alias("v"))
        counts = each.groupBy("pair_id", "v").agg(F.count(F.lit(1)).alias("n"))
        weight = H.rarity(family, F.col("n"))
        if family == "string":
            context = H.string_context(F.col("v"))
            weight = weight * F.create_map(*[F.lit(x) for kv in CONTEXT_WEIGHT.items() for x in kv])[context]
        elif family == "constant":
            weight = weight * 0.8
        else:
            weight = weight * 0.6
        own = each.distinct().join(counts, ["pair_id", "v"]).groupBy("side", "id").agg(F.map_from_entries(F.collect_list(F.struct("v", weight.alias("w")))).alias(f"w_{column}"))
        out = out.join(own, ["side", "id"], "left")
    return out


def evidence(a: str, b: str) -> tuple[Column, Column]:
    """(score, count) of what the structs a and b (with weights in a) share. Strings and constants count once, API calls
    for each pair of equal calls, with 0.3 more where their first literal arguments agree."""
    total = lambda values, w: F.aggregate(values, F.lit(0.0), lambda n, v: n + F.coalesce(F.element_at(w, v), F.lit(0.0)))
    strings, constants = (F.array_intersect(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("strings", "constants"))
    calls = F.flatten(F.transform(F.col(f"{a}.api"), lambda x: F.transform(F.filter(F.col(f"{b}.api"), lambda y: x["key"] == y["key"]), lambda y: F.struct(x["key"].alias("key"), F.coalesce(x["arg"] == y["arg"], F.lit(False)).alias("same")))))
    bonus = F.aggregate(calls, F.lit(0.0), lambda n, c: n + F.coalesce(F.element_at(F.col(f"{a}.w_api"), c["key"]), F.lit(0.0)) + F.when(c["same"], 0.3).otherwise(0.0))
    n = F.size(strings) + F.size(constants) + F.size(calls)
    ratio = F.least(F.col(f"{a}.evidence_size"), F.col(f"{b}.evidence_size")) / F.greatest(F.col(f"{a}.evidence_size"), F.col(f"{b}.evidence_size"))
    factor = F.when(ratio > 0.7, 1.0).otherwise(0.8 + 0.2 * ratio)
    score = (total(strings, F.col(f"{a}.w_strings")) + total(constants, F.col(f"{a}.w_constants")) + bonus) / n * factor
    return F.when(n > 0, score).otherwise(0.0), n


@dataclass
class Comparison:
    """declarations; matches: pair_id, i1, i2, name_old, name_new, similarity, classification (unchanged, string_only or
    structural); changes: see compare."""

    declarations: DataFrame
    matches: DataFrame
    changes: DataFrame
    words: DataFrame  # of changed matches: pair_id, i1, i2, and for both sides tokens as words, their lines, and the text


def compare(pairs: DataFrame, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matches, changes) of pairs (pair_id, old, new).

    changes: pair_id, change, name, classification, kind, name_new, similarity, description, path, and of both sides line,
    end_line and snippet; unchanged matches have no row. With fingerprints, the similarity of functions and variables is
    0.7 times the score of shared evidence plus 0.3 times that of their shapes.
    """
    found = comparison(pairs, fingerprints)
    return found.matches, found.changes


def comparison(pairs: DataFrame, fingerprints: bool = False) -> Comparison:
    decls = declarations(pairs)
    old, new = decls.where("side = 'old'"), decls.where("side = 'new'")
    columns = ["id", "pair_id", "name", "kind", "signature", "hashes", "size"]
    l, r = (t.select(*[F.col(c).alias(f"{c}_{s}") for c in columns]) for t, s in ((old, "old"), (new, "new")))
    scored = candidates(old, new).join(l, F.col("i1") == F.col("id_old")).join(r, F.col("i2") == F.col("id_new"))
    score = S.declared_similarity(F.col("kind_old"), F.col("kind_new"), F.col("signature_old"), F.col("signature_new"), F.col("hashes_old"), F.col("hashes_new"))
    scored = scored.withColumn("similarity", score)
    count = F.lit(0)
    if fingerprints:
        scored = with_evidence(scored, decls)
        count = F.col("evidence")
    good = F.col("name_match") | H.acceptance(F.round(F.col("similarity") * H.SCALE, 6).cast("long"), count, F.col("size_old"))
    edges = scored.where(good).select("i1", "i2", "similarity", F.col("pair_id_old").alias("pair_id"), F.col("name_match"), F.col("size_new").alias("size2"), F.col("name_old"), F.col("name_new"), "kind_old")
    matches = M.greedy(edges, [-F.col("similarity"), F.col("i1"), (~F.col("name_match")).cast("int"), F.col("size2")])

    # Names of other declarations read alike where those declarations are matched.
    maps = lambda key: matches.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(f"{key}.decl_ix"), F.concat(F.lit("match "), F.col("i1.decl_ix").cast("string"))))).alias("known"))

    def normal(t: DataFrame, key: str, k: int) -> DataFrame:
        joined = t.join(maps(key), "pair_id")
        word = lambda x: F.concat_ws(" ", x["tag"], F.coalesce(F.element_at("known", x["decl"]), x["text"]))
        plain = F.transform("tokens", lambda x: F.when(x["tag"] == "string", "string").otherwise(word(x)))
        return joined.select(F.col("id").alias(key), F.transform("tokens", word).alias(f"t{k}"), plain.alias(f"plain{k}"), F.transform("tokens", lambda x: x["line"]).alias(f"lines{k}"), F.col("text").alias(f"text{k}"))

    read = matches.join(normal(old, "i1", 1), "i1").join(normal(new, "i2", 2), "i2")
    kind = F.when(F.col("t1") == F.col("t2"), "unchanged").when(F.col("plain1") == F.col("plain2"), "string_only").otherwise("structural")
    read = M.cut(read.withColumn("classification", kind).withColumnRenamed("kind_old", "kind").drop("plain1", "plain2", "size2", "name_match"), "classified")
    matches = read.select("pair_id", "i1", "i2", "name_old", "name_new", "similarity", "classification", "kind")
    return Comparison(decls, matches, _changes(old, new, matches), read.where("classification != 'unchanged'").select("pair_id", "i1", "i2", "t1", "lines1", "text1", "t2", "lines2", "text2"))


def with_evidence(scored: DataFrame, decls: DataFrame) -> DataFrame:
    """scored pairs (i1, i2, similarity) with the similarity of shared evidence mixed in, and evidence: how much of it there is."""
    held = ["strings", "constants", "api", "evidence_size"]
    w = decls.select("side", "id", "kind", *held).join(weights(decls), ["side", "id"])
    mine, other = w.where("side = 'old'").select(F.col("id").alias("i1"), F.struct("kind", *held, "w_strings", "w_constants", "w_api").alias("f1")), w.where("side = 'new'").select(F.col("id").alias("i2"), F.struct("kind", *held).alias("f2"))
    scored = scored.join(mine, "i1").join(other, "i2")
    both = F.col("f1.kind").isin("function", "variable") & F.col("f2.kind").isin("function", "variable")
    score, n = evidence("f1", "f2")
    scored = scored.withColumn("shape", F.col("similarity")).withColumn("evidence", F.when(both, n).otherwise(0))
    return scored.withColumn("similarity", F.when(both, 0.7 * score + 0.3 * F.col("shape")).otherwise(F.col("shape")))


def described(change: Column, kind: Column, old: Column, new: Column, classification: Column, similarity: Column) -> Column:
    """What happened to a declaration, in words. Formats are fixed values."""
    what = F.when(classification == "string_only", F.lit("string-only")).otherwise(F.format_string("structural (%.1f%%)", similarity * 100))
    return (
        F.when(change == "deletion", F.format_string("Removed %s '%s'", kind, old))
        .when(change == "addition", F.format_string("Added %s '%s'", kind, new))
        .when(old != new, F.format_string("%s '%s' (was '%s') — %s", kind, new, old, what))
        .otherwise(F.format_string("%s '%s' — %s", kind, old, what))
    )


def path_of(old: Column, new: Column) -> Column:
    """Where a change stands; one of both names may be null."""
    return F.when(old != new, F.format_string("global.%s->%s", old, new)).otherwise(F.format_string("global.%s", F.coalesce(old, new)))


def _changes(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    place = lambda t, key, s: t.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{s}") for c in ("line", "end_line", "snippet")])
    none = lambda s: [F.lit(None).cast(k).alias(f"{c}_{s}") for c, k in (("line", "int"), ("end_line", "int"), ("snippet", "string"))]
    empty = [F.lit(None).cast("string").alias("classification"), F.lit(None).cast("double").alias("similarity")]
    changed = matches.where("classification != 'unchanged'").join(place(old, "i1", "old"), "i1").join(place(new, "i2", "new"), "i2").withColumn("change", F.lit("modification"))
    here = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("line", "end_line", "snippet")]
    gone = M.unmatched(old, matches, "i1").select("pair_id", F.lit("deletion").alias("change"), F.col("name").alias("name_old"), F.lit(None).cast("string").alias("name_new"), "kind", *empty, *here("old"), *none("new"))
    came = M.unmatched(new, matches, "i2").select("pair_id", F.lit("addition").alias("change"), F.lit(None).cast("string").alias("name_old"), F.col("name").alias("name_new"), "kind", *empty, *none("old"), *here("new"))
    rows = changed.select(*gone.columns).unionByName(gone).unionByName(came)
    text = described(F.col("change"), F.col("kind"), F.col("name_old"), F.col("name_new"), F.col("classification"), F.col("similarity"))
    return rows.select("pair_id", "change", F.coalesce("name_old", "name_new").alias("name"), "classification", "kind", "name_new", "similarity", text.alias("description"), path_of(F.col("name_old"), F.col("name_new")).alias("path"), *[f"{c}_{s}" for s in ("old", "new") for c in ("line", "end_line", "snippet")])


def totals(declarations: DataFrame, matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: total_old, total_new, matched and similarity (matched over the larger side; 1 for two empty sides)."""
    sides = declarations.groupBy("pair_id").agg(F.count_if(F.col("side") == "old").alias("total_old"), F.count_if(F.col("side") == "new").alias("total_new"))
    n = matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matched"))
    rows = pairs.select("pair_id").join(sides, "pair_id", "left").join(n, "pair_id", "left").fillna(0)
    high = F.greatest("total_old", "total_new")
    return rows.withColumn("similarity", F.when(high == 0, 1.0).otherwise(F.col("matched") / high))


def summary(pairs: DataFrame, matches: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pair: matched, renamed, unchanged, string_only, structural, added, removed."""
    m = matches.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("name_old") != F.col("name_new")).alias("renamed"), *[F.count_if(F.col("classification") == c).alias(c) for c in ("unchanged", "string_only", "structural")])
    c = changes.groupBy("pair_id").agg(F.count_if(F.col("change") == "addition").alias("added"), F.count_if(F.col("change") == "deletion").alias("removed"))
    out = pairs.select("pair_id").join(m, "pair_id", "left").join(c, "pair_id", "left")
    return out.select("pair_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("matched", "renamed", "unchanged", "string_only", "structural", "added", "removed")])
