"""What must hold in the tables of an analysis: rows that break a rule. A sound analysis has none."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions import hashing as H

#: The role of the reference that each kind of call is made through; None: any.
CALLEE = {"direct": "call", "construct": "construct"}


def _broken(rows: DataFrame, keys: list[str], row: str, rules: dict[str, Column]) -> DataFrame:
    """(keys..., rule, row) of every rule whose condition a row meets. All rules of a table take one pass."""
    each = [F.when(c, F.struct(F.lit(rule).alias("rule"), F.col(row).cast("long").alias("row"))) for rule, c in rules.items()]
    return rows.select(*keys, F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))


def violations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys..., rule, row), each once, over nodes, scopes, symbols, references and calls of files named by keys.

    Every pair of tables meets once, and all rules read the rows that met there: a plan with a join for each rule is more
    than the driver's memory holds.
    """
    nodes, scopes, symbols, references, calls = (tables[t] for t in ("nodes", "scopes", "symbols", "references", "calls"))
    has = lambda c: F.coalesce(c, F.lit(False))

    parent = nodes.select(*keys, F.col("node_ix").alias("parent_ix"), F.col("start_byte").alias("lo"), F.col("end_byte").alias("hi"), F.col("node_id").alias("up_id"), F.lit(True).alias("inside"))
    w = Window.partitionBy(*keys, "parent_ix").orderBy("node_ix")
    placed = nodes.withColumn("nth", F.row_number().over(w) - 1).join(parent, [*keys, "parent_ix"], "left").withColumn("inside", has(F.col("inside")))
    placed = placed.withColumn("other_id", F.col("node_id") != H.digest_id("node", F.col("up_id"), F.col("child_ordinal"), F.col("kind"), F.col("flags")))
    found = [_broken(placed, keys, "node_ix", {
        "node's identity": F.col("inside") & F.col("other_id"),
        "root": F.col("parent_ix").isNull() & (F.col("other_id") | (F.col("kind") != "program") | (F.col("start_byte") != 0)),
        "flags": F.expr("flags < 0 OR flags > 3 OR (flags & 1 = 1) != named"),
        "span ends before it starts": F.expr("start_byte > end_byte"),
        "parent stands after its child": F.expr("parent_ix >= node_ix"),
        "second root": F.expr("parent_ix IS NULL AND node_ix > 0"),
        "child leaves its parent": F.col("inside") & F.expr("start_byte < lo OR end_byte > hi"),
        "ordinals have gaps": F.col("parent_ix").isNotNull() & (F.col("nth") != F.col("child_ordinal")),
    })]

    up = scopes.select(*keys, F.col("scope_ix").alias("parent_ix"), F.col("depth").alias("up"), F.col("start_byte").alias("lo"), F.col("end_byte").alias("hi"), F.col("scope_id").alias("up_id"), F.lit(True).alias("held"))
    held = scopes.join(up, [*keys, "parent_ix"], "left").withColumn("held", has(F.col("held")))
    scope_id = H.digest_id("scope", F.col("up_id"), F.col("kind"), F.col("depth"), F.col("start_byte"), F.col("end_byte"))
    found.append(_broken(held, keys, "scope_ix", {
        "depth is not the parent's plus one": F.col("held") & F.expr("depth != up + 1"),
        "scope leaves its parent": F.col("held") & F.expr("start_byte < lo OR end_byte > hi"),
        "scope's identity": F.col("held") & (F.col("scope_id") != scope_id),
        "global scope": F.expr("parent_ix IS NULL AND (kind != 'global' OR depth != 0 OR scope_ix != 0)"),
        "scope stands before its parent": F.expr("parent_ix >= scope_ix"),
    }))

    # What rows of a node's own table have met goes with them to the nodes and scopes.
    held_by = references.where("symbol_ix IS NOT NULL").groupBy(*keys, "symbol_ix").agg(F.count(F.lit(1)).alias("n"))
    bound = symbols.select(*keys, "symbol_ix", "symbol_id", "node_ix", "scope_ix", "kind", "reference_count").join(held_by, [*keys, "symbol_ix"], "left")
    bound = bound.select(*keys, F.lit("symbol").alias("table"), F.col("symbol_ix").alias("row_ix"), "node_ix", "scope_ix", F.col("symbol_id").alias("row_id"), F.col("kind").alias("what"), F.expr("coalesce(n, 0) != reference_count").alias("other_length"))
    own = symbols.select(*keys, "symbol_ix", "reference_first", "reference_count", F.col("name").alias("bound"))
    used = references.join(own, [*keys, "symbol_ix"], "left").select(
        *keys, F.lit("reference").alias("table"), F.col("ref_ix").alias("row_ix"), "node_ix", "scope_ix", F.col("ref_id").alias("row_id"), F.col("role").alias("what"),
        F.expr("ref_ix < reference_first OR ref_ix >= reference_first + reference_count").alias("out_of_range"), F.expr("name != bound").alias("other_name"), F.expr("(resolution = 'resolved') != (symbol_ix IS NOT NULL)").alias("unsure"),
    )
    ids = references.select(*keys, F.col("ref_ix").alias("callee_ref"), "ref_id", F.col("role").alias("callee_role"), F.col("symbol_ix").alias("bound"), F.lit(True).alias("through"))
    names = symbols.select(*keys, F.col("symbol_ix").alias("target_symbol"), F.col("symbol_id").alias("target_id"))
    want = F.create_map(*[F.lit(x) for kv in CALLEE.items() for x in kv])[F.col("kind")]
    shape = (
        F.when(F.col("kind").isin(*CALLEE), F.col("callee_ref").isNull() | F.col("property").isNotNull() | (F.col("callee_role") != want))
        .when(F.col("kind") == "member", F.col("property").isNull() | F.col("target_symbol").isNotNull())
        .otherwise(F.col("callee_ref").isNotNull() | F.col("target_symbol").isNotNull() | F.col("property").isNotNull())
    )
    called = calls.join(ids, [*keys, "callee_ref"], "left").join(names, [*keys, "target_symbol"], "left").select(
        *keys, F.lit("call").alias("table"), F.col("call_ix").alias("row_ix"), "node_ix", F.col("call_id").alias("row_id"), F.col("kind").alias("what"), "ref_id", "target_id", "property", shape.alias("other_shape"),
        (F.col("callee_ref").isNotNull() & F.col("through").isNull()).alias("no_reference"), F.expr("target_symbol != bound").alias("other_target"),
    )
    at = nodes.select(*keys, "node_ix", "node_id", F.col("start_byte").alias("from_byte"), F.col("end_byte").alias("to_byte"), F.lit(True).alias("at_node"))
    box = scopes.select(*keys, "scope_ix", F.col("start_byte").alias("lo"), F.col("end_byte").alias("hi"), F.lit(True).alias("in_scope"))
    rows = bound.unionByName(used, allowMissingColumns=True).unionByName(called, allowMissingColumns=True)
    rows = rows.join(at, [*keys, "node_ix"], "left").join(box, [*keys, "scope_ix"], "left").withColumn("at_node", has(F.col("at_node"))).withColumn("in_scope", has(F.col("in_scope")))
    is_ = lambda t: F.col("table") == t
    both, outside = F.col("at_node") & F.col("in_scope"), F.expr("from_byte < lo OR to_byte > hi")
    call_id = H.digest_id("call", F.col("node_id"), F.col("what"), F.col("ref_id"), F.col("target_id"), F.col("property"))
    found.append(_broken(rows, keys, "row_ix", {
        "symbol outside its scope": is_("symbol") & both & outside,
        "symbol's identity": is_("symbol") & both & (F.col("row_id") != H.digest_id("symbol", F.col("node_id"), F.col("what"))),
        "range of another length": F.col("other_length"),
        "symbol without a scope": is_("symbol") & ~F.col("in_scope"),
        "symbol without a node": is_("symbol") & ~F.col("at_node"),
        "reference outside its scope": is_("reference") & both & outside,
        "reference's identity": is_("reference") & both & (F.col("row_id") != H.digest_id("reference", F.col("node_id"), F.col("what"))),
        "reference outside its symbol's range": F.col("out_of_range"),
        "reference without a node": is_("reference") & ~F.col("at_node"),
        "resolution and symbol disagree": F.col("unsure"),
        "reference names another symbol": F.col("other_name"),
        "call's identity": is_("call") & F.col("at_node") & (F.col("row_id") != call_id),
        "call's shape": F.col("at_node") & F.col("other_shape"),
        "call of no reference": F.col("no_reference"),
        "call targets another symbol": F.col("other_target"),
    }))

    once = {("symbols", "node_ix"): "symbols share a node", ("references", "node_ix"): "references share a node", ("calls", "node_ix"): "calls share a node"}
    once |= {(t, ix): f"{t} repeat a row number" for t, ix in (("nodes", "node_ix"), ("scopes", "scope_ix"), ("symbols", "symbol_ix"), ("references", "ref_ix"), ("calls", "call_ix"))}
    listed = [rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(ix).cast("long").alias("row")) for (t, ix), rule in once.items() if t == name]))) for name, rows in tables.items() if any(t == name for t, _ in once)]
    again = functools.reduce(lambda a, b: a.unionByName(b), listed).groupBy(*keys, "rule", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return functools.reduce(lambda a, b: a.unionByName(b), [*found, again]).distinct()
