"""What a reviewer sees of each symbol before naming it: use, surroundings, and capped contexts with flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions.js_analysis import ROLES

#: How many children, references and calls are shown.
CHILDREN, REFERENCES, CALLS = 12, 24, 16
KINDS = ["direct", "member", "construct", "dynamic"]


def usage(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys..., symbol_ix, 14 counters): references in all, by role and by resolution, and calls by kind."""
    r = tables["references"].where("symbol_ix IS NOT NULL").groupBy(*keys, "symbol_ix").agg(
        F.count(F.lit(1)).alias("references"), *[F.count_if(F.col("role") == x).alias(x) for x in ROLES], *[F.count_if(F.col("resolution") == x).alias(x) for x in ("resolved", "unresolved", "ambiguous")]
    )
    c = tables["calls"].where("target_symbol IS NOT NULL").groupBy(*keys, F.col("target_symbol").alias("symbol_ix")).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_calls") for k in KINDS])
    names = ["references", *ROLES, "resolved", "unresolved", "ambiguous", *[f"{k}_calls" for k in KINDS]]
    out = tables["symbols"].select(*keys, "symbol_ix").join(r, [*keys, "symbol_ix"], "left").join(c, [*keys, "symbol_ix"], "left")
    return out.select(*keys, "symbol_ix", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _capped(rows: DataFrame, keys: list[str], order: str, fields: list[str], cap: int, name: str) -> DataFrame:
    """The first cap rows of each symbol as an array, with whether there were more."""
    w = Window.partitionBy(*keys, "symbol_ix")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy(order))).withColumn("all", F.count(F.lit(1)).over(w)).where(F.col("nth") <= cap)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("nth", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return rows.groupBy(*keys, "symbol_ix").agg(listed.alias(name), (F.max("all") > cap).alias(f"{name}_truncated"))


def entries(tables: dict[str, DataFrame], keys: list[str], generated: bool = False) -> DataFrame:
    """One row a symbol: its identity, kind, scope, the declaration that holds it with ancestors and children, usage,
    references and calls. The text's own names are left out unless generated."""
    nodes, scopes, symbols, references, calls = (tables[t] for t in ("nodes", "scopes", "symbols", "references", "calls"))
    box = nodes.select(*keys, F.col("node_ix").alias("container_ix"), F.col("node_id").alias("declaration_id"), F.col("kind").alias("declaration_kind"), "start_byte", "end_byte")
    scope = scopes.select(*keys, "scope_ix", "scope_id", F.col("kind").alias("scope_kind"), F.col("depth").alias("scope_depth"), F.col("ancestor_kinds").alias("scope_ancestors"))
    s = symbols.select(*keys, "symbol_ix", "symbol_id", "kind", "scope_ix", "container_ix", F.col("ancestor_kinds").alias("ancestors"), *(["name"] if generated else []))
    out = s.join(scope, [*keys, "scope_ix"]).join(box, [*keys, "container_ix"]).join(usage(tables, keys), [*keys, "symbol_ix"])
    kids = nodes.where("named").select(*keys, F.col("parent_ix").alias("container_ix"), F.col("node_ix").alias("child_ix"), F.col("kind").alias("child_kind"))
    children = _capped(s.select(*keys, "symbol_ix", "container_ix").join(kids, [*keys, "container_ix"]), keys, "child_ix", ["child_kind"], CHILDREN, "children")
    up = nodes.select(*keys, "node_ix", "parent_ix", "node_id").join(nodes.select(*keys, F.col("node_ix").alias("parent_ix"), F.col("kind").alias("parent_kind")), [*keys, "parent_ix"], "left")
    refs = _capped(references.where("symbol_ix IS NOT NULL").join(up, [*keys, "node_ix"]), keys, "ref_ix", ["node_id", "role", "resolution", "parent_kind"], REFERENCES, "reference_contexts")
    by_ref = references.where("symbol_ix IS NOT NULL").select(*keys, F.col("ref_ix").alias("callee_ref"), "symbol_ix")
    called = calls.join(by_ref, [*keys, "callee_ref"]).join(nodes.select(*keys, "node_ix", "node_id"), [*keys, "node_ix"]).withColumnRenamed("kind", "call_kind").withColumn("is_target", F.col("target_symbol").isNotNull())
    call = _capped(called, keys, "call_ix", ["node_id", "call_kind", "is_target"], CALLS, "call_contexts")
    for part in (children, refs, call):
        out = out.join(part, [*keys, "symbol_ix"], "left")
    return out.drop("container_ix", "scope_ix")
