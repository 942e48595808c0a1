"""Registered queries over JavaScript made from the driver's tables, with the rows that the language's rules ask for.

Each supplier (or nation) gives a text by a template: @k is its key, @n its nation, @s its name. What must come out is
written down by hand next to the template, and DuckDB fills it in from the same table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import fields, sourcemap
from cambium.functions import hashing as H
from cambium.operators import integrity, names
from cambium.operators import ordered as O
from cambium.operators import similarity as S
from cambium.operators.scratch import cut, shared_folder
from cambium.plans import diff, lineage, render, report, review
from cambium.plans.queries import page_scripts, query, table
from cambium.sources import documents, dump, javascript, maps

MODULE = """import def@k, {alpha as al@k, beta} from "mod/@n";
import * as ns@k from './lib.js';
const {a, b: [c = @k, ...d], ...rest} = load("cfg-@n");
let total@k = @n, lim = 500, ratio = 1.25, big = 9@k1, re = /x@k+/g;
var twice; var twice = [1, 2]; // @s
function mix@k(p, q = 7, {r, s: t}, ...u) {
  if (p > q) { let inner = p + q; total@k += inner; return helper(inner, "error in @s"); }
  for (const i of u) { twice = i; ns@k.track("@s", i); }
  for (var j = 0; j < 3; j++) { t++; }
  try { throw new Error("/api/v@n/x"); } catch (e) { console.log(e, "~/logs"); }
  return al@k(r, "re-run", "settings_@n") + missing@k;
}
class Box@k extends Base {
  size() { return this.w * total@k; }
  static make(n) { return new Box@k(n); }
}
export { mix@k as mixed, Box@k };
"""


def filled(template: str | Column) -> Column:
    """A template for each supplier."""
    out = F.lit(template) if isinstance(template, str) else template
    for mark, value in (("@k", F.col("s_suppkey").cast("string")), ("@n", F.col("s_nationkey").cast("string")), ("@s", F.col("s_name"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_filled(column: str) -> str:
    return f"replace(replace(replace({column}, '@k', CAST(s_suppkey AS VARCHAR)), '@n', CAST(s_nationkey AS VARCHAR)), '@s', s_name)"


def expected(columns: str, rows: list[tuple], where: str = "TRUE", key: str = "file_id") -> str:
    """SQL of rows for each supplier. columns: names, those of numbers and booleans with a colon and the type behind."""
    parts = [c.split(":") for c in columns.split()]
    value = lambda v: "NULL" if v is None else sql_text(v) if isinstance(v, str) else str(v)
    listed = ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows)
    quoted = [f'"{p[0]}"' for p in parts]  # some are words of SQL
    chosen = ", ".join(f"CAST(t.{q} AS {p[1]}) AS {q}" if len(p) > 1 else f"{sql_filled('t.' + q)} AS {q}" for p, q in zip(parts, quoted, strict=True))
    return f"SELECT s_suppkey AS {key}, {chosen} FROM supplier CROSS JOIN (VALUES {listed}) t({', '.join(quoted)}) WHERE {where}"


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), filled(MODULE).alias("source"))


def rows_of(spark: SparkSession, sf_dir: str, *which: str) -> list[DataFrame]:
    made = javascript.analyze(modules(spark, sf_dir), list(which))
    made = cut(made, "modules") if len(which) > 1 else made
    return [javascript.rows_of(made, t, ["file_id"]) for t in which]


DECLARATIONS = [
    ("import@0", "import", "import_statement", 'import from "mod/@n"', 1, 1), ("import@1", "import", "import_statement", "import from './lib.js'", 2, 2),
    ("total@k", "variable", "variable_declarator", "var=number:@n", 4, 4), ("lim", "variable", "variable_declarator", "var=number:500", 4, 4), ("ratio", "variable", "variable_declarator", "var=number:1.25", 4, 4),
    ("big", "variable", "variable_declarator", "var=number:9@k1", 4, 4), ("re", "variable", "variable_declarator", "var=regex", 4, 4), ("twice", "variable", "variable_declarator", "var=array:len5", 5, 5),
    ("mix@k", "function", "function_declaration", "function(params:1,stmts:5)", 6, 12), ("Box@k", "class", "class_declaration", "class(methods:2,fields:0)", 13, 16), ("export@16", "export", "export_statement", "export 2 items", 17, 17),
]


@query(expected("name kind node_kind signature line:INTEGER end_line:INTEGER", DECLARATIONS))
def js_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = rows_of(spark, sf_dir, "declarations")
    return rows.select("file_id", "name", "kind", "node_kind", "signature", "line", "end_line")


EVIDENCE = [
    ("mix@k", "string", "error in @s", "error"), ("mix@k", "string", "@s", "regular"), ("mix@k", "string", "/api/v@n/x", "endpoint"), ("mix@k", "string", "~/logs", "path"), ("mix@k", "string", "re-run", "command"),
    ("mix@k", "string", "settings_@n", "config"), ("lim", "constant", "duration 500", None), ("ratio", "constant", "float 1.25", None), ("big", "constant", "number 9@k1", None), ("re", "constant", "regex /x@k+/g", None),
    ("mix@k", "api", ".helper", None), ("mix@k", "api", "ns@k.track", "@s"), ("mix@k", "api", "console.log", None), ("mix@k", "api", ".al@k", None),
]


@query(expected("name family value detail", EVIDENCE))
def js_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What functions and variables hold that tells them: strings with their context, constants, calls with their argument."""
    (rows,) = rows_of(spark, sf_dir, "declarations")
    strings = rows.select("file_id", "name", F.lit("string").alias("family"), F.explode("strings").alias("value")).withColumn("detail", H.string_context(F.col("value")))
    constants = rows.select("file_id", "name", F.lit("constant").alias("family"), F.explode("constants").alias("value"), F.lit(None).cast("string").alias("detail"))
    api = rows.select("file_id", "name", F.lit("api").alias("family"), F.explode("api").alias("a")).select("file_id", "name", "family", F.col("a.key").alias("value"), F.col("a.arg").alias("detail"))
    return strings.unionByName(constants).unionByName(api)


SCOPES = [
    (0, "global", 0, None, ""), (1, "function", 1, 0, "global"), (2, "class", 1, 0, "global"), (3, "block", 2, 1, "function,global"), (4, "loop", 2, 1, "function,global"), (5, "loop", 2, 1, "function,global"),
    (6, "block", 2, 1, "function,global"), (7, "catch", 2, 1, "function,global"), (8, "function", 2, 2, "class,global"), (9, "function", 2, 2, "class,global"), (10, "block", 3, 4, "loop,function,global"), (11, "block", 3, 5, "loop,function,global"),
]


@query(expected("scope_ix:INTEGER kind depth:INTEGER parent_ix:INTEGER ancestors", SCOPES))
def js_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = rows_of(spark, sf_dir, "scopes")
    return rows.select("file_id", "scope_ix", "kind", "depth", "parent_ix", F.array_join("ancestor_kinds", ",").alias("ancestors"))


#: name, kind, scope, references in all, and of them read, write, read and write, call, construct, export.
SYMBOLS = [
    ("def@k", "import", 0, 0, 0, 0, 0, 0, 0, 0), ("al@k", "import", 0, 1, 0, 0, 0, 1, 0, 0), ("beta", "import", 0, 0, 0, 0, 0, 0, 0, 0), ("ns@k", "import", 0, 1, 1, 0, 0, 0, 0, 0),
    ("a", "const", 0, 0, 0, 0, 0, 0, 0, 0), ("c", "const", 0, 0, 0, 0, 0, 0, 0, 0), ("d", "const", 0, 0, 0, 0, 0, 0, 0, 0), ("rest", "const", 0, 0, 0, 0, 0, 0, 0, 0),
    ("total@k", "let", 0, 2, 1, 0, 1, 0, 0, 0), ("lim", "let", 0, 0, 0, 0, 0, 0, 0, 0), ("ratio", "let", 0, 0, 0, 0, 0, 0, 0, 0), ("big", "let", 0, 0, 0, 0, 0, 0, 0, 0), ("re", "let", 0, 0, 0, 0, 0, 0, 0, 0),
    ("twice", "variable", 0, 1, 0, 1, 0, 0, 0, 0), ("mix@k", "function", 0, 1, 0, 0, 0, 0, 0, 1), ("p", "parameter", 1, 2, 2, 0, 0, 0, 0, 0), ("q", "parameter", 1, 2, 2, 0, 0, 0, 0, 0),
    ("r", "parameter", 1, 1, 1, 0, 0, 0, 0, 0), ("t", "parameter", 1, 1, 0, 0, 1, 0, 0, 0), ("u", "parameter", 1, 1, 1, 0, 0, 0, 0, 0), ("inner", "let", 3, 2, 2, 0, 0, 0, 0, 0), ("i", "const", 4, 2, 2, 0, 0, 0, 0, 0),
    ("j", "variable", 1, 2, 1, 0, 1, 0, 0, 0), ("e", "catch", 7, 1, 1, 0, 0, 0, 0, 0), ("Box@k", "class", 0, 2, 0, 0, 0, 0, 1, 1), ("n", "parameter", 9, 1, 1, 0, 0, 0, 0, 0),
]


@query(expected("name kind scope_ix:INTEGER reference_count:INTEGER", [r[:4] for r in SYMBOLS]))
def js_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = rows_of(spark, sf_dir, "symbols")
    return rows.select("file_id", "name", "kind", "scope_ix", "reference_count")


CALLS_OF = {"al@k": (1, 0), "Box@k": (0, 1)}


@query(expected("name references:BIGINT read:BIGINT write:BIGINT read_write:BIGINT call:BIGINT construct:BIGINT export:BIGINT resolved:BIGINT direct_calls:BIGINT construct_calls:BIGINT", [(r[0], *r[3:], r[3], *CALLS_OF.get(r[0], (0, 0))) for r in SYMBOLS]))
def js_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, references, calls = rows_of(spark, sf_dir, "symbols", "references", "calls")
    found = review.usage({"symbols": symbols, "references": references, "calls": calls}, ["file_id"])
    named = found.join(symbols.select("file_id", "symbol_ix", "name"), ["file_id", "symbol_ix"])
    return named.select("file_id", "name", *[F.col(c).cast("long").alias(c) for c in ("references", "read", "write", "read_write", "call", "construct", "export", "resolved", "direct_calls", "construct_calls")])


REFERENCES = [
    ("load", "call", "unresolved", None), ("p", "read", "resolved", "parameter"), ("p", "read", "resolved", "parameter"), ("q", "read", "resolved", "parameter"), ("q", "read", "resolved", "parameter"),
    ("total@k", "read_write", "resolved", "let"), ("inner", "read", "resolved", "let"), ("helper", "call", "unresolved", None), ("inner", "read", "resolved", "let"), ("u", "read", "resolved", "parameter"),
    ("twice", "write", "resolved", "variable"), ("i", "read", "resolved", "const"), ("ns@k", "read", "resolved", "import"), ("i", "read", "resolved", "const"), ("j", "read", "resolved", "variable"),
    ("j", "read_write", "resolved", "variable"), ("t", "read_write", "resolved", "parameter"), ("Error", "construct", "unresolved", None), ("console", "read", "unresolved", None), ("e", "read", "resolved", "catch"),
    ("al@k", "call", "resolved", "import"), ("r", "read", "resolved", "parameter"), ("missing@k", "read", "unresolved", None), ("Base", "read", "unresolved", None), ("total@k", "read", "resolved", "let"),
    ("Box@k", "construct", "resolved", "class"), ("n", "read", "resolved", "parameter"), ("mix@k", "export", "resolved", "function"), ("Box@k", "export", "resolved", "class"),
]


@query(expected("name role resolution kind", REFERENCES))
def js_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, references = rows_of(spark, sf_dir, "symbols", "references")
    return references.join(symbols.select("file_id", "symbol_ix", "kind"), ["file_id", "symbol_ix"], "left").select("file_id", "name", "role", "resolution", "kind")


CALLS = [
    ("load", "direct", None, "cfg-@n", None), ("helper", "direct", None, None, None), ("ns@k.track", "member", "track", "@s", None), ("Error", "construct", None, "/api/v@n/x", None),
    ("console.log", "member", "log", None, None), ("al@k", "direct", None, None, "import"), ("Box@k", "construct", None, None, "class"),
]


@query(expected("callee kind property first_arg target", CALLS))
def js_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, calls = rows_of(spark, sf_dir, "symbols", "calls")
    targets = symbols.select("file_id", F.col("symbol_ix").alias("target_symbol"), F.col("kind").alias("target"))
    return calls.join(targets, ["file_id", "target_symbol"], "left").select("file_id", "callee", "kind", "property", "first_arg", "target")


_FUNCTION = ("function_declaration", "program", "identifier,formal_parameters,statement_block")
_PLACES = {
    "def@k": ("import_statement", "program", "import_clause,string"), "re": ("variable_declarator", "lexical_declaration,program", "identifier,regex"), "twice": ("variable_declarator", "variable_declaration,program", "identifier"),
    "inner": ("variable_declarator", "lexical_declaration,statement_block,if_statement,statement_block,function_declaration,program", "identifier,binary_expression"),
    "i": ("for_in_statement", "statement_block,function_declaration,program", "identifier,identifier,statement_block"), "j": ("variable_declarator", "variable_declaration,for_statement,statement_block,function_declaration,program", "identifier,number"),
    "e": ("catch_clause", "try_statement,statement_block,function_declaration,program", "identifier,statement_block"), "Box@k": ("class_declaration", "program", "identifier,class_heritage,class_body"),
    "n": ("method_definition", "class_body,class_declaration,program", "property_identifier,formal_parameters,statement_block"),
} | dict.fromkeys(("mix@k", "p", "q", "r", "t", "u"), _FUNCTION)
_PLACES |= dict.fromkeys(("al@k", "beta", "ns@k"), _PLACES["def@k"]) | dict.fromkeys(("a", "c", "d", "rest"), ("variable_declarator", "lexical_declaration,program", "object_pattern,call_expression"))
_PLACES |= dict.fromkeys(("total@k", "lim", "ratio", "big"), ("variable_declarator", "lexical_declaration,program", "identifier,number"))


@query(expected("name scope_kind declaration_kind ancestors children references:BIGINT", [(r[0], dict((s[0], s[1]) for s in SCOPES)[r[2]], *_PLACES[r[0]], r[3]) for r in SYMBOLS]))
def js_review_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = ["nodes", "scopes", "symbols", "references", "calls"]
    rows = review.entries(dict(zip(which, rows_of(spark, sf_dir, *which), strict=True)), ["file_id"], generated=True)
    return rows.select("file_id", "name", "scope_kind", "declaration_kind", F.array_join("ancestors", ",").alias("ancestors"), F.array_join("children.child_kind", ",").alias("children"), F.col("references").cast("long").alias("references"))


#: Kind class and uses by role of each symbol.
_CLASS = {"import": "import", "const": "value", "let": "value", "variable": "value", "catch": "value", "function": "callable", "class": "type", "parameter": "parameter"}


@query(expected("name kind_class scope_kind depth:INTEGER roles", [(r[0], _CLASS[r[1]], SCOPES[r[2]][1], SCOPES[r[2]][2], ",".join(map(str, r[4:]))) for r in SYMBOLS]))
def js_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = modules(spark, sf_dir).select(F.col("file_id").alias("pair_id"), F.col("source").alias("old"), F.lit("").alias("new"))
    rows = lineage.contexts(pairs).where("side = 'old'")
    return rows.select(F.col("pair_id").alias("file_id"), "name", "kind_class", "scope_kind", "depth", F.array_join("roles", ",").alias("roles"))


@query(f"SELECT s_suppkey AS file_id, sha256({sql_filled(sql_text(MODULE))}) AS source_digest, CAST(strlen({sql_filled(sql_text(MODULE))}) AS BIGINT) AS source_length, TRUE AS repeats FROM supplier")
def js_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text, and whether the digest of its analysis is the same when it is made again."""
    sources = modules(spark, sf_dir)
    once = javascript.digests(sources, javascript.analyze(sources), ["file_id"])
    again = javascript.digests(sources, javascript.analyze(sources.repartition(3)), ["file_id"]).select("file_id", F.col("analysis_digest").alias("second"))
    return once.join(again, "file_id").select("file_id", "source_digest", "source_length", (F.col("analysis_digest") == F.col("second")).alias("repeats"))


#: Rules that analyses break which were altered in one place, by key % 6.
BROKEN = {1: ["node's identity", "ordinals have gaps"], 2: ["call's shape", "reference's identity"], 3: ["depth is not the parent's plus one", "scope's identity"], 4: ["call's identity", "call's shape"], 5: ["reference names another symbol"]}


@query(" UNION ALL ".join(expected("rule", [(r,) for r in rules], f"s_suppkey % 6 = {m}") for m, rules in BROKEN.items()))
def js_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that analyses break: five in six are altered in one place."""
    which = ["nodes", "scopes", "symbols", "references", "calls"]
    tables = dict(zip(which, rows_of(spark, sf_dir, *which), strict=True))
    spoil = lambda t, c, m, where, value: tables.__setitem__(t, tables[t].withColumn(c, F.when((F.col("file_id") % 6 == m) & F.expr(where), value).otherwise(F.col(c))))
    spoil("nodes", "child_ordinal", 1, "kind = 'class_declaration'", F.col("child_ordinal") + 1)
    spoil("references", "role", 2, "name LIKE 'al%'", F.lit("write"))
    spoil("scopes", "depth", 3, "scope_ix = 11", F.lit(9))
    spoil("calls", "property", 4, "callee = 'load'", F.lit("zz"))
    spoil("symbols", "name", 5, "name LIKE 'total%'", F.lit("forged"))
    return integrity.violations(tables, ["file_id"]).select("file_id", "rule").distinct()


@query("SELECT s_suppkey AS file_id, name FROM supplier CROSS JOIN (VALUES ('lim', 1), ('mix', 2), ('re', 3)) t(name, m) WHERE s_suppkey % 4 = m")
def js_declaration_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations whose bytes were altered so that they are no part of their source."""
    (rows,) = rows_of(spark, sf_dir, "declarations")
    k = F.col("file_id") % 4
    rows = rows.withColumn("end_byte", F.when((k == 1) & (F.col("name") == "lim"), F.col("start_byte")).when((k == 2) & F.col("name").startswith("mix"), 1_000_000).otherwise(F.col("end_byte")))
    rows = rows.withColumn("start_byte", F.when((k == 3) & (F.col("name") == "re"), -1).otherwise(F.col("start_byte")))
    found = javascript.out_of_range(rows, modules(spark, sf_dir), ["file_id"])
    return found.join(rows, ["file_id", "decl_ix"]).select("file_id", F.regexp_replace("name", "\\d", "").alias("name"))


@query("SELECT * FROM (VALUES ('source_map_lineage_unavailable'), ('fingerprint_evidence_unavailable'), ('dynamic_call_target_unavailable'), ('tdz_and_flow_resolution_unavailable'), ('dynamic_scope_unavailable')) t(code)")
def js_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return javascript.losses(spark).select("code")


# One inline script of each page: var t="</p>";track(N);

#: node, kind, parent, place, start, end, flags, line of the outline. @w: digits of the page's id.
NODES = [
    (0, "program", None, 0, "0", "21 + @w", 1, "program [0:0]"), (1, "variable_declaration", 0, 0, "0", "13", 1, "  variable_declaration [0:0]"), (2, "var", 1, 0, "0", "3", 0, '    var [0:0] => "var"'),
    (3, "variable_declarator", 1, 1, "4", "12", 1, "    variable_declarator [0:4]"), (4, "identifier", 3, 0, "4", "5", 1, '      name=identifier [0:4] => "t"'), (5, "=", 3, 1, "5", "6", 0, '      = [0:5] => "="'),
    (6, "string", 3, 2, "6", "12", 1, "      value=string [0:6]"), (7, '"', 6, 0, "6", "7", 0, '        " [0:6] => """'), (8, "string_fragment", 6, 1, "7", "11", 1, '        string_fragment [0:7] => "</p>"'),
    (9, '"', 6, 2, "11", "12", 0, '        " [0:11] => """'), (10, ";", 1, 2, "12", "13", 0, '    ; [0:12] => ";"'), (11, "expression_statement", 0, 1, "13", "21 + @w", 1, "  expression_statement [0:13]"),
    (12, "call_expression", 11, 0, "13", "20 + @w", 1, "    call_expression [0:13]"), (13, "identifier", 12, 0, "13", "18", 1, '      function=identifier [0:13] => "track"'), (14, "arguments", 12, 1, "18", "20 + @w", 1, "      arguments=arguments [0:18]"),
    (15, "(", 14, 0, "18", "19", 0, '        ( [0:18] => "("'), (16, "number", 14, 1, "19", "19 + @w", 1, '        number [0:19] => "@p"'), (17, ")", 14, 2, "19 + @w", "20 + @w", 0, '        ) [0:@x] => ")"'), (18, ";", 11, 1, "20 + @w", "21 + @w", 0, '    ; [0:@y] => ";"'),
]
_WIDTH = "length(CAST(page_id AS VARCHAR))"


def _sql_nodes() -> str:
    rows = []
    for node, kind, parent, place, start, end, flags, line in NODES:
        line = f"replace(replace(replace({sql_text(line)}, '@p', CAST(page_id AS VARCHAR)), '@x', CAST(19 + {_WIDTH} AS VARCHAR)), '@y', CAST(20 + {_WIDTH} AS VARCHAR))"
        number = lambda x: f"CAST({x.replace('@w', _WIDTH)} AS INTEGER)"
        rows.append(f"SELECT page_id, {node} AS node_ix, {sql_text(kind)} AS kind, CAST({'NULL' if parent is None else parent} AS INTEGER) AS parent_ix, {place} AS child_ordinal, {number(start)} AS start_byte, {number(end)} AS end_byte, {flags} AS flags, {line} AS text FROM pages")
    return " UNION ALL ".join(rows)


@query(_sql_nodes())
def js_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syntax tree of each page's script as rows, with the line that an outline has for each node."""
    sources = page_scripts(spark, sf_dir)
    nodes = javascript.rows_of(javascript.analyze(sources, ["nodes"]), "nodes", ["page_id"])
    return nodes.join(javascript.outline(sources), ["page_id", "node_ix"]).select("page_id", "node_ix", "kind", "parent_ix", "child_ordinal", "start_byte", "end_byte", "flags", "text")


@query("SELECT page_id, CAST(place AS INTEGER) AS place, kind FROM pages CROSS JOIN (VALUES (0, 'variable_declaration'), (4, 'identifier'), (6, 'string'), (13, 'identifier'), (1, NULL)) t(place, kind)")
def js_smallest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cut(javascript.rows_of(javascript.analyze(page_scripts(spark, sf_dir), ["nodes"]), "nodes", ["page_id"]), "nodes")
    asked = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*[F.lit(x) for x in (0, 4, 6, 13, 1)])).alias("place"))
    return O.smallest_starting_at(asked, nodes, ["page_id"], "place").join(nodes.select("page_id", "node_ix", "kind"), ["page_id", "node_ix"], "left").select("page_id", "place", "kind")


@query("""SELECT s_suppkey AS file_id, CASE s_suppkey % 4 WHEN 1 THEN 'unexpected token at 3:' || (3 + length(CAST(s_suppkey AS VARCHAR))) WHEN 2 THEN 'unexpected token at 3:5' WHEN 3 THEN 'unexpected token at 3:5' END AS error, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n FROM supplier""")
def js_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that don't parse, with where; nothing is told of what is in them."""
    tail = F.array(F.lit("\n"), filled("f(@k"), F.lit("var = 3"), F.lit('x = "abc'))[(F.col("s_suppkey") % 4).cast("int")]
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(filled("var a=1;\nvar b=@k;\n"), tail).alias("source"))
    made = javascript.analyze(sources, ["declarations"], strict=False)
    return made.select("file_id", "error", F.size("declarations").cast("long").alias("n"))


@query("SELECT count(*) AS n_declarations, CAST(sum(length('var v' || s_suppkey || '=' || s_nationkey || ';') + 1) AS BIGINT) AS n_chars FROM supplier")
def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of JavaScript, written as text and read as whole texts."""
    folder = f"{shared_folder(spark)}/js-files-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("part"), filled("var v@k=@n;").alias("value")).write.partitionBy("part").text(folder)
    read = cut(javascript.read_sources(spark, f"{folder}/*/*.txt", most_bytes=1 << 20), "files")
    found = javascript.rows_of(javascript.analyze(read, ["declarations"]), "declarations", ["file_id"]).agg(F.count(F.lit(1)).alias("n_declarations"))
    return found.join(read.agg(F.sum(F.length("source")).alias("n_chars")), F.lit(True))


SHAPE = 'function f@k(a,b){return {x:a,y:[b,"s@n"],z:/r/}}'
SHAPES = [SHAPE, 'function g@k(c,d){return {x:c,y:[d,"s@n"],z:/r/}}', 'function f@k(a,b){return {z:/r/,y:[b,"s@n"],x:a}}', 'function f@k(a, b) { /* why */\n  return {x: a, y: [b, "s@n"], z: /r/} }', 'function f@k(a,b){return {x:a,y:[b,"t@n"],z:/r/}}']


@query("SELECT s_suppkey AS pair_id, s_suppkey % 5 != 4 AS same_hashes, s_suppkey % 5 != 4 AS same_lanes FROM supplier")
def js_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, the order of an object's members, comments and layout are no part of a shape; literals are."""
    new = F.array(*[F.lit(x) for x in SHAPES])[(F.col("s_suppkey") % 5).cast("int")]
    decls = diff.declarations(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"), filled(SHAPE).alias("old"), filled(new).alias("new")))
    a, b = (decls.where(F.col("side") == s).select("pair_id", F.col("hashes").alias(f"h_{s}"), F.col("minhash").alias(f"m_{s}")) for s in ("old", "new"))
    return a.join(b, "pair_id").select("pair_id", (F.col("h_old") == F.col("h_new")).alias("same_hashes"), (H.equal_lanes(F.col("m_old"), F.col("m_new")) == diff.LANES).alias("same_lanes"))


# Each module against a next version: the same; names changed; a string changed; a function more; a variable less; another
# variable counted.

_RENAMED = MODULE.replace("mix@k", "blend@k").replace("(p, q = 7", "(first, q = 7").replace("p > q", "first > q").replace("p + q", "first + q").replace("inner", "inside")
VERSIONS = [MODULE, _RENAMED, MODULE.replace("error in", "failed in"), MODULE + "function extra@k(x) { while (x) x = step(x); }\n", MODULE.replace("var twice; var twice = [1, 2];", ""), MODULE.replace("{ t++; }", "{ r++; }")]


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.array(*[F.lit(v) for v in VERSIONS])[(F.col("s_suppkey") % 6).cast("int")]
    return cut(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"), filled(MODULE).alias("old"), filled(new).alias("new")), "pairs")


#: matched, renamed, unchanged, string_only, structural, added, removed, total_old, total_new.
COUNTS = [(11, 0, 11, 0, 0, 0, 0, 11, 11), (11, 1, 11, 0, 0, 0, 0, 11, 11), (11, 0, 10, 1, 0, 0, 0, 11, 11), (11, 0, 11, 0, 0, 1, 0, 11, 12), (10, 0, 9, 0, 1, 0, 1, 11, 10), (11, 0, 10, 0, 1, 0, 0, 11, 11)]
_NAMES = "matched renamed unchanged string_only structural added removed total_old total_new"


@query(f"SELECT s_suppkey AS pair_id, {', '.join(f'CAST(t.{c} AS BIGINT) AS {c}' for c in _NAMES.split())}, CAST(t.matched AS DOUBLE) / greatest(t.total_old, t.total_new) AS similarity FROM supplier JOIN (VALUES {', '.join(str((m, *r)) for m, r in enumerate(COUNTS))}) t(m, {', '.join(_NAMES.split())}) ON t.m = s_suppkey % 6")
def js_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = version_pairs(spark, sf_dir)
    found = diff.comparison(pairs)
    counts = diff.summary(pairs, found.matches, found.changes)
    return counts.join(diff.totals(found.declarations, found.matches, pairs).drop("matched"), "pair_id").select("pair_id", *[F.col(c).cast("long").alias(c) for c in _NAMES.split()], "similarity")


_MIX, _TWICE = "function mix@k(p, q = 7, {r, s: t}, ...u) {", "var twice; var twice = [1, 2]; // @s"
CHANGES = [
    (2, "modification", "mix@k", "string_only", "function 'mix@k' — string-only", "global.mix@k", 6, 12, _MIX, 6, 12, _MIX),
    (3, "addition", "extra@k", None, "Added function 'extra@k'", "global.extra@k", None, None, None, 18, 18, "function extra@k(x) { while (x) x = step(x); }"),
    (4, "deletion", "twice", None, "Removed variable 'twice'", "global.twice", 5, 5, _TWICE, None, None, None),
    (4, "modification", "mix@k", "structural", "function 'mix@k' — structural (100.0%)", "global.mix@k", 6, 12, _MIX, 6, 12, _MIX),
    (5, "modification", "mix@k", "structural", "function 'mix@k' — structural (100.0%)", "global.mix@k", 6, 12, _MIX, 6, 12, _MIX),
]
_CHANGE = "change name classification description path line_old:INTEGER end_line_old:INTEGER snippet_old line_new:INTEGER end_line_new:INTEGER snippet_new quoted"


@query(" UNION ALL ".join(expected(_CHANGE, [(*r[1:], r[2])], f"s_suppkey % 6 = {r[0]}", "pair_id") for r in CHANGES))
def js_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with its words, path and places; quoted: the name that its description quotes first."""
    _, changes = diff.compare(version_pairs(spark, sf_dir))
    return changes.withColumn("quoted", fields.quoted(F.col("description"))).select("pair_id", *[c.split(":")[0] for c in _CHANGE.split()])


_HUNK = [
    (0, "@@ -1,5 +1,5 @@"), (1, " " + _MIX), (2, '-  if (p > q) { let inner = p + q; total@k += inner; return helper(inner, "error in @s"); }'), (3, '+  if (p > q) { let inner = p + q; total@k += inner; return helper(inner, "failed in @s"); }'),
    (4, '   for (const i of u) { twice = i; ns@k.track("@s", i); }'), (5, "   for (var j = 0; j < 3; j++) { t++; }"), (6, '   try { throw new Error("/api/v@n/x"); } catch (e) { console.log(e, "~/logs"); }'),
]
_HUNK4 = [(0, "@@ -1,6 +1,6 @@"), (1, " " + _MIX), (2, "   if (p > q) { let inner = p + q; total@k += inner; return helper(inner, \"error in @s\"); }"), (3, '-  for (const i of u) { twice = i; ns@k.track("@s", i); }'), (4, '+  for (const i of u) { twice = i; ns@k.track("@s", i); }'), (5, _HUNK[5][1]), (6, _HUNK[6][1]), (7, '   return al@k(r, "re-run", "settings_@n") + missing@k;')]
_HUNK5 = [(0, "@@ -1,7 +1,7 @@"), (1, " " + _MIX), (2, "   if (p > q) { let inner = p + q; total@k += inner; return helper(inner, \"error in @s\"); }"), (3, _HUNK[4][1]), (4, "-  for (var j = 0; j < 3; j++) { t++; }"), (5, "+  for (var j = 0; j < 3; j++) { r++; }"), (6, _HUNK[6][1]), (7, '   return al@k(r, "re-run", "settings_@n") + missing@k;'), (8, " }")]


@query(" UNION ALL ".join(expected("place:BIGINT text", rows, f"s_suppkey % 6 = {m}", "pair_id") for m, rows in ((2, _HUNK), (4, _HUNK4), (5, _HUNK5))))
def js_display_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line diffs of changed declarations by what their tokens mean, in the original lines: renamed locals are no change."""
    return report.display_diffs(diff.comparison(version_pairs(spark, sf_dir)).words).select("pair_id", "place", "text")


_COMPACT = [(2, "String-only: 1"), (2, "  mix@k (old:6 -> new:6)"), (3, "Added: 1"), (3, "  extra@k (new:18-18)"), (4, "Removed: 1"), (4, "  twice (old:5-5)"), (4, "Structural: 1"), (4, "  mix@k (old:6 -> new:6) 100.0%"), (5, "Structural: 1"), (5, "  mix@k (old:6 -> new:6) 100.0%")]
_FULL = [
    (2, "=== String Changes ==="), (2, f"@@@ function 'mix@k' — string-only\n  - at line 6: {_MIX}\n  + at line 6: {_MIX}"), (3, "=== Added ==="), (3, "+++ Added function 'extra@k'\n    at line 18: function extra@k(x) { while (x) x = step(x); }"),
    (4, "=== Removed ==="), (4, f"--- Removed variable 'twice'\n    at line 5: {_TWICE}"), *[(m, t) for m in (4, 5) for t in ("=== Structural Changes ===", f"@@@ function 'mix@k' — structural (100.0%)\n  - at line 6: {_MIX}\n  + at line 6: {_MIX}")],
]


@query(" UNION ALL ".join(expected("form text", [(form, t)], f"s_suppkey % 6 = {m}", "pair_id") for form, rows in (("compact", _COMPACT), ("full", _FULL)) for m, t in rows) + " UNION ALL " + expected("form text", [("renames", "mix@k: blend@k\n")], "s_suppkey % 6 = 1", "pair_id"))
def js_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the compact and of the full report, and the export of renames."""
    matches, changes = diff.compare(version_pairs(spark, sf_dir))
    matches, changes = cut(matches, "matches"), cut(changes, "changes")
    made = [report.compact_lines(changes).withColumn("form", F.lit("compact")), report.full_lines(changes).withColumn("form", F.lit("full")), report.rename_export(matches).withColumn("form", F.lit("renames"))]
    return made[0].select("pair_id", "form", "text").unionByName(made[1].select("pair_id", "form", "text")).unionByName(made[2].select("pair_id", "form", "text"))


@query("SELECT s_suppkey AS pair_id, CAST(7445 AS BIGINT) AS similarity_bps, CAST(10 AS INTEGER) AS evidence FROM supplier")
def js_evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of mix by its shape and shared evidence: six strings, each on both sides, of all contexts: 0.7 * (1.2 +
    0.7 + 1.0 + 1.1 + 1.0 + 0.9); four calls at 0.8 * 0.6, one with equal arguments: 0.3 more; over ten; 0.7 of it and 0.3."""
    new = F.when(F.col("s_suppkey") % 2 == 0, F.lit(VERSIONS[1])).otherwise(F.lit(VERSIONS[0]))
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"), filled(MODULE).alias("old"), filled(new).alias("new"))
    decls = diff.declarations(pairs)
    side = lambda s, i: decls.where((F.col("side") == s) & (F.col("kind") == "function")).select("pair_id", F.col("id").alias(i))
    scored = diff.with_evidence(side("old", "i1").join(side("new", "i2"), "pair_id").withColumn("similarity", F.lit(1.0)), decls)
    return scored.select("pair_id", F.round(F.col("similarity") * H.SCALE).cast("long").alias("similarity_bps"), F.col("evidence").cast("int").alias("evidence"))


_BASE = "SELECT s_suppkey AS pair_id, "


def _dump(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_folder(spark)}/dump-{spark.range(1).select(F.uuid()).first()[0]}"
    found = diff.comparison(version_pairs(spark, sf_dir))
    dump.save(spark, folder, {"declarations": found.declarations, "matches": found.matches, "changes": found.changes})
    return folder


_OTHER = "CASE WHEN t.name = 'mix@k' AND s_suppkey % 6 = 1 THEN 'blend@k' WHEN t.name = 'twice' AND s_suppkey % 6 = 4 THEN NULL ELSE t.name END"


@query(f"{_BASE}{sql_filled('t.name')} AS name, t.line, {sql_filled(_OTHER)} AS other, CASE WHEN t.name = 'twice' AND s_suppkey % 6 = 4 THEN NULL ELSE t.line END AS other_line FROM supplier CROSS JOIN (VALUES {', '.join(f'({sql_text(r[0])}, {r[4]})' for r in DECLARATIONS)}) t(name, line)")
def js_dump_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that was saved and loaded: what each old declaration matches."""
    return dump.match_named(dump.load(spark, _dump(spark, sf_dir))).select("pair_id", "name", "line", "other", "other_line")


@query(f"""{_BASE}CAST(11 AS BIGINT) AS total_old, CAST(CASE s_suppkey % 6 WHEN 3 THEN 12 WHEN 4 THEN 10 ELSE 11 END AS BIGINT) AS total_new, CAST(CASE s_suppkey % 6 WHEN 4 THEN 10 ELSE 11 END AS BIGINT) AS matched, CAST(s_suppkey % 6 = 3 AS BIGINT) AS additions,
CAST(s_suppkey % 6 = 4 AS BIGINT) AS deletions, CAST(s_suppkey % 6 IN (2, 4, 5) AS BIGINT) AS modifications, CASE s_suppkey % 6 WHEN 3 THEN 'new extra' WHEN 4 THEN 'old twice' END AS unmatched FROM supplier""")
def js_dump_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = dump.load(spark, _dump(spark, sf_dir))
    lost = None
    for side in ("old", "new"):
        one = dump.unmatched(held, side).select("pair_id", F.concat(F.lit(f"{side} "), F.regexp_replace("name", "\\d", "")).alias("unmatched"))
        lost = one if lost is None else lost.unionByName(one)
    return dump.overview(held).drop("similarity").join(lost, "pair_id", "left").select("pair_id", *[F.col(c).cast("long").alias(c) for c in ("total_old", "total_new", "matched", "additions", "deletions", "modifications")], "unmatched")


@query("SELECT 'changes' AS name, 'rows' AS problem")
def js_dump_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump to which a row was added is no longer whole."""
    folder = _dump(spark, sf_dir)
    spark.read.parquet(f"{folder}/changes").limit(1).write.mode("append").parquet(f"{folder}/changes")
    return dump.validate(spark, folder)


@query(f"{_BASE}'old' AS side, 5 AS line, 'var=array:len5' AS signature, CASE WHEN s_suppkey % 6 != 4 THEN 'twice' END AS other, 'twice = [1, 2]' AS text FROM supplier UNION ALL {_BASE}'new', 18, 'function(params:1,stmts:1)', NULL, 'function extra' || s_suppkey || '(x) {{ while (x) x = step(x); }}' FROM supplier WHERE s_suppkey % 6 = 3")
def js_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What there is of two names, one of which only new versions have."""
    found = diff.comparison(version_pairs(spark, sf_dir))
    plain = found.declarations.withColumn("name", F.regexp_replace("name", "\\d", ""))
    rows = [dump.inspect(plain, found.matches, name).select("pair_id", "side", "line", "signature", F.regexp_replace("other", "\\d", "").alias("other"), "text") for name in ("twice", "extra")]
    return rows[0].unionByName(rows[1])


# Lineage: unique shapes under other names, clones, a class that goes, and what comes.

TRACED = 'function alpha@k(){return fetch("x@k")}\nfunction beta@k(){if(ready)go();else stop()}\nfunction twin1(){return 1}\nfunction twin2(){return 1}\nclass Gone@k{run(){while(true)step()}}\n'
NEXT = 'function a(){return fetch("x@k")}\nfunction b(){if(ready)go();else stop()}\nfunction twin1(){return 1}\nfunction twin2(){return 1}\nfunction extra@k(){for(const v of all)use(v)}\n'


def traced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("s_suppkey") % 2 == 0, F.lit(NEXT)).otherwise(F.lit(TRACED))
    return cut(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"), filled(TRACED).alias("old"), filled(new).alias("new")), "pairs")


_SURE = ("accepted", "exact", 10000, 10000, 10000, 10000, True)
_CLONE = ("abstained", "low", 10000, 10000, 10000, 10000, False)
_TRACE = "name_old name_new decision confidence score:BIGINT shape_bps:BIGINT roles_bps:BIGINT scope_bps:BIGINT exact_shape:BOOLEAN"
_TWINS = [("twin1", "twin1", *_CLONE), ("twin2", "twin2", *_CLONE)]


@query(expected(_TRACE, [("alpha@k", "a", *_SURE), ("beta@k", "b", *_SURE), *_TWINS, ("Gone@k", None, "deleted", "low", None, None, None, None, None)], "s_suppkey % 2 = 0", "pair_id") + " UNION ALL "
       + expected(_TRACE, [("alpha@k", "alpha@k", *_SURE), ("beta@k", "beta@k", *_SURE), *_TWINS, ("Gone@k", "Gone@k", *_SURE)], "s_suppkey % 2 = 1", "pair_id"))
def js_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol traced to the next version; names are no signal, clones abstain."""
    matches, _, _ = lineage.trace(traced_pairs(spark, sf_dir))
    return matches.select(F.col("i1.pair_id").alias("pair_id"), *[F.col(c.split(":")[0]) for c in _TRACE.split()])


_EVEN = [("a", "accepted"), ("b", "accepted"), ("twin1", "ambiguous"), ("twin2", "ambiguous"), ("extra@k", "ambiguous"), ("v", "added")]
_ODD = [("alpha@k", "accepted"), ("beta@k", "accepted"), ("twin1", "ambiguous"), ("twin2", "ambiguous"), ("Gone@k", "accepted")]


@query(expected("name target", _EVEN, "s_suppkey % 2 = 0", "pair_id") + " UNION ALL " + expected("name target", _ODD, "s_suppkey % 2 = 1", "pair_id"))
def js_lineage_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, targets, _ = lineage.trace(traced_pairs(spark, sf_dir))
    return targets.select("pair_id", "name", "target")


_STATS = "source_symbols target_symbols exact_unique_anchors truncated_sources accepted abstained deleted added ambiguous_targets"


@query(" UNION ALL ".join(f"SELECT s_suppkey AS pair_id, {', '.join(f'CAST({v} AS BIGINT) AS {c}' for c, v in zip(_STATS.split(), row, strict=True))}, TRUE AS compared FROM supplier WHERE s_suppkey % 2 = {m}" for m, row in ((0, (5, 6, 2, 0, 2, 2, 1, 1, 3)), (1, (5, 5, 3, 0, 3, 2, 0, 0, 2)))))
def js_lineage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters; compared: is each candidate pair compared, and are there as many as symbols at least?"""
    _, _, stats = lineage.trace(traced_pairs(spark, sf_dir))
    fine = (F.col("candidate_pairs") == F.col("expensive_comparisons")) & (F.col("candidate_pairs") >= F.col("accepted") + F.col("abstained"))
    return stats.select("pair_id", *[F.col(c).cast("long").alias(c) for c in _STATS.split()], fine.alias("compared"))


#: What is found of reports that were altered, by key % 4.
FORGED = {1: ["another computation", "statistics"], 2: ["another computation", "format"], 3: ["another computation", "digest"]}


@query(" UNION ALL ".join(expected("rule", [(r,) for r in rules], f"s_suppkey % 4 = {m}", "pair_id") for m, rules in FORGED.items()))
def js_lineage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage reports, written, altered in three of four cases, read and checked by themselves and against their sources."""
    pairs = traced_pairs(spark, sf_dir)
    made = lineage.reports(pairs, *lineage.trace(pairs))
    k = F.col("pair_id") % 4
    forged = F.when(k == 1, F.regexp_replace("json", '"abstained":2', '"abstained":1')).when(k == 2, F.replace("json", F.lit(lineage.FORMAT), F.lit("other"))).when(k == 3, F.regexp_replace("json", '"source_digest":"[0-9a-f]{4}', '"source_digest":"ZZZZ')).otherwise(F.col("json"))
    folder = f"{shared_folder(spark)}/reports-{spark.range(1).select(F.uuid()).first()[0]}"
    documents.write(made.withColumn("json", forged), folder, lineage.MOST_BYTES, "pair_id")
    read = documents.read(spark, folder, lineage.REPORT, lineage.MOST_BYTES, "pair_id").withColumn("pair_id", F.col("pair_id").cast("long"))
    other = lineage.report_differences(read.select("pair_id", "json"), pairs).select("pair_id", F.lit("another computation").alias("rule"))
    return lineage.report_violations(read).unionByName(other)


@query("SELECT s_suppkey AS pair_id, CASE WHEN s_suppkey % 5 = 1 THEN 'accepted under the limits' END AS rule FROM supplier WHERE FALSE UNION ALL SELECT s_suppkey, rule FROM supplier CROSS JOIN (VALUES (1, 'decision and candidate disagree'), (1, 'row is not recomputed'), (1, 'recomputed row is missing'), (2, 'target told twice'), (2, 'target is not recomputed')) t(m, rule) WHERE s_suppkey % 5 = m")
def js_lineage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages that were altered: of every fifth pair a clone's row says deleted, of every fifth another target stands twice."""
    pairs = traced_pairs(spark, sf_dir)
    matches, targets, _ = lineage.trace(pairs)
    matches = matches.withColumn("decision", F.when((F.col("i1.pair_id") % 5 == 1) & (F.col("name_old") == "twin1"), "deleted").otherwise(F.col("decision")))
    targets = targets.unionByName(targets.where("pair_id % 5 = 2 AND name = 'twin1'"))
    return lineage.violations(pairs, matches, targets).distinct()


@query(expected("name same:BOOLEAN", [("alpha@k", True), ("beta@k", False)], "TRUE", "pair_id"))
def js_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether source maps put both versions of a symbol at one place."""
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pair_id"), filled(TRACED).alias("old"), filled(TRACED).alias("new"))
    text = lambda second: '{"version":3,"sources":["src.ts"],"names":[],"mappings":"' + sourcemap.encode([(0, 0, 0, 3, 0), (1, 0, 0, second, 0)]) + '"}'
    json = F.array(F.struct(F.lit("old").alias("side"), F.lit(text(7)).alias("json")), F.struct(F.lit("new").alias("side"), F.lit(text(9)).alias("json")))
    held = table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(json)).select(F.concat_ws(":", F.col("s_suppkey").cast("string"), "side").alias("map_id"), "json")
    rows = lineage.origins(lineage.contexts(pairs), maps.segments(held)).where("name LIKE 'alpha%' OR name LIKE 'beta%'")
    return rows.groupBy("pair_id", "name").agg((F.count_distinct("origin") == 1).alias("same"))


# Reviewed names of both functions.


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), filled(TRACED).alias("source"))


def _reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols with doc_id, symbol_id, name, events): alpha is named, then by key % 3 approved, left or rejected, and by
    key % 5 named again; beta is named, and cleared where the key is even."""
    made = javascript.analyze(_sources(spark, sf_dir), ["symbols"])
    symbols = cut(javascript.rows_of(made, "symbols", ["doc_id"]).select("doc_id", "symbol_id", "name"), "symbols")
    k = F.col("doc_id").cast("int")
    alpha, beta = F.col("name").startswith("alpha"), F.col("name").startswith("beta")
    ask = lambda where, state, name: symbols.where(where).select("doc_id", "symbol_id", F.lit(state).alias("new_state"), (F.concat(F.lit(name), "doc_id") if name else F.lit(None).cast("string")).alias("new_name"), F.lit("review").alias("origin"), F.lit("me").alias("actor"))
    steps = [
        ask(alpha, "suggested", "fetchItem").unionByName(ask(beta, "suggested", "switch")),
        ask(alpha & (k % 3 == 0), "approved", None).unionByName(ask(alpha & (k % 3 == 2), "rejected", None)).unionByName(ask(beta & (k % 2 == 0), "cleared", None)),
        ask(alpha & (k % 5 == 0), "suggested", "other"),
    ]
    events = spark.createDataFrame([], names.EVENT)
    for step in [*steps, steps[0]]:  # the first again: its operations are in the log
        events = cut(events.unionByName(names.apply_requests(events, step)), "events")
    return symbols, events


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'alpha' || s_suppkey AS symbol, CASE WHEN s_suppkey % 5 = 0 THEN 'suggested' ELSE ['approved', 'suggested', 'rejected'][s_suppkey % 3 + 1] END AS state, CASE WHEN s_suppkey % 5 = 0 THEN 'other' || s_suppkey WHEN s_suppkey % 3 < 2 THEN 'fetchItem' || s_suppkey END AS name FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'beta' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'cleared' ELSE 'suggested' END, CASE WHEN s_suppkey % 2 = 1 THEN 'switch' || s_suppkey END FROM supplier""")
def js_name_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, events = _reviewed(spark, sf_dir)
    return names.current(events).join(symbols.withColumnRenamed("name", "symbol"), ["doc_id", "symbol_id"]).select("doc_id", "symbol", "state", "name")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(s_suppkey % 3 = 0 AND s_suppkey % 5 != 0 AS BIGINT) AS approved, CAST(2 + (s_suppkey % 3 != 1)::INT + (s_suppkey % 2 = 0)::INT + (s_suppkey % 5 = 0)::INT AS BIGINT) AS revision, CAST(0 AS BIGINT) AS problems FROM supplier""")
def js_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = _reviewed(spark, sf_dir)
    bad = names.violations(events).groupBy("doc_id").agg(F.count(F.lit(1)).alias("problems"))
    return names.approved_counts(events).join(bad, "doc_id", "left").select("doc_id", F.col("approved").cast("long").alias("approved"), "revision", F.coalesce("problems", F.lit(0)).cast("long").alias("problems"))


#: What is found of review documents that were altered, by key % 4.
SPOILED = {1: ["field", "replay"], 2: ["altered context"], 3: ["format"]}


@query(" UNION ALL ".join(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '{p}' AS problem FROM supplier WHERE s_suppkey % 4 = {m}" for m, found in SPOILED.items() for p in found))
def js_review_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review documents, written, altered in three of four cases, read and checked by themselves and against their sources."""
    _, events = _reviewed(spark, sf_dir)
    sources = _sources(spark, sf_dir)
    which = ["nodes", "scopes", "symbols", "references", "calls"]
    analysis = cut(javascript.analyze(sources), "analysis")
    entries = cut(review.entries({t: javascript.rows_of(analysis, t, ["doc_id"]) for t in which}, ["doc_id"]), "entries")
    digests = javascript.digests(sources, analysis, ["doc_id"])
    k = F.col("doc_id").cast("int") % 4
    spoiled = F.when(k == 1, F.replace("json", F.lit('"state":"suggested"'), F.lit('"state":"rejected"'))).when(k == 2, F.replace("json", F.lit('"kind":"class"'), F.lit('"kind":"klass"'))).when(k == 3, F.replace("json", F.lit(documents.FORMAT), F.lit("other"))).otherwise(F.col("json"))
    folder = f"{shared_folder(spark)}/reviews-{spark.range(1).select(F.uuid()).first()[0]}"
    documents.write(documents.review_documents(entries, digests, events).withColumn("json", spoiled), folder, documents.MOST_BYTES)
    read = cut(documents.read(spark, folder, documents.NAMES, documents.MOST_BYTES), "read")
    return documents.review_violations(read).unionByName(documents.bound_violations(read, entries, digests)).distinct()


_APPROVED = "s_suppkey % 3 = 0 AND s_suppkey % 5 != 0"


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'approved' AS state, 'fetchItem' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'alpha' || s_suppkey END AS symbol FROM supplier WHERE {_APPROVED}")
def three_way_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved names along accepted matches to symbols of the next versions."""
    _, events = _reviewed(spark, sf_dir)
    matches, targets, _ = lineage.trace(traced_pairs(spark, sf_dir))
    doc, new = F.col("i1.pair_id").cast("string"), F.concat(F.lit("next-"), F.col("pair_id").cast("string"))
    accepted = matches.where("decision = 'accepted'").select(doc.alias("doc_id"), F.col("symbol_id_s").alias("source_symbol"), F.concat(F.lit("next-"), doc).alias("new_doc"), F.col("symbol_id_t").alias("target_symbol"))
    known = targets.select(new.alias("new_doc"), "symbol_id", F.col("name").alias("symbol"))
    added = names.apply_requests(spark.createDataFrame([], names.EVENT), names.propagate(events, accepted, known), trusted=True)
    named = known.withColumnRenamed("new_doc", "doc_id")
    return names.current(added).join(named, ["doc_id", "symbol_id"]).select(F.regexp_replace("doc_id", "next-", "").alias("doc_id"), "state", "name", "symbol")


@query(f"SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CASE WHEN {_APPROVED} THEN replace({sql_filled(sql_text(TRACED))}, 'alpha' || s_suppkey, 'fetchItem' || s_suppkey) ELSE {sql_filled(sql_text(TRACED))} END AS text FROM supplier")
def js_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts under their approved names."""
    _, events = _reviewed(spark, sf_dir)
    return render.rendered(_sources(spark, sf_dir), names.current(events).where("state = 'approved'"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, ['revision', 'history', 'repeated operation', 'illegal step'][c_custkey % 5] AS problem FROM customer WHERE c_custkey % 5 > 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'name is approved twice' FROM customer WHERE c_custkey % 20 = 10""")
def name_log_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event logs, one a customer, four in five of which break one rule; every tenth approves one name for two symbols, every
    twentieth of them in two scopes."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    m = F.col("k") % 5
    step = lambda n, symbol, before, old, state, name: F.struct(F.lit(n).cast("long").alias("revision"), F.lit(f"op{n}").alias("operation_id"), F.lit(symbol).alias("symbol_id"), F.lit(before).alias("previous_state"), F.lit(old).cast("string").alias("previous_name"), F.lit(state).alias("new_state"), F.lit(name).cast("string").alias("new_name"))
    four = [step(1, "s1", "unknown", None, "suggested", "total"), step(2, "s1", "suggested", "total", "approved", "total"), step(3, "s2", "unknown", None, "suggested", "total"), step(4, "s2", "suggested", "total", "approved", "total")]
    log = F.when(F.col("k") % 10 == 0, F.array(*four)).otherwise(F.array(*four[:2]))
    e = rows.select(F.col("k"), F.col("k").cast("string").alias("doc_id"), F.inline(log))
    second = F.col("revision") == 2
    e = e.withColumn("revision", F.when((m == 1) & second, 3).otherwise(F.col("revision")).cast("long")).withColumn("previous_name", F.when((m == 2) & second, "sum").otherwise(F.col("previous_name")))
    e = e.withColumn("operation_id", F.when((m == 3) & second, "op1").otherwise(F.col("operation_id"))).withColumn("new_state", F.when((m == 4) & second, "unheard").otherwise(F.col("new_state")))
    e = e.withColumns({"origin": F.lit("review"), "actor": F.lit("me"), "evidence_digest": F.lit(None).cast("string")})
    scopes = e.select("doc_id", "symbol_id", F.when(F.col("k") % 20 == 0, F.col("symbol_id")).otherwise("one").alias("scope_id")).distinct()
    return names.violations(e.drop("k"), scopes).select("doc_id", "problem")


# Rewrites.

PLAIN = "function area@k(w, h){let s = w * @n; return s + h}\narea@k(1, 2);"
_KINDS = "function_declaration function identifier formal_parameters ( identifier , identifier ) statement_block { lexical_declaration let variable_declarator identifier = binary_expression identifier * number ; return_statement return binary_expression identifier + identifier }".split()
_FN = f"fn_{int.from_bytes(hashlib.sha256(b''.join(len(k).to_bytes(8, 'little') + k.encode() for k in _KINDS)).digest()[:8], 'little', signed=True) % 65535:x}"
_CANONICAL = f"function {_FN}(param_0, param_1){{let var_0 = param_0 * @n; return var_0 + param_1}}\n{_FN}(1, 2);"
_FORMATTED = f"function {_FN}(param_0, param_1) {{\n  let var_0 = param_0 * @n;\n  return var_0 + param_1\n}}\n{_FN}(1, 2);\n"


@query(f"SELECT s_suppkey AS doc_id, {sql_filled(sql_text(_CANONICAL))} AS canonical, TRUE AS restored, {sql_filled(sql_text(_FORMATTED))} AS formatted FROM supplier")
def js_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under canonical names, brought back by their mapping, and formatted. A function's name is the hash of its syntax."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), filled(PLAIN).alias("source"))
    made = render.rewritten(sources).join(sources, "doc_id")
    return made.select("doc_id", "canonical", (F.col("restored") == F.col("source")).alias("restored"), "formatted")


@query(expected("first_line:INTEGER last_line:INTEGER type scope:INTEGER original canonical", [(1, 2, "func", 0, "area@k", _FN), (1, 1, "param", 1, "w", "param_0"), (1, 1, "param", 1, "h", "param_1"), (1, 1, "var", 1, "s", "var_0")], key="doc_id"))
def js_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), filled(PLAIN).alias("source"))
    return render.rewritten(sources).select("doc_id", F.inline("mapping")).select("doc_id", "first_line", "last_line", "type", "scope", "original", "canonical")


# Source maps, one a nation.

INNER = '{"version":3,"sources":["src@n.js"],"names":[],"mappings":"IAAA,KACE,AAIG;;AAEL"}'
INDEXED = '{"version":3,"sections":[{"offset":{"line":@n,"column":0},"map":' + INNER + "}]}"


def _nations(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    """(n, and a column for each text)."""
    fill = lambda t: F.replace(F.lit(t), F.lit("@n"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n"), *[fill(t).alias(f"t{k}") for k, t in enumerate(texts)])


_FOUND = "(0, 0, 'unmapped', NULL, NULL), (0, 5, 'mapped', 0, 0), (0, 100, 'ambiguous', 1, 2), (0, 100, 'ambiguous', 5, 5), (1, 3, 'ambiguous', 1, 2), (1, 3, 'ambiguous', 5, 5), (2, 1, 'mapped', 7, 0)"


@query(f"SELECT CAST(n_nationkey AS INTEGER) AS n, CAST(n_nationkey + line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, status, CASE WHEN status != 'unmapped' THEN 'src' || n_nationkey || '.js' END AS source, CAST(ol AS BIGINT) AS orig_line, CAST(oc AS BIGINT) AS orig_col FROM nation CROSS JOIN (VALUES {_FOUND}) t(line, col, status, ol, oc)")
def js_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in indexed maps whose one section begins at another line in each."""
    rows = _nations(spark, sf_dir, INDEXED)
    held = maps.segments(rows.select(F.col("n").alias("map_id"), F.col("t0").alias("json")))
    at = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("c")) for a, b in ((0, 0), (0, 5), (0, 100), (1, 3), (2, 1))])
    asked = rows.select(F.col("n").alias("map_id"), F.explode(at).alias("p")).select("map_id", (F.col("map_id") + F.col("p.l")).cast("long").alias("line"), F.col("p.c").cast("long").alias("column"))
    return maps.lookup(asked, held).select(F.col("map_id").alias("n"), "line", F.col("column").alias("col"), "status", "source", "orig_line", "orig_col")


OUTER = '{"version":3,"sources":["mid@n.js"],"names":["label@n"],"mappings":"' + sourcemap.encode([(0, 0, 0, 0, 5), (0, 10, 0, 0, 100), (1, 0, 0, 2, 1)]) + '"}'


@query("SELECT CAST(n_nationkey AS INTEGER) AS n, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS col, status, 'src' || n_nationkey || '.js' AS source, CAST(ol AS BIGINT) AS orig_line, CAST(oc AS BIGINT) AS orig_col FROM nation CROSS JOIN (VALUES (0, 0, 'mapped', 0, 0), (0, 12, 'ambiguous', 1, 2), (0, 12, 'ambiguous', 5, 5), (1, 4, 'mapped', 7, 0)) t(line, col, status, ol, oc)")
def js_map_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps in a row: what the first finds is looked up in the map of that source."""
    rows = _nations(spark, sf_dir, OUTER, INNER, "mid@n.js")
    outer = maps.segments(rows.select(F.concat(F.lit("outer"), "n").alias("map_id"), F.col("t0").alias("json")))
    inner = maps.segments(rows.select(F.concat(F.lit("inner"), "n").alias("map_id"), F.col("t1").alias("json")))
    inner_of = rows.select(F.col("t2").alias("source"), F.concat(F.lit("inner"), "n").alias("inner_id"))
    asked = rows.select(F.concat(F.lit("outer"), "n").alias("map_id"), F.inline(F.array(*[F.struct(F.lit(a).cast("long").alias("line"), F.lit(b).cast("long").alias("column")) for a, b in ((0, 0), (0, 12), (1, 4))])))
    found = maps.compose(asked, outer, inner, inner_of)
    return found.select(F.regexp_replace("map_id", "outer", "").cast("int").alias("n"), "line", F.col("column").alias("col"), "status", "source", "orig_line", "orig_col")


#: Maps by nation % 5, with the error of those that are not sound.
SOUND = [(INNER, None), (INNER.replace("IAAA", "!!"), "'!' is no base64 digit"), (INNER.replace("IAAA", "DAAA"), "negative column"), (INNER.replace(":3", ":2"), "not a version 3 map"), (INNER.replace("IAAA", "ICAA"), "original position out of range")]


def _sql_map() -> str:
    cases = " ".join(f"WHEN {m} THEN {sql_text(t)}" for m, (t, _) in enumerate(SOUND))
    wrong = " ".join(f"WHEN {m} THEN {sql_text(e)}" for m, (_, e) in enumerate(SOUND) if e)
    return f"SELECT CAST(n_nationkey AS INTEGER) AS n, n_nationkey % 5 = 0 AS valid, CAST(CASE WHEN n_nationkey % 5 = 0 THEN 4 END AS BIGINT) AS segments, sha256(replace(CASE n_nationkey % 5 {cases} END, '@n', CAST(n_nationkey AS VARCHAR))) AS digest, CASE n_nationkey % 5 {wrong} END AS error FROM nation"


@query(_sql_map())
def js_map_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nations(spark, sf_dir, *[t for t, _ in SOUND])
    json = F.array(*[F.col(f"t{k}") for k in range(len(SOUND))])[F.col("n") % 5]
    return maps.validate(rows.select(F.col("n").alias("map_id"), json.alias("json"))).select(F.col("map_id").alias("n"), "valid", "segments", "digest", "error")


# Functions of columns.

_LP = lambda x: f"unhex(printf('%02x', strlen({x})) || '00000000000000') || encode({x})"
_DIGEST = f"sha256({_LP(sql_text('nation'))} || {_LP('CAST(n_nationkey AS VARCHAR)')} || {_LP('n_name')})"


@query(f"SELECT n_nationkey, {_DIGEST} AS id FROM nation")
def sha_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", H.digest_id("nation", F.col("n_nationkey"), F.col("n_name")).alias("id"))


_LITTLE = " || ".join(f"substr({_DIGEST}, {15 - 2 * k}, 2)" for k in range(8))


@query(f"WITH h AS (SELECT n_nationkey, CAST(('0x' || {_LITTLE}) AS UBIGINT) AS u FROM nation) SELECT n_nationkey, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE CAST(u AS HUGEINT) END AS BIGINT) AS hash FROM h")
def feature_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", H.feature_hash("nation", F.col("n_nationkey"), F.col("n_name")).alias("hash"))


@query("""SELECT l_orderkey, l_linenumber, CAST(10000 - bit_count(xor(l_partkey, l_suppkey)) * 10000 // 64 AS BIGINT) AS hamming, CAST(CASE WHEN greatest(l_partkey, l_suppkey) = 0 THEN 10000 ELSE least(l_partkey, l_suppkey) * 10000 // greatest(l_partkey, l_suppkey) END AS BIGINT) AS ratio,
CAST(floor(log2(greatest(l_partkey, 1))) AS INTEGER) AS bucket FROM lineitem""")
def similarity_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", H.hamming_bps(a, b).cast("long").alias("hamming"), H.ratio_bps(a, b).alias("ratio"), H.size_bucket(a).alias("bucket"))


_KIND = "['function', 'variable', 'class', 'import', 'export']"


@query(f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, ({_KIND}[a.n_nationkey % 5 + 1] = {_KIND}[b.n_nationkey % 5 + 1] OR (a.n_nationkey % 5 < 2 AND b.n_nationkey % 5 < 2)) AS compatible FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def kind_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.array(*[F.lit(x) for x in ("function", "variable", "class", "import", "export")])[F.col("n_nationkey") % 5]
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", kind.alias("kind"))
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), S.compatible_kinds(F.col("a.kind"), F.col("b.kind")).alias("compatible"))


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN ' ' || p_name WHEN 3 THEN sha256(p_name) WHEN 4 THEN upper(sha256(p_name)) ELSE repeat(p_name, 20) END AS v FROM part)
SELECT p_partkey, regexp_full_match(v, '[A-Za-z0-9._:-]{1,128}') AS token, strlen(v) BETWEEN 1 AND 128 AND trim(v) = v AS name, regexp_full_match(v, '[0-9a-f]{64}') AS hex FROM v""")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    sha = F.sha2(F.col("p_name").cast("binary"), 256)
    v = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_brand")).when(k == 2, F.concat(F.lit(" "), "p_name")).when(k == 3, sha).when(k == 4, F.upper(sha)).otherwise(F.repeat("p_name", 20))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", fields.token(F.col("v")).alias("token"), fields.name(F.col("v")).alias("name"), fields.hex256(F.col("v")).alias("hex"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 2, 3), chr(10)) AS text FROM documents")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", javascript.source_range("text", F.lit(2), F.lit(3)).alias("text"))


@query("""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS byte, CAST(len(lines) - 1 AS BIGINT) AS line, CAST(length(lines[-1]) + length(regexp_replace(lines[-1], '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS col FROM l""")
def utf16_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each text's end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    ends = docs.select("doc_id", F.octet_length("source").cast("long").alias("byte"))
    return maps.positions(docs, ends, ["doc_id"]).select("doc_id", "byte", "line", F.col("column").alias("col"))


@query("SELECT event_type AS name, CAST(sum(floor(value)) AS DOUBLE) AS seconds, count(*) AS calls, sum(floor(value)) / count(*) * 1000 AS average_ms FROM events GROUP BY 1")
def timer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.timers(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.floor("value").cast("double").alias("seconds")))


@query("SELECT c_mktsegment AS doc_id, CAST(c_custkey AS VARCHAR) AS symbol_id, CASE WHEN c_custkey % 3 != 0 THEN 'left' ELSE 'right' END AS side FROM customer WHERE (c_custkey % 3 != 0) != (c_custkey % 5 != 0)")
def symbol_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("doc_id"), F.col("c_custkey").cast("string").alias("symbol_id"), F.col("c_custkey").alias("k"))
    return names.symbol_differences(rows.where("k % 3 != 0"), rows.where("k % 5 != 0"))
