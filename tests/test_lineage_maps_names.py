import json

import pytest
from pyspark.errors import PySparkException

from cambium.functions import js_rewrite, sourcemap
from cambium.operators import names
from cambium.plans import lineage, review
from cambium.sources import javascript, maps


def traced(spark, old, new):
    matches, targets, stats = lineage.trace(spark.createDataFrame([(1, old, new)], "pair_id long, old string, new string"))
    return {r.name_old: (r.name_new, r.decision, r.confidence) for r in matches.collect()}, {r.name: r.target for r in targets.collect()}, stats.first()


OLD = 'function area(w,h){return w*h}\nfunction greet(n){if(n){log("hello "+n)}else{throw new Error("x")}}\nclass Box{size(){return 1}}'
NEW = 'function a(x,y){return x*y}\nfunction extra(){for(;;){work(1,2,3)}}\nfunction b(z){if(z){log("hello "+z)}else{throw new Error("x")}}\nclass C{size(){return 1}}'


def test_lineage_follows_renames(spark):
    matches, targets, stats = traced(spark, OLD, NEW)
    assert {k: matches[k][:2] for k in ("area", "greet", "Box")} == {"area": ("a", "accepted"), "greet": ("b", "accepted"), "Box": ("C", "accepted")}
    assert targets["extra"] in ("added", "ambiguous") and targets["a"] == "accepted"
    assert stats.source_symbols == 6 and stats.accepted + stats.abstained + stats.deleted == 6


def test_clones_abstain(spark):
    text = "function p(){return 1}\nfunction q(){return 1}"
    matches, targets, stats = traced(spark, text, text)
    assert stats.accepted == 0 and set(targets.values()) == {"ambiguous"}


def test_vlq():
    assert sourcemap.vlq("AAgBC") == [0, 0, 16, 1] and sourcemap.vlq("D") == [-1] and sourcemap.vlq("B") == [-(1 << 31)]
    for bad in ("!", "g", "ggggggggC"):
        with pytest.raises(sourcemap.MapError):
            sourcemap.vlq(bad)


def basic(segments, sources=("a.js",), names=()):
    return json.dumps({"version": 3, "sources": list(sources), "names": list(names), "mappings": sourcemap.encode(segments)})


@pytest.mark.parametrize("spread", [False, True])
def test_lookup_takes_ties_earlier_lines_and_gaps(spark, spread):
    text = basic([(0, 4, 0, 0, 0), (0, 9, 0, 1, 2), (0, 9, 0, 5, 5), (2, 0, 0, 7, 0)])
    table = maps.segments(spark.createDataFrame([("m", text)], "map_id string, json string"))
    q = spark.createDataFrame([("m", 0, 0), ("m", 0, 5), ("m", 0, 100), ("m", 1, 3), ("m", 2, 1)], "map_id string, line long, column long")
    got = sorted(((r.line, r.column), r.status, r.orig_line, r.orig_col) for r in maps.lookup(q, table, spread).collect() if r.orig_line is not None)
    assert got == [((0, 5), "mapped", 0, 0), ((0, 100), "ambiguous", 1, 2), ((0, 100), "ambiguous", 5, 5), ((1, 3), "ambiguous", 1, 2), ((1, 3), "ambiguous", 5, 5), ((2, 1), "mapped", 7, 0)]
    assert [r.status for r in maps.lookup(q, table, spread).where("line = 0 AND column = 0").collect()] == ["unmapped"]


def test_composition(spark):
    made = maps.segments(spark.createDataFrame([("outer", basic([(0, 0, 0, 3, 1)], ["mid.js"])), ("inner", basic([(3, 0, 0, 2, 0)], ["src.ts"]))], "map_id string, json string"))
    q = spark.createDataFrame([("outer", 0, 4)], "map_id string, line long, column long")
    out = maps.compose(q, made, made, spark.createDataFrame([("mid.js", "inner")], "source string, inner_id string")).collect()
    assert [(r.source, r.orig_line, r.status) for r in out] == [("src.ts", 2, "mapped")]


def test_sections_and_malformed_maps():
    inner = json.loads(basic([(0, 1, 0, 0, 0), (1, 2, 0, 1, 0)]))
    made = {"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": inner}, {"offset": {"line": 5, "column": 7}, "map": inner}]}
    assert [(g.line, g.column) for g in sourcemap.decode(json.dumps(made))] == [(0, 1), (1, 2), (5, 8), (6, 2)]
    bad = ["[]", "{", '{"version":2}', '{"version":3,"sources":[],"mappings":"AAAA"}', '{"version":3,"sources":["a"],"mappings":"AA"}', '{"version":3,"sources":["a"],"mappings":",A"}', '{"version":3,"sources":["a"],"mappings":"A","ignoreList":[1]}', json.dumps(made | {"sections": made["sections"][::-1]})]
    for text in bad:
        with pytest.raises(sourcemap.MapError):
            sourcemap.decode(text)


def test_positions_count_utf16():
    text = "a😀\r\nb\u2028c\rd"
    offsets = [0, 1, 5, 7, 8, 11, 12, 13]
    assert sourcemap.positions(text, offsets) == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    with pytest.raises(sourcemap.MapError):
        sourcemap.positions(text, [2])


def log(spark, rows):
    return spark.createDataFrame(rows, names.EVENT)


def request(spark, *rows):
    return spark.createDataFrame([("d", s, state, name, "review", "me") for s, state, name in rows], "doc_id string, symbol_id string, new_state string, new_name string, origin string, actor string")


def test_event_log(spark):
    events = log(spark, [])
    for step in ([("s1", "suggested", "total"), ("s2", "suggested", "count")], [("s1", "approved", None)], [("s2", "rejected", None)]):
        added = names.apply_requests(events, request(spark, *step)).collect()
        events = log(spark, [*[tuple(r) for r in events.collect()], *[tuple(r) for r in added]])
    assert {(r.symbol_id, r.state, r.name) for r in names.current(events).collect()} == {("s1", "approved", "total"), ("s2", "rejected", None)}
    assert names.violations(events).count() == 0
    assert names.apply_requests(events, request(spark, ("s1", "approved", None))).count() == 0
    assert names.apply_requests(events, request(spark, ("s2", "suggested", "count"))).count() == 0  # that operation is in the log
    with pytest.raises(PySparkException):
        names.apply_requests(events, request(spark, ("s2", "approved", None))).collect()
    with pytest.raises(PySparkException):
        names.apply_requests(events, request(spark, ("s3", "suggested", "x")), spark.createDataFrame([("d", 1)], "doc_id string, expected_revision long")).collect()
    forged = [list(r) for r in events.collect()]
    forged[0][6] = "approved"
    assert names.violations(log(spark, [tuple(r) for r in forged])).count() > 0
    accepted = spark.createDataFrame([("d", "s1", "new", "t1"), ("d", "s2", "new", "t2")], "doc_id string, source_symbol string, new_doc string, target_symbol string")
    moved = names.propagate(events, accepted, spark.createDataFrame([("new", "t1"), ("new", "t2")], "new_doc string, symbol_id string"))
    assert [(r.doc_id, r.symbol_id, r.new_state, r.new_name) for r in moved.collect()] == [("new", "t1", "approved", "total")]
    assert names.apply_requests(log(spark, []), moved, trusted=True).count() == 1
    for bad in (request(spark, ("s3", "suggested", "x"), ("s3", "suggested", "y")), request(spark, ("s3", "suggested", " x"))):
        with pytest.raises(PySparkException):
            names.apply_requests(events, bad).collect()


TEXT = 'import {q as z} from "m";export function keep(a,{b,c:d=1}){let e=a+b*-d;return z(e,`x${a}`)};var u=keep(1,{b:2});if(u){u++}else{for(let i=0;i<3;i++)console.log(i)}'


def test_canonical_round_trip():
    made, rows = js_rewrite.canonicalize(TEXT)
    text = js_rewrite.mapping_text([(*r[:8], r[6]) for r in rows])
    back = js_rewrite.apply_mapping(made, js_rewrite.read_mapping(text))
    assert back.replace("{b: b", "{b") == TEXT and "keep" in made and "param_0" in made


def test_pretty_keeps_syntax():
    for text in (TEXT, "a\n++b", "x=- -y+ +z;if(a)b;else c", "class A{static x=1;get y(){return 1}}", "switch(a){case 1:b();break;default:c}", "var f=async(a)=>{await a}", "`a${b}c`;/x/g.test(y)", "// c\nx()"):
        made = js_rewrite.pretty(text)
        assert js_rewrite.shape(js_rewrite.parse(made)) == js_rewrite.shape(js_rewrite.parse(text))
    assert js_rewrite.pretty("function f(){return 1}") == "function f() {\n  return 1\n}\n"


def test_render():
    assert js_rewrite.render("var é=a+1", [(7, 8, "a", "total")]) == "var é=total+1"
    for bad in ([(7, 8, "b", "x")], [(4, 6, "é", "x"), (5, 7, "", "y")], [(7, 8, "a", "1 1")]):
        with pytest.raises(ValueError):
            js_rewrite.render("var é=a+1", bad)


def test_origins_put_candidates_first_and_lineage_is_checked(spark):
    pairs = spark.createDataFrame([(1, OLD, NEW)], "pair_id long, old string, new string")
    table = maps.segments(spark.createDataFrame([("1:old", basic([(0, 9, 0, 3, 0)])), ("1:new", basic([(0, 9, 0, 3, 0)]))], "map_id string, json string"))
    rows = lineage.origins(lineage.contexts(pairs), table)
    held = {(r.side, r.name): r.origin for r in rows.collect()}
    assert held["old", "area"] == held["new", "a"] is not None and len(held["old", "area"]) == 64
    matches, targets, _ = lineage.trace(pairs, segments=table)
    assert {r.name_old: r.name_new for r in matches.where("decision = 'accepted'").collect()}["area"] == "a"
    matches, targets, _ = lineage.trace(pairs)
    assert lineage.violations(pairs, matches, targets).count() == 0
    from pyspark.sql import functions as F

    assert lineage.violations(pairs, matches.withColumn("decision", F.lit("accepted")), targets).count() > 0


def test_review_entries(spark):
    text = "var t=1;function f(a){return a+t}" + "f(1);" * 20
    made = javascript.analyze(spark.createDataFrame([("x", text)], "file_id string, source string"))
    tables = {t: javascript.rows_of(made, t, ["file_id"]) for t in ("nodes", "scopes", "symbols", "references", "calls")}
    got = {r.name: r for r in review.entries(tables, ["file_id"], generated=True).collect()}
    assert (got["f"].references, got["f"].call, got["f"].direct_calls, len(got["f"].call_contexts), got["f"].call_contexts_truncated) == (20, 20, 20, 16, True)
    assert got["a"].read == 1 and got["a"].ancestors == ["program"] and got["a"].declaration_kind == "function_declaration" and got["a"].children[0].child_kind == "identifier" and got["t"].direct_calls == 0
    assert "name" not in review.entries(tables, ["file_id"]).columns
