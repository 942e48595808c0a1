import pytest

from cambium.functions.js_analysis import analyze
from cambium.functions.js_parser import ParseError, parse
from cambium.plans import diff

VALID = [
    "let a=1,b={c,d:2,e(){},get f(){return 1},...g},[h,,i=2,...j]=k",
    "async function* g(a,{b},c=1,...d){yield* x;await y}",
    "class A extends B{static #p=1;static{q()}async *m(){}constructor(){super()}y=2\nz}",
    "import a,{b as c,default as d}from'm';export default function(){};export{a as b};export*from'x'",
    "a=b/c/d;x=/re[/]g/gi.test(y);z=a\n++b",
    "for(const [k,v] of o)f(k);for(x in y);for(var i=0,n=3;i<n;i++){}",
    "a?.b?.[c]?.(d);`x${a+`y${b}`}z`;tag`q`",
    "({a,b}=c);[a,b]=[b,a];async x=>x;(a,b)=>({y:a})",
]
INVALID = ["var =", "function(){", "a b", "x={", '"abc', "class{}", "f(", "`x", "if(", "let [a"]


@pytest.mark.parametrize("text", VALID)
def test_parses(text):
    root = parse(text).root
    for n in root.walk():
        assert all(n.start <= c.start <= c.end <= n.end for c in n.children)


@pytest.mark.parametrize("text", INVALID)
def test_rejects(text):
    with pytest.raises(ParseError, match=r"at \d+:\d+"):
        parse(text)


def rows(text, table):
    return analyze(text)[table]


def test_scopes_and_roles():
    text = "var t=1;function f(a){let t=a;t+=1;return g(t)}new f(t);t=2"
    roles = [(r[4], r[5], r[7]) for r in sorted(rows(text, "references"), key=lambda r: r[8])]
    assert roles == [("a", "read", "resolved"), ("t", "read_write", "resolved"), ("g", "call", "unresolved"), ("t", "read", "resolved"), ("f", "construct", "resolved"), ("t", "read", "resolved"), ("t", "write", "resolved")]


def test_byte_spans():
    assert [(d[1], d[7], d[8]) for d in rows('var é="ü",b=1', "declarations")] == [("é", 4, 11), ("b", 12, 15)]


def changes(spark, old, new):
    df = spark.createDataFrame([(1, old, new)], "pair_id long, old string, new string")
    matches, found = diff.compare(df)
    return sorted((r.change, r.name, r.classification) for r in found.collect()), sorted((r.name_old, r.name_new) for r in matches.collect())


def test_renames_are_no_change(spark):
    assert changes(spark, "function f(a,b){return a+b}\nfunction g(x){return f(x,1)}", "function h(p,q){\n return p+q;}\nfunction g(z){return h(z,1)}") == ([], [("f", "h"), ("g", "g")])


def test_classes_of_change(spark):
    found, _ = changes(spark, 'function f(){return "a"}\nfunction g(){return true}\nvar gone=function(){for(;;)q()}', 'function f(){return "b"}\nfunction g(){return null}\nclass New{m(){}}')
    assert found == [("addition", "New", None), ("deletion", "gone", None), ("modification", "f", "string_only"), ("modification", "g", "structural")]


def test_empty_side(spark):
    assert changes(spark, "function f(){}", "") == ([("deletion", "f", None)], [])


def test_fingerprints_follow_evidence(spark):
    old = 'function f(a){console.log("fatal error here",a);fetchThing("/api/v1/x",12345);if(a){b()}else{c(a,b)}}'
    new = 'function g(){for(;;){q(1)}}\nfunction h(z){while(z){console.log("fatal error here",z)};return fetchThing("/api/v1/x",12345)}'
    df = spark.createDataFrame([(1, old, new)], "pair_id long, old string, new string")
    matches, _ = diff.compare(df, fingerprints=True)
    got = [(r.name_old, r.name_new, r.similarity) for r in matches.collect()]
    assert [x[:2] for x in got] == [("f", "h")]
    decls = diff.declarations(df)
    w = {r.id.decl_ix: r for r in diff.weights(decls).where("side = 'old'").collect()}[0]  # each value is found twice
    near = lambda x, want: set(x) == set(want) and all(abs(x[k] - want[k]) < 1e-9 for k in want)
    assert near(w.w_strings, {"fatal error here": 0.84, "/api/v1/x": 0.7}) and near(w.w_constants, {"number 12345": 0.48})
    assert near({k: v for k, v in w.w_api.items() if k == "console.log"}, {"console.log": 0.48})
