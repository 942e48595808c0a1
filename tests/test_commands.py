"""Commands over files: reviewed names from export to rendering, source maps, inspection, exports."""

import json

import pytest

from cambium import __main__ as cli
from cambium.functions import sourcemap

OLD = 'function fetchAll(x){return get("/api/list",x)}\nfunction other(n){if(n){stop()}else{go(n)}}\n'
NEW = 'function a(b){return get("/api/list",b)}\nfunction c(d){if(d){stop()}else{go(d)}}\nclass Added{m(){return 1}}\n'


@pytest.fixture
def run(spark, capsys):
    def call(*args):
        capsys.readouterr()
        code = cli.main([str(x) for x in args])
        said = capsys.readouterr()
        return code, said.out.splitlines(), said.err

    return call


@pytest.fixture
def files(tmp_path):
    old, new = tmp_path / "old.js", tmp_path / "new.js"
    old.write_text(OLD)
    new.write_text(NEW)
    return tmp_path, old, new


def test_names_from_export_to_rendering(run, files):
    folder, old, new = files
    document, report = folder / "names.json", folder / "lineage.json"
    assert run("names", "export", old, "--output", document)[1] == ['{"symbols": 4, "revision": 0}']
    before = document.read_text()
    assert "fetchAll" not in before  # names of the text are left out
    held = json.loads(before)
    symbol = next(s["symbol_id"] for s in held["symbols"] if s["kind"] == "function" and s["declaration"]["start_byte"] == 0)
    assert run("names", "set", document, symbol, "loadEverything", "--expected-revision", 0)[0] == 0
    assert run("names", "approve", document, symbol, "--expected-revision", 0)[0] == 1  # a stale revision
    assert run("names", "set", document, symbol, " padded", "--expected-revision", 1)[0] == 1
    assert run("names", "approve", document, symbol, "--expected-revision", 1)[1] == ['{"updated": true, "revision": 2}']
    assert json.loads(run("names", "validate", document, "--source-file", old)[1][0]) == {"valid": True, "symbols": 4, "approved": 1, "revision": 2}
    assert run("names", "validate", document, "--source-file", new)[0] == 1
    assert run("lineage", old, new, "--output", report)[0] == 0
    out, made = folder / "next.json", folder / "rendered.js"
    assert run("names", "propagate", document, report, old, new, "--output", out, "--render-output", made, "--render-format", "preserve")[1] == ['{"approved": 1}']
    assert made.read_text() == NEW.replace("function a(", "function loadEverything(") and new.read_text() == NEW
    assert json.loads(out.read_text())["events"][0]["origin"] == "lineage"
    assert run("names", "render", out, new, "--output", new)[0] == 1  # never over its input
    assert run("names", "render", out, new, "--output", made)[0] == 0 and "function loadEverything(b) {\n" in made.read_text()
    report.write_text(report.read_text().replace('"accepted":', '"accepted" :'))
    assert run("names", "propagate", document, report, old, new, "--output", out)[0] == 1
    document.write_text(before.replace('"kind":"parameter"', '"kind":"variable"'))
    assert run("names", "validate", document)[0] == 0 and run("names", "validate", document, "--source-file", old)[0] == 1
    document.write_text(before.replace('"redacted"', '"unheard"'))
    assert run("names", "validate", document)[0] == 1


def test_source_map_commands(run, files):
    folder, old, new = files
    made = lambda name, rows, **more: (folder / name).write_text(json.dumps({"version": 3, "sources": [f"{name}.ts"], "names": [], "mappings": sourcemap.encode(rows), **more}))
    made("outer", [(0, 0, 0, 0, 5)])
    made("inner", [(0, 0, 0, 7, 1)])
    made("full", [(0, 0, 0, 0, 0)], sourcesContent=["text"])
    assert json.loads(run("map", "validate", folder / "outer")[1][0])["segments"] == 1
    assert run("map", "validate", folder / "full")[0] == 1 and run("map", "validate", folder / "full", "--allow-sources-content")[0] == 0
    assert json.loads(run("map", "lookup", folder / "outer", "--line", 0, "--column", 3)[1][0]) == {"orig_line": 0, "orig_col": 5, "status": "mapped"}
    found = json.loads(run("map", "compose-lookup", folder / "outer", folder / "inner", "--line", 0, "--column", 3, "--include-source-names")[1][0])
    assert (found["source"], found["orig_line"], found["orig_col"]) == ("inner.ts", 7, 1)
    assert run("lineage", old, new, "--source-map-source", folder / "outer")[0] == 1
    assert run("lineage", old, new, "--source-map-source", folder / "outer", "--source-map-target", folder / "inner", "--output", folder / "r")[0] == 0
    assert "source_map_source_digest" in (folder / "r").read_text()


def test_diff_inspect_and_dump_commands(run, files):
    folder, old, new = files
    code, lines, _ = run("diff", old, new, "--dump", folder / "dump", "--export-mappings", folder / "renames")
    assert code == 0 and lines[:2] == ["Structural similarity: 66.7%", "Matched declarations: 2/2 vs 3"]
    assert (folder / "renames").read_text() == "fetchAll: a\nother: c\n"
    assert run("diff", old, new, "--export-mappings", old)[0] == 1 and old.read_text() == OLD
    assert run("diff", old, new, "--format", "full")[1][:2] == ["=== Added ===", "+++ Added class 'Added'"]
    rows = [json.loads(x) for x in run("inspect", old, "other", "--compare", new)[1]]
    assert [(r["side"], r["other"], r["other_line"]) for r in rows] == [("old", "c", 2)]
    assert json.loads(run("dump", folder / "dump", "match", "fetchAll")[1][0])["other"] == "a"
    assert json.loads(run("dump", folder / "dump", "load")[1][0])["additions"] == 1
    assert run("ast", old)[1][:2] == ["program [0:0]", "  function_declaration [0:0]"]


def test_long_texts_take_time_in_proportion():
    import time

    from cambium.functions.js_analysis import analyze
    from cambium.functions.js_parser import ParseError, parse

    one = "function f%d(a,b){ // note\n var x=a+b*(a-1)/2, y={k:x,'s':[1,2,3]}; if(x>3){return g(y,\"text %d\")} return (a,b)=>{return x+a}}\n"
    seconds = []
    for n in (200, 2000):
        began = time.process_time()
        analyze("".join(one % (i, i) for i in range(n)))
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0]
    began = time.process_time()
    with pytest.raises(ParseError):
        parse("(" * 8000 + "1" + ")" * 8000)
    for text in ("a" + "+a" * 4000, "x=" + "(" * 1000 + "1" + ")" * 1000, "x=" + "a?b:" * 500 + "c", "f(" * 300 + ")" * 300):
        analyze(text)
    assert time.process_time() - began < 8
