import pytest
from pyspark.sql import functions as F

from cambium import __main__ as cli
from cambium.operators import integrity
from cambium.plans import diff, report
from cambium.sources import dump, javascript

OLD = 'function f(){return "a"}\nfunction g(x){return h(x)}\nvar gone=function(){for(;;)q()}\n'
NEW = 'function f(){return "b"}\nfunction renamed(y){return h(y)}\nclass New{m(){}}\n'


def test_dump_round_trip_and_tampering(spark, tmp_path):
    pairs = spark.createDataFrame([(1, OLD, NEW)], "pair_id long, old string, new string")
    matches, changes = diff.compare(pairs)
    folder = f"{tmp_path}/dump"
    dump.save(spark, folder, {"declarations": diff.declarations(pairs), "matches": matches, "changes": changes})
    held = dump.load(spark, folder)
    assert [(r.side, r.other, r.classification) for r in dump.find(held, "f").collect()] == [("old", "f", "string_only"), ("new", "f", "string_only")]
    assert [r.name for r in dump.unmatched(held, "old").collect()] == ["gone"] and [r.name for r in dump.unmatched(held, "new").collect()] == ["New"]
    assert [(r.old, r.new) for r in dump.renames(held).collect()] == [("g", "renamed")]
    assert {r.change: r.n for r in dump.summary(held).collect()} == {"addition": 1, "deletion": 1, "modification": 1}
    assert dump.match_of(held, 1, 0).count() == 1 and dump.first_lines(held, 1).count() == 1
    held["changes"].limit(2).write.mode("append").parquet(f"{folder}/changes")
    with pytest.raises(dump.DumpError, match="changes: rows"):
        dump.load(spark, folder)


def test_reports(spark):
    pairs = spark.createDataFrame([(1, OLD, NEW)], "pair_id long, old string, new string")
    matches, changes = diff.compare(pairs)
    assert [r.text for r in report.summary_lines(diff.summary(pairs, matches, changes)).collect()] == ["matched: 2", "renamed: 1", "unchanged: 1", "string_only: 1", "structural: 0", "added: 1", "removed: 1"]
    assert [r.text for r in report.compact_lines(changes, "a.js", "b.js").collect()] == ["Removed: 1", "  gone (a.js:3-3)", "Added: 1", "  New (b.js:3-3)", "String-only: 1", "  f (a.js:1 -> b.js:1)"]
    assert [r.text for r in report.full_lines(changes).collect()] == [
        "=== Removed ===", "--- Removed variable 'gone'\n    at line 3: var gone=function(){for(;;)q()}", "=== Added ===", "+++ Added class 'New'\n    at line 3: class New{m(){}}",
        "=== String Changes ===", "@@@ function 'f' — string-only\n  - at line 1: function f(){return \"a\"}\n  + at line 1: function f(){return \"b\"}",
    ]
    assert [r.text for r in report.rename_export(matches).collect()] == ["g: renamed\n"]
    assert any(r.text == '+function f(){return "b"}' for r in report.unified(pairs).collect())
    long = spark.createDataFrame([("x", "var a='" + "x" * 300 + "';\n\n  /*1*/ function f(){}")], "file_id string, source string")
    shown = [r.snippet for r in javascript.rows_of(javascript.analyze(long, ["declarations"]), "declarations", ["file_id"]).collect()]
    assert len(shown[0]) == 201 and shown[0].endswith("…") and shown[1] == "/*1*/ function f(){}"


def test_integrity(spark):
    sources = spark.createDataFrame([("a", OLD), ("b", 'import {q as z} from "m";new z(1);{let w=z;w()}')], "file_id string, source string")
    analysis = javascript.analyze(sources)
    tables = {t: javascript.rows_of(analysis, t, ["file_id"]).cache() for t in ("nodes", "scopes", "symbols", "references", "calls")}
    assert integrity.violations(tables, ["file_id"]).count() == 0
    bad = tables | {"references": tables["references"].withColumn("name", F.lit("forged"))}
    assert {r.rule for r in integrity.violations(bad, ["file_id"]).collect()} == {"reference names another symbol"}


def test_sources_are_checked(spark, tmp_path):
    (tmp_path / "ok.js").write_text("var a=1")
    assert [r.source for r in javascript.read_sources(spark, f"{tmp_path}/ok.js").collect()] == ["var a=1"]
    (tmp_path / "bad.js").write_bytes(b"\xff\xfe")
    for path, most in ((f"{tmp_path}/bad.js", 100), (f"{tmp_path}/ok.js", 3)):
        with pytest.raises(Exception, match="UTF-8|large"):
            javascript.read_sources(spark, path, most).collect()
    loose = javascript.analyze(spark.createDataFrame([("x", "var =")], "file_id string, source string"), ["calls"], strict=False).first()
    assert loose.calls == [] and "1:5" in loose.error


def test_command_line(spark, tmp_path, capsys):
    old, new = tmp_path / "old.js", tmp_path / "new.js"
    old.write_text(OLD)
    new.write_text(NEW)
    assert cli.main(["diff", str(old), str(new), "--format", "compact", "--dump", f"{tmp_path}/d"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["Removed: 1", "  gone (old.js:3-3)"]
    assert cli.main(["dump", f"{tmp_path}/d", "unmatched-old"]) == 0
    assert '"gone"' in capsys.readouterr().out
    assert cli.main(["canon", str(old), "--mapping", f"{tmp_path}/m"]) == 0
    assert "param_0" in capsys.readouterr().out and "param_0" in (tmp_path / "m").read_text()
    new.write_text("var =")
    assert cli.main(["diff", str(old), str(new)]) == 1
    assert "1:5" in capsys.readouterr().err
