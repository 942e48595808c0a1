"""python -m cambium diff|lineage|names|canon|pretty|ast|map|inspect|dump ...: the engine over files that the driver can name."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cambium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cambium")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("diff")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--format", choices=["summary", "compact", "full", "unified", "json"], default="summary")
    p.add_argument("--fingerprints", action="store_true")
    p.add_argument("--dump")
    p.add_argument("--export-mappings")
    p = sub.add_parser("lineage")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--output")
    p.add_argument("--source-map-source")
    p.add_argument("--source-map-target")
    p.add_argument("--allow-sources-content", action="store_true")
    p.add_argument("--min-score-bps", type=int, default=7200)
    p.add_argument("--min-margin-bps", type=int, default=700)
    p.add_argument("--max-candidates", type=int, default=96)
    for name in ("canon", "pretty", "ast"):
        p = sub.add_parser(name)
        p.add_argument("source")
        p.add_argument("--mapping")
        p.add_argument("--apply")
    p = sub.add_parser("inspect")
    p.add_argument("old")
    p.add_argument("name")
    p.add_argument("--compare")
    p = sub.add_parser("dump")
    p.add_argument("folder")
    p.add_argument("query", choices=["find", "match", "unmatched-old", "unmatched-new", "summary", "load", "validate"])
    p.add_argument("name", nargs="?")
    maps = sub.add_parser("map").add_subparsers(dest="query", required=True)
    for name in ("validate", "lookup", "compose-lookup"):
        p = maps.add_parser(name)
        p.add_argument("map")
        if name == "compose-lookup":
            p.add_argument("inner")
        if name != "validate":
            p.add_argument("--line", type=int, required=True)
            p.add_argument("--column", type=int, required=True)
            p.add_argument("--include-source-names", action="store_true")
        p.add_argument("--allow-sources-content", action="store_true")
    names = sub.add_parser("names").add_subparsers(dest="query", required=True)
    p = names.add_parser("export")
    p.add_argument("source")
    p.add_argument("--output", required=True)
    p.add_argument("--include-generated-names", action="store_true")
    p = names.add_parser("validate")
    p.add_argument("document")
    p.add_argument("--source-file")
    for name in ("set", "approve", "reject", "clear"):
        p = names.add_parser(name)
        p.add_argument("document")
        p.add_argument("symbol")
        if name == "set":
            p.add_argument("name")
        p.add_argument("--expected-revision", type=int, required=True)
        p.add_argument("--origin", default="human")
    p = names.add_parser("propagate")
    for name in ("document", "lineage", "source", "target"):
        p.add_argument(name)
    p.add_argument("--output", required=True)
    p.add_argument("--source-map-source")
    p.add_argument("--source-map-target")
    p.add_argument("--allow-sources-content", action="store_true")
    p.add_argument("--render-output")
    p.add_argument("--render-format", choices=["pretty", "preserve"], default="pretty")
    p = names.add_parser("render")
    p.add_argument("document")
    p.add_argument("target")
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=["pretty", "preserve"], default="pretty")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    from pyspark.errors import PySparkException

    try:
        return _run(a)
    except (ValueError, OSError, PySparkException) as e:
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


def read_text(path: str, most_bytes: int = 1 << 28) -> str:
    """A whole file of UTF-8, which must not be longer than most_bytes."""
    with open(path, "rb") as f:
        raw = f.read(most_bytes + 1)
    if len(raw) > most_bytes:
        raise ValueError(f"{path} is too large")
    return raw.decode("utf-8")


def write_text(path: str, text: str, inputs: tuple[str, ...] = ()) -> None:
    """Puts a file in place at once; never over one of the inputs."""
    target = Path(path).resolve()
    if any(Path(i).resolve() == target for i in inputs):
        raise ValueError(f"{path} would overwrite its input")
    handle, temporary = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, target)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def told(rows) -> list[str]:
    from pyspark.sql import functions as F

    return [r.value for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).collect()]


def _run(a: argparse.Namespace) -> int:
    if a.command in ("canon", "pretty", "ast"):
        lines = [_rewrite(a)]
    else:
        lines = {"map": _map, "dump": _dump, "inspect": _inspect, "names": _names, "lineage": _lineage, "diff": _diff}[a.command](session(), a)
    sys.stdout.write("\n".join(lines) + ("" if lines and lines[-1].endswith("\n") else "\n"))
    return 0


def _rewrite(a: argparse.Namespace) -> str:
    from cambium.functions import js_analysis, js_rewrite

    text = read_text(a.source)
    if a.command == "ast":
        return "\n".join(line for _, line in js_analysis.outline(text))
    if a.command == "pretty":
        return js_rewrite.pretty(text)
    if a.apply:
        return js_rewrite.apply_mapping(text, js_rewrite.read_mapping(read_text(a.apply)))
    made, rows = js_rewrite.canonicalize(text)
    if a.mapping:
        write_text(a.mapping, js_rewrite.mapping_text(rows), (a.source,))
    return made


def _map(spark, a: argparse.Namespace) -> list[str]:
    from cambium.functions import sourcemap
    from cambium.sources import maps

    limits = sourcemap.Limits(content=a.allow_sources_content)
    held = lambda *paths: spark.createDataFrame([(f"map-{k}", read_text(p, limits.bytes)) for k, p in enumerate(paths)], "map_id string, json string")
    if a.query == "validate":
        (row,) = maps.validate(held(a.map), limits).collect()
        if not row.valid:
            raise ValueError(row.error)
        return [json.dumps({"valid": True, "version": 3, "coordinate_basis": "zero_based_utf16", "map_digest": row.digest, "segments": row.segments})]
    asked = spark.createDataFrame([("map-0", a.line, a.column)], "map_id string, line long, column long")
    if a.query == "lookup":
        found = maps.lookup(asked, maps.segments(held(a.map), limits))
    else:
        both = maps.segments(held(a.map, a.inner), limits)
        outer = both.where("map_id = 'map-0'")
        sources = outer.where("source IS NOT NULL").select("source").distinct().selectExpr("source", "'map-1' AS inner_id")
        found = maps.compose(asked, outer, both.where("map_id = 'map-1'"), sources)
    found = found.drop("map_id", "line", "column")
    return told((found if a.include_source_names else maps.redacted(found)).orderBy("orig_line", "orig_col"))


def _dump(spark, a: argparse.Namespace) -> list[str]:
    from cambium.sources import dump

    if a.query == "validate":
        return told(dump.validate(spark, a.folder))
    held = dump.load(spark, a.folder)
    rows = {
        "find": lambda: dump.find(held, a.name or ""), "match": lambda: dump.match_named(held, a.name), "summary": lambda: dump.summary(held), "load": lambda: dump.overview(held),
        "unmatched-old": lambda: dump.unmatched(held, "old").select("id", "name", "kind", "line"), "unmatched-new": lambda: dump.unmatched(held, "new").select("id", "name", "kind", "line"),
    }
    return told(rows[a.query]())


def _pairs(spark, old: str, new: str):
    from cambium.functions.js_parser import parse

    parse(old), parse(new)  # a clear error before any job starts
    return spark.createDataFrame([(0, old, new)], "pair_id long, old string, new string")


def _inspect(spark, a: argparse.Namespace) -> list[str]:
    from cambium.plans import diff
    from cambium.sources import dump

    old = read_text(a.old)
    found = diff.comparison(_pairs(spark, old, read_text(a.compare) if a.compare else ""))
    return told(dump.inspect(found.declarations, found.matches, a.name)) or [json.dumps({"name": a.name, "found": 0})]


def _diff(spark, a: argparse.Namespace) -> list[str]:
    from cambium.plans import diff, report
    from cambium.sources import dump

    pairs = _pairs(spark, read_text(a.old), read_text(a.new))
    found = diff.comparison(pairs, a.fingerprints)
    if a.dump:
        dump.save(spark, a.dump, {"declarations": found.declarations, "matches": found.matches, "changes": found.changes})
    if a.export_mappings:
        made = report.rename_export(found.matches).collect()
        write_text(a.export_mappings, made[0].text if made else "{}\n", (a.old, a.new))
    if a.format == "json":
        return [r.json for r in report.as_json(found.changes).collect()]
    if a.format == "unified":
        return [r.text for r in report.display_diffs(found.words).orderBy("i1", "place").collect()]
    if a.format == "summary":
        total = diff.totals(found.declarations, found.matches, pairs).first()
        head = [f"Structural similarity: {total.similarity * 100:.1f}%", f"Matched declarations: {total.matched}/{total.total_old} vs {total.total_new}"]
        return head + [r.text for r in report.summary_lines(diff.summary(pairs, found.matches, found.changes)).collect()]
    rows = report.compact_lines(found.changes, Path(a.old).name, Path(a.new).name) if a.format == "compact" else report.full_lines(found.changes)
    return [r.text for r in rows.collect()]


def _traced(spark, a: argparse.Namespace, old: str, new: str, config=None):
    """(pairs, config, segments and digests of source maps, or none) of a command's arguments."""
    from cambium.functions import sourcemap
    from cambium.plans import lineage
    from cambium.sources import maps

    if bool(a.source_map_source) != bool(a.source_map_target):
        raise ValueError("source maps of both sides go together")
    pairs = _pairs(spark, old, new)
    config = config or lineage.Config(a.min_score_bps, a.min_margin_bps, a.max_candidates)
    if not a.source_map_source:
        return pairs, config, None, None
    limits = sourcemap.Limits(content=a.allow_sources_content)
    held = spark.createDataFrame([(f"0:{side}", read_text(path, limits.bytes)) for side, path in (("old", a.source_map_source), ("new", a.source_map_target))], "map_id string, json string")
    digests = maps.validate(held, limits).collect()
    if any(not d.valid for d in digests):
        raise ValueError(next(d.error for d in digests if not d.valid))
    of = {d.map_id: d.digest for d in digests}
    bound = spark.createDataFrame([(0, of["0:old"], of["0:new"])], "pair_id long, source_map_source_digest string, source_map_target_digest string")
    return pairs, config, maps.segments(held, limits), bound


def _lineage(spark, a: argparse.Namespace) -> list[str]:
    from cambium.plans import lineage

    pairs, config, segments, bound = _traced(spark, a, read_text(a.old), read_text(a.new))
    matches, targets, stats = lineage.trace(pairs, config, segments)
    if a.output:
        (row,) = lineage.reports(pairs, matches, targets, stats, config, bound).collect()
        write_text(a.output, row.json + "\n", (a.old, a.new))
        return told(stats.drop("pair_id"))
    return told(matches.select("name_old", "name_new", "decision", "confidence", "score")) + told(stats.drop("pair_id"))


def _analysis(spark, path: str, generated: bool = False):
    """(sources, entries of review, digests) of one file, under the doc_id of its place."""
    from cambium.operators.scratch import cut
    from cambium.plans import review
    from cambium.sources import javascript

    sources = spark.createDataFrame([("doc", read_text(path))], "doc_id string, source string")
    made = cut(javascript.analyze(sources), "analysis")
    tables = {t: javascript.rows_of(made, t, ["doc_id"]) for t in ("nodes", "scopes", "symbols", "references", "calls")}
    return sources, cut(review.entries(tables, ["doc_id"], generated), "entries"), javascript.digests(sources, made, ["doc_id"])


def _document(spark, path: str):
    """A review document that was read and found sound."""
    from cambium.operators.scratch import cut
    from cambium.sources import documents

    rows = spark.createDataFrame([("doc", read_text(path, documents.MOST_BYTES).rstrip("\n"))], "doc_id string, json string")
    read = cut(documents.parsed(rows, documents.NAMES, documents.MOST_BYTES).select("doc_id", "json", "d.*"), "document")
    _sound(documents.review_violations(read))
    return read


def _sound(violations) -> None:
    if wrong := sorted({r.problem for r in violations.select("problem").distinct().collect()}):
        raise ValueError(f"document is not sound: {', '.join(wrong)}")


def _names(spark, a: argparse.Namespace) -> list[str]:
    from pyspark.sql import functions as F

    from cambium.operators import names
    from cambium.plans import lineage, render
    from cambium.sources import documents

    one = lambda rows: rows.collect()[0].json + "\n"
    if a.query == "export":
        _, entries, digests = _analysis(spark, a.source, a.include_generated_names)
        write_text(a.output, one(documents.review_documents(entries, digests)), (a.source,))
        return [json.dumps({"symbols": entries.count(), "revision": 0})]
    read = _document(spark, a.document)
    head = read.select("revision", F.size("symbols").alias("n"), "redacted").first()
    events = documents.events_of(read)
    if a.query == "validate":
        if a.source_file:
            _, entries, digests = _analysis(spark, a.source_file, not head.redacted)
            _sound(documents.bound_violations(read, entries, digests))
        counts = names.approved_counts(events).collect()
        return [json.dumps({"valid": True, "symbols": head.n, "approved": counts[0].approved if counts else 0, "revision": head.revision})]
    if a.query in ("set", "approve", "reject", "clear"):
        if head.revision != a.expected_revision:
            raise ValueError(f"revision changed: expected {a.expected_revision}, found {head.revision}")
        if documents.symbols_of(read).where(F.col("symbol_id") == a.symbol).isEmpty():
            raise ValueError("unknown symbol")
        state = {"set": "suggested", "approve": "approved", "reject": "rejected", "clear": "cleared"}[a.query]
        asked = spark.createDataFrame([("doc", a.symbol, state, a.name if a.query == "set" else None, a.origin, None)], "doc_id string, symbol_id string, new_state string, new_name string, origin string, actor string")
        added = names.apply_requests(events, asked).collect()
        made = events.unionByName(spark.createDataFrame(added, names.EVENT))
        write_text(a.document, one(documents.updated(read, made)))
        return [json.dumps({"updated": True, "revision": head.revision + len(added)})]
    if a.query == "render":
        sources, entries, digests = _analysis(spark, a.target, not head.redacted)
        _sound(documents.bound_violations(read, entries, digests))
        (row,) = render.rendered(sources, names.current(events).where("state = 'approved'"), a.format == "pretty").collect()
        write_text(a.output, row.text, (a.target, a.document))
        return [json.dumps({"rendered": True})]
    return _propagate(spark, a, read, events)


def _propagate(spark, a: argparse.Namespace, read, events) -> list[str]:
    from pyspark.sql import functions as F

    from cambium.operators import names
    from cambium.plans import lineage, render
    from cambium.sources import documents

    sources, entries, digests = _analysis(spark, a.source, not read.first().redacted)
    _sound(documents.bound_violations(read, entries, digests))
    rows = spark.createDataFrame([(0, read_text(a.lineage, lineage.MOST_BYTES).rstrip("\n"))], "pair_id long, json string")
    held = documents.parsed(rows, lineage.REPORT, lineage.MOST_BYTES).select("pair_id", "json", "d.*")
    if wrong := [r.rule for r in lineage.report_violations(held).collect()]:
        raise ValueError(f"report is not sound: {', '.join(wrong)}")
    said = held.select("config", "config_digest").first()
    pairs, config, segments, bound = _traced(spark, a, read_text(a.source), read_text(a.target), lineage.Config(**said.config.asDict()))
    if not lineage.report_differences(held.select("pair_id", "json"), pairs, segments, config, bound).isEmpty():
        raise ValueError("report is not what these files, and source maps, give")
    target, found, target_digests = _analysis(spark, a.target)
    accepted = held.select(F.inline("matches")).where("decision = 'accepted'").select(F.lit("doc").alias("doc_id"), F.col("source_symbol_id").alias("source_symbol"), F.lit("doc").alias("new_doc"), F.col("target_symbol_id").alias("target_symbol"))
    moved = names.propagate(events, accepted, found.select(F.lit("doc").alias("new_doc"), "symbol_id"), said.config_digest)
    made = spark.createDataFrame(names.apply_requests(spark.createDataFrame([], names.EVENT), moved, trusted=True).collect(), names.EVENT)
    (row,) = documents.review_documents(found, target_digests, made).collect()
    write_text(a.output, row.json + "\n", (a.document, a.source, a.target, a.lineage))
    if a.render_output:
        (text,) = render.rendered(target, names.current(made).where("state = 'approved'"), a.render_format == "pretty").collect()
        write_text(a.render_output, text.text, (a.target,))
    return [json.dumps({"approved": made.count()})]


if __name__ == "__main__":
    sys.exit(main())
