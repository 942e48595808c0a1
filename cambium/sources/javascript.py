"""JavaScript texts to tables. Parsing is the one stage in Python; all tables of a file come from a single pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cambium.functions import js_analysis
from cambium.functions.js_parser import ParseError
from cambium.operators.scratch import dealt

#: Columns of each table, as Spark types.
TABLES = {
    "nodes": "node_ix int, node_id string, parent_ix int, child_ordinal int, kind string, start_byte int, end_byte int, named boolean, flags int",
    "scopes": "scope_ix int, scope_id string, parent_ix int, kind string, depth int, start_byte int, end_byte int, ancestor_kinds array<string>",
    "symbols": "symbol_ix int, symbol_id string, name string, kind string, scope_ix int, node_ix int, reference_first int, reference_count int, container_ix int, ancestor_kinds array<string>",
    "references": "ref_ix int, ref_id string, node_ix int, scope_ix int, name string, role string, symbol_ix int, resolution string, start_byte int, end_byte int",
    "calls": "call_ix int, call_id string, node_ix int, kind string, callee string, callee_ref int, target_symbol int, property string, first_arg string",
    "occurrences": "symbol_ix int, start_byte int, end_byte int",
    "declarations": (
        "decl_ix int, name string, kind string, node_kind string, signature string, line int, end_line int, start_byte int, end_byte int, hashes array<bigint>, "
        "tokens array<struct<tag:string,text:string,decl:int,line:int>>, strings array<string>, constants array<string>, api array<struct<key:string,arg:string>>, evidence_size int, snippet string, text string"
    ),
}

#: Texts, and characters of them, whose tables a Python worker holds at a time.
SLICE_ROWS, SLICE_CHARS = 64, 1 << 17

#: What an analysis does not tell: fixed codes, with what they mean.
LOSSES = {
    "source_map_lineage_unavailable": "where a text comes from is told by its source map, not by its analysis",
    "fingerprint_evidence_unavailable": "evidence of declarations is not part of the graph",
    "dynamic_call_target_unavailable": "calls of members and of computed functions have no target",
    "tdz_and_flow_resolution_unavailable": "names are resolved by scope, not by when they are assigned",
    "dynamic_scope_unavailable": "with statements and direct eval can change what a name means",
}


def _columns(columns: str) -> list[tuple[str, str]]:
    """(name, type) of each column; commas inside types do not split."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate([*columns, ","]):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(tuple(columns[last:k].strip().split(" ", 1)))
            last = k + 1
    return parts


def _struct(columns: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in _columns(columns)) + ">"


def analyze(sources: DataFrame, which: list[str] | None = None, strict: bool = True) -> DataFrame:
    """sources (keys..., source) with one array column for each table and error: null, or where the text doesn't parse.

    strict raises on the first text that is not JavaScript; else its tables are empty. A null source is empty. occurrences
    (every place that spells a symbol) are made only where `which` names them.
    """
    which = which or [t for t in TABLES if t != "occurrences"]
    keys = [c for c in sources.columns if c != "source"]
    kinds = [to_arrow_type(T.ArrayType(T.StructType.fromDDL(TABLES[t]))) for t in which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("source")):
                made: list[list] = [[] for _ in which]
                errors = []
                for text in part.column("source").to_pylist():
                    try:
                        found, error = js_analysis.analyze(text or "", which=which), None
                    except ParseError as e:
                        if strict:
                            raise
                        found, error = {t: [] for t in which}, str(e)
                    errors.append(error)
                    for t, rows in zip(which, made, strict=True):
                        rows.append(found[t])
                columns = [part.column(k) for k in keys] + [pa.array(rows, kind) for rows, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], [*keys, *which, "error"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in sources.schema if f.name != "source"], *[f"{t} array<{_struct(TABLES[t])}>" for t in which], "error string"])
    return dealt(sources, keys).mapInArrow(run, schema).hint("merge")


def slices(batch: pa.RecordBatch, source: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS texts and, if more than one, SLICE_CHARS."""
    start, chars = 0, 0
    for k, n in enumerate(x or 0 for x in pc.utf8_length(batch.column(source)).to_pylist()):
        if k > start and (k - start >= SLICE_ROWS or chars + n > SLICE_CHARS):
            yield batch.slice(start, k - start)
            start, chars = k, 0
        chars += n
    if batch.num_rows > start:
        yield batch.slice(start)


def rows_of(analysis: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """One table of an analysis, with the files' keys."""
    return analysis.select(*keys, F.inline(table))


def losses(spark: SparkSession) -> DataFrame:
    """(code, message): what no analysis of this kind can tell."""
    return spark.createDataFrame(list(LOSSES.items()), "code string, message string")


def digests(sources: DataFrame, analysis: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., source_digest, source_length, analysis_digest): SHA-256 of each text's bytes, and of all its tables."""
    tables = [t for t in TABLES if t in analysis.columns]
    source = F.coalesce("source", F.lit("")).cast("binary")
    texts = sources.select(*keys, F.sha2(source, 256).alias("source_digest"), F.octet_length(source).cast("long").alias("source_length"))
    return texts.join(analysis.select(*keys, F.sha2(F.to_json(F.struct(*tables)), 256).alias("analysis_digest")), keys)


def outline(sources: DataFrame) -> DataFrame:
    """(keys..., node_ix, text): the syntax tree of each source as indented lines."""
    keys = [c for c in sources.columns if c != "source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("source")):
                lines = [js_analysis.outline(text or "") for text in part.column("source").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(lines, kind)], [*keys, "line"])

    kind = to_arrow_type(T.ArrayType(T.StructType.fromDDL("node_ix int, text string")))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in sources.schema if f.name != "source"], "line array<struct<node_ix:int,text:string>>"])
    return dealt(sources, keys).mapInArrow(run, schema).hint("merge").select(*keys, F.inline("line"))


def source_range(source: Column | str, start_line: Column, end_line: Column) -> Column:
    """Lines start_line to end_line (from 1) of a text; empty where there are none."""
    lines = F.split(F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit("")), "\r?\n", -1)
    count = F.least(end_line, F.size(lines)) - start_line + 1
    return F.when((start_line >= 1) & (count > 0), F.array_join(F.slice(lines, F.greatest(start_line, F.lit(1)), F.greatest(count, F.lit(0))), "\n")).otherwise("")


def out_of_range(declarations: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., decl_ix) of declarations whose bytes are no part of their source: empty, beyond its end, or cutting a
    character."""
    raw = sources.select(*keys, F.coalesce("source", F.lit("")).cast("binary").alias("raw"))
    start, end = F.col("start_byte"), F.col("end_byte")
    inner = lambda at: F.conv(F.hex(F.expr(f"substring(raw, {at} + 1, 1)")), 16, 10).cast("int").between(128, 191)
    bad = (start >= end) | (start < 0) | (end > F.octet_length("raw")) | F.coalesce(inner("start_byte"), F.lit(False)) | F.coalesce(inner("end_byte"), F.lit(False))
    return declarations.join(raw, keys).where(bad).select(*keys, "decl_ix")


def read_sources(spark: SparkSession, path: str, most_bytes: int = 256 << 20) -> DataFrame:
    """(file_id, source) of whole files, which must be UTF-8 and no longer than most_bytes."""
    files = spark.read.format("binaryFile").load(path)
    fine = F.when(F.col("length") > most_bytes, F.raise_error(F.concat(F.col("path"), F.lit(" is too large")))).when(~F.is_valid_utf8(F.col("content").cast("string")), F.raise_error(F.concat(F.col("path"), F.lit(" is not UTF-8")))).otherwise(F.col("content").cast("string"))
    return files.select(F.col("path").alias("file_id"), fine.alias("source"))
