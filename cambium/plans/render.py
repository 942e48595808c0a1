"""Approved names written into texts: DataFrames of names and sources in, texts out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.functions import js_rewrite
from cambium.sources import javascript


def edits(sources: DataFrame, approved: DataFrame) -> DataFrame:
    """(doc_id, start, end, spelling, name): every place that spells a symbol of approved (doc_id, symbol_id, name)."""
    made = javascript.analyze(sources, ["symbols", "occurrences"])
    symbols = javascript.rows_of(made, "symbols", ["doc_id"]).select("doc_id", "symbol_ix", "symbol_id", F.col("name").alias("spelling"))
    places = javascript.rows_of(made, "occurrences", ["doc_id"])
    named = symbols.join(approved.select("doc_id", "symbol_id", "name"), ["doc_id", "symbol_id"])
    return places.join(named, ["doc_id", "symbol_ix"]).select("doc_id", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "spelling", "name")


def rendered(sources: DataFrame, approved: DataFrame, pretty: bool = False) -> DataFrame:
    """(doc_id, text): sources (doc_id, source) under their approved names. Spans must hold their spelling, may not overlap,
    and the text must still parse; pretty formats it."""
    listed = edits(sources, approved).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "spelling", "name"))).alias("edits"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for source, rows in zip(frame["source"], frame["edits"], strict=True):
                made = js_rewrite.render(source or "", [] if rows is None else [(r["start"], r["end"], r["spelling"], r["name"]) for r in rows])
                texts.append(js_rewrite.pretty(made) if pretty else made)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": texts})

    kind = sources.schema["doc_id"].dataType.simpleString()
    return sources.join(listed, "doc_id", "left").select("doc_id", "source", "edits").mapInPandas(run, f"doc_id {kind}, text string")


def rewritten(sources: DataFrame) -> DataFrame:
    """(doc_id, canonical, mapping, restored, formatted) of sources (doc_id, source): the text under canonical names, the
    mapping rows, the text that the mapping with the old names as new ones gives back, and the canonical text formatted."""
    row = "first_line:int,first_col:int,last_line:int,last_col:int,type:string,scope:int,original:string,canonical:string,new:string"
    names = [f.split(":")[0] for f in row.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [js_rewrite.canonicalize(t or "") for t in frame["source"]]
            back = [js_rewrite.apply_mapping(text, js_rewrite.read_mapping(js_rewrite.mapping_text([(*r[:8], r[6]) for r in rows]))) for text, rows in made]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "canonical": [t for t, _ in made], "mapping": [[dict(zip(names, r, strict=True)) for r in rows] for _, rows in made], "restored": back, "formatted": [js_rewrite.pretty(t) for t, _ in made]})

    kind = sources.schema["doc_id"].dataType.simpleString()
    return sources.select("doc_id", "source").mapInPandas(run, f"doc_id {kind}, canonical string, mapping array<struct<{row}>>, restored string, formatted string")
