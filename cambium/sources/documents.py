"""JSON documents: one line of text each, read strictly and within limits; and the review documents of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.functions import fields
from cambium.functions.js_analysis import ROLES
from cambium.operators import names
from cambium.plans.review import KINDS

#: Format and instructions of a review document, its most bytes and symbols, and events for each symbol.
FORMAT = "cambium.semantic-name-review.v1"
INSTRUCTIONS = "Suggest names with the names set command. A suggestion moves to other versions only once it is approved."
MOST_BYTES, MOST_SYMBOLS, MOST_EVENTS = 32 << 20, 1_000_000, 8


def write(documents: DataFrame, folder: str, most_bytes: int, key: str = "doc_id") -> None:
    """Writes documents (key, json) as lines of text, all or none; a longer one than most_bytes is an error."""
    fine = F.when(F.octet_length("json") <= most_bytes, F.col("json")).otherwise(F.raise_error(F.concat(F.lit("document is too large: "), F.col(key).cast("string"))))
    documents.select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), fine.alias("json"))).alias("value")).write.mode("errorifexists").text(folder)


def read(spark: SparkSession, folder: str, schema: str, most_bytes: int, key: str = "doc_id") -> DataFrame:
    """(key, json, the columns of schema) of documents that write made. One that is too large, is no JSON, or has a field at
    its top that schema doesn't know, is an error."""
    lines = spark.read.text(folder).select(F.from_json("value", "key string, json string", {"mode": "FAILFAST"}).alias("d")).select(F.col("d.key").alias(key), "d.json")
    return parsed(lines, schema, most_bytes).select(key, "json", "d.*")


def parsed(documents: DataFrame, schema: str, most_bytes: int) -> DataFrame:
    """documents (..., json) with d, a struct of schema."""
    known = [f.name for f in T.StructType.fromDDL(schema)]
    small = F.octet_length("json") <= most_bytes
    plain = F.size(F.array_except(F.coalesce(F.json_object_keys("json"), F.array(F.lit("?"))), F.array(*[F.lit(k) for k in known]))) == 0
    checked = F.when(~small, F.raise_error(F.lit("document is too large")).cast("string")).when(~plain, F.raise_error(F.lit("document has an unknown field")).cast("string")).otherwise(F.col("json"))
    return documents.withColumn("d", F.from_json(checked, schema, {"mode": "FAILFAST"}))


USAGE = ["references", *ROLES, "resolved", "unresolved", "ambiguous", *[f"{k}_calls" for k in KINDS]]
NAMES = (
    "format string, revision long, instructions string, analysis struct<source_digest:string,analysis_digest:string,source_length:bigint>, redacted boolean, "
    "symbols array<struct<symbol_id:string,state:string,semantic_name:string,generated_name:string,kind:string,scope:struct<id:string,kind:string,depth:int,ancestor_kinds:array<string>>,"
    "declaration:struct<node_id:string,kind:string,start_byte:int,end_byte:int,ancestor_kinds:array<string>,child_kinds:array<string>,truncated:boolean>,"
    f"usage:struct<{','.join(f'{k}:bigint' for k in USAGE)}>,references:array<struct<node_id:string,role:string,resolution:string,parent_kind:string>>,references_truncated:boolean,"
    "calls:array<struct<node_id:string,call_kind:string,is_target:boolean>>,calls_truncated:boolean,provenance:struct<origin:string,actor:string,evidence_digest:string>>>, "
    "events array<struct<revision:bigint,operation_id:string,symbol_id:string,previous_state:string,previous_name:string,new_state:string,new_name:string,origin:string,actor:string,evidence_digest:string>>"
)


def _immutable() -> list[Column]:
    """What an entry tells of the source."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return [
        F.col("kind"), F.struct(F.col("scope_id").alias("id"), F.col("scope_kind").alias("kind"), F.col("scope_depth").alias("depth"), F.col("scope_ancestors").alias("ancestor_kinds")).alias("scope"),
        F.struct(F.col("declaration_id").alias("node_id"), F.col("declaration_kind").alias("kind"), "start_byte", "end_byte", F.col("ancestors").alias("ancestor_kinds"), none(F.col("children.child_kind"), "array<string>").alias("child_kinds"), F.coalesce("children_truncated", F.lit(False)).alias("truncated")).alias("declaration"),
        F.struct(*USAGE).alias("usage"), none(F.col("reference_contexts"), "array<struct<node_id:string,role:string,resolution:string,parent_kind:string>>").alias("references"), F.coalesce("reference_contexts_truncated", F.lit(False)).alias("references_truncated"),
        none(F.col("call_contexts"), "array<struct<node_id:string,call_kind:string,is_target:boolean>>").alias("calls"), F.coalesce("call_contexts_truncated", F.lit(False)).alias("calls_truncated"),
    ]


def review_documents(entries: DataFrame, digests: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): one document for each file of review.entries keyed by doc_id, with the events so far. digests: of
    javascript.digests. Names of the text are in it where the entries have them."""
    spark = entries.sparkSession
    events = spark.createDataFrame([], names.EVENT) if events is None else events
    last = events.groupBy("doc_id", "symbol_id").agg(F.max_by(F.struct("new_state", "new_name", "origin", "actor", "evidence_digest"), "revision").alias("last"))
    generated = F.col("name") if "name" in entries.columns else F.lit(None).cast("string")
    provenance = F.when(F.col("last").isNotNull(), F.struct("last.origin", "last.actor", "last.evidence_digest"))
    entry = F.struct("symbol_id", F.coalesce("last.new_state", F.lit(names.UNKNOWN)).alias("state"), F.col("last.new_name").alias("semantic_name"), generated.alias("generated_name"), *_immutable(), provenance.alias("provenance"))
    symbols = entries.join(last, ["doc_id", "symbol_id"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["symbol_id"] < b["symbol_id"], -1).when(a["symbol_id"] > b["symbol_id"], 1).otherwise(0)).alias("symbols"))
    event = F.struct("revision", *[c for c in events.columns if c not in ("doc_id", "revision")])
    log = events.groupBy("doc_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    kind = log.schema["events"].dataType
    rows = digests.join(symbols, "doc_id", "left").join(log, "doc_id", "left")
    held = F.coalesce("events", F.array().cast(kind))
    body = F.struct(
        F.lit(FORMAT).alias("format"), F.size(held).cast("long").alias("revision"), F.lit(INSTRUCTIONS).alias("instructions"), F.struct("source_digest", "analysis_digest", "source_length").alias("analysis"),
        F.lit("name" not in entries.columns).alias("redacted"), F.coalesce("symbols", F.array().cast(symbols.schema["symbols"].dataType)).alias("symbols"), held.alias("events"),
    )
    return rows.select("doc_id", F.to_json(body).alias("json"))


def updated(read: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id, json): documents that were read (doc_id, NAMES) with another event log, and the states that follow from it."""
    last = events.groupBy("doc_id", "symbol_id").agg(F.max_by(F.struct("new_state", "new_name", "origin", "actor", "evidence_digest"), "revision").alias("last"))
    rows = symbols_of(read)
    kept = [c for c in rows.columns if c not in ("doc_id", "symbol_id", "state", "semantic_name", "provenance")]
    provenance = F.when(F.col("last").isNotNull(), F.struct("last.origin", "last.actor", "last.evidence_digest"))
    entry = F.struct("symbol_id", F.coalesce("last.new_state", F.lit(names.UNKNOWN)).alias("state"), F.col("last.new_name").alias("semantic_name"), *kept, provenance.alias("provenance"))
    symbols = rows.join(last, ["doc_id", "symbol_id"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["symbol_id"] < b["symbol_id"], -1).when(a["symbol_id"] > b["symbol_id"], 1).otherwise(0)).alias("symbols"))
    log = events.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("revision", *[c for c in events.columns if c not in ("doc_id", "revision")]))).alias("events"))
    held = F.coalesce("e.events", F.array().cast(log.schema["events"].dataType))
    out = read.alias("r").join(symbols.alias("s"), "doc_id", "left").join(log.alias("e"), "doc_id", "left")
    symbols_or_none = F.coalesce("s.symbols", F.array().cast(symbols.schema["symbols"].dataType))
    return out.select("doc_id", F.to_json(F.struct("r.format", F.size(held).cast("long").alias("revision"), "r.instructions", "r.analysis", "r.redacted", symbols_or_none.alias("symbols"), held.alias("events"))).alias("json"))


def events_of(read: DataFrame) -> DataFrame:
    """The event log of documents that were read (doc_id, NAMES)."""
    rows = read.select("doc_id", F.inline("events"))
    return rows.select(*[f.name for f in T.StructType.fromDDL(names.EVENT)])


def symbols_of(read: DataFrame) -> DataFrame:
    """(doc_id, the fields of a symbol's entry)."""
    return read.select("doc_id", F.inline("symbols"))


def review_violations(read: DataFrame) -> DataFrame:
    """(doc_id, problem) of review documents by themselves: format, limits, order, fields, states that replaying the events
    doesn't give, and what names.violations finds. Empty for sound ones."""
    symbols, events = symbols_of(read), events_of(read)
    out = read.where((F.col("format") != FORMAT) | (F.col("instructions") != INSTRUCTIONS)).select("doc_id", F.lit("format").alias("problem"))
    out = out.unionByName(read.where((F.size("symbols") > MOST_SYMBOLS) | (F.size("events") > MOST_EVENTS * MOST_SYMBOLS)).select("doc_id", F.lit("limits").alias("problem")))
    out = out.unionByName(read.where(F.col("revision") != F.size("events")).select("doc_id", F.lit("revision").alias("problem")))
    order = F.transform("symbols", lambda s: s["symbol_id"])
    out = out.unionByName(read.where(~F.array_sort(F.array_distinct(order)).eqNullSafe(order)).select("doc_id", F.lit("order").alias("problem")))
    tokens = F.concat(F.array("kind", "scope.kind", "declaration.kind"), F.col("scope.ancestor_kinds"), F.col("declaration.ancestor_kinds"), F.col("declaration.child_kinds"))
    fine = fields.hex256(F.col("symbol_id")) & fields.hex256(F.col("scope.id")) & fields.hex256(F.col("declaration.node_id")) & F.forall(tokens, lambda t: fields.token(t)) & (F.col("declaration.start_byte") <= F.col("declaration.end_byte"))
    fine = fine & (F.size("declaration.ancestor_kinds") <= 6) & (F.size("declaration.child_kinds") <= 12) & (F.size("references") <= 24) & (F.size("calls") <= 16)
    fine = fine & (F.col("semantic_name").isNull() | fields.name(F.col("semantic_name"))) & (F.col("state").isin("suggested", "approved") == F.col("semantic_name").isNotNull()) & ((F.col("state") == names.UNKNOWN) == F.col("provenance").isNull())
    out = out.unionByName(symbols.where(~fine).select("doc_id", F.lit("field").alias("problem")))
    out = out.unionByName(read.where("redacted").select("doc_id", F.inline("symbols")).where("generated_name IS NOT NULL").select("doc_id", F.lit("name in a redacted document").alias("problem")))
    state = names.current(events).withColumnRenamed("state", "replayed").withColumnRenamed("name", "replayed_name")
    both = symbols.select("doc_id", "symbol_id", "state", "semantic_name").join(state, ["doc_id", "symbol_id"], "full_outer")
    stale = F.col("state").isNull() | ~F.col("state").eqNullSafe(F.coalesce("replayed", F.lit(names.UNKNOWN))) | ~F.col("semantic_name").eqNullSafe(F.col("replayed_name"))
    out = out.unionByName(both.where(stale).select("doc_id", F.lit("replay").alias("problem")))
    scopes = symbols.select("doc_id", "symbol_id", F.col("scope.id").alias("scope_id"))
    return out.unionByName(names.violations(events, scopes).select("doc_id", "problem"))


def bound_violations(read: DataFrame, entries: DataFrame, digests: DataFrame) -> DataFrame:
    """(doc_id, problem) of documents against the exact sources that entries and digests were made of: another source, other
    symbols, or entries whose context was altered."""
    both = read.select("doc_id", "analysis.*").join(digests.select("doc_id", *[F.col(c).alias(f"is_{c}") for c in ("source_digest", "analysis_digest", "source_length")]), "doc_id", "left")
    other = ~(F.col("source_digest").eqNullSafe(F.col("is_source_digest")) & F.col("analysis_digest").eqNullSafe(F.col("is_analysis_digest")) & F.col("source_length").eqNullSafe(F.col("is_source_length")))
    out = both.where(other).select("doc_id", F.lit("another source").alias("problem"))
    symbols = symbols_of(read)
    out = out.unionByName(names.symbol_differences(symbols, entries).select("doc_id", F.lit("other symbols").alias("problem")))
    fields_ = ["kind", "scope", "declaration", "usage", "references", "references_truncated", "calls", "calls_truncated"]
    told = symbols.select("doc_id", "symbol_id", F.to_json(F.struct(*fields_)).alias("told"))
    made = entries.select("doc_id", "symbol_id", F.struct(*_immutable()).alias("e")).select("doc_id", "symbol_id", F.to_json(F.struct(*[F.col("e")[f].alias(f) for f in fields_])).alias("made"))
    return out.unionByName(told.join(made, ["doc_id", "symbol_id"]).where("told != made").select("doc_id", F.lit("altered context").alias("problem")))
