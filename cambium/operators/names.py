"""Reviewed names as an event log: suggestions, decisions, replay, validation, propagation along accepted matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions import fields
from cambium.functions import hashing as H

#: A symbol's state before any event, and which decision may follow which state.
UNKNOWN = "unknown"
STATES = [UNKNOWN, "suggested", "approved", "rejected", "cleared"]
STEPS = {("suggested", "approved"), ("suggested", "rejected"), ("suggested", "cleared"), ("approved", "cleared")}
EVENT = "doc_id string, revision long, operation_id string, symbol_id string, previous_state string, previous_name string, new_state string, new_name string, origin string, actor string, evidence_digest string"


def operation_id(*columns: str) -> Column:
    """Requests with equal contents are one operation."""
    return H.digest_id("operation", *[F.col(c) for c in columns])


def _legal(trusted: bool = False) -> Column:
    legal = F.col("new_state") == "suggested"
    for a, b in sorted(STEPS | ({(s, "approved") for s in STATES} if trusted else set())):
        legal = legal | (F.col("previous_state") == a) & (F.col("new_state") == b)
    return legal


def _or_error(fine: Column, value: Column, message: Column | str) -> Column:
    return F.when(fine, value).otherwise(F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("string"))


def current(events: DataFrame) -> DataFrame:
    """(doc_id, symbol_id, state, name): each symbol's last state."""
    last = events.groupBy("doc_id", "symbol_id").agg(F.max_by(F.struct("new_state", "new_name"), "revision").alias("last"))
    return last.select("doc_id", "symbol_id", F.col("last.new_state").alias("state"), F.col("last.new_name").alias("name"))


def apply_requests(events: DataFrame, requests: DataFrame, expected: DataFrame | None = None, trusted: bool = False) -> DataFrame:
    """Events that requests (doc_id, symbol_id, new_state, new_name, origin, actor[, evidence_digest]) add: at most one for
    each symbol; two for one symbol raise an error (streaming.names folds such).

    A suggestion may follow any state; other decisions only those of STEPS (if trusted, approval any), and keep the name. A
    request that changes nothing, or whose operation is in the log, adds nothing; an illegal step raises an error, as do
    names and tokens that are not fine, and a document whose revision is not the expected one (doc_id, expected_revision).
    """
    if "evidence_digest" not in requests.columns:
        requests = requests.withColumn("evidence_digest", F.lit(None).cast("string"))
    own = Window.partitionBy("doc_id", "symbol_id")
    r = requests.withColumn("asked", F.count(F.lit(1)).over(own)).join(current(events), ["doc_id", "symbol_id"], "left")
    r = r.withColumn("new_state", _or_error(F.col("asked") == 1, F.col("new_state"), "two requests for one symbol")).drop("asked")
    r = r.withColumn("previous_state", F.coalesce("state", F.lit(UNKNOWN))).withColumn("previous_name", F.col("name"))
    r = r.withColumn("new_name", F.when(F.col("new_state") == "suggested", F.col("new_name")).when(F.col("new_state") == "approved", F.coalesce("new_name", "name")))
    same = (F.col("previous_state") == F.col("new_state")) & F.col("previous_name").eqNullSafe(F.col("new_name"))
    r = r.withColumn("operation_id", operation_id("doc_id", "symbol_id", "new_state", "new_name", "origin", "actor", "evidence_digest"))
    r = r.where(~same).join(events.select("doc_id", "operation_id"), ["doc_id", "operation_id"], "left_anti")
    heads = events.groupBy("doc_id").agg(F.max("revision").alias("head"))
    r = r.join(heads, "doc_id", "left").withColumn("head", F.coalesce("head", F.lit(0)))
    if expected is not None:
        r = r.join(expected, "doc_id", "left")
        r = r.withColumn("head", F.when(F.coalesce("expected_revision", "head") == F.col("head"), F.col("head")).otherwise(F.raise_error(F.lit("revision is not the expected one")).cast("long")))
    named = ~F.col("new_state").isin("suggested", "approved") | fields.name(F.col("new_name"))
    tokens = fields.token(F.col("origin")) & (F.col("actor").isNull() | fields.token(F.col("actor"))) & (F.col("evidence_digest").isNull() | fields.hex256(F.col("evidence_digest")))
    step = F.concat(F.lit("no step from "), "previous_state", F.lit(" to "), "new_state")
    r = r.withColumn("new_state", _or_error(named & tokens, _or_error(_legal(trusted), F.col("new_state"), step), "a name, origin, actor or digest is not fine"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("symbol_id", "operation_id"))
    return r.select("doc_id", (F.col("head") + place).cast("long").alias("revision"), "operation_id", "symbol_id", "previous_state", "previous_name", "new_state", "new_name", "origin", "actor", "evidence_digest")


def violations(events: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """(doc_id, revision, problem): gaps in revisions, steps that do not start at the state before, repeated operations,
    illegal steps, states and names that disagree, fields that are not fine, and approved names that two symbols of one
    scope share. scopes: (doc_id, symbol_id, scope_id); without them a document is one scope. Empty for a sound log."""
    doc = Window.partitionBy("doc_id").orderBy("revision")
    own = Window.partitionBy("doc_id", "symbol_id").orderBy("revision")
    e = events.withColumn("place", F.row_number().over(doc)).withColumn("before", F.coalesce(F.lag("new_state").over(own), F.lit(UNKNOWN))).withColumn("before_name", F.lag("new_name").over(own))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "operation_id").orderBy("revision")))
    named = F.col("new_state").isin("suggested", "approved")
    problem = (
        F.when(F.col("place") != F.col("revision"), "revision")
        .when((F.col("before") != F.col("previous_state")) | ~F.col("before_name").eqNullSafe(F.col("previous_name")), "history")
        .when(F.col("nth") > 1, "repeated operation")
        .when(~_legal() & ~((F.col("new_state") == "approved") & (F.col("origin") == "lineage")), "illegal step")
        .when(named != F.col("new_name").isNotNull(), "state and name disagree")
        .when(named & ~fields.name(F.col("new_name")) | ~fields.token(F.col("origin")), "field")
    )
    found = e.select("doc_id", "revision", problem.alias("problem")).where("problem IS NOT NULL")
    approved = current(events).where("state = 'approved'")
    approved = approved.withColumn("scope_id", F.lit("")) if scopes is None else approved.join(scopes, ["doc_id", "symbol_id"], "left")
    shared = approved.groupBy("doc_id", "scope_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(shared.select("doc_id", F.lit(None).cast("long").alias("revision"), F.lit("name is approved twice").alias("problem")))


def approved_counts(events: DataFrame) -> DataFrame:
    """(doc_id, approved, revision) of each document with events."""
    heads = events.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    counts = current(events).groupBy("doc_id").agg(F.count_if(F.col("state") == "approved").alias("approved"))
    return counts.join(heads, "doc_id").select("doc_id", "approved", "revision")


def symbol_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, symbol_id, side) of symbols that only one of two tables (doc_id, symbol_id) has. Empty if they are equal."""
    columns = ["doc_id", "symbol_id"]
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def propagate(events: DataFrame, accepted: DataFrame, targets: DataFrame, evidence_digest: str | None = None) -> DataFrame:
    """Requests for new documents: approved names (doc_id, symbol_id) move along accepted matches (doc_id, source_symbol,
    new_doc, target_symbol) to symbols of targets (new_doc, symbol_id). apply_requests takes them as trusted: a name that
    was approved before is approved again."""
    names = current(events).where("state = 'approved'").select("doc_id", F.col("symbol_id").alias("source_symbol"), "name")
    known = targets.select("new_doc", F.col("symbol_id").alias("target_symbol"))
    moved = names.join(accepted, ["doc_id", "source_symbol"]).join(known, ["new_doc", "target_symbol"], "left_semi")
    return moved.select(
        F.col("new_doc").alias("doc_id"), F.col("target_symbol").alias("symbol_id"), F.lit("approved").alias("new_state"), F.col("name").alias("new_name"),
        F.lit("lineage").alias("origin"), F.lit(None).cast("string").alias("actor"), F.lit(evidence_digest).cast("string").alias("evidence_digest"),
    )
