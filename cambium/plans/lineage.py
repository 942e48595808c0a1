"""Symbols traced from one version to the next: candidates from five sources, integer scores, decisions that abstain."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cambium.functions import fields
from cambium.functions import hashing as H
from cambium.functions import js_context
from cambium.operators import matching as M
from cambium.operators import similarity as S
from cambium.operators.scratch import dealt
from cambium.sources import javascript, maps


@dataclass(frozen=True)
class Config:
    least_score: int = 7200
    least_margin: int = 700
    max_candidates: int = 96
    rare: int = 24
    size_ratio: int = 4

    def __post_init__(self):
        if min(self.max_candidates, self.rare, self.size_ratio) < 1 or not 0 <= self.least_score <= H.SCALE or not 0 <= self.least_margin <= H.SCALE:
            raise ValueError(f"no sound configuration: {self}")

    def column(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in asdict(self).items()])

    def digest(self) -> Column:
        return F.sha2(F.to_json(self.column()), 256)


#: Names of the report's format, and the most bytes of one.
FORMAT, ALGORITHM, MOST_BYTES = "cambium.lineage.v1", "structural-context-v1", 128 << 20
COUNTERS = ["source_symbols", "target_symbols", "exact_unique_anchors", "candidate_pairs", "expensive_comparisons", "truncated_sources", "accepted", "abstained", "deleted", "added", "ambiguous_targets"]
EVIDENCE = ["exact_shape", "shape_bps", "context_bps", "roles_bps", "size_bps", "scope_bps", "shared_rare_features", "source_map_origin_match"]


_NAMES = [c.split()[0] for c in js_context.COLUMNS.split(", ")]


def contexts(pairs: DataFrame) -> DataFrame:
    """Context rows of both sides of pairs (pair_id, old, new): pair_id, side, id = (pair_id, symbol_ix), ..."""
    sides = pairs.select("pair_id", F.explode(F.create_map(F.lit("old"), "old", F.lit("new"), "new")).alias("side", "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in javascript.slices(batch, batch.schema.get_field_index("source")):
                found = [js_context.contexts(text or "") for text in part.column("source").to_pylist()]
                own = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
                columns = pa.array([r for rows in found for r in rows], row).flatten()
                yield pa.RecordBatch.from_arrays([part.column(k).take(own) for k in ("pair_id", "side")] + columns, ["pair_id", "side", *_NAMES])

    kind, row = pairs.schema["pair_id"].dataType.simpleString(), to_arrow_type(T.StructType.fromDDL(js_context.COLUMNS))
    made = dealt(sides, ["pair_id", "side"]).mapInArrow(run, f"pair_id {kind}, side string, {js_context.COLUMNS}")
    return M.cut(made.withColumn("id", F.struct("pair_id", "symbol_ix")), "contexts")


def origins(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """rows (contexts) with origin: a digest of where their side's source map puts them, null where it doesn't say.

    segments: of maps named pair_id, a colon, and the side. Digests hide the original paths.
    """
    asked = rows.select(F.concat_ws(":", "pair_id", "side").alias("map_id"), F.col("gen_line").cast("long").alias("line"), F.col("gen_column").cast("long").alias("column")).distinct()
    found = maps.lookup(asked, segments).where("status = 'mapped' AND source IS NOT NULL")
    digest = H.digest_id("origin", F.col("source"), F.col("orig_line"), F.col("orig_col"))
    found = found.select("map_id", F.col("line").alias("gen_line"), F.col("column").alias("gen_column"), digest.alias("origin"))
    return rows.withColumn("map_id", F.concat_ws(":", "pair_id", "side")).join(found, ["map_id", "gen_line", "gen_column"], "left").drop("map_id")


def candidates(old: DataFrame, new: DataFrame, c: Config) -> DataFrame:
    """(i1, i2, vote, exact): unique shapes, rare shared features, bands of two similarity hashes, and for symbols
    without any of these the nearest sizes. Caps on postings and candidates are the operator's contract."""
    group = ["pair_id", "kind_class"]
    once = lambda t, name: t.groupBy(*group, "shape").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    exact = once(old, "i1").join(once(new, "i2"), [*group, "shape"]).select("i1", "i2", F.lit(1_000_000).cast("long").alias("vote"), F.lit(True).alias("exact"))
    feature = lambda t: t.select("id", *group, F.explode("features").alias("key"))
    rare = S.posting_votes(feature(old), feature(new), [*group, "key"], c.rare).select("i1", "i2", F.col("votes").alias("vote"), F.lit(False).alias("exact"))

    def bands(t: DataFrame) -> DataFrame:
        keys = [F.struct(F.lit(2 * k + s).alias("band"), H.band(F.col(h), k).alias("value")) for k in range(4) for s, h in enumerate(("shape_hash", "context_hash"))]
        return t.select("id", *group, F.explode(F.array(*keys)).alias("key"))

    near = S.posting_votes(bands(old), bands(new), [*group, "key"], max(64, 8 * c.max_candidates)).select("i1", "i2", F.lit(0).cast("long").alias("vote"), F.lit(False).alias("exact"))
    some = exact.unionByName(rare).unionByName(near)
    if "origin" in old.columns:  # equal origins come first; other candidates stay
        place = lambda t: t.where("origin IS NOT NULL").select("id", "pair_id", F.col("origin").alias("key"))
        same = S.posting_votes(place(old), place(new), ["pair_id", "key"], max(64, 8 * c.max_candidates))
        some = some.unionByName(same.select("i1", "i2", F.lit(65_535).cast("long").alias("vote"), F.lit(False).alias("exact")))
    lonely = old.join(some.select(F.col("i1").alias("id")).distinct(), "id", "left_anti")
    near = S.nearest_sizes(lonely, new, 2 * c.max_candidates, [*group, "scope_kind"])
    sizes = near.select("i1", "i2", F.lit(0).cast("long").alias("vote"), F.lit(False).alias("exact"))
    return some.unionByName(sizes).groupBy("i1", "i2").agg(F.max("vote").alias("vote"), F.max("exact").alias("exact"))


def trace(pairs: DataFrame, c: Config = Config(), segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, targets, stats) of pairs (pair_id, old, new).

    matches: a row for each old symbol with its best candidate, decision (accepted, abstained, or deleted where nothing is
    a candidate), confidence, scores and evidence. An exact shape that either side has once is accepted whatever its score;
    other pairs need the score, both margins, and an untruncated candidate list. segments of source maps, if given, put
    candidates of one origin first. targets: accepted, ambiguous (a candidate of something) or added. stats: COUNTERS.
    """
    rows = contexts(pairs)
    if segments is not None:
        rows = M.cut(origins(rows, segments), "origins")
    old, new = rows.where("side = 'old'"), rows.where("side = 'new'")
    mapped = "origin" in rows.columns
    keep = ["id", "name", "symbol_id", "kind_class", "scope_kind", "depth", "shape_hash", "context_hash", "size", "roles", "features", *(["origin"] if mapped else [])]
    l, r = (t.select(*[F.col(k).alias(f"{k}_{s}") for k in keep]) for t, s in ((old, "s"), (new, "t")))
    met = candidates(old, new, c).join(l, F.col("i1") == F.col("id_s")).join(r, F.col("i2") == F.col("id_t"))
    fits = (F.col("kind_class_s") == F.col("kind_class_t")) & (F.col("scope_kind_s") == F.col("scope_kind_t")) & (F.greatest("size_s", "size_t") <= c.size_ratio * F.least("size_s", "size_t"))
    sign = F.lit(-(1 << 63)).cast("long")
    order = [F.desc("exact"), F.desc("vote"), F.abs(F.col("size_s") - F.col("size_t")), F.col("shape_hash_s").bitwiseXOR(F.col("shape_hash_t")).bitwiseXOR(sign), F.col("i2")]
    top = M.top_candidates(met.where(fits), c.max_candidates, order)
    scope = F.lit(H.SCALE) - 1250 * F.least(F.lit(8), F.abs(F.col("depth_s") - F.col("depth_t")))
    role = H.histogram_bps([(F.col("roles_s")[k], F.col("roles_t")[k]) for k in range(len(js_context.ROLES))])
    parts = {"shape_bps": (45, H.hamming_bps(F.col("shape_hash_s"), F.col("shape_hash_t"))), "context_bps": (20, H.hamming_bps(F.col("context_hash_s"), F.col("context_hash_t"))), "roles_bps": (15, role), "size_bps": (10, H.ratio_bps(F.col("size_s"), F.col("size_t"))), "scope_bps": (10, scope)}
    top = top.select("*", *[x.cast("long").alias(name) for name, (_, x) in parts.items()], F.size(F.array_intersect("features_s", "features_t")).cast("long").alias("shared_rare_features"), F.col("exact").alias("exact_shape"))
    same_origin = F.col("origin_s") == F.col("origin_t") if mapped else F.lit(None).cast("boolean")
    score = F.floor(sum((w * F.col(name) for name, (w, _) in parts.items()), F.lit(0)) / 100).cast("long")
    scored = M.cut(top.select("i1", "i2", score.alias("score"), "exact", "truncated", F.col("name_s").alias("name_old"), F.col("name_t").alias("name_new"), "symbol_id_s", "symbol_id_t", *EVIDENCE[:-1], same_origin.alias("source_map_origin_match")), "scored")
    counted = scored.groupBy("i1").agg(F.count(F.lit(1)).alias("candidate_count"))
    best = M.ranked_both_ways(scored).where("source_place = 1").join(counted, "i1")
    sure = (F.col("score") >= c.least_score) & (F.col("source_margin") >= c.least_margin) & (F.col("target_margin") >= c.least_margin) & ~F.col("truncated")
    accepted = (F.col("target_place") == 1) & (F.col("exact") | sure)
    columns = ["i1", "i2", "name_old", "name_new", "symbol_id_s", "symbol_id_t", "score", "source_margin", "target_margin", "truncated", "candidate_count", *EVIDENCE]
    best = best.select(*columns, F.when(accepted, "accepted").otherwise("abstained").alias("decision"), H.tier(F.col("score"), F.col("source_margin"), F.col("target_margin"), F.col("exact")).alias("confidence"))
    lone = old.join(scored.select(F.col("i1").alias("id")).distinct(), "id", "left_anti")
    lone = lone.select(F.col("id").alias("i1"), F.col("name").alias("name_old"), F.col("symbol_id").alias("symbol_id_s"), F.lit(0).cast("long").alias("candidate_count"), F.lit("deleted").alias("decision"), F.lit("low").alias("confidence"))
    matches = M.cut(best.unionByName(lone, allowMissingColumns=True), "matches")
    took = matches.where("decision = 'accepted'").select(F.col("i2").alias("id"), F.lit(True).alias("took"))
    seen = scored.select(F.col("i2").alias("id")).distinct().withColumn("seen", F.lit(True))
    state = F.when(F.col("took"), "accepted").when(F.col("seen"), "ambiguous").otherwise("added")
    targets = M.cut(new.join(took, "id", "left").join(seen, "id", "left").select("pair_id", "id", "name", "symbol_id", state.alias("target")), "targets")
    return matches, targets, statistics(pairs, matches, targets, scored)


def statistics(pairs: DataFrame, matches: DataFrame, targets: DataFrame, scored: DataFrame) -> DataFrame:
    """pair_id and COUNTERS. Every candidate that is left after the filter is compared."""
    pair = F.col("i1.pair_id").alias("pair_id")
    decided = lambda d: F.count_if(F.col("decision") == d).alias(d)
    m = matches.groupBy(pair).agg(F.count(F.lit(1)).alias("source_symbols"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_sources"), decided("accepted"), decided("abstained"), decided("deleted"))
    p = scored.groupBy(pair).agg(F.count_if("exact").alias("exact_unique_anchors"), F.count(F.lit(1)).alias("candidate_pairs"), F.count(F.lit(1)).alias("expensive_comparisons"))
    t = targets.groupBy("pair_id").agg(F.count(F.lit(1)).alias("target_symbols"), F.count_if(F.col("target") == "added").alias("added"), F.count_if(F.col("target") == "ambiguous").alias("ambiguous_targets"))
    out = pairs.select("pair_id").join(m, "pair_id", "left").join(p, "pair_id", "left").join(t, "pair_id", "left")
    return out.select("pair_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in COUNTERS])


def violations(pairs: DataFrame, matches: DataFrame, targets: DataFrame, c: Config = Config(), segments: DataFrame | None = None) -> DataFrame:
    """(pair_id, rule) that a lineage of pairs breaks, by itself (see inner_violations) and because computing it again, with
    the same source maps if it had any, gives other rows. Empty for a sound one."""
    out = inner_violations(matches, targets, c)
    again, seen, _ = trace(pairs, c, segments)
    columns = ["i1", "i2", "score", "decision", "confidence", "symbol_id_s", "symbol_id_t"]
    pair = F.col("i1.pair_id").alias("pair_id")
    for one, other, rule in ((matches, again, "row is not recomputed"), (again, matches, "recomputed row is missing")):
        out = out.unionByName(one.select(*columns).exceptAll(other.select(*columns)).select(pair, F.lit(rule).alias("rule")))
    for one, other, rule in ((targets, seen, "target is not recomputed"), (seen, targets, "recomputed target is missing")):
        out = out.unionByName(one.select("pair_id", "id", "target").exceptAll(other.select("pair_id", "id", "target")).select("pair_id", F.lit(rule).alias("rule")))
    return out


def inner_violations(matches: DataFrame, targets: DataFrame, c: Config = Config()) -> DataFrame:
    """(pair_id, rule): sources told twice, targets accepted twice, targets that are not accounted for exactly once, scores
    out of range, accepted rows under the limits, and rows whose decision and candidate disagree."""
    accepted = matches.where("decision = 'accepted'")
    pair = F.col("i1.pair_id").alias("pair_id")
    say = lambda rows, key, rule: rows.select(key, F.lit(rule).alias("rule"))
    took = targets.where("target = 'accepted'").select(F.col("id").alias("i2"))
    marks = ["score", "source_margin", "target_margin", "shape_bps", "context_bps", "roles_bps", "size_bps", "scope_bps"]
    wild = functools.reduce(lambda a, b: a | b, [~F.col(k).between(0, H.SCALE) for k in marks])
    empty = F.col("i2").isNull() & F.col("score").isNull() & (F.col("candidate_count") == 0)
    found = [
        say(matches.groupBy("i1").count().where("count > 1"), pair, "source told twice"),
        say(accepted.groupBy("i2").count().where("count > 1"), F.col("i2.pair_id").alias("pair_id"), "target accepted twice"),
        say(accepted.where((F.col("confidence") != "exact") & ((F.col("score") < c.least_score) | (F.col("source_margin") < c.least_margin) | (F.col("target_margin") < c.least_margin))), pair, "accepted under the limits"),
        say(accepted.join(took, "i2", "left_anti"), pair, "target is not accounted for"),
        say(took.join(accepted.select("i2"), "i2", "left_anti"), F.col("i2.pair_id").alias("pair_id"), "target is accepted by nothing"),
        say(targets.groupBy("pair_id", "id").count().where("count > 1"), F.col("pair_id"), "target told twice"),
        say(matches.where(F.coalesce(wild, F.lit(False)) | (F.col("candidate_count") > c.max_candidates)), pair, "out of range"),
        say(matches.where(~F.col("decision").isin("accepted", "abstained", "deleted") | ((F.col("decision") == "deleted") != empty)), pair, "decision and candidate disagree"),
    ]
    return functools.reduce(DataFrame.unionByName, found)


def reports(pairs: DataFrame, matches: DataFrame, targets: DataFrame, stats: DataFrame, c: Config = Config(), map_digests: DataFrame | None = None) -> DataFrame:
    """(pair_id, json): one document a pair, of at most MOST_BYTES. map_digests: (pair_id, source_map_source_digest,
    source_map_target_digest) where source maps were used."""
    evidence = F.when(F.col("i2").isNotNull(), F.struct(*EVIDENCE))
    row = F.struct(
        F.col("i1.symbol_ix").alias("source_row"), F.col("symbol_id_s").alias("source_symbol_id"), F.col("i2.symbol_ix").alias("target_row"), F.col("symbol_id_t").alias("target_symbol_id"), "decision", "confidence",
        F.coalesce("score", F.lit(0)).alias("score_bps"), F.coalesce("source_margin", F.lit(0)).alias("source_margin_bps"), F.coalesce("target_margin", F.lit(0)).alias("target_margin_bps"), "candidate_count",
        F.coalesce("truncated", F.lit(False)).alias("candidates_truncated"), evidence.alias("evidence"),
    )
    held = matches.groupBy(F.col("i1.pair_id").alias("pair_id")).agg(F.sort_array(F.collect_list(row)).alias("matches"))
    rows_of = lambda t: F.sort_array(F.collect_list(F.when(F.col("target") == t, F.col("id.symbol_ix"))))
    other = targets.groupBy("pair_id").agg(rows_of("added").alias("added_target_rows"), rows_of("ambiguous").alias("ambiguous_target_rows"))
    digest = lambda c_: F.sha2(F.coalesce(c_, F.lit("")).cast("binary"), 256)
    out = pairs.select("pair_id", digest("old").alias("source_digest"), digest("new").alias("target_digest")).join(held, "pair_id", "left").join(other, "pair_id", "left").join(stats, "pair_id", "left")
    maps_ = [F.col("source_map_source_digest"), F.col("source_map_target_digest")] if map_digests is not None else []
    out = out if map_digests is None else out.join(map_digests, "pair_id", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    body = F.struct(
        F.lit(FORMAT).alias("format"), F.lit(ALGORITHM).alias("algorithm"), "source_digest", "target_digest", *maps_, c.column().alias("config"), c.digest().alias("config_digest"),
        F.struct(*COUNTERS).alias("stats"), none("matches", held.schema["matches"].dataType), none("added_target_rows", "array<int>"), none("ambiguous_target_rows", "array<int>"),
    )
    return out.select("pair_id", F.to_json(body).alias("json"))


REPORT = (
    "format string, algorithm string, source_digest string, target_digest string, source_map_source_digest string, source_map_target_digest string, "
    "config struct<least_score:int,least_margin:int,max_candidates:int,rare:int,size_ratio:int>, config_digest string, "
    f"stats struct<{','.join(f'{k}:bigint' for k in COUNTERS)}>, "
    "matches array<struct<source_row:int,source_symbol_id:string,target_row:int,target_symbol_id:string,decision:string,confidence:string,score_bps:bigint,source_margin_bps:bigint,target_margin_bps:bigint,candidate_count:bigint,candidates_truncated:boolean,"
    "evidence:struct<exact_shape:boolean,shape_bps:bigint,context_bps:bigint,roles_bps:bigint,size_bps:bigint,scope_bps:bigint,shared_rare_features:bigint,source_map_origin_match:boolean>>>, "
    "added_target_rows array<int>, ambiguous_target_rows array<int>"
)


def report_violations(read: DataFrame) -> DataFrame:
    """(pair_id, rule) of reports that were read (pair_id, REPORT's columns)."""
    ascending = lambda a: F.forall(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda k: (F.size(a) < 2) | (F.element_at(a, F.least(k, F.size(a))) < F.element_at(a, F.least(k + 1, F.size(a)))) | (k >= F.size(a)))
    count = lambda d: F.size(F.filter("matches", lambda m: m["decision"] == d))
    sources = F.transform("matches", lambda m: m["source_row"])
    took = F.transform(F.filter("matches", lambda m: m["decision"] == "accepted"), lambda m: m["target_row"])
    digests = fields.hex256(F.col("source_digest")) & fields.hex256(F.col("target_digest")) & F.forall("matches", lambda m: fields.hex256(m["source_symbol_id"]) & (m["target_symbol_id"].isNull() | fields.hex256(m["target_symbol_id"])))
    rules = {
        "format": (F.col("format") == FORMAT) & (F.col("algorithm") == ALGORITHM),
        "config digest": F.col("config_digest") == F.sha2(F.to_json("config"), 256),
        "digest": digests & (F.col("source_map_source_digest").isNull() == F.col("source_map_target_digest").isNull()),
        "source rows ascend": ascending(sources),
        "one-to-one": F.size(F.array_distinct(took)) == F.size(took),
        "decision and evidence": F.forall("matches", lambda m: (m["decision"] == "deleted") == m["evidence"].isNull()) & F.forall("matches", lambda m: (m["decision"] == "deleted") == m["target_row"].isNull()),
        "map evidence": F.col("source_map_source_digest").isNotNull() | F.forall("matches", lambda m: m["evidence"]["source_map_origin_match"].isNull()),
        "scores": F.forall("matches", lambda m: m["score_bps"].between(0, H.SCALE) & m["source_margin_bps"].between(0, H.SCALE) & m["target_margin_bps"].between(0, H.SCALE)),
        "statistics": (F.col("stats.source_symbols") == F.size("matches")) & (F.col("stats.accepted") == count("accepted")) & (F.col("stats.abstained") == count("abstained")) & (F.col("stats.deleted") == count("deleted"))
        & (F.col("stats.added") == F.size("added_target_rows")) & (F.col("stats.ambiguous_targets") == F.size("ambiguous_target_rows")) & (F.col("stats.target_symbols") == F.size(took) + F.size("added_target_rows") + F.size("ambiguous_target_rows")),
        "target rows": ascending(F.col("added_target_rows")) & ascending(F.col("ambiguous_target_rows")) & ~F.arrays_overlap("added_target_rows", "ambiguous_target_rows") & ~F.arrays_overlap(took, F.concat("added_target_rows", "ambiguous_target_rows")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(~fine, F.lit(True)), F.lit(name)) for name, fine in rules.items()]))
    return read.select("pair_id", F.explode(broken).alias("rule"))


def report_differences(read: DataFrame, pairs: DataFrame, segments: DataFrame | None = None, c: Config = Config(), map_digests: DataFrame | None = None) -> DataFrame:
    """(pair_id) of reports (pair_id, json) that are not what their exact sources, and source maps, give."""
    again = reports(pairs, *trace(pairs, c, segments), c, map_digests)
    return read.alias("a").join(again.alias("b"), "pair_id", "full_outer").where(~F.col("a.json").eqNullSafe(F.col("b.json"))).select("pair_id")
