"""Registered queries of the engine's own operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.functions import hashing as H
from cambium.operators import matching as M
from cambium.operators import ordered as O
from cambium.operators import similarity as S
from cambium.plans import diff
from cambium.sources import javascript

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Portable pieces of the SQL side.
SQL_INT = "CAST('0x' || substring(md5({}), 1, 7) AS BIGINT)"
SQL_LINES = "list_filter(list_distinct(string_split(coalesce(text, ''), chr(10))), lambda x: length(trim(x)) > 0)"


def line_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features): the distinct lines of each document that are not blank."""
    docs = table(spark, sf_dir, "documents")
    lines = F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return docs.select(F.col("doc_id").alias("id"), F.filter(lines, lambda x: F.length(F.trim(x)) > 0).alias("features"))


def line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_sets(spark, sf_dir)
    return rows.select("id", F.array_sort(F.array_distinct(F.transform("features", lambda x: H.md5_int(x)))).alias("features"))


SQL_HASHES = f"SELECT doc_id AS id, list_sort(list_distinct(list_transform({SQL_LINES}, lambda x: {SQL_INT.format('x')}))) AS features FROM documents"
LANES, GATE = 16, 5


def _sql_lanes(n: int) -> str:
    lanes = []
    for k in range(n):
        a, b = H.lane_parameters(k)
        lanes.append(f"list_min(list_transform(features, lambda h: (h * {a} + {b}) % {H.PRIME}))")
    return ", ".join(lanes)


@query(f"SELECT id AS doc_id, len(features) AS n_features FROM ({SQL_HASHES})")
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hashes(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size("features").cast("long").alias("n_features"))


@query(f"SELECT id AS doc_id, {', '.join(f'm[{k + 1}] AS lane_{k}' for k in range(LANES))} FROM (SELECT id, [{_sql_lanes(LANES)}] AS m FROM ({SQL_HASHES}) WHERE len(features) > 0)")
def minhash_signature_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_hashes(spark, sf_dir).where(F.size("features") > 0).select("id", H.minhash(F.col("features"), LANES).alias("m"))
    return rows.select(F.col("id").alias("doc_id"), *[F.col("m")[k].alias(f"lane_{k}") for k in range(LANES)])


NAMED_SQL = "SELECT min(id) AS id, features FROM h WHERE len(features) > 0 GROUP BY features"
CLASSES_SQL = f"h AS ({SQL_HASHES}), c AS ({NAMED_SQL})"
PAIRS_SQL = f"""{CLASSES_SQL}, s AS (SELECT id, features, [{_sql_lanes(LANES)}] AS m FROM c),
k AS (SELECT id, unnest(range({LANES})) AS lane, unnest(m) AS value FROM s),
p AS (SELECT a.id AS i1, b.id AS i2, count(*) AS equal_lanes FROM k a JOIN k b ON a.lane = b.lane AND a.value = b.value AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= {GATE})"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of distinct line sets, each named by its least id; copies are members, not pairs."""
    classes = line_hashes(spark, sf_dir).groupBy("features").agg(F.min("id").alias("id"))
    # The empty set goes once the table is written: a filter before makes all hashes twice.
    return M.cut(classes.select("id", "features", H.minhash(F.col("features"), LANES).alias("minhash")), "classes").where(F.size("features") > 0)


@query(f"WITH {PAIRS_SQL} SELECT i1, i2, equal_lanes FROM p")
def minhash_gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gate_pairs(_classes(spark, sf_dir), LANES, GATE).withColumn("equal_lanes", F.col("equal_lanes").cast("long"))


SCORED_SQL = f"""{PAIRS_SQL}, j AS (SELECT i1, i2, len(list_intersect(a.features, b.features)) AS x, len(a.features) AS n, len(b.features) AS m FROM p JOIN c a ON a.id = i1 JOIN c b ON b.id = i2),
q AS (SELECT i1, i2, CAST(x * 10000 // (n + m - x) AS BIGINT) AS similarity_bps, n AS size1 FROM j)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored_pairs(_classes(spark, sf_dir), LANES, GATE)


@query(f"WITH {SCORED_SQL} SELECT i1, i2, similarity_bps FROM q")
def jaccard_scored_pairs_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("i1", "i2", "similarity_bps")


ACCEPT_SQL = "similarity_bps >= 8500 OR similarity_bps >= CASE WHEN size1 < 10 THEN 7000 WHEN size1 < 50 THEN 5000 ELSE 4000 END"


@query(f"WITH {SCORED_SQL} SELECT i1, i2, similarity_bps, ({ACCEPT_SQL}) AS accepted FROM q")
def accept_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = H.acceptance(F.col("similarity_bps"), F.lit(0), F.col("size1"))
    return _scored(spark, sf_dir).select("i1", "i2", "similarity_bps", accepted.alias("accepted"))


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of even and odd id as two versions, and the scored pairs across them."""
    rows = line_hashes(spark, sf_dir).where(F.size("features") > 0)
    old, new = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    across = S.scored_pairs(_classes(spark, sf_dir), LANES, GATE, first=F.col("id") % 2 == 0).select("i1", "i2", "similarity_bps")
    return old.select("id"), new.select("id"), M.cut(across, "across")


ACROSS_SQL = f"""{SCORED_SQL}, x2 AS (SELECT CASE WHEN i1 % 2 = 0 THEN i1 ELSE i2 END AS i1, CASE WHEN i1 % 2 = 0 THEN i2 ELSE i1 END AS i2, similarity_bps FROM q WHERE (i1 + i2) % 2 = 1)"""


# Edges one after the other, best first, with the ends that were taken before.
GREEDY_SQL = f"""WITH RECURSIVE {ACROSS_SQL}, e AS (SELECT row_number() OVER (ORDER BY similarity_bps DESC, i1, i2) AS n, i1, i2, similarity_bps FROM x2),
g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS u1, CAST([] AS BIGINT[]) AS u2, CAST(NULL AS BIGINT) AS i1, CAST(NULL AS BIGINT) AS i2, CAST(NULL AS BIGINT) AS similarity_bps, FALSE AS took
 UNION ALL SELECT e.n, CASE WHEN list_contains(u1, e.i1) OR list_contains(u2, e.i2) THEN u1 ELSE list_append(u1, e.i1) END, CASE WHEN list_contains(u1, e.i1) OR list_contains(u2, e.i2) THEN u2 ELSE list_append(u2, e.i2) END,
 e.i1, e.i2, e.similarity_bps, NOT (list_contains(u1, e.i1) OR list_contains(u2, e.i2)) FROM g JOIN e ON e.n = g.n + 1),
m AS (SELECT i1, i2, similarity_bps FROM g WHERE took)"""
# Copies are rows of their own, so each meets what it resembles, copies among them.
EVERY_SQL = GREEDY_SQL.replace(NAMED_SQL, "SELECT id, features FROM h WHERE len(features) > 0")
SIDES_SQL = "SELECT id FROM h WHERE len(features) > 0 AND id % 2 ="


@query(f"{GREEDY_SQL} SELECT i1, i2, similarity_bps FROM m")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, edges = _old_new(spark, sf_dir)
    return M.best_first(edges, [-F.col("similarity_bps")]).select("i1", "i2", "similarity_bps")


def _leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ids, features, minhash): of each distinct line set, the documents that no copy in the other version takes.

    Only copies score 10000, so the best edges take a set's copies of both versions two by two, in order of id. What is left
    is of one version; id is the least of ids.
    """
    sets = line_hashes(spark, sf_dir).groupBy("features").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    old, new = F.filter("ids", lambda x: x % 2 == 0), F.filter("ids", lambda x: x % 2 == 1)
    more = F.when(F.size(old) > F.size(new), old).otherwise(new)
    left = F.slice(more, F.least(F.size(old), F.size(new)) + 1, F.size("ids"))
    rows = M.cut(sets.select("features", left.alias("ids"), H.minhash(F.col("features"), LANES).alias("minhash")), "leftover")
    return rows.where((F.size("features") > 0) & (F.size("ids") > 0)).withColumn("id", F.col("ids")[0])


@query(f"{EVERY_SQL} SELECT id, 'removed' AS change FROM ({SIDES_SQL} 0) WHERE id NOT IN (SELECT i1 FROM m) UNION ALL SELECT id, 'added' FROM ({SIDES_SQL} 1) WHERE id NOT IN (SELECT i2 FROM m)")
def added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leftover(spark, sf_dir)
    across = S.scored_pairs(rows, LANES, GATE, ["ids"], F.col("id") % 2 == 0)
    across = across.select("ids_1", F.explode("ids_2").alias("i2"), "similarity_bps").select(F.explode("ids_1").alias("i1"), "i2", "similarity_bps")
    matches = M.best_first(M.cut(across, "across"), [-F.col("similarity_bps")])
    left = rows.select(F.explode("ids").alias("id"))
    gone = M.unmatched(left.where("id % 2 = 0"), matches, "i1").select("id", F.lit("removed").alias("change"))
    return gone.unionByName(M.unmatched(left.where("id % 2 = 1"), matches, "i2").select("id", F.lit("added").alias("change")))


@query(f"{GREEDY_SQL}, z AS (SELECT (SELECT count(*) FROM ({SIDES_SQL} 0)) AS n_old, (SELECT count(*) FROM ({SIDES_SQL} 1)) AS n_new, (SELECT count(*) FROM m) AS matched) SELECT n_old, n_new, matched, n_old - matched AS removed, n_new - matched AS added, CAST(matched * 10000 // greatest(n_old, n_new) AS BIGINT) AS similarity_bps FROM z")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new, edges = _old_new(spark, sf_dir)
    return M.match_summary(old, new, M.best_first(edges, [-F.col("similarity_bps")]))


RANK_SQL = f"""{ACROSS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY i1 ORDER BY similarity_bps DESC, i2) AS sp, similarity_bps - coalesce(lead(similarity_bps) OVER (PARTITION BY i1 ORDER BY similarity_bps DESC, i2), 0) AS source_margin,
 row_number() OVER (PARTITION BY i2 ORDER BY similarity_bps DESC, i1) AS tp, similarity_bps - coalesce(lead(similarity_bps) OVER (PARTITION BY i2 ORDER BY similarity_bps DESC, i1), 0) AS target_margin FROM x2),
d AS (SELECT i1, i2, similarity_bps AS score, source_margin, target_margin, CASE WHEN tp = 1 AND similarity_bps >= 7200 AND source_margin >= 700 AND target_margin >= 700 THEN 'accepted' ELSE 'abstained' END AS decision,
 CASE WHEN similarity_bps >= 8500 AND source_margin >= 1500 AND target_margin >= 1500 THEN 'high' WHEN similarity_bps >= 7200 AND source_margin >= 700 AND target_margin >= 700 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE sp = 1)"""


@query(f"WITH {RANK_SQL} SELECT * FROM d")
def reciprocal_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, edges = _old_new(spark, sf_dir)
    return M.reciprocal_best(edges.withColumnRenamed("similarity_bps", "score"))


@query(f"""WITH {RANK_SQL} SELECT t.id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.i2 = t.id AND decision = 'accepted') THEN 'accepted' WHEN EXISTS (SELECT 1 FROM x2 WHERE x2.i2 = t.id) THEN 'ambiguous' ELSE 'added' END AS target
FROM (SELECT id FROM h WHERE len(features) > 0 AND id % 2 = 1) t""")
def added_vs_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, new, edges = _old_new(spark, sf_dir)
    accepted = M.reciprocal_best(edges.withColumnRenamed("similarity_bps", "score")).where("decision = 'accepted'").select(F.col("i2").alias("id"), F.lit(True).alias("taken"))
    seen = edges.select(F.col("i2").alias("id")).distinct().withColumn("seen", F.lit(True))
    rows = new.join(accepted, "id", "left").join(seen, "id", "left")
    return rows.select("id", F.when(F.col("taken"), "accepted").when(F.col("seen"), "ambiguous").otherwise("added").alias("target"))


@query("""WITH t AS (SELECT md5(coalesce(text, '')) AS k, doc_id % 2 AS side, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT a.id AS i1, b.id AS i2 FROM t a JOIN t b ON a.k = b.k AND a.side = 0 AND b.side = 1 AND a.n = 1 AND b.n = 1""")
def exact_duplicate_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return S.unique_anchors(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "key")


@query("""WITH o AS (SELECT doc_id AS id, length(coalesce(text, '')) AS size FROM documents)
SELECT a.id, a.size, count(b.id) AS partners FROM (SELECT * FROM o WHERE id % 2 = 0) a LEFT JOIN (SELECT * FROM o WHERE id % 2 = 1) b ON b.size BETWEEN greatest(1, a.size // 2) AND a.size * 3 // 2 GROUP BY 1, 2""")
def size_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return S.partners_in_window(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


CONTEXT_SQL = """CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'fail') OR contains(lower(text), 'exception') OR contains(lower(text), 'invalid') OR contains(lower(text), 'unable') THEN 'error'
 WHEN contains(text, '~/') OR contains(text, '/.') OR contains(text, chr(92)) OR ends_with(text, '.js') OR ends_with(text, '.json') OR ends_with(text, '.md') THEN 'path'
 WHEN starts_with(text, '/') AND (contains(text, '/api') OR length(text) - length(replace(text, '/', '')) > 1) THEN 'endpoint'
 WHEN contains(text, '-') AND regexp_matches(text, '^[\\p{L}\\p{N}-]*$') THEN 'command'
 WHEN regexp_matches(text, '^[\\p{L}\\p{N}_]*$') AND strlen(text) > 5 THEN 'config' ELSE 'regular' END"""


@query(f"SELECT {CONTEXT_SQL} AS context, count(*) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS text FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents)) WHERE length(text) > 2 GROUP BY 1")
def string_context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    pieces = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("piece")).where(F.length("piece") > 2)
    return pieces.groupBy(H.string_context(F.col("piece")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT tier, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_uses FROM (SELECT w, count(*) AS n, CASE WHEN count(*) = 1 THEN 10 WHEN count(*) = 2 THEN 7 WHEN count(*) <= 5 THEN 4 ELSE 1 END AS tier
FROM (SELECT unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents) WHERE w != '' GROUP BY w) GROUP BY tier""")
def rarity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("w")).where("w != ''")
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy((H.rarity("string", F.col("n")) * 10).cast("int").alias("tier")).agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_uses"))


SIM_SQL = f"""SELECT id, CASE WHEN len(features) = 0 THEN NULL ELSE {' + '.join(f'(CASE WHEN list_sum(list_transform(features, lambda h: CASE WHEN (h >> {k}) & 1 = 1 THEN 1 ELSE -1 END)) >= 0 THEN {1 << k} ELSE 0 END)' for k in range(28))} END AS simhash FROM ({SQL_HASHES})"""


def _simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hashes(spark, sf_dir).select("id", H.simhash(F.col("features"), 28).alias("simhash"))


@query(f"SELECT id AS doc_id, CAST(simhash & 65535 AS BIGINT) AS band_0, CAST((simhash >> 16) & 65535 AS BIGINT) AS band_1 FROM ({SIM_SQL}) WHERE simhash IS NOT NULL")
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _simhashes(spark, sf_dir).where("simhash IS NOT NULL")
    return rows.select(F.col("id").alias("doc_id"), H.band(F.col("simhash"), 0).alias("band_0"), H.band(F.col("simhash"), 1).alias("band_1"))


CAP = 64


@query(f"""WITH s AS ({SIM_SQL}), b AS (SELECT id, 0 AS band, simhash & 65535 AS value FROM s WHERE simhash IS NOT NULL UNION ALL SELECT id, 1, (simhash >> 16) & 65535 FROM s WHERE simhash IS NOT NULL),
n AS (SELECT band, value FROM b WHERE id % 2 = 1 GROUP BY 1, 2 HAVING count(*) <= {CAP})
SELECT x.id AS i1, y.id AS i2, count(*) AS votes FROM b x JOIN b y ON x.band = y.band AND x.value = y.value JOIN n ON n.band = y.band AND n.value = y.value WHERE x.id % 2 = 0 AND y.id % 2 = 1 GROUP BY 1, 2""")
def lsh_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on a posting is the operator's contract: bands that more targets share say nothing."""
    rows = S.band_postings(_simhashes(spark, sf_dir), bands=2)
    return S.posting_votes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["band", "value"], CAP)


@query(f"""WITH f AS (SELECT id, unnest(features) AS h FROM ({SQL_HASHES})), n AS (SELECT h FROM f WHERE id % 2 = 1 GROUP BY h HAVING count(*) <= 24)
SELECT a.id AS i1, b.id AS i2, count(*) AS votes FROM f a JOIN f b ON a.h = b.h JOIN n ON n.h = b.h WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2""")
def rare_feature_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_hashes(spark, sf_dir).select("id", F.explode("features").alias("h"))
    return S.posting_votes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["h"], 24)


@query("""WITH o AS (SELECT doc_id AS id, length(coalesce(text, '')) AS size, CAST(floor(log2(greatest(length(coalesce(text, '')), 1))) AS BIGINT) AS bucket FROM documents)
SELECT i1, i2, distance, place FROM (SELECT a.id AS i1, b.id AS i2, abs(a.size - b.size) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.size - b.size), b.size, b.id) AS place
FROM o a JOIN o b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.bucket - b.bucket) <= 1) WHERE place <= 4""")
def nearest_size_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return S.nearest_sizes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 4).withColumn("place", F.col("place").cast("long"))


@query("""SELECT user_id, event_id, place, truncated FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place, count(*) OVER (PARTITION BY user_id) > 8 AS truncated FROM events) WHERE place <= 8""")
def candidate_topk_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("i1"), "event_id", "value")
    return M.top_candidates(rows, 8, [F.desc("value"), F.col("event_id")]).select(F.col("i1").alias("user_id"), "event_id", F.col("place").cast("long").alias("place"), "truncated")


@query("""WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)),
u AS (SELECT user_id, """ + ", ".join(f"count(*) FILTER (WHERE k = {k}) AS r{k}" for k in range(5)) + """ FROM events JOIN t USING (event_type) GROUP BY 1)
SELECT a.user_id AS u1, b.user_id AS u2, CAST((""" + " + ".join(f"least(a.r{k}, b.r{k})" for k in range(5)) + ") * 10000 // (" + " + ".join(f"greatest(a.r{k}, b.r{k})" for k in range(5)) + """) AS BIGINT) AS similarity_bps
FROM u a JOIN u b ON b.user_id = a.user_id + 1""")
def role_histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's histogram of event types against the next user's."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a few event types
    counts = events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"r{i}") for i, k in enumerate(kinds)])
    a, b = counts.alias("a"), counts.alias("b")
    return a.join(b, F.col("b.user_id") == F.col("a.user_id") + 1).select(F.col("a.user_id").alias("u1"), F.col("b.user_id").alias("u2"), H.histogram_bps([(F.col(f"a.r{i}"), F.col(f"b.r{i}")) for i in range(len(kinds))]).alias("similarity_bps"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.where("event_id % 3 = 0"), rows.where("event_id % 3 != 0")


@query("""WITH q AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_id % 3 = 0), p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_id % 3 != 0)
SELECT q.event_id, max(p.at) AS found FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.at <= q.at GROUP BY 1""")
def asof_last_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = _halves(spark, sf_dir)
    return O.asof_position(q, p.select("user_id", "at"), ["user_id"], "at").select("event_id", "found")


@query("""WITH q AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS at FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_custkey, o_orderkey AS target, CAST(o_orderdate AS DATE) AS at FROM orders WHERE o_orderkey % 2 = 1),
f AS (SELECT q.o_custkey, q.o_orderkey, max(p.at) AS found FROM q LEFT JOIN p ON p.o_custkey = q.o_custkey AND p.at <= q.at GROUP BY 1, 2)
SELECT f.o_orderkey, p.target FROM f LEFT JOIN p ON p.o_custkey = f.o_custkey AND p.at = f.found""")
def asof_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("at"))
    p = orders.where("o_orderkey % 2 = 1").withColumnRenamed("o_orderkey", "target")
    return O.asof_rows(orders.where("o_orderkey % 2 = 0"), p, ["o_custkey"], "at").select("o_orderkey", "target")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events), q AS (SELECT * FROM e WHERE event_id % 3 = 0), p AS (SELECT * FROM e WHERE event_id % 3 = 1), r AS (SELECT * FROM e WHERE event_id % 3 = 2),
f AS (SELECT q.event_id, q.user_id, max(p.at) AS middle FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.at <= q.at GROUP BY 1, 2)
SELECT f.event_id, max(r.at) AS original FROM f LEFT JOIN r ON r.user_id = f.user_id AND r.at <= f.middle GROUP BY 1""")
def compose_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps in a row: the position that the first finds is looked up in the second."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    outer = O.asof_position(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1").select("user_id", "at"), ["user_id"], "at")
    middle = outer.select("event_id", "user_id", F.col("found").alias("at"))
    return O.asof_position(middle, e.where("event_id % 3 = 2").select("user_id", "at"), ["user_id"], "at").select("event_id", F.col("found").alias("original"))


@query("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, count(*) AS revision, arg_max(event_type, event_id) AS last_state, CAST(coalesce(sum(CASE WHEN b = event_type THEN 1 ELSE 0 END), 0) AS BIGINT) AS repeats FROM w GROUP BY 1""")
def event_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.replay(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return out.withColumn("repeats", F.coalesce("repeats", F.lit(0)).cast("long"))


@query("SELECT user_id, event_type, props, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) WHERE n = 1")
def event_idempotent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_of_operation(table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id"), ["user_id", "event_type", "props"], ["event_id"])


@query("""SELECT user_id, event_id, from_state, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state FROM events) WHERE from_state IS NOT NULL AND NOT (from_state = 'view' AND event_type = 'click') AND NOT (from_state = 'click' AND event_type = 'purchase')""")
def transition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return O.violations(rows, "user_id", ["event_id"], "event_type", [("view", "click"), ("click", "purchase")]).select("user_id", "event_id", "from_state", "event_type")


@query("""WITH v AS (SELECT c_custkey AS interval, c_custkey * 7 AS lo, c_custkey * 7 + 5 + c_custkey % 40 AS hi, c_custkey % 9 AS depth FROM customer), p AS (SELECT DISTINCT o_orderkey AS pos FROM orders)
SELECT p.pos AS at, arg_max(i.interval, depth * 1000000000 - i.interval) AS interval FROM p LEFT JOIN v i ON lo <= p.pos AND p.pos < hi GROUP BY 1""")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("interval"), (F.col("c_custkey") * 7).alias("lo"), (F.col("c_custkey") * 7 + 5 + F.col("c_custkey") % 40).alias("hi"), (F.col("c_custkey") % 9).alias("depth"))
    return O.innermost(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at")).distinct(), i)


_SCOPES = """s AS (SELECT 'r' || r_regionkey AS scope, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b AS (SELECT 'r' || r_regionkey AS scope, 'x' || r_regionkey % 3 AS name, 'region ' || r_regionkey AS symbol FROM region UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey % 4, 'nation ' || n_nationkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'x' || n_nationkey % 6, 'again ' || n_nationkey FROM nation),
refs AS (SELECT c_custkey AS ref, 'c' || c_custkey AS scope, 'x' || c_custkey % 5 AS name FROM customer)"""


@query(f"""WITH {_SCOPES}, near AS (SELECT r.ref, r.name, r.scope AS at0, s1.parent AS at1, s2.parent AS at2 FROM refs r JOIN s s1 ON s1.scope = r.scope LEFT JOIN s s2 ON s2.scope = s1.parent),
n AS (SELECT scope, name, count(*) AS n, min(symbol) AS symbol FROM b GROUP BY 1, 2),
m AS (SELECT near.ref, near.name, CASE WHEN n0.n IS NOT NULL THEN n0.n WHEN n1.n IS NOT NULL THEN n1.n ELSE n2.n END AS n, CASE WHEN n0.n IS NOT NULL THEN n0.symbol WHEN n1.n IS NOT NULL THEN n1.symbol ELSE n2.symbol END AS symbol
FROM near LEFT JOIN n n0 ON n0.scope = at0 AND n0.name = near.name LEFT JOIN n n1 ON n1.scope = at1 AND n1.name = near.name LEFT JOIN n n2 ON n2.scope = at2 AND n2.name = near.name)
SELECT ref, name, CASE WHEN n = 1 THEN symbol END AS symbol, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS resolution FROM m""")
def nearest_scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    x = lambda col, k: F.concat(F.lit("x"), (F.col(col) % k).cast("string"))
    scopes = region.select(name("r", "r_regionkey").alias("scope"), F.lit(None).cast("string").alias("parent")).unionByName(nation.select(name("n", "n_nationkey").alias("scope"), name("r", "n_regionkey").alias("parent"))).unionByName(customer.select(name("c", "c_custkey").alias("scope"), name("n", "c_nationkey").alias("parent")))
    bindings = region.select(name("r", "r_regionkey").alias("scope"), x("r_regionkey", 3).alias("name"), name("region ", "r_regionkey").alias("symbol"))
    bindings = bindings.unionByName(nation.select(name("n", "n_nationkey").alias("scope"), x("n_nationkey", 4).alias("name"), name("nation ", "n_nationkey").alias("symbol"))).unionByName(nation.select(name("n", "n_nationkey").alias("scope"), x("n_nationkey", 6).alias("name"), name("again ", "n_nationkey").alias("symbol")))
    refs = customer.select(F.col("c_custkey").alias("ref"), name("c", "c_custkey").alias("scope"), x("c_custkey", 5).alias("name"))
    return O.resolve_names(refs, O.scope_closure(scopes), bindings).select("ref", "name", "symbol", "resolution")


@query("SELECT l_partkey, l_suppkey, arg_min(l_orderkey, l_orderkey * 100 + l_linenumber) AS first_value, arg_max(l_orderkey, l_orderkey * 100 + l_linenumber) AS last_value, count(*) AS n FROM lineitem GROUP BY 1, 2")
def first_last_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return O.first_and_last(rows, ["l_partkey", "l_suppkey"], F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_orderkey")


@query("SELECT event_id, CAST(sum(CAST(floor(value) AS BIGINT) - 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS absolute FROM events")
def running_delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return O.running(rows, ["user_id"], ["event_id"], F.floor("value") - 50).select("event_id", F.col("absolute").cast("long").alias("absolute"))


@query("""WITH w AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), ' ')) AS d, string_split(coalesce(text, ''), ' ') AS a FROM documents),
t AS (SELECT doc_id, a, unnest(d) AS token FROM w), f AS (SELECT doc_id, token, CAST(list_position(a, token) AS BIGINT) - 1 AS pos FROM t)
SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos, token) - 1 AS number FROM f""")
def canonical_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("at", "token"))
    return O.dense_numbers(tokens, "doc_id", "token", "at").select("doc_id", "token", F.col("number").cast("long").alias("number"))


@query("""SELECT 'lineitem without order' AS violation, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'order without customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'order key repeats', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'line number not positive', count(*) FROM lineitem WHERE l_linenumber < 1""")
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    found = [
        ("lineitem without order", line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("order without customer", orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("order key repeats", orders.groupBy("o_orderkey").count().where("count > 1")),
        ("line number not positive", line.where("l_linenumber < 1")),
    ]
    out = None
    for what, rows in found:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("violation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# Pages hold one inline script each: var t="...";track(N);

SQL_SCRIPT = "regexp_extract(html, '<script>(.*?)</script>', 1)"


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<script>(.*?)</script>", 1).alias("source"))


@query(f"SELECT page_id, regexp_extract({SQL_SCRIPT}, 'var ([a-z]+)=', 1) AS name, 'variable' AS kind, 'var=string:len' || strlen(regexp_extract({SQL_SCRIPT}, '=(\".*?\");', 1)) AS signature FROM pages")
def page_script_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = javascript.analyze(page_scripts(spark, sf_dir), ["declarations"])
    return javascript.rows_of(rows, "declarations", ["page_id"]).select("page_id", "name", "kind", "signature")


@query(f"SELECT page_id, regexp_extract({SQL_SCRIPT}, ';([a-z]+)[(]', 1) AS callee, 'direct' AS kind, regexp_extract({SQL_SCRIPT}, '[(]([0-9]+)[)]', 1) AS first_arg FROM pages")
def page_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = javascript.analyze(page_scripts(spark, sf_dir), ["calls"])
    return javascript.rows_of(rows, "calls", ["page_id"]).select("page_id", "callee", "kind", "first_arg")


@query("""SELECT page_id AS pair_id, CAST(1 AS BIGINT) AS matched, CAST(page_id % 5 = 1 AS BIGINT) AS renamed, CAST(page_id % 5 IN (0, 1, 3) AS BIGINT) AS unchanged, CAST(page_id % 5 = 2 AS BIGINT) AS string_only,
CAST(page_id % 5 = 4 AS BIGINT) AS structural, CAST(page_id % 5 = 3 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed FROM pages""")
def page_script_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's script against a version of it: as it is, renamed, another string, a function more, or another type."""
    old = page_scripts(spark, sf_dir)
    k = F.col("page_id") % 5
    new = (
        F.when(k == 1, F.replace("source", F.lit("var t="), F.lit("var renamed=")))
        .when(k == 2, F.replace("source", F.lit('"</p>"'), F.lit('"</div>"')))
        .when(k == 3, F.concat("source", F.lit("function added(a){return a+1}")))
        .when(k == 4, F.replace("source", F.lit('"</p>"'), F.lit("42")))
        .otherwise(F.col("source"))
    )
    pairs = M.cut(old.select(F.col("page_id").alias("pair_id"), F.col("source").alias("old"), new.alias("new")), "pairs")
    return diff.summary(pairs, *diff.compare(pairs))
