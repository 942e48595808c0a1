"""Candidate joins over (id, features): exact anchors, size windows, MinHash gate, bands, rare postings, nearest sizes."""

from __future__ import annotations

import functools
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cambium.functions import hashing as H


def feature_classes(rows: DataFrame, key: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows with equal features form a class, named by its least id: (classes, members(id, class))."""
    marked = rows.withColumn("class_key", F.md5(F.to_json(F.struct(key))))
    named = marked.groupBy("class_key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("members"))
    members = marked.join(named, "class_key").select("id", "class")
    classes = marked.join(named, "class_key").where("id = class").drop("class_key", "class")
    return classes, members


def unique_anchors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(i1, i2) for key values that each side holds exactly once."""
    once = lambda t, name: t.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return once(left, "i1").join(once(right, "i2"), key).select("i1", "i2")


def compatible_kinds(a: Column, b: Column) -> Column:
    """Equal, or a function and a variable."""
    return (a == b) | (a.isin("function", "variable") & b.isin("function", "variable"))


def size_window(n: Column, m: Column) -> Column:
    """m lies between half of n (at least 1) and one and a half times n, both rounded down."""
    return m.between(F.greatest(F.lit(1), F.floor(n / 2)), F.floor(n * 3 / 2))


def partners_in_window(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, size, partners: how many right rows lie in each left row's size window.

    Both sides shrink to histograms by size before they meet, so the work depends on the number of distinct sizes.
    """
    sizes = right.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    bucket = lambda c: H.size_bucket(F.col(c))
    asked = left.select("size").distinct().select(F.col("size").alias("s"), F.greatest(F.lit(1), F.floor(F.col("size") / 2)).alias("lo"), F.floor(F.col("size") * 3 / 2).alias("hi"))
    asked = asked.withColumn("b", F.explode(F.sequence(bucket("lo"), F.greatest(bucket("lo"), bucket("hi")))))
    met = asked.join(sizes.withColumn("b", bucket("size")), "b").where("size BETWEEN lo AND hi").groupBy("s").agg(F.sum("n").alias("partners"))
    return left.join(met, left["size"] == met["s"], "left").select("id", "size", F.coalesce("partners", F.lit(0)).alias("partners"))


def gate_keys(minhash: Column, lanes: int, least: int) -> Column:
    """Keys of which two signatures with `least` equal lanes share one: lanes are dealt to least - 1 groups, so two equal
    lanes fall into one group (pigeonhole), and each pair of lanes of a group is a key. Single lanes for least = 1."""
    return F.array(*[F.struct(F.lit(k).alias("key"), minhash[i].alias("x"), minhash[j].alias("y")) for k, (i, j) in enumerate(_lane_pairs(lanes, least))])


def gate_key_count(lanes: int, least: int) -> int:
    return len(_lane_pairs(lanes, least))


def _lane_pairs(lanes: int, least: int) -> list[tuple[int, int]]:
    if least < 2:
        return [(k, k) for k in range(lanes)]
    return [p for g in range(least - 1) for p in combinations(range(g, lanes, least - 1), 2)]


#: Rows of one key that meet in one place; those of a key with more are dealt to blocks, of which each two meet.
BLOCK_ROWS = 2000


def gate_pairs(rows: DataFrame, lanes: int, least: int, carry: list[str] | None = None, block_rows: int = BLOCK_ROWS, first: Column | None = None) -> DataFrame:
    """(i1, i2, equal_lanes) of rows (id, minhash) with at least `least` equal lanes, i1 < i2. Lossless (see gate_keys).
    For each column c of carry, c_1 and c_2 hold its values. With first, a condition on rows, only rows of unlike sides
    meet: i1 is one for which it is true, i2 one for which it is false.

    Lanes are compared where rows meet, and a pair counts at the first key that it shares, so candidates are not shuffled.
    Rows with equal signatures should be one row (feature_classes), so that copies do not meet in pairs.
    """
    carry = carry or []
    # Methods of more than 8000 bytes of code are not compiled: lanes that can't be null and keys by place are short code.
    none = F.lit(-1).cast("long")
    held = rows.where(F.col("minhash").isNotNull() & ~F.exists("minhash", lambda x: x.isNull()))
    places = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(_lane_pairs(lanes, least))])
    side = F.lit(True) if first is None else first
    each = held.select("id", side.alias("side"), "minhash", *[F.coalesce(F.col("minhash")[k], none).alias(f"m{k}") for k in range(lanes)], *carry, F.inline(places))
    each = each.select("id", "side", *[f"m{k}" for k in range(lanes)], *carry, "key", F.coalesce(F.get("minhash", F.col("i")), none).alias("x"), F.coalesce(F.get("minhash", F.col("j")), none).alias("y"))
    large = each.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("key", "x", "y", F.ceil(F.col("n") / block_rows).alias("blocks"))
    each = each.join(F.broadcast(large), ["key", "x", "y"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    zero = F.lit(0).cast("long")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "x", "y", "p", "q")]
    if first is None:
        a = each.withColumn("p", F.col("own")).withColumn("q", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("a")
        b = each.withColumn("q", F.col("own")).withColumn("p", F.explode(F.sequence(zero, "own"))).alias("b")
        met.append((F.col("a.p") < F.col("a.q")) | (F.col("a.id") < F.col("b.id")))
        up = F.col("a.id") < F.col("b.id")
    else:
        all_blocks = F.explode(F.sequence(zero, F.col("blocks") - 1))
        a = each.where("side").withColumn("p", F.col("own")).withColumn("q", all_blocks).alias("a")
        b = each.where("NOT side").withColumn("q", F.col("own")).withColumn("p", all_blocks).alias("b")
        up = F.lit(True)
    bit = lambda k: F.lit(1 << k % 62).cast("long")
    words = [functools.reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.col(f"a.m{k}") == F.col(f"b.m{k}"), bit(k)).otherwise(zero) for k in range(w, min(w + 62, lanes))]) for w in range(0, lanes, 62)]
    equal = lambda words: functools.reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])
    found = a.join(b, functools.reduce(lambda x, y: x & y, [*met, equal(words) >= least]))
    ends = lambda c: [F.when(up, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(up, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))]
    i1, i2 = ends("id")
    carried = [x.alias(f"{c}_{n}") for c in carry for n, x in enumerate(ends(c), 1)]
    # A generator, so that the words are made once a pair and not anew for each key that is asked for below.
    found = found.select(i1.alias("i1"), i2.alias("i2"), *carried, F.col("a.key").alias("key"), F.inline(F.array(F.struct(*[w.alias(f"w{n}") for n, w in enumerate(words)]))))
    shared = lambda k: F.col(f"w{k // 62}").bitwiseAND(bit(k)) != 0
    found_at = F.coalesce(*[F.when(shared(i) & shared(j), k) for k, (i, j) in enumerate(_lane_pairs(lanes, least))])
    return found.where(F.col("key") == found_at).select("i1", "i2", equal([F.col(f"w{n}") for n in range(len(words))]).alias("equal_lanes"), *[f"{c}_{n}" for c in carry for n in (1, 2)])


def jaccard_bps(a: Column, b: Column) -> Column:
    """Two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(H.SCALE)).otherwise(F.floor(both * F.lit(H.SCALE) / either)).cast("long")


def scored_pairs(rows: DataFrame, lanes: int, least: int, carry: list[str] | None = None, first: Column | None = None) -> DataFrame:
    """(i1, i2, similarity_bps, size1) of the pairs of gate_pairs, for rows (id, features, minhash); carry and first as there."""
    carry = carry or []
    pairs = gate_pairs(rows, lanes, least, ["features", *carry], first=first)
    return pairs.select("i1", "i2", jaccard_bps(F.col("features_1"), F.col("features_2")).alias("similarity_bps"), F.size("features_1").alias("size1"), *[f"{c}_{n}" for c in carry for n in (1, 2)])


def declared_similarity(kind1: Column, kind2: Column, signature1: Column, signature2: Column, hashes1: Column, hashes2: Column, cross: float = 0.9) -> Column:
    """Similarity of two declarations. Imports and exports by signature 1.0 or 0.3; two empty sets 1.0 with
    equal signatures, else 0.5; 0.2 where the sizes' ratio is under 0.3; else Jaccard, times `cross` for unlike kinds."""
    n, m = F.size(hashes1), F.size(hashes2)
    low, high = F.least(n, m), F.greatest(n, m)
    both = F.size(F.array_intersect(hashes1, hashes2))
    factor = F.when(kind1 == kind2, 1.0).otherwise(F.when(compatible_kinds(kind1, kind2), cross).otherwise(0.7))
    return (
        F.when((kind1 == kind2) & kind1.isin("import", "export"), F.when(signature1 == signature2, 1.0).otherwise(0.3))
        .when((n == 0) & (m == 0), F.when(signature1 == signature2, 1.0).otherwise(0.5) * factor)
        .when(high == 0, 0.0).when(low / high < 0.3, 0.2 * factor)
        .otherwise(both / (n + m - both) * factor)
    )


def capped_postings(postings: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """postings without those of keys that more than cap rows hold (the cap is the operator's contract)."""
    small = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("posting_rows")).where(F.col("posting_rows") <= cap).select(*keys)
    return postings.join(small, keys, "left_semi")


def posting_votes(left: DataFrame, right: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """(i1, i2, votes): how many keys of at most cap right rows a pair shares."""
    r = capped_postings(right, keys, cap).withColumnRenamed("id", "i2")
    return left.withColumnRenamed("id", "i1").join(r, keys).groupBy("i1", "i2").agg(F.count(F.lit(1)).alias("votes"))


def band_postings(rows: DataFrame, column: str = "simhash", bands: int = 4) -> DataFrame:
    """(id, band, value) of 64-bit similarity hashes."""
    return rows.where(F.col(column).isNotNull()).select("id", F.posexplode(F.array(*[H.band(F.col(column), k) for k in range(bands)])).alias("band", "value"))


def nearest_sizes(left: DataFrame, right: DataFrame, k: int, group: list[str] | None = None) -> DataFrame:
    """(i1, i2, distance, place): the k right rows of nearest size for each left row, from the same or a neighbouring
    log2 bucket of size and the same group; nearer, then smaller, then lower id first.

    Sizes meet, not rows: the left side is its distinct sizes, and the right side holds at most k rows of each size.
    """
    group = group or []
    bucket = H.size_bucket(F.col("size"))
    r = right.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "size").orderBy("id"))).where(F.col("nth") <= k).withColumn("bucket", bucket)
    near = r.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    sizes = left.select(*group, F.col("size").alias("s")).distinct().withColumn("bucket", H.size_bucket(F.col("s")))
    met = sizes.join(near, [*group, "bucket"]).withColumn("distance", F.abs(F.col("size") - F.col("s")))
    place = Window.partitionBy(*group, "s").orderBy("distance", F.col("size"), "id")
    best = met.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select(*group, "s", F.col("id").alias("i2"), "distance", "place")
    l = left.select(*group, F.col("id").alias("i1"), F.col("size").alias("s"))
    return l.join(best, [*group, "s"]).select("i1", "i2", "distance", "place")
