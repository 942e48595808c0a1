"""N-gram Jaccard join: size-banded tiles, hashed bitmaps whose bit counts bound the overlap, then exact intersections.

How a link can't be lost. With threshold t, sets of sizes n and m can link only if t*n <= m <= n/t, and then they share at
least ceil(t/(1+t)*(n+m)) >= ceil(t*n) shingles. So for any one order of all shingles, the first n-ceil(t*n)+1 of each set
(its prefix) share one. The order takes rare shingles first: those whose hash lies under a border are counted over all
classes and stand in order of that count, the others follow by hash. A shingle that one class alone has opens no tile, so
a set whose prefix is filled by such shingles is compared with nothing. A tile is a shared prefix shingle and a band of
sizes.

What is never done: pairs within a group. Sets that are equal are one class. In each tile every class is first held
against one class of the tile alone (a star), which joins near copies in as many comparisons as there are members; only
tiles that then still hold several components are compared in pairs, and only across components, behind the bitmaps.
Counts, posts and tiles are joined by their shingle from written tables, so that Spark can split a shingle that many
classes share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cambium.llm import words
from cambium.llm.common import Scratch, fresh, text_slices, trim
from cambium.llm.components import components

def share(percent: int) -> float:
    """Share of all hashes that are counted: enough that the rare ones among them can fill a prefix."""
    return min(0.5, 0.1 + 1.5 * (100 - percent) / 100)


def prefix_size(n, percent: int):
    """n - ceil(percent/100 * n) + 1, in integers."""
    return n - (percent * n + 99) // 100 + 1


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; of fewer words, their whole sequence; of none, nothing."""
    grams = words.ngrams(hashes, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(grams[a : b - n + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        elif b > a:
            yield np.array([words.whole(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def bitmap(x: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit, in 64-bit words. The number of bits is the power of two from the size
    of the set on, so that unlike sets of any size differ in many bits. The bits in which two bitmaps differ are at most as
    many as the shingles that only one of the sets has; a bitmap's halves, XORed, are the bitmap of half as many bits."""
    bits = 1 << max(6, (len(x) - 1).bit_length())
    counts = np.bincount(((x >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _described(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two keys of each set; sets that agree in all three are one class."""
    key1, key2 = [], []
    with np.errstate(over="ignore"):
        for x in sets:
            key1.append(int(words.mix(np.array([np.bitwise_xor.reduce(x) if len(x) else 0], np.uint64)).view(np.int64)[0]))
            key2.append(int(np.sum(words.mix(x ^ np.uint64(0x5BF03635)), dtype=np.uint64).view(np.int64)) if len(x) else 0)
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64())]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(flat))


def _features(n: int, percent: int):
    """Per text its set's size, keys and bitmap, the hashes that can stand in its prefix, and how many of them are counted."""
    border = np.uint64(int(share(percent) * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = words.hash_words(batch.column(2), words.SPACES)
            sets = list(shingle_sets(hashes, offsets, n))
            counted = [int(np.searchsorted(x, border)) for x in sets]
            low = [x[: max(c, prefix_size(len(x), percent))] if len(x) else x for x, c in zip(sets, counted, strict=True)]
            columns = [batch.column(0), batch.column(1), *_described(sets), _lists([bitmap(x) for x in sets]), _lists(low), pa.array(counted, pa.int64())]
            yield pa.record_batch(columns, names=["doc_id", "t", "n", "k1", "k2", "map", "low", "counted"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            hashes, offsets = words.hash_words(batch.column(0), words.SPACES)
            sets = list(shingle_sets(hashes, offsets, n))
            yield pa.record_batch([*_described(sets), _lists(sets)], names=["n", "k1", "k2", "set"])

    return run


def _linked(percent: int):
    """Keeps the pairs whose sorted sets link: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                x, y = (s[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for s in (left, right))
                if len(y) > len(x):
                    x, y = y, x
                at = np.searchsorted(x, y)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) and len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _near(n: str, m: str, percent: int) -> Column:
    """Sizes that can link."""
    return (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)).cast("boolean")


def _band(n: Column, percent: int) -> Column:
    """Band of a size, eight of the widest ratios of sizes that link wide."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.lit(8 * math.log(100 / percent))).cast("int")


def _folded(m: Column) -> Column:
    half = F.shiftright(F.size(m), 1)
    return F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _bound(a: str, b: str, percent: int) -> Column:
    """The bit counts allow a link of the structs a and b (n, map): the sets differ in d shingles or more, so they share
    (n + m - d) / 2 at most. Sizes that can link need bitmaps of one size or the double of it."""
    x, y = F.col(f"{a}.map"), F.col(f"{b}.map")
    x, y = F.when(F.size(x) > F.size(y), _folded(x)).otherwise(x), F.when(F.size(y) > F.size(x), _folded(y)).otherwise(y)
    differ = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (100 - percent) * both >= (100 + percent) * differ


CLASS = ["n", "k1", "k2"]
#: Rounds of stars with random centres. More or fewer change the cost, no result.
ROUNDS = 2
#: Stands for a null id among the keys of rows.
NO_ID = -(1 << 63)


@dataclass
class _Sets:
    """Written tables: heads (c, n, k1, k2, t, d, least), one row a class, with its representative row and least id;
    classes (c, n, map, low, counted); members (doc_id, t, n, c, least), one row for each row of the input."""

    scratch: Scratch
    rows: DataFrame  # doc_id, d, t, text
    heads: DataFrame
    classes: DataFrame
    members: DataFrame
    n: int
    percent: int


def _classes(spark: SparkSession, docs: DataFrame, n: int, percent: int, id_column: str, text_column: str) -> _Sets:
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"), "text")
    shape = "doc_id long, t long, n long, k1 long, k2 long, map array<long>, low array<long>, counted long"
    made = scratch.table(rows.select("doc_id", "t", "text").mapInArrow(_features(n, percent), shape), "features")
    made = made.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID)))
    sized = made.where("n > 0")
    heads = sized.groupBy(*CLASS).agg(F.min(F.struct("t", "d")).alias("head"), F.min("doc_id").alias("least"))
    heads = heads.select(F.monotonically_increasing_id().alias("c"), *CLASS, "head.t", "head.d", "least")
    heads = scratch.table(heads, "heads")  # written once, so that the numbers stay
    whole = sized.join(heads.select(*CLASS, "t", "d", "c"), [*CLASS, "t", "d"]).dropDuplicates(["c"])
    whole = scratch.table(whole.select("c", "n", "map", "low", "counted"), "classes")
    members = made.select("doc_id", "t", *CLASS).join(heads.select(*CLASS, "c", "least"), CLASS, "left")
    members = scratch.table(members.select("doc_id", "t", "n", "c", "least"), "members")
    scratch.drop("features")
    scratch.release()
    return _Sets(scratch, rows, heads, whole, members, n, percent)


def _components(spark: SparkSession, docs: DataFrame, n: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: doc_id, t (hash of the text), n, root (number of its component; null without words), component_id."""
    made = _classes(spark, docs, n, percent, id_column, text_column)
    found = _links(made)
    if found is None:
        return made.members.select("doc_id", "t", "n", F.col("c").alias("root"), F.coalesce("least", "doc_id").alias("component_id"))
    least = found.join(made.heads.select(F.col("c").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("top"))
    named = made.scratch.table(found.join(least, "component").select(F.col("node").alias("c"), F.col("component").alias("root"), "top"), "named")
    joined = made.members.join(named, "c", "left")
    return joined.select("doc_id", "t", "n", F.coalesce("root", "c").alias("root"), F.coalesce("top", "least", "doc_id").alias("component_id"))


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Texts: A-Z lower-cased; words are runs of what is not ASCII white space. Set: distinct n-word shingles; with fewer
    words the whole sequence; null, empty or blank texts have an empty set, link with nothing and are their own component.
    Two rows link when 100 * intersection >= percent * union. component_id: the least id reachable by links (null ids
    count last). Rows that repeat an id are rows of their own, each with the component of its own text. Other columns of
    docs don't matter. An empty table gives an empty result.
    """
    return _components(spark, docs, n, percent, id_column, text_column).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) between classes of equal sets, a < b, each once; and membership (doc_id, n_shingles, class).

    Every pair of unlike sets that links is one row, so a group of near copies has as many rows as it has linked pairs of
    unlike texts; copies with equal sets are one class. Rows without words have a null class. Rules as in jaccard_components.
    """
    made = _classes(spark, docs, n, percent, id_column, text_column)
    members = made.members.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("class"))
    posted = _posted(made)
    if posted is None:
        return spark.createDataFrame([], "a long, b long"), members
    tiles = posted.withColumn("g", F.col("c"))
    return _verify(made, _pairs(made, tiles, _maps(made, posted), "all"), "links"), members


def _verify(made: _Sets, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) of classes that link. Sets are made again from the texts of the rows that represent them."""
    scratch = made.scratch
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    need = scratch.table(made.heads.join(ids, "c", "left_semi"), f"{name}-heads")
    texts = made.rows.join(need.select("t", "d"), ["t", "d"], "left_semi").dropDuplicates(["t", "d"]).select("text")
    sets = texts.mapInArrow(_sets(made.n), "n long, k1 long, k2 long, set array<long>").join(need.select("c", *CLASS), CLASS).dropDuplicates(["c"])
    sets = scratch.table(sets.select("c", "set"), f"{name}-sets")
    left = pairs.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    out = scratch.table(both.mapInArrow(_linked(made.percent), "a long, b long"), name)
    scratch.drop(f"{name}-sets", f"{name}-heads")
    scratch.release()
    return out


def _posted(made: _Sets) -> DataFrame | None:
    """(h, c, n, place, before, pop): the prefix shingles that several classes have, written. place: of h in the set's
    order; before: the shared shingle before it, if any; pop: how often other classes have the class's shingles."""
    scratch, percent = made.scratch, made.percent
    if percent == 100:  # equal sets only, which are one class already; below, sizes under this link with equal ones only
        return None
    wide = made.classes.where(F.col("n") >= math.ceil(percent / (100 - percent)))
    posts = wide.select("c", F.explode("low").alias("h"))
    counts = scratch.table(posts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "counts")
    shared = posts.join(counts, "h").join(wide.select("c", "n", "counted"), "c")
    border = min((1 << 63) - 1, int(share(percent) * 2.0**64))
    known = (F.col("h") >= 0) & (F.col("h") < border)
    whole = Window.partitionBy("c")
    order = whole.orderBy("later", F.when(F.col("later"), 0).otherwise(F.col("k")), "h")
    shared = shared.withColumn("later", ~known).withColumn("mine", F.col("counted") - F.sum(F.when(known, 1).otherwise(0)).over(whole))
    shared = shared.select("h", "c", "n", (F.col("mine") + F.row_number().over(order) - 1).alias("place"), F.lag("h").over(order).alias("before"), F.sum("k").over(whole).alias("pop"))
    posted = scratch.table(shared.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).withColumns({"n": F.col("n").cast("int"), "place": F.col("place").cast("int")}), "posted")
    scratch.drop("counts")
    scratch.release()
    return posted


def _maps(made: _Sets, posted: DataFrame) -> DataFrame:
    """(c, n, map) of the classes that stand in a tile."""
    return made.scratch.table(made.classes.select("c", "n", "map").join(posted.select("c").distinct(), "c", "left_semi"), "maps")


def _pairs(made: _Sets, tiles: DataFrame, maps: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of classes of unlike g that a tile holds, that the places in their orders and their bitmaps allow.

    A pair is taken where its first common shingle stands, as far as the shingles right before tell (equal ones are an
    earlier common shingle). tiles: h, c, n, place, before, g.
    """
    percent = made.percent
    held = tiles.join(maps.select("c", "map"), "c")
    # Of a pair's smaller set, the place bound leaves only the first 1 - 2p/(1+p) of its shingles.
    small = held.where((100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")).withColumn("band", _band(F.col("n"), percent)).alias("a")
    reach = F.array_distinct(F.array(_band(F.floor(F.col("n") * percent / 100), percent), _band(F.col("n"), percent)))
    large = held.withColumn("band", F.explode(reach)).alias("b")
    first_common = (F.col("a.h") == F.col("b.h")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.g") != F.col("b.g")) & F.coalesce(F.col("a.before") != F.col("b.before"), F.lit(True))
    ordered = (F.col("a.n") < F.col("b.n")) | (F.col("a.n") == F.col("b.n")) & (F.col("a.c") < F.col("b.c"))
    sizes = F.col("a.n") + F.col("b.n")
    places = (100 + percent) * F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place")) >= percent * sizes
    pairs = small.join(large, first_common & ordered & _near("a.n", "b.n", percent) & places & _bound("a", "b", percent))
    return made.scratch.table(pairs.select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b")).distinct(), f"{name}-pairs")


def _starred(made: _Sets, tiles: DataFrame, centres: DataFrame, maps: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) of each tile's classes (h, c, n, g) with its centre (h, o, m, go), where sizes, components and bitmaps
    allow a link. Places don't count: h need not be the first shingle that the two share."""
    percent = made.percent
    met = tiles.join(centres, "h").where((F.col("g") != F.col("go")) & _near("n", "m", percent))
    met = met.select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).distinct()
    sized = maps.select("c", F.struct("n", "map").alias("x"))
    met = met.join(sized.select(F.col("c").alias("a"), F.col("x").alias("l")), "a").join(sized.select(F.col("c").alias("b"), F.col("x").alias("r")), "b")
    out = made.scratch.table(met.where(_bound("l", "r", percent)).select("a", "b"), name)
    made.scratch.release()
    return out


def _merged(made: _Sets, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """found (node, component) after more links (a, b) of nodes."""
    scratch = made.scratch
    extra = links.join(found.select(F.col("node").alias("a"), F.col("component").alias("ga")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("gb")), "b", "left")
    merged = scratch.table(components(scratch, extra.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")), name), f"{name}-merged")
    nodes = found.union(merged.join(found, merged.node == found.node, "left_anti").select("node", F.col("node").alias("component")))
    named = nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return scratch.table(named.select("node", F.coalesce("top", "component").alias("component")), f"{name}-found")


def _links(made: _Sets) -> DataFrame | None:
    """(node, component) of the classes that link with another."""
    scratch = made.scratch
    posted = _posted(made)
    if posted is None:
        return None
    maps = _maps(made, posted)
    # First the centre is the class whose shingles the most classes share: the text that others were copied from, if there
    # is one, so that most copies link with it. Then tiles that hold several components take centres at random, another
    # in each tile and round: of a group whose members link with many others, few components are left for the pairs.
    centres = posted.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("pop", "n", "c")).alias("o")).where("k > 1")
    centres = scratch.table(centres.select("h", F.col("o.c").alias("o"), F.col("o.n").alias("m"), F.col("o.c").alias("go")), "centres")
    compared = _starred(made, posted.withColumn("g", F.col("c")), centres, maps, "starred-0")
    found = scratch.table(components(scratch, _verify(made, compared, "starred-0-links"), "star"), "found")
    for k in range(1, ROUNDS + 2):
        labelled = posted.drop("pop").join(found.select(F.col("node").alias("c"), F.col("component").alias("g")), "c", "left").withColumn("g", F.coalesce("g", "c"))
        labelled = scratch.table(labelled, f"labelled-{k}")
        chosen = F.min_by(F.struct("c", "n", "g"), F.xxhash64("c", "h", F.lit(k)))
        mixed = labelled.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), chosen.alias("o")).where("lo < hi")
        mixed = scratch.table(mixed.select("h", F.col("o.c").alias("o"), F.col("o.n").alias("m"), F.col("o.g").alias("go")), f"mixed-{k}")
        if k > ROUNDS:
            pairs = _pairs(made, labelled.join(mixed.select("h"), "h", "left_semi"), maps, "open")
            links = _verify(made, pairs.join(compared, ["a", "b"], "left_anti"), "pair-links")
        else:
            pairs = _starred(made, labelled, mixed, maps, f"starred-{k}")
            links = _verify(made, pairs.join(compared, ["a", "b"], "left_anti"), f"starred-{k}-links")
            compared = compared.unionByName(pairs)
        found = _merged(made, found, links, f"round-{k}")
        scratch.drop(f"labelled-{k}", f"mixed-{k}")
    scratch.drop("posted", "centres", "maps")
    scratch.release()
    return found


def keep_one(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row for each component, that of its least doc_id (of rows with that id, the one with the least text
    hash); all columns of docs. Rows without a doc_id stay; rows that repeat an id and a text are one."""
    (mark,) = fresh(docs, "text_mark")
    rows = _components(spark, docs, n, percent).where(F.col("doc_id").isNotNull())
    heads = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("k")).select("k.doc_id", F.col("k.t").alias(mark))
    kept = heads.union(rows.where(F.col("root").isNull()).select("doc_id", "t").distinct())
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    kept = kept.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), mark)
    one = named.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
