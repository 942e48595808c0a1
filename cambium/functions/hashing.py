"""Portable hashes, digests, similarity hashes and integer (basis-point) similarities as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of the MinHash lanes (a Mersenne prime), and the scale of basis points.
PRIME, SCALE = 2147483647, 10_000


def md5_int(text: Column, digits: int = 7) -> Column:
    """The first hex digits of a text's md5 as a long; the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def lane_parameters(lane: int) -> tuple[int, int]:
    """Multiplier and increment of a MinHash lane."""
    return (lane * 7919 + 104_729) % 65_521 * 2 + 1, (lane * 15_485_863 + 32_452_843) % PRIME


def minhash(hashes: Column, lanes: int) -> Column:
    """array<long>: for each lane the least (h * a + b) mod PRIME over a set of longs under 2**28."""

    def lane(k: int) -> Column:
        a, b = lane_parameters(k)
        return F.array_min(F.transform(hashes, lambda h: F.pmod(h * F.lit(a) + F.lit(b), F.lit(PRIME))))

    return F.array(*[lane(k) for k in range(lanes)])


def equal_lanes(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def simhash(features: Column, bits: int = 64) -> Column:
    """Votes of 64-bit feature hashes for each bit; a tie sets the bit. Null for no features."""
    bit = lambda k: F.when(F.aggregate(features, F.lit(0), lambda n, h: n + F.when(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)) >= 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(features) > 0, functools.reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(bits)]))


def band(x: Column, k: int) -> Column:
    """The k-th 16 bits of a similarity hash."""
    return F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(65_535).cast("long"))


def hamming_bps(a: Column, b: Column) -> Column:
    return F.lit(SCALE) - F.floor(F.bit_count(a.bitwiseXOR(b)) * F.lit(SCALE) / 64)


def ratio_bps(a: Column, b: Column) -> Column:
    """Lesser over greater; two zeros are equal."""
    return F.when(F.greatest(a, b) == 0, F.lit(SCALE)).otherwise(F.floor(F.least(a, b) * F.lit(SCALE) / F.greatest(a, b))).cast("long")


def histogram_bps(pairs: list[tuple[Column, Column]]) -> Column:
    """Sum of minima over sum of maxima; two empty histograms are equal."""
    low = functools.reduce(lambda x, y: x + y, [F.least(a, b) for a, b in pairs])
    high = functools.reduce(lambda x, y: x + y, [F.greatest(a, b) for a, b in pairs])
    return F.when(high == 0, F.lit(SCALE)).otherwise(F.floor(low * F.lit(SCALE) / high)).cast("long")


def size_bucket(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def tier(score: Column, source_margin: Column, target_margin: Column, anchored: Column | None = None) -> Column:
    """Confidence of a match: exact for anchors, high and medium by score and both margins, else low."""
    out = F.when((score >= 8500) & (source_margin >= 1500) & (target_margin >= 1500), "high").when((score >= 7200) & (source_margin >= 700) & (target_margin >= 700), "medium").otherwise("low")
    return out if anchored is None else F.when(anchored, "exact").otherwise(out)


def little_endian(n: Column) -> Column:
    """Eight bytes of a long, least significant first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))


def digest_id(domain: str, *parts: Column) -> Column:
    """SHA-256 (hex) over a domain and parts, each behind its length, so that no two lists of parts read alike."""
    pieces = []
    for p in (F.lit(domain), *parts):
        b = F.coalesce(p.cast("string"), F.lit("")).cast("binary")
        pieces += [little_endian(F.octet_length(b)), b]
    return F.sha2(F.concat(*pieces), 256)


def feature_hash(*parts: Column | str) -> Column:
    """A signed 64-bit hash of parts: the first eight bytes, least first, of the SHA-256 over each behind its length."""
    domain, *rest = parts
    digest = digest_id(domain, *rest)
    return F.conv(F.concat(*[F.substring(digest, 15 - 2 * k, 2) for k in range(8)]), 16, -10).cast("long")


def string_context(text: Column) -> Column:
    """What a string literal looks like. Fixed values, in order: error words, path marks, endpoints, kebab case, long identifiers."""
    low = F.lower(text)
    any_of = lambda col, words: functools.reduce(lambda x, y: x | y, [F.contains(col, F.lit(w)) for w in words])
    slashes = F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))
    return (
        F.when(any_of(low, ["error", "fail", "exception", "invalid", "unable"]), "error")
        .when(any_of(text, ["~/", "/.", "\\"]) | F.endswith(text, F.lit(".js")) | F.endswith(text, F.lit(".json")) | F.endswith(text, F.lit(".md")), "path")
        .when(F.startswith(text, F.lit("/")) & (F.contains(text, F.lit("/api")) | (slashes > 1)), "endpoint")
        .when(F.contains(text, F.lit("-")) & text.rlike(r"^[\p{L}\p{N}-]*$"), "command")
        .when(text.rlike(r"^[\p{L}\p{N}_]*$") & (F.octet_length(text) > 5), "config")
        .otherwise("regular")
    )


def rarity(family: str, n: Column) -> Column:
    """Weight of a value by how often both sides hold it. Fixed values."""
    if family == "string":
        return F.when(n == 0, 0.0).when(n == 1, 1.0).when(n == 2, 0.7).when(n <= 5, 0.4).otherwise(0.1)
    if family == "constant":
        return F.when(n == 0, 0.0).when(n == 1, 1.0).when(n == 2, 0.6).when(n <= 5, 0.3).otherwise(0.1)
    if family == "api":
        return F.when(n == 0, 0.0).when(n <= 3, 0.8).when(n <= 10, 0.5).otherwise(0.2)
    raise ValueError(family)


def acceptance(similarity_bps: Column, evidence: Column, size: Column) -> Column:
    """Is a pair good enough? By the number of evidence items, without any by size. Fixed values, in basis points."""
    by_size = (similarity_bps >= 8500) | (similarity_bps >= F.when(size < 10, 7000).when(size < 50, 5000).otherwise(4000))
    by_evidence = similarity_bps >= F.when(evidence == 1, 6000).when(evidence == 2, 4500).when(evidence <= 4, 4000).otherwise(3500)
    return F.when(evidence > 0, by_evidence).otherwise(by_size)
