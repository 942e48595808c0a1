"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a text that rejects above a cutoff. Labelled holdouts choose the cutoffs of all rules together,
along one path: a position allows each rule the same multiple of its width above its middle. Middles (median) and widths
(up to the share 1 - RISK / 2) come from every PILOT-th good label by hash, whatever its stratum; the path is then fixed,
and the other good labels test it. In each stratum (the language) positions are tested from the loosest on: is the share of
good documents that the rules together reject under RISK? The test is exact: the binomial probability of as few rejections
at that share. The first position that fails ends the sequence, so the tests of one sequence need no correction; strata
share the error LEVEL evenly (Bonferroni). Strata too small to prove even no rejection are tested as one pool. With
probability 1 - LEVEL, no stratum with a test of its own, and not the pool as a whole, therefore loses more than RISK of its
good documents. Where the pool is too small as well, and in strata without good labels, the rules reject nothing.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import stats
from cambium.llm.common import Scratch, fresh, text_udf

RISK, LEVEL = 0.02, 0.05
#: Steps of a statistic; cutoffs are whole steps.
STEPS = 1000
#: One good label in PILOT scales the path; a rule's width is MARGIN steps at least, and a position a PARTS-th of a width.
PILOT, MARGIN, PARTS = 8, 10, 100
RULES = ["symbols", "dup_lines", "repeats", "long_words", "short_words"]


def steps() -> list[Column]:
    """The statistics of RULES in whole steps from 0 to STEPS."""
    share = lambda a, b: F.least(F.lit(STEPS), F.floor(F.lit(STEPS) * F.col(a) / F.greatest(F.col(b), F.lit(1)))).cast("int")
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return [
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        F.least(F.lit(STEPS), F.floor(mean * 20)).cast("int"),
        F.greatest(F.lit(0), STEPS - F.floor(mean * 50)).cast("int"),
    ]


def log_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial (n, p): the regularised incomplete beta function of 1 - p at (n - k, k + 1)."""
    if k >= n:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    log_front = math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p)
    if x * (a + b + 2) < a + 1:
        return min(0.0, log_front - math.log(a) + math.log(_fraction(a, b, x)))
    rest = math.exp(log_front - math.log(b)) * _fraction(b, a, p)
    return math.log1p(-min(rest, 1 - 1e-300)) if rest < 1 else -math.inf


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards with its convergents' ratios."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            return out


def cutoff(counts: dict[int, int], risk: float, level: float) -> int:
    """Least cutoff of the fixed sequence STEPS, STEPS - 1, ...: statistics above it are rejected. STEPS rejects nothing."""
    n, rejected, best = sum(counts.values()), 0, STEPS
    if not n or not provable(n, risk, level):
        return best
    for c in range(STEPS - 1, -1, -1):
        more = counts.get(c + 1, 0)
        rejected += more
        if more and log_cdf(rejected, n, risk) > math.log(level):
            break
        best = c
    return best


def provable(n: int, risk: float, level: float) -> bool:
    """No rejection at all among n would prove the risk."""
    return n * math.log1p(-risk) <= math.log(level)


def scale(counts: dict[int, int], risk: float) -> tuple[int, int]:
    """Middle and width of a statistic; without counts, the whole range."""
    n, seen, middle = sum(counts.values()), 0, None
    for step in sorted(counts):
        seen += counts[step]
        if middle is None and 2 * seen >= n:
            middle = step
        if seen >= (1 - risk / 2) * n:
            return middle, max(MARGIN, step - middle)
    return 0, STEPS


def on_path(position: int, middle: int, width: int) -> int:
    """The cutoff at a position: the largest statistic whose own position is no higher."""
    return STEPS if position >= STEPS else min(STEPS, middle + ((position + 1) * width - 1) // PARTS)


def thresholds(scratch: Scratch, counted: DataFrame, labels: DataFrame, risk: float, level: float) -> DataFrame:
    """(stratum, one cutoff for each rule)."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("labelled_id")).distinct()
    rows = counted.where(~F.col("base_failed")).join(good, F.col("id") == F.col("labelled_id"), "left_semi")
    rows = scratch.table(rows.select("stratum", *[f"s_{r}" for r in RULES], (F.pmod(F.xxhash64("id"), F.lit(PILOT)) == 0).alias("pilot")), "labelled")
    long = rows.where("pilot").select(F.posexplode(F.array(*[F.col(f"s_{r}") for r in RULES])).alias("rule", "step"))
    pilot: dict[int, dict[int, int]] = {k: {} for k in range(len(RULES))}
    for r in long.groupBy("rule", "step").count().collect():  # RULES * (STEPS + 1) rows at most
        pilot[r["rule"]][r["step"]] = r["count"]
    scales = [scale(pilot[k], risk) for k in range(len(RULES))]

    position = F.greatest(F.lit(0), *[F.floor((F.col(f"s_{r}") - m) * PARTS / w) for r, (m, w) in zip(RULES, scales, strict=True)])
    sums = rows.where("not pilot").groupBy("stratum", F.least(F.lit(STEPS), position).cast("int").alias("position")).count()
    sums = scratch.table(sums, "histogram")
    sized = sums.groupBy("stratum").agg(F.sum("count").alias("n"))
    own = F.col("n") * F.lit(math.log1p(-risk)) <= F.lit(math.log(level / (sized.count() + 1)))  # as provable
    sized = scratch.table(sized.select("stratum", F.when(own, F.col("stratum")).otherwise("").alias("unit")), "units")  # "": the pool
    tests = max(1, sized.select("unit").distinct().count())

    def choose(part: pd.DataFrame) -> pd.DataFrame:  # STEPS + 1 rows at most
        c = cutoff(dict(zip(part["position"], part["count"], strict=True)), risk, level / tests)
        return pd.DataFrame([{"unit": part["unit"].iloc[0]} | {f"c_{r}": on_path(c, m, w) for r, (m, w) in zip(RULES, scales, strict=True)}])

    units = sums.join(sized, "stratum").groupBy("unit", "position").agg(F.sum("count").alias("count"))
    cuts = units.groupBy("unit").applyInPandas(choose, "unit string, " + ", ".join(f"c_{r} int" for r in RULES))
    return sized.join(cuts, "unit").drop("unit")


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, risk: float = RISK, level: float = LEVEL) -> tuple[DataFrame, dict[str, str]]:
    """columns of docs (all by default) with the base counts, base_failed, kept, and for each rule whether it rejects; and
    a map from those names to the ones under which they stand (an underscore before where docs has the name).

    Words are runs of what is not ASCII white space; null and empty texts have none and fail the base rule, as do texts of
    under 50 words or with over half their words in repeated 3-word windows. A null language is a stratum of its own.
    Only good labels count, an id once; without labels nothing but the base rule rejects. Rows that repeat are judged
    alike. An empty table gives an empty table.
    """
    keep = list(columns or docs.columns)
    inner = [*stats.RULE_NAMES, "base_failed", "kept", *[f"by_{r}" for r in RULES]]
    names = dict(zip(inner, fresh(docs, *inner), strict=True))
    scratch = Scratch(spark, "rules")

    def made(texts: list[str]) -> pa.Array:
        found = [stats.rule_counts(x.encode("utf-8")) for x in texts]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(stats.RULE_NAMES), names=stats.RULE_NAMES)

    counts = text_udf(made, ", ".join(f"{n} long" for n in stats.RULE_NAMES))

    def counted(row: list[str]) -> DataFrame:
        lang = F.when(F.col("lang").isNull(), "no language").otherwise(F.concat(F.lit("language "), F.col("lang").cast("string")))
        rows = docs.select(F.struct(*row).alias("row"), F.col("doc_id").cast("long").alias("id"), lang.alias("stratum"), counts(F.col("text").cast("string")).alias("found"))
        rows = rows.select("row", "id", "stratum", "found.*")
        rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        return rows.select("*", *[c.alias(f"s_{r}") for c, r in zip(steps(), RULES, strict=True)])

    # Counts are kept without the texts. Where the result carries texts, they are read once more for it.
    light = "text" not in keep
    known = scratch.table(counted(keep if light else ["doc_id"]), "counted")
    cuts = scratch.table(thresholds(scratch, known, labels, risk, level), "cutoffs")
    counted = known if light else counted(keep)
    judged = counted.join(cuts, "stratum", "left")  # one row a stratum: Spark broadcasts it only where it is small
    by = [(F.col(f"s_{r}") > F.coalesce(F.col(f"c_{r}"), F.lit(STEPS))).alias(names[f"by_{r}"]) for r in RULES]
    verdict = ~F.col("base_failed")
    for r in RULES:
        verdict = verdict & (F.col(f"s_{r}") <= F.coalesce(F.col(f"c_{r}"), F.lit(STEPS)))
    out = judged.select(*[F.col("row")[c].alias(c) for c in keep], *[F.col(n).alias(names[n]) for n in stats.RULE_NAMES], F.col("base_failed").alias(names["base_failed"]), verdict.alias(names["kept"]), *by)
    return out, names


def keep_passed(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that fail; all columns of docs."""
    out, names = judge(spark, docs, labels)
    return out.where(F.col(names["kept"])).select(*docs.columns)
