"""Reports of comparisons as rows of text, in the order in which they are read."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: lines shown around a change.
CONTEXT = 3
#: The parts of a report, in order: which changes, what a summary and a compact list head them with, and sign.
SECTIONS = [("deletion", None, "Removed", "Removed", "---"), ("addition", None, "Added", "Added", "+++"), ("modification", "structural", "Structural Changes", "Structural", "@@@"), ("modification", "string_only", "String Changes", "String-only", "@@@")]


def summary_lines(summary: DataFrame) -> DataFrame:
    """(pair_id, place, text) from the summary of a diff."""
    names = ["matched", "renamed", "unchanged", "string_only", "structural", "added", "removed"]
    rows = summary.select("pair_id", F.posexplode(F.array(*[F.format_string(f"{n}: %d", F.col(n)) for n in names])).alias("place", "text"))
    return rows.orderBy("pair_id", "place")


def _section(changes: DataFrame) -> Column:
    out = F.lit(None).cast("int")
    for k, (change, kind, *_) in enumerate(SECTIONS):
        mine = F.col("change") == change if kind is None else (F.col("change") == change) & (F.col("classification") == kind)
        out = F.when(mine, k).otherwise(out)
    return out


def full_lines(changes: DataFrame) -> DataFrame:
    """(pair_id, section, text): each change with its description and where it stands, under the section's heading."""
    rows = changes.withColumn("section", _section(changes))
    sign = F.array(*[F.lit(s[4]) for s in SECTIONS])[F.col("section")]
    at = lambda s, mark: F.when(F.col(f"line_{s}").isNotNull(), F.format_string(f"\n{mark}at line %d: %s", F.col(f"line_{s}"), F.col(f"snippet_{s}"))).otherwise("")
    both = F.col("change") == "modification"
    text = F.concat(sign, F.lit(" "), "description", F.when(both, F.concat(at("old", "  - "), at("new", "  + "))).otherwise(F.concat(at("old", "    "), at("new", "    "))))
    heads = rows.select("pair_id", "section").distinct().select("pair_id", "section", F.lit(0).alias("rank"), F.format_string("=== %s ===", F.array(*[F.lit(s[2]) for s in SECTIONS])[F.col("section")]).alias("text"))
    own = rows.select("pair_id", "section", F.lit(1).alias("rank"), text.alias("text"))
    return heads.unionByName(own).orderBy("pair_id", "section", "rank", "text").drop("rank")


def compact_lines(changes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(pair_id, section, text): a heading with a count for each section, and a line a change: its name and where it stands
    in the files old and new."""
    rows = changes.withColumn("section", _section(changes))
    name = F.coalesce("name_new", "name")
    text = (
        F.when(F.col("change") == "deletion", F.format_string(f"  %s ({old}:%d-%d)", F.col("name"), F.col("line_old"), F.col("end_line_old")))
        .when(F.col("change") == "addition", F.format_string(f"  %s ({new}:%d-%d)", name, F.col("line_new"), F.col("end_line_new")))
        .when(F.col("classification") == "structural", F.format_string(f"  %s ({old}:%d -> {new}:%d) %.1f%%", name, F.col("line_old"), F.col("line_new"), F.col("similarity") * 100))
        .otherwise(F.format_string(f"  %s ({old}:%d -> {new}:%d)", name, F.col("line_old"), F.col("line_new")))
    )
    heads = rows.groupBy("pair_id", "section").agg(F.count(F.lit(1)).alias("n")).select("pair_id", "section", F.lit(0).alias("rank"), F.format_string("%s: %d", F.array(*[F.lit(s[3]) for s in SECTIONS])[F.col("section")], F.col("n")).alias("text"))
    return heads.unionByName(rows.select("pair_id", "section", F.lit(1).alias("rank"), text.alias("text"))).orderBy("pair_id", "section", "rank", "text").drop("rank")


def normalised_lines(words: list[str], lines: list[int], count: int) -> list[str]:
    """For each line of a declaration its tokens as they compare; a string of several lines stands on each of them."""
    out: list[list[str]] = [[] for _ in range(count)]
    for word, line in zip(words, lines, strict=True):
        parts = word.split("\n") if word.startswith("string ") else [word]
        for k, part in enumerate(parts):
            if line + k < count:
                out[line + k].append(part if k == 0 else f"string {part}")
    return [" ".join(x) for x in out]


def hunks(old: list[str], new: list[str], old_text: list[str], new_text: list[str]) -> list[str]:
    """The unified diff of two lists of lines, which shows other lines in their place."""
    out = []
    for group in difflib.SequenceMatcher(None, old, new, autojunk=False).get_grouped_opcodes(CONTEXT):
        a, b, c, d = group[0][1], group[-1][2], group[0][3], group[-1][4]
        out.append(f"@@ -{a + (b > a)},{b - a} +{c + (d > c)},{d - c} @@")
        for tag, i, j, k, m in group:
            if tag == "equal":
                out += [f" {x}" for x in new_text[k:m]]
            else:
                out += [f"-{x}" for x in old_text[i:j]] + [f"+{x}" for x in new_text[k:m]]
    return out


def display_diffs(words: DataFrame) -> DataFrame:
    """(pair_id, i1, i2, place, text): for each changed match the line diff of its tokens, so that renamed locals and
    layout are no change, shown in the original lines. words: of a diff.Comparison."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for t1, l1, x1, t2, l2, x2 in zip(*(frame[c] for c in ("t1", "lines1", "text1", "t2", "lines2", "text2")), strict=True):
                x1, x2 = x1.split("\n"), x2.split("\n")
                made.append([{"place": k, "text": t} for k, t in enumerate(hunks(normalised_lines(list(t1), list(l1), len(x1)), normalised_lines(list(t2), list(l2), len(x2)), x1, x2))])
            yield pd.DataFrame({"row": frame["row"], "lines": made})

    keyed = words.withColumn("row", F.to_json(F.struct("pair_id", "i1", "i2")))
    key = words.select(F.struct("pair_id", "i1", "i2").alias("k")).schema["k"].dataType
    made = keyed.select("row", "t1", "lines1", "text1", "t2", "lines2", "text2").mapInPandas(run, "row string, lines array<struct<place:long,text:string>>")
    return made.select(F.from_json("row", key).alias("k"), F.inline("lines")).select("k.*", "place", "text")


def unified(pairs: DataFrame) -> DataFrame:
    """(pair_id, place, text): the line diff of pairs (pair_id, old, new) as they are written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, k, line) for p, old, new in frame.itertuples(index=False) for k, line in enumerate(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "old", "new", n=CONTEXT, lineterm=""))]
            yield pd.DataFrame(rows, columns=["pair_id", "place", "text"])

    return pairs.select("pair_id", "old", "new").mapInPandas(run, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, place long, text string")


def as_json(changes: DataFrame) -> DataFrame:
    """(pair_id, json): each change with all that is told of it."""
    return changes.select("pair_id", F.to_json(F.struct(*[c for c in changes.columns if c != "pair_id"])).alias("json"))


def rename_export(matches: DataFrame) -> DataFrame:
    """(pair_id, text): a YAML mapping of old to new names of matched declarations that are named otherwise, sorted. Of
    declarations that share an old name the last in order of declaration counts."""
    last = matches.where("name_old != name_new").groupBy("pair_id", "name_old").agg(F.max_by("name_new", F.col("i1.decl_ix")).alias("name_new"))
    quoted = lambda c: F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)
    line = F.when(F.col("name_old").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("name_old")).otherwise(quoted("name_old"))
    to = F.when(F.col("name_new").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("name_new")).otherwise(quoted("name_new"))
    rows = last.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.concat(line, F.lit(": "), to))).alias("lines"))
    return rows.select("pair_id", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("text"))


def timers(rows: DataFrame) -> DataFrame:
    """(name, seconds, calls, average_ms) of rows (name, seconds), longest first."""
    out = rows.groupBy("name").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("calls"))
    return out.withColumn("average_ms", F.col("seconds") / F.col("calls") * 1000).orderBy(F.desc("seconds"), "name")
