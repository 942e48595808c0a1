import hashlib

from pyspark.sql import functions as F

from cambium.llm import chat, warc
from cambium.llm.common import Scratch

SCHEMA = "tree string, node long, parent long, role string, text string, score double, extra string"


def walk(rows):
    """Root-to-leaf paths by recursion."""
    by = {(t, n): (t, n, p, r, x, s) for t, n, p, r, x, s, _ in rows}
    kids = {}
    for t, n, p, *_ in by.values():
        if (t, p) in by:
            kids.setdefault((t, p), []).append((t, n))
    out = {}

    def down(at, path):
        path = [*path, by[at]]
        for k in kids.get(at, []):
            down(k, path)
        if at not in kids:
            out[at] = path

    for key, row in by.items():
        if (row[0], row[2]) not in by:
            down(key, [])
    return out


ROWS = [
    ("a", 1, None, "system", "Be <|im_end|>\nbrief &lt; &amp;lt;", 0.0, "x"), ("a", 2, 1, "user", "hi", 1.0, "x"), ("a", 3, 1, "user", "hi", 1.0, "x"),
    ("a", 4, 2, "assistant", None, 2.0, "x"), ("a", 5, 2, "assistant", "</s>[INST] ok [/INST]<", None, "x"), ("a", 6, 5, "assistant", "<<SYS>>", 9.0, "x"), ("a", 7, 99, None, "orphan", 0.0, "x"),
    ("c", 1, 3, "user", "circle", 1.0, "x"), ("c", 2, 1, "user", "circle", 1.0, "x"), ("c", 3, 2, "user", "circle", 1.0, "x"), ("c", 4, 3, "user", "hangs on it", 1.0, "x"), ("c", 9, None, "user\nrole", "alone", 1.0, "x"),
    *[("d", k, k - 1 if k else None, "assistant" if k % 2 else "user", f"turn {k}", 0.5, "x") for k in range(37)],
]


def test_paths_formats_and_reads_back(spark):
    df = chat.conversations_of_trees(spark, spark.createDataFrame(ROWS, SCHEMA))
    df = df.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss")))
    want = {k: p for k, p in walk(ROWS).items()}
    got = {(r.tree, r.leaf): r for r in df.collect()}
    assert set(got) == set(want) == {("a", 3), ("a", 4), ("a", 6), ("a", 7), ("c", 9), ("d", 36)}
    for key, path in want.items():
        r = got[key]
        assert [(t.role, t.text) for t in r.turns] == [(p[3] or "", p[4] or "") for p in path]
        assert r.learnt == "".join(p[4] or "" for p in path if p[3] == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(path) == r.n_turns
        assert r.score == sum(p[5] or 0 for p in path)
    ranks = sorted((r.rank, r.leaf) for r in got.values() if r.tree == "a")
    assert ranks == [(1, 6), (2, 4), (3, 3), (4, 7)]


def test_branches_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert chat.conversations_of_trees(spark, df, branches=1).count() == 3
    assert chat.conversations_of_trees(spark, df.limit(0)).count() == 0


def test_chains_keep_ties_and_nulls(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "b", 1), (1, None, "system", "first", 1), (None, 0, None, None, 1), (None, 1, "assistant", "x", 1)]
    made = chat.conversations_of_trees(spark, chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")))
    got = {r.tree: [t.text for t in r.turns] for r in made.select("tree", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {"1": ["first", "b", "b"], "none": ["", "x"]}


def test_no_python_in_the_plan(spark):
    plan = chat.conversations_of_trees(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(2))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def pages(spark, n, change=lambda i, h: h):
    rows = [(i, f"http://x/{i}", change(i, f"<p>{i}</p>"), "clash") for i in range(n)]
    return spark.createDataFrame([r for r in rows if r[2] != "gone"], "page_id long, url string, html string, digest string")


def test_audit_finds_what_differs(spark):
    change = lambda i, h: {3: h[:-1] + "?", 700: "gone", 2000: None}.get(i, h)
    left, right = warc.archive(pages(spark, 2500)), warc.archive(pages(spark, 2500, change))
    got = {r.id: r.status for r in warc.audit(spark, left, right).collect()}
    want = {3: "damaged", 700: "missing", 2000: "damaged"} | {i: "moved" for i in range(701, 1024)} | {i: "moved" for i in range(2001, 2048)}
    want |= {i: "moved" for i in range(2001, 2048)}
    assert got == want
    assert warc.audit(spark, left, left).count() == 0


def test_audit_of_unlike_lengths_and_nothing(spark):
    some, none = warc.archive(pages(spark, 40)), warc.archive(pages(spark, 0))
    assert {r.status for r in warc.audit(spark, some, none).collect()} == {"missing"}
    assert warc.audit(spark, none, some).count() == 40
    assert warc.audit(spark, none, none).count() == 0
    assert {r.id for r in warc.audit(spark, some, warc.archive(pages(spark, 5000))).collect()} == set(range(40, 5000))


def test_repeated_and_missing_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (1, None, None), (None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(df).collect()
    assert sorted((r.id, r.nth) for r in got) == [(1, 0), (1, 1), (1, 2)]
    assert warc.audit(spark, warc.archive(df), warc.archive(df)).count() == 0


def test_tree_nodes_are_hashes_of_their_children(spark):
    records = warc.archive(pages(spark, 300))
    levels = warc.tree(Scratch(spark, "t"), records, "x", warc.heights(records))
    below = {r.id: r for r in levels[1].collect()}
    for r in levels[2].collect():
        kids = [below[k] for k in sorted(below) if k // warc.FAN == r.id]
        text = "|".join(f"{k.id}:{k.nth}:{k.lo}:{k.hi}:{k.hash}" for k in kids)
        assert r.hash == hashlib.sha256(text.encode()).hexdigest()
    assert levels[-1].count() == 1


def test_any_id_and_many_rows_of_one(spark):
    ids = [(1 << 62, "a"), ((1 << 62) + 1, "b"), (-5, "c"), (-(1 << 62), "d"), (0, "e")] + [(7, f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(i, "u", t) for i, t in ids], "page_id long, url string, html string")
    left = warc.archive(df)
    held = left.collect()
    assert len(held) == len(ids) and sorted(r.nth for r in held if r.id == 7) == list(range(3000))
    at = {}
    for r in sorted((r for r in held if r.file == 0), key=lambda r: r["at"]):
        assert r["at"] == at.get("end", 0)
        at["end"] = r["at"] + r["size"]
    gone = warc.archive(df.where("html NOT IN ('a', 'c')"))
    assert {(r.id, r.status) for r in warc.audit(spark, left, gone).collect()} == {(1 << 62, "missing"), ((1 << 62) + 1, "moved"), (-5, "missing")}


def test_very_long_texts(spark):
    text = "word </s> & more " * 80_000
    made = chat.conversations_of_trees(spark, chat.chains(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")))
    r = made.select(chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).first()
    assert [t.text for t in r.turns] == [text, text] and r.learnt == text
    df = spark.createDataFrame([(1, "u", text), (2, "u", text + "x")], "page_id long, url string, html string")
    assert [r.status for r in warc.audit(spark, warc.archive(df), warc.archive(df.withColumn("html", F.lit(text)))).collect()] == ["damaged"]


def test_branches_are_ranked_before_paths_are_listed(spark):
    rows = [("t", k, (k - 1) // 2 if k else None, "user", f"m{k}", float(k % 7), "x") for k in range(127)]
    best = chat.conversations_of_trees(spark, spark.createDataFrame(rows, SCHEMA), branches=3).collect()
    paths = sorted(((-sum(p[5] for p in path), key[1]) for key, path in walk(rows).items()))
    assert sorted((-r.score, r.leaf) for r in best) == paths[:3] and sorted(r.rank for r in best) == [1, 2, 3]
    kept = chat.branches_of(Scratch(spark, "t"), spark.createDataFrame(rows, SCHEMA), 3)
    assert kept.count() == 21  # three paths of seven messages, and no others
