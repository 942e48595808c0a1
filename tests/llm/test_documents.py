import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cambium.llm import html, huffman, packing, quality, rules, sharding, stats, tokens

from .helpers import HARD_TEXTS, empty_docs, hard_docs

DIR = "/root/testdata/sf0.01"


def docs_and_labels(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")


def test_quality_on_held_out_labels(spark):
    docs, labels = docs_and_labels(spark)
    out, _ = quality.score(spark, docs, labels, ["doc_id"])
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_model_is_the_regularised_discriminant():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 1, (80, quality.D)), 1: rng.normal(0.7, 2, (200, quality.D))}
    both = np.concatenate([x[0], x[1]])
    model = quality.discriminant(both, np.repeat([0, 1], [80, 200]), 0.1, 0.02, 3.0)
    z = (both - both.mean(0)) / both.std(0)
    covs = [np.cov(z[:80].T, bias=True), np.cov(z[80:].T, bias=True)]
    pooled = (80 * covs[0] + 200 * covs[1]) / 280
    logs = []
    for c, part in ((0, z[:80]), (1, z[80:])):
        s = 0.9 * covs[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.eye(quality.D) * np.trace(s) / quality.D
        d = z - part.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / 3.0 + math.log(200 / 80), -500, 500)))
    assert np.allclose(model.scores(both), want, atol=1e-9)


def test_quality_fits_a_bounded_sample(spark):
    docs, labels = docs_and_labels(spark)
    model = quality.train(docs, labels, fit_rows=80)
    full = quality.train(docs, labels)
    assert isinstance(model, quality.Model) and isinstance(full, quality.Model) and abs(model.prior - full.prior) < 0.2
    rows = docs.join(labels, "doc_id").where(quality.held_out()).select("text", "quality").collect()
    x = np.array([stats.features(r.text.encode()) for r in rows])
    assert np.mean((model.scores(x) >= quality.CUT) == [r.quality == 1 for r in rows]) > 0.9


def test_quality_on_hard_tables(spark):
    docs = hard_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, names = quality.score(spark, docs, none)
    assert names == ["held_out", "_score", "predicted"] and {r["_score"] for r in out.collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(spark, docs, labels)[0].collect()
    assert len(got) == docs.count() and all(0 <= r["_score"] <= 1 for r in got)
    assert quality.score(spark, empty_docs(spark), labels)[0].count() == 0
    assert quality.keep_good(spark, docs, none).columns == docs.columns


def slow_counts(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again, lines = set(), 0, 0
    for line in (text or "").encode().split(b"\n"):
        if re.search(rb"[^\x20\x09-\x0D]", line):
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(hit), lines


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\té😀#|\x0b\x85"), max_size=60))
def test_rule_counts(text):
    assert stats.rule_counts(text.encode()) == slow_counts(text)


def test_rules_equal_brute_force(spark):
    docs, labels = docs_and_labels(spark)
    out, names = rules.judge(spark, docs, labels, ["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert tuple(r[n] for n in stats.RULE_NAMES) == slow_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_cutoffs_are_exact():
    for n, p, k in ((400, 0.02, 3), (1000, 0.01, 0), (50, 0.3, 20)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(rules.log_cdf(k, n, p)), want, rel_tol=1e-9)
    for n, k in ((10**9, 19_990_000), (10**9, 10), (400_000_000, 400_000)):  # far too many terms for a sum
        assert rules.log_cdf(k, n, 0.02) < math.log(0.05)
    assert math.isclose(math.exp(rules.log_cdf(20_000_000, 10**9, 0.02)), 0.5, abs_tol=0.001)
    counts = {0: 990, 5: 5, 900: 5}
    assert rules.cutoff(counts, 0.02, 0.05) == 0 and rules.cutoff(counts, 0.012, 0.05) == 5 and rules.cutoff(counts, 0.01, 0.05) == 900
    assert rules.cutoff({3: 20}, 0.02, 0.05) == rules.STEPS


def test_rules_reject_junk_and_keep_good(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, say(80), "en") for i in range(3000)] + [(5000 + i, say(80).replace(" ", "# "), "en") for i in range(20)]
    labels = [(i, 1, 0) for i in range(3000)]
    out, _ = rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert len(kept & set(range(3000))) >= 2940 and not kept & set(range(5000, 5020))


def test_rules_reject_junk_in_small_strata(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    sizes = {"en": 700, "es": 330, "pl": 150, "cs": 150, "tr": 40}  # the last three are one pool
    rows, labels, junk = [], [], set()
    for lang, n in sizes.items():
        for _ in range(n):
            labels.append((len(rows), 1, 0))
            rows.append((len(rows), say(80), lang))
        for _ in range(20):
            junk.add(len(rows))
            rows.append((len(rows), say(80).replace(" ", "# "), lang))
    junk_none = {len(rows) + k for k in range(5)}  # a language without labels: nothing is proven, nothing rejected
    rows += [(i, say(80).replace(" ", "# "), "xx") for i in sorted(junk_none)]
    out, _ = rules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in out.where("kept").collect()}
    assert not kept & junk and junk_none <= kept
    for lang in ("en", "es"):
        good = {i for i, _, x in rows if x == lang} - junk
        assert len(good & kept) >= (1 - rules.RISK) * len(good)
    pool = {i for i, _, x in rows if x in ("pl", "cs", "tr")} - junk
    assert len(pool & kept) >= (1 - rules.RISK) * len(pool)


def test_path_of_cutoffs():
    assert rules.scale({}, 0.02) == (0, rules.STEPS) and rules.scale({0: 500}, 0.02) == (0, rules.MARGIN)
    assert rules.scale({0: 60, 100: 38, 130: 1, 900: 1}, 0.02) == (0, 130)
    for m, w in ((0, 10), (746, 43), (99, 333)):
        for c in (0, 7, 150, 999):
            cut = rules.on_path(c, m, w)
            below = [s for s in range(rules.STEPS + 1) if math.floor((s - m) * rules.PARTS / w) <= c]
            assert cut == max(below)
    assert rules.on_path(rules.STEPS, 5, 10) == rules.STEPS


def test_rules_on_hard_tables(spark):
    docs, labels = hard_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, names = rules.judge(spark, docs, labels)
    assert names["n_words"] == "_n_words" and names["kept"] == "_kept" and out.count() == docs.count()
    assert rules.keep_passed(spark, docs, labels).columns == docs.columns
    assert rules.judge(spark, empty_docs(spark), labels)[0].count() == 0


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_path())
    texts = [t or "" for t in HARD_TEXTS] + ["trail  ", "  lead", "a\x1fb", "don't 'S", "<|endoftext|> x", "½²", "tab\tx \n\n y", "Ærø's " * 50]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [w.ids for w in want]
    e.known.clear()
    e.known.memory = 10
    assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [w.ids for w in want]


def test_encoder_equals_a_fresh_tokenizer_on_added_tokens():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_path())
    added = [x.content for x in fresh.get_added_tokens_decoder().values()]
    texts = [f"a {x} b" for x in added] + [f"{x}{x}x" for x in added] + [f"été {x[:-1]} {x}" for x in added] + ["plain text"]
    assert added
    e = tokens.Encoder(tokens.default_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in e.ids(texts)] == [w.ids for w in fresh.encode_batch(texts, add_special_tokens=False)]


def test_a_new_piece_costs_no_second_look_up_of_the_others():
    looked = Counter()

    class Piece(str):
        def __hash__(self):
            looked[str(self)] += 1
            return str.__hash__(self)

    e = tokens.Encoder(tokens.default_path())
    want = e.ids(["one two three"])
    assert [e.known.joined([Piece(x) for x in ("one", " two", " newest", " three")])] == e.ids(["one two newest three"])
    assert looked["one"] == looked[" two"] == looked[" three"] == 1
    assert e.ids(["one two three"]) == want


def test_codes_of_all_lengths_stand_where_their_bits_do():
    lengths = np.array([*range(1, 25), 24])
    book = huffman.Codebook(np.arange(25), lengths)
    ids = np.random.default_rng(0).integers(0, 25, 3000)
    bits = "".join(f"{int(book.code[i]):0{int(book.length[i])}b}" for i in ids)
    payload, marks = book.encode(ids)
    assert payload == int(bits.ljust(-len(bits) // 8 * -8, "0"), 2).to_bytes((len(bits) + 7) // 8, "big")
    assert marks.tolist() == [int(book.length[ids[:k]].sum()) for k in range(0, len(ids), huffman.EVERY)]
    (back,) = huffman.decode(book, book.table(), [payload], [marks], [len(ids)])
    assert back.tolist() == ids.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths(counts, longest):
    lengths = huffman.code_lengths(np.array(counts), longest)
    assert lengths.max() <= longest and sum(2.0 ** -int(n) for n in lengths) <= 1
    if len(counts) > 1:
        import heapq

        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        free = huffman.code_lengths(np.array(counts), 60)
        assert int((free * np.array(counts)).sum()) == cost


def test_corpus_round_trip(spark, tmp_path):
    docs = hard_docs(spark)
    folder = f"file://{tmp_path}/corpus"
    huffman.write_corpus(spark, docs, folder, end_id=0)
    back = huffman.read_corpus(spark, folder).orderBy("start").collect()
    e = tokens.Encoder(tokens.default_path())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, np.frombuffer(e.ids([r.text or ""])[0], "<u4").tobytes() + b"\0" * 4] += 1
    assert Counter((r.doc_id, bytes(r.ids)) for r in back) == want
    assert [r.start for r in back] == np.concatenate([[0], np.cumsum([r.n_tokens for r in back])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in back]
    assert ids == sorted(ids)
    huffman.write_corpus(spark, empty_docs(spark), f"{folder}-none")
    assert huffman.read_corpus(spark, f"{folder}-none").count() == 0


def test_packing(spark):
    docs = hard_docs(spark).unionByName(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(1).alias("n_words"), F.lit("").alias("kept"), F.lit(0.0).alias("score")).where("doc_id > 30"))
    rows = packing.pack(spark, docs).collect()
    e = tokens.Encoder(tokens.default_path())
    want = Counter()
    for r in docs.collect():
        ids = np.frombuffer(e.ids([r.text or ""])[0], "<u4").tolist() + [1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[r.doc_id, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) * 2048 / sum(r.length for r in rows) < 1.02
    assert packing.pack(spark, empty_docs(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_plan_covers_each_piece_once(lengths):
    runs = packing.plan(lengths, 256, 8)
    used = Counter()
    places = {c: [] for c in lengths}
    for c, lo, hi, first, each in runs:
        places[c].append((lo, hi))
        for k in range(hi - lo):
            used[first + k // each] += c
    assert all(v <= 32 for v in used.values())
    for c, n in lengths.items():
        at = 0
        for lo, hi in sorted(places[c]):
            assert lo == at
            at = hi
        assert at == n


def test_sharding(spark):
    docs = hard_docs(spark).unionByName(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", F.lit(1).alias("n_words"), F.lit("").alias("kept"), F.lit(0.0).alias("score")))
    rows = sharding.shard_documents(spark, docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    total, shard_of = Counter(), {}
    for r in rows:
        total[r.shard] += r.size
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert sorted(total) == list(range(8)) and max(total.values()) < 1.01 * min(total.values())
    for s in total:
        own = sorted((r.slot, -1 if r.doc_id is None else r.doc_id) for r in rows if r.shard == s)
        assert [a for a, _ in own] == list(range(len(own))) and [b for _, b in own] == sorted(b for _, b in own)
    assert sharding.shard_documents(spark, empty_docs(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(50, 120))
def test_best_fit_decreasing_equals_the_loop(sizes, capacity):
    rooms, placed = [], Counter()
    for s in sorted(sizes, reverse=True):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(capacity)
        rooms[b] -= s
        placed[s, b] += 1
    got = Counter()
    counts = sorted(Counter(sizes).items(), reverse=True)
    for (size, _), runs in zip(counts, sharding.fit(counts, capacity, 100), strict=True):
        for shard, n in runs:
            got[size, shard] += n
    assert got == placed


def test_large_groups_have_shards_of_their_own():
    classes = [(1000, 1), (400, 2), (3, 100), (1, 60)]
    total = Counter()
    for (size, n), runs in zip(classes, sharding.assign(classes, 8), strict=True):
        assert sum(k for _, k in runs) == n
        for shard, k in runs:
            total[shard] += k * size
    assert sorted(total.values()) == [72, 72, 72, 72, 72, 400, 400, 1000]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
%s<div class="comments"><p>Reader says a lot of things here that are long enough to look like text, really long ones.</p></div><footer>&copy; all</footer></body></html>"""


def test_html_with_and_without_article():
    text = "<h1>Head &amp; line</h1><p>First   para\n<b>bold</b>graph &lt;x&gt;.<p>Second one.<div class='ad'>Buy!</div><p>Short."
    want = "Head & line First para boldgraph <x>. Second one. Short."
    assert html.main_text(PAGE % f"<article>{text}</article>") == want
    long = "<p>" + "Words that carry on. " * 12
    assert html.main_text(PAGE % f"<div id=content>{long}<p>Tiny.{long}</div><form>search</form><div class=cookie-notice>We use cookies</div>") == " ".join([("Words that carry on. " * 12).strip(), "Tiny.", ("Words that carry on. " * 12).strip()])


LINKS = "<ul>%s</ul>" % "".join(f"<li><a href=/{k}>Another headline of this site, number {k}</a>" for k in range(5))
PARAGRAPH, SMALLER = "Words that carry on. " * 12, "A smaller part of the same text, still part of it, and long enough to be told as one. "


@pytest.mark.parametrize("around", ["<div>%s</div>", "<article>%s</article>", "<main>%s</main>"])
def test_html_keeps_all_parts_of_an_article_without_its_link_lists(around):
    page = PAGE % (around % f"<h1>Title</h1><p>By me<p>{SMALLER}{LINKS}<h2>More</h2><p>{PARAGRAPH}{LINKS}<p>{SMALLER}<p>End.")
    assert html.main_text(page) == " ".join(f"Title By me {SMALLER} More {PARAGRAPH} {SMALLER} End.".split())


def test_html_main_around_the_whole_page():
    page = f"<body><main>{LINKS}<h1>Title</h1><p>Short<p>one<p>{PARAGRAPH}{LINKS}</main></body>"
    assert html.main_text(page) == " ".join(f"Title Short one {PARAGRAPH}".split())


@pytest.mark.parametrize("around", ["<div>%s</div>", "<article>%s</article>"])
def test_html_opening_lines_and_linked_title(around):
    opening = "<h1><a href=/>Linked title</a></h1><p>By me<p>May<p>One<p>Two<p>Three"
    assert html.main_text(PAGE % (around % f"{opening}<p>{PARAGRAPH}")) == " ".join(f"Linked title By me May One Two Three {PARAGRAPH}".split())


def test_html_on_hard_tables(spark):
    pages = spark.createDataFrame([(1, "u", h, "mine") for h in [None, "", "plain text", "<p", "<script>x", "<!-- a", "<a href='x>y", "<p>" * 3000 + "deep", "&#0;&bogus;&amp"]], "page_id long, url string, html string, text string")
    out, name = html.extract(pages)
    assert name == "_text" and out.count() == 9 and all(r[name] is not None for r in out.collect())
    assert html.extract(pages.limit(0))[0].count() == 0


class Second(HTMLParser):
    """Another reader of pages: the library's parser, and states worked out anew from all open elements at each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.raw, self.pieces, self.blocks, self.articles = [], None, [], [], 0

    def state(self):
        dropped, article, link = False, 0, False
        for tag, own, number in self.open:
            marks = html._HAS.sub(" ", f"{own.get('class') or ''} {own.get('id') or ''}")
            if number is not None:
                inside = any(t in html._DROP for t, *_ in self.open[: [x[0] for x in self.open].index(tag)])
                dropped = inside or html._REMARKS.search(marks) is not None or (dropped and article > 0)
                article = article or (0 if dropped else number)
            elif tag not in ("html", "body"):
                quiet = tag in html._DROP or (own.get("role") or "").lower() in html._ROLES or tag == "header" and not article or "hidden" in own
                dropped = dropped or quiet or (own.get("aria-hidden") or "") == "true" or "display:none" in (own.get("style") or "").replace(" ", "") or html._BOILER.search(marks) is not None
            link = link or tag == "a"
        return dropped, article, link

    def flush(self):
        text = " ".join("".join(t for t, _ in self.pieces).split())
        if text:
            dropped, article, _ = self.state()
            linked = sum(len(t.strip()) for t, link in self.pieces if link)
            self.blocks.append(html.Line(text, min(linked, len(text)), dropped, article, any(t in html._HEADINGS for t, *_ in self.open[-4:])))
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if self.raw:
            return
        if tag not in html._INLINE:
            self.flush()
        if tag in html._RAW:
            self.raw = tag
        elif tag not in html._VOID:
            own = dict(attrs)
            number = None
            if tag in ("article", "main") or own.get("role") == "main" or html._BODY.search(own.get("itemprop") or ""):
                self.articles += 1
                number = self.articles
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.open and self.open[-1][0] == tag:
                self.open.pop()
            self.open.append((tag, own, number))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
            return
        if tag not in html._INLINE:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.raw:
            self.pieces.append((data, self.state()[2]))


def second_text(page):
    reader = Second()
    reader.feed(page)
    reader.close()
    reader.flush()
    own = [x for x in reader.blocks if not x.dropped]
    for found in ([x for x in own if x.article], own):
        weight = [(len(x.text) - x.linked) * (html.ARTICLE if x.article else 1) for x in found]
        near = [sum(weight[k : k + html.WINDOW]) for k in range(len(found))]
        inside, k = set(), 0
        while k < len(found):
            if near[k] >= html.SURGE and weight[k]:
                end = next((j for j in range(k, len(found)) if near[j] <= html.DIVE), len(found))
                start = k
                while start - 1 >= 0 and start - 1 not in inside and (weight[start - 1] or found[start - 1].heading) and not any(j in inside for j in range(start - 1, k)):
                    start -= 1
                inside |= set(range(start, end))
                k = end
            else:
                k += 1
        kept = [found[j] for j in sorted(inside)] or [x for x in found if len(x.text) > x.linked]
        if kept:
            return " ".join(x.text for x in kept)
    return ""


def test_html_equals_a_second_version_on_all_pages(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    out, name = html.extract(pages.select("page_id", "html"))
    got = {r.page_id: r[name] for r in out.collect()}
    assert got == {r.page_id: second_text(r.html) for r in pages.collect()} and sum(map(bool, got.values())) > 200
    bare = [r.html.replace("<article", "<div").replace("</article", "</div") for r in pages.limit(60).collect()]
    assert [html.main_text(x) for x in bare] == [second_text(x) for x in bare]


@pytest.mark.parametrize("piece", ["<a", "<!", "<!--", "<a x=\"", "<a x='", "<", "</", "<b>", "</b>", "<p>", "<div>", "<article>", "<a href=x>y", "<script>", "&", "<![CDATA[", "<a b = ", "<svg>", "<li>x", "<x y='>\">"])
def test_html_of_a_megabyte_of_one_piece(piece):
    page = "<p>Some words before.</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 15
