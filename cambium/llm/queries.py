"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import chat, html, huffman, jaccard, packing, quality, rules, sharding, warc, winnow
from cambium.llm.common import Scratch, read


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one (-7) whose texts hold control strings."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(1).select(F.explode(F.array(F.lit("user"), F.lit("assistant"))).alias("role"))
    hard = hard.select(F.lit(-7).cast("long").alias("conv_id"), F.when(F.col("role") == "user", 0).otherwise(1).cast("long").alias("turn"), "role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.conversations_of_trees(spark, chat.chains(rows.unionByName(hard)))
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss"))
    made = made.withColumn("turns", turns).withColumn("loss_text", loss)
    return made.select(
        F.expr("try_cast(tree AS bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    x = f"regexp_replace({x}, '&(amp|lt|lb|nl);', '&amp;\\1;', 'g')"
    x = f"regexp_replace({x}, '<(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|/?s>|<SYS>>|</SYS>>)', '&lt;\\1', 'g')"
    return f"regexp_replace({x}, '\\[(/?INST\\])', '&lb;\\1', 'g')"


OP1_SQL = f"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality.score(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), ["doc_id"])
    return out


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, with what an audit finds against a replica: every 101st page from 7 on has a byte more, every
    211th from 5 on is cut to its first half, every 307th from 11 on is gone."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    other = pages.where("page_id % 307 != 11").withColumn("html", F.expr("CASE WHEN page_id % 211 = 5 THEN substring(html, 1, length(html) div 2) WHEN page_id % 101 = 7 THEN concat(html, '!') ELSE html END"))
    left, right = warc.archive(pages), warc.archive(other)
    found = warc.audit(spark, left, right)
    rows = left.join(found, ["id", "nth"], "left")
    return rows.select(F.col("id").alias("page_id"), F.col("file").cast("long").alias("file"), F.col("at").alias("byte_offset"), F.col("size").alias("n_bytes"), F.col("digest").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"))


def _sql_archive(source: str) -> str:
    return f"""
  SELECT page_id, page_id // 1024 AS file, sum(strlen(rec)) OVER (PARTITION BY page_id // 1024 ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(rec) AS byte_offset, strlen(rec) AS n_bytes, sha256(rec) AS sha256
  FROM (SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM {source})"""


OP3_SQL = f"""
WITH a AS ({_sql_archive("pages")}),
p AS (SELECT page_id, url, CASE WHEN page_id % 211 = 5 THEN substring(html, 1, length(html) // 2) WHEN page_id % 101 = 7 THEN html || '!' ELSE html END AS html FROM pages WHERE page_id % 307 != 11),
b AS ({_sql_archive("p")})
SELECT a.page_id, CAST(a.file AS BIGINT) AS file, CAST(a.byte_offset AS BIGINT) AS byte_offset, CAST(a.n_bytes AS BIGINT) AS n_bytes, a.sha256,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.byte_offset = b.byte_offset AND a.sha256 = b.sha256 THEN 'ok' WHEN a.byte_offset = b.byte_offset THEN 'damaged' WHEN a.sha256 = b.sha256 THEN 'moved' ELSE 'changed' END AS status
FROM a LEFT JOIN b ON a.page_id = b.page_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = rules.judge(spark, read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", *[names[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (n_words, spans, items) = winnow.overlaps(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id", n_words, winnow.n_hit(spans).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), winnow.contaminated(n_words, spans).alias("contaminated"),
    )


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "corpus").root
    huffman.write_corpus(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), folder)
    back = huffman.read_corpus(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_quality_classifier, op3_warc_fixity, op4_quality_rules, op5_ngram_jaccard_join, op6_html_extraction, op7_packing, op8_sharding, op9_benchmark_decontamination, op10_token_binary)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(s.doc_id, min(r.c)) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, g
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

ORACLES = {"op1_chat_formatting": OP1_SQL, "op3_warc_fixity": OP3_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op9_benchmark_decontamination": OP9_SQL}
