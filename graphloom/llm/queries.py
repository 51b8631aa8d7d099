"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, licenses, neardup, packing, pieces, pii, quality, toxicity, urlrules, warc


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.ledger(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), (quality.passes("base") & quality.passes("v1")).alias("kept"), "failed",
    )


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN dup ON dup.r = w.r),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of every document for each document whose id is divisible by 50, its whole text as the query."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 50 = 0"), 10).withColumn("score", F.round("score", 4))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = toxicity.scored(docs.select("doc_id", "text"), toxicity.learn(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return made.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in each document, in order, with the best coverage."""
    made = licenses.scan(table(spark, sf_dir, "documents"))
    spelled = F.concat_ws(",", F.transform("licenses", lambda x: F.concat_ws(":", x.license, x.start.cast("string"), x.end.cast("string"))))
    return made.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.coalesce(F.round(F.array_max(F.transform("licenses", lambda x: x.coverage)), 6), F.lit(0.0)).alias("coverage"), spelled.alias("licenses"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.mine(pages, urlrules.by_document(pages, table(spark, sf_dir, "labels"))))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=2, similarity="0.8")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.x = d.doc_id
"""


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    spell = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    base = F.filter("found", lambda x: x.base)
    count = lambda kind: F.size(F.filter("found", lambda x: x.base & (x.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT h, max(page_id) AS latest FROM p GROUP BY h),
x AS (SELECT p.*, m.latest, list_transform(range(40), lambda i: instr('0123456789abcdef', p.h[i + 1]) - 1) AS d FROM p JOIN m ON m.h = p.h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((d[(5 * i) // 4 + 1] * 16 + coalesce(d[(5 * i) // 4 + 2], 0)) >> (3 - (5 * i) % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality, op3_search, op4_toxicity, op5_licenses, op6_urls, op7_neardup, op8_pii, op9_pieces, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op7_neardup": OP7_SQL, "op10_warc": OP10_SQL}
