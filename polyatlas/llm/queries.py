"""The registered queries of this package and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hpylm, langid, linedup, packing, pieces, quality, simhash, substring, urlgraph
from .store import table


def _remainder(by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(by))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _remainder(4) == 2)
    return langid.identify(docs, langid.fit(docs.where("not held_out")), "doc_id", "held_out")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, whether they decode to it again."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document had and lost, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long")).withColumn("before", F.col("text"))
    kept = linedup.line_dedup(docs)
    left = F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("before") != "")), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return kept.select("doc_id", "n_lines", (F.col("n_lines") - left).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlgraph.judge_pages(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _remainder(7) == 2)
    model, vocabulary = hpylm.fit(docs.where("not held_out"))
    return hpylm.score(docs, model, vocabulary, "doc_id", "held_out")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(ann.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words every document had and lost, and the digest of what is left."""
    cut = substring.repeated_windows_removed(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 packed of every document: tokens and pieces."""
    return op4_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("size").alias("n_tokens"), F.count("*").alias("n_pieces"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5 alone, which SQL can express."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op7 alone, and the verdicts that rules decide."""
    return op7_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of op8 alone, which SQL can express."""
    return op8_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_sentencepiece, op4_best_fit_packing, op5_quality_rules, op6_line_dedup, op7_url_filters, op8_lm_scoring, op9_nearest_neighbours, op10_substring_dedup, pipeline, packed_sizes, quality_base, url_rules, language_model_base)}

_WORD = r"[^\x20\x09-\x0D]+"
_CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda crc, b: xor(crc_table[(xor(crc, b) & 255) + 1], crc >> 8))"""

ORACLES = {
    "packed_sizes": rf"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) + 1 AS BIGINT) AS n_tokens,
CAST((len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) + 2048) // 2048 AS BIGINT) AS n_pieces FROM documents""",
    "quality_base": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
t AS (SELECT doc_id, i, word || chr(32) || lead(word, 1) OVER (PARTITION BY doc_id ORDER BY i) || chr(32) || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM t WHERE s IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY 1),
all_ AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM all_""",
    "url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '', 'org/'), ('block', 'example.org', 'es/', 'example.org/es/'), ('block', 'example.org', 'en/1', 'example.org/en/1'), ('allow', 'com', 'fr/', 'com/fr/'), ('block', 'com', 'de/', 'com/de/')) t(verdict, name, prefix, rule)),
f AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(name) DESC) AS nth FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, '/' || prefix))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, verdict AS ruled FROM h LEFT JOIN (SELECT * FROM f WHERE nth = 1) USING (page_id)""",
    "language_model_base": rf"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
d AS (SELECT doc_id, xor({_CRC32}, 4294967295) % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), chr(10)) AS ws FROM documents, k),
t AS (SELECT doc_id, held_out, unnest(ws) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1.0::DOUBLE) / (n + v + 1))), 4) AS base_score
FROM t LEFT JOIN c USING (word), s GROUP BY doc_id, held_out""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, source, unnest(s) AS line, unnest(range(0, len(s))) AS pos
  FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS k FROM l),
spread AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT t.*, CASE WHEN s.k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY t.k ORDER BY doc_id, pos) END AS nth
  FROM t LEFT JOIN spread s ON t.k = s.k),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (nth = 1), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM d),
win AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s FROM w),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win WHERE i + 34 <= n) WHERE c > 1),
cov AS (
  SELECT w.doc_id, w.i, w.word,
         max(CASE WHEN dup.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id AND w.i = dup.i),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS text
  FROM cov GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
