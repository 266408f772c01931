"""The training-data queries: one per operator, applied to its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, hard_negatives, html_text, license_scans, pieces, quality, simhash, token_counts, token_files, toxicity, url_filter
from .common import table

URL_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the number of folds; 0 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by compression distance, learned from four folds of five."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.scores(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by Bradley-Terry ranking, learned from three folds of four."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold("doc_id", 4) != 2))
    return quality.scores(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four differing bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best pieces and the scores of its five best segmentations, decoded again."""
    import public_tokenizers

    return pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=5)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as shard files in doc_id order and read back from them."""
    import public_tokenizers

    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the block and allow lists through Bloom filter cascades."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP7_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
  FROM parts)
SELECT page_id, host, path, rule, coalesce((SELECT any_value(verdict) FROM rules WHERE h || p = rule), 'allow') AS verdict
FROM judged
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, word for word or with substitutions."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "doc_start", "n_equal", "n_words")


#: Brute force over every diagonal on which document and item share words, without seeds.
OP8_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, hash(text) AS text_hash, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM b),
dw AS (SELECT doc_id, text_hash, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
met AS (
  SELECT dw.doc_id, dw.text_hash, bw.item_id, bw.n, dw.pos - bw.pos AS doc_start, count(*) AS n_equal, list(bw.pos) AS places
  FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= 0.8 * least(bw.n, 13)),
good AS (
  SELECT doc_id, text_hash, item_id, n, doc_start, n_equal FROM met
  WHERE list_max(list_transform(range(0, n - least(n, 13) + 1), lambda s: len(list_filter(places, lambda p: p >= s AND p < s + least(n, 13))))) >= 0.8 * least(n, 13))
SELECT doc_id, item_id, doc_start, n_equal::INT AS n_equal, n::INT AS n_words FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text_hash, item_id ORDER BY n_equal DESC, doc_start) AS rn FROM good) WHERE rn = 1
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text by the recurrent block labeller."""
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, a crossing token going to the line that holds its first character."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="start")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license notices, word for word and with edits."""
    return license_scans.summary(license_scans.scan(table(spark, sf_dir, "documents")))


_NOTICES = ", ".join(f"({k}, '{n.label}', '{n.text}', {n.edits}, '{n.head}', {n.base}, {len(n.text.split())})" for k, n in enumerate(license_scans.NOTICES))
#: Brute force over every word span of fitting length, without seeds: its edit distance from each notice.
OP11_SQL = rf"""
WITH notices(notice, label, t, k, head, base, m) AS (VALUES {_NOTICES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
places AS (SELECT r, pos, word, sum(strlen(word) + 1) OVER (PARTITION BY r ORDER BY pos) AS close FROM w),
spans AS (
  SELECT a.r, a.pos, a.n, notice FROM (
    SELECT r, pos, close, word, notice, t, k, unnest(range(greatest(m - k, 1), m + k + 1)) AS n FROM places JOIN notices ON head = '' OR head = word || ' ') a
  JOIN places z ON z.r = a.r AND z.pos = a.pos + a.n - 1
  WHERE abs(z.close - a.close + strlen(a.word) - strlen(t)) <= k),
fit AS (SELECT r, pos, notice, list_aggregate(d.w[pos + 1 : pos + n], 'string_agg', ' ') AS span FROM spans JOIN d USING (r)),
hits AS (SELECT * FROM (SELECT fit.r, fit.pos, notices.*, levenshtein(span, t) AS edits FROM fit JOIN notices USING (notice)) WHERE edits <= k),
found AS (
  SELECT r, count(*) FILTER (base AND edits = 0) AS n_base, min(pos) FILTER (base AND edits = 0) AS first_word, max(pos) FILTER (base AND edits = 0) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND edits = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(1.0::DOUBLE - edits / strlen(t)::DOUBLE) AS score
  FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from the other sources of its language, and the terms that set it off."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
met AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT d.lang, d.source, coalesce(any_value(m.n), 0)::BIGINT AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM met GROUP BY ALL) m USING (lang, source) GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(m.n, 0) AS n, 1 + (1000000000 * (coalesce(m.n, 0) + 2)) // (t.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM totals t JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN met m USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM totals a JOIN totals b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose vec_id is divisible by 100, the labels of every seventh moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
met AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score FROM positive JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank, negative_id, positive_score, negative_score
FROM met QUALIFY rank <= 5
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_ann, op4_quality, op5_pieces, op6_token_files, op7_url_filter, op8_decontaminate, op9_html_text, op10_token_counts, op11_license_scans, op12_divergence, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op8_decontaminate": OP8_SQL, "op11_license_scans": OP11_SQL, "op12_divergence": OP12_SQL, "op13_hard_negatives": OP13_SQL}
