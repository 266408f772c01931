"""Queries on cleaning, splitting and byte-pair encoding."""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.decode import ascii_lower
from ..operators import bpe
from .inputs import table

@lru_cache(1)
def merges() -> list[tuple[str, str]]:
    """The merge pairs of a public vocabulary, in rank order."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in json.load(f)["model"]["merges"]]


def _first_ranks() -> list[tuple[str, str, int]]:
    """Pairs of the merge list that a word begins with: two ASCII characters, the second with the word's end on it or not."""
    plain = lambda x: len(x) == 1 and x.isascii()
    return [(a, b, k) for k, (a, b) in enumerate(merges()) if plain(a) and plain(b.removesuffix(bpe.END))]


def q_html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.basic_clean(F.col("html"))).alias("digest"), F.length(t.basic_clean(F.col("html"))).alias("n"))


def q_whitespace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.whitespace_clean(F.col("text"))).alias("digest"))


def q_regex_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.token_words(ascii_lower(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, " ")).alias("digest"))


def q_charset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.keep_charset(F.col("text"), "a-zA-Z0-9 ").alias("text"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct adjacent symbols of every word of every document, with their number of words."""
    words = table(spark, sf_dir, "documents").select(F.explode(t.token_words(ascii_lower(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    chars = F.split("word", "")
    both = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.concat(F.get(chars, i - 1), F.get(chars, i))))
    return words.where(F.length("word") > 1).select("n", F.explode(both).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))


def q_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def q_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest-ranked pair of the symbols of each different word of the documents, by a public merge list."""
    words = table(spark, sf_dir, "documents").select(F.explode(t.token_words(ascii_lower(F.col("text")))).alias("word")).distinct().where(F.length("word") > 1)
    chars = F.split("word", "")
    last = F.size(chars) - 1
    pair = lambda i: F.concat(F.get(chars, i - 1), F.lit(" "), F.get(chars, i), F.when(i == last, F.lit(bpe.END)).otherwise(F.lit("")))
    pairs = words.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), last), pair))).alias("pair"))
    ranks = F.broadcast(spark.createDataFrame([(f"{a} {b}", k) for a, b, k in _first_ranks()], "pair string, rank int"))  # 2 * 128 * 128 at most
    return pairs.join(ranks, "pair", "left").groupBy("word").agg(F.min("rank").alias("rank"))


def q_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by a public merge list: how many, and a digest of them."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], "text", merges())
    return ids.select("doc_id", F.size("ids").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


_PATTERN = t.TOKEN_PATTERN.replace("'", "''")
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_unescape(x: str) -> str:
    for entity, plain in t.ENTITIES:
        x = f"replace({x}, '{entity}', '{plain.replace(chr(39), chr(39) * 2)}')"
    return x


_CLEAN = f"regexp_replace(regexp_replace({_sql_unescape(_sql_unescape('html'))}, '^[ \\t\\n\\r]+', ''), '[ \\t\\n\\r]+$', '')"
QUERIES = [q_html_unescape, q_whitespace_clean, q_regex_tokens, q_charset_filter, q_adjacent_pairs, q_best_pair, q_bpe_encode]
SQL = {
    "q_html_unescape": f"SELECT page_id, md5({_CLEAN}) AS digest, length({_CLEAN})::INT AS n FROM pages",
    "q_whitespace_clean": r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
    "q_regex_tokens": f"WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM documents) SELECT doc_id, len(w)::INT AS n_words, md5(array_to_string(w, ' ')) AS digest FROM w",
    "q_charset_filter": "SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS text FROM conversations",
    "q_adjacent_pairs": f"""WITH w AS (SELECT unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
p AS (SELECT n, unnest(list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2)))) AS pair FROM c WHERE length(word) > 1) SELECT pair, sum(n)::BIGINT AS n FROM p GROUP BY pair""",
}


def _best_pair_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    ranks = ", ".join(f"('{quoted(a)} {quoted(b)}', {k})" for a, b, k in _first_ranks())
    return f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all({_LOWER}, '{_PATTERN}')) AS word FROM documents),
r(pair, rank) AS (VALUES {ranks}),
p AS (SELECT word, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 1) || ' ' || substr(word, i + 1, 1) || CASE WHEN i = length(word) - 1 THEN '{bpe.END}' ELSE '' END)) AS pair FROM w WHERE length(word) > 1)
SELECT word, min(rank)::INT AS rank FROM p LEFT JOIN r USING (pair) GROUP BY word"""


try:
    SQL["q_best_pair"] = _best_pair_sql()
except ImportError:  # a machine without the public vocabulary files: its two queries can't run either
    pass
