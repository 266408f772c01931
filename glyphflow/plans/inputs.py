"""Recognition inputs derived from the driver's tables, in Spark and as DuckDB SQL: the tables hold no images.

Every derivation covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = [*"abcdefghijklmnopqrstuvwxyz0123456789"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text region per word of every conversation turn: id and probability of every character.

    Ids run to 39, so some lie outside a dictionary of 37.
    """
    return _word_steps(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def doc_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every word of every document."""
    return _word_steps(table(spark, sf_dir, "documents"), "doc_id")


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document, without steps: doc_id, word_no, word."""
    return _words(table(spark, sf_dir, "documents"), "doc_id")


def _words(rows: DataFrame, *key: str) -> DataFrame:
    return rows.select(*key, F.posexplode(F.split("text", " ")).alias("word_no", "word")).where("word <> ''")


def with_steps(words: DataFrame) -> DataFrame:
    """``words`` with the steps of each row's word: ids and probs."""
    codes = words.withColumn("codes", F.transform(F.split("word", ""), F.ascii))
    ids = F.transform("codes", lambda c: (c % 40).cast("int"))
    probs = F.transform("codes", lambda c, i: ((c * 31 + i * 17) % 100 + 1) / F.lit(101.0))
    return codes.select(*words.columns, ids.alias("ids"), probs.alias("probs"))


def _word_steps(rows: DataFrame, *key: str) -> DataFrame:
    return with_steps(_words(rows, *key))


STEPS_SQL = """
words AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_no FROM conversations),
codes AS (SELECT *, list_transform(range(1, length(word) + 1), lambda i: unicode(substr(word, i, 1))) AS codes FROM words WHERE word <> ''),
steps AS (
  SELECT conv_id, turn, word_no::INT AS word_no, word, list_transform(codes, lambda c: c % 40) AS ids,
         list_transform(range(1, len(codes) + 1), lambda i: ((codes[i] * 31 + (i - 1) * 17) % 100 + 1) / 101.0::DOUBLE) AS probs
  FROM codes)
"""
DOC_STEPS_SQL = STEPS_SQL.replace("conv_id, turn", "doc_id").replace("FROM conversations", "FROM documents")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slightly sheared box per order: image_id is the customer, score in [0, 1)."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("poly_id"), F.col("o_custkey").alias("image_id"), (100 + k * 37 % 900).cast("int").alias("cx"), (100 + k * 53 % 700).cast("int").alias("cy"),
        (5 + k % 60).cast("int").alias("hw"), (k % 25).cast("int").alias("hh"), (k % 7 - 3).cast("int").alias("s"), (k * 7919 % 1000 / F.lit(1000.0)).alias("score"),
    )
    cx, cy, hw, hh, s = (F.col(c) for c in ("cx", "cy", "hw", "hh", "s"))
    corners = {"x1": cx - hw + s, "y1": cy + hh, "x2": cx - hw, "y2": cy - hh + s, "x3": cx + hw, "y3": cy - hh, "x4": cx + hw + s, "y4": cy + hh}
    return o.withColumns(corners)


POLYGONS_SQL = """
boxes AS (
  SELECT o_orderkey AS poly_id, o_custkey AS image_id, 100 + o_orderkey * 37 % 900 AS cx, 100 + o_orderkey * 53 % 700 AS cy,
         5 + o_orderkey % 60 AS hw, o_orderkey % 25 AS hh, o_orderkey % 7 - 3 AS s, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS score FROM orders),
polys AS (
  SELECT poly_id, image_id, hw, hh, score, (cx - hw + s)::INT AS x1, (cy + hh)::INT AS y1, (cx - hw)::INT AS x2, (cy - hh + s)::INT AS y2,
         (cx + hw)::INT AS x3, (cy - hh)::INT AS y3, (cx + hw + s)::INT AS x4, (cy + hh)::INT AS y4 FROM boxes)
"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 map per embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("p"))


def map_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's box, brought down to the size of a map and laid on the map of its number: image_id, poly_id, pts."""
    maps = table(spark, sf_dir, "embeddings").select("vec_id")
    point = lambda i: F.struct((F.col(f"x{i}") * F.lit(0.02) - 6).cast("int").alias("x"), (F.col(f"y{i}") * F.lit(0.03) - 8).cast("int").alias("y"))
    boxes = polygons(spark, sf_dir).select("poly_id", F.array(*map(point, range(1, 5))).alias("pts"))
    return boxes.join(maps.withColumnRenamed("vec_id", "image_id"), F.col("poly_id") % 1000 == F.col("image_id")).select("image_id", "poly_id", "pts")


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel per line item."""
    li = table(spark, sf_dir, "lineitem")
    channel = lambda a, b: ((F.col(a) * 3 + F.col(b) * 11) % 256).cast("int")
    return li.select("l_orderkey", "l_linenumber", channel("l_orderkey", "l_linenumber").alias("b"), channel("l_partkey", "l_linenumber").alias("g"), channel("l_suppkey", "l_linenumber").alias("r"))


COLOURS_SQL = """
pixels AS (
  SELECT l_orderkey, l_linenumber, ((l_orderkey * 3 + l_linenumber * 11) % 256)::INT AS b, ((l_partkey * 3 + l_linenumber * 11) % 256)::INT AS g,
         ((l_suppkey * 3 + l_linenumber * 11) % 256)::INT AS r FROM lineitem)
"""
