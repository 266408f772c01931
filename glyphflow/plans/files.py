"""Queries through files: symbol and merge lists, results as JSON, streams with watermarks, frame numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..functions.text import split_ints
from ..operators import bpe, results
from ..sources import files
from ..streaming import frames as s
from . import decoding, streams, tokens
from .inputs import POLYGONS_SQL, SYMBOLS, polygons, steps, table


def _written(spark: SparkSession, lines: list[str]) -> str:
    """A folder with one file of these lines."""
    folder = f"{s.scratch(spark)}/lines"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    return folder


def q_dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTC decoding by a dictionary that was read from a file of symbols."""
    symbols = files.dictionary(spark, _written(spark, SYMBOLS), "ctc")
    text, conf = decode.ctc(F.col("ids"), F.col("probs"), symbols)
    return steps(spark, sf_dir).select("conv_id", "turn", "word_no", text.alias("text"), F.round(conf, 9).alias("conf"))


def q_bpe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items encoded by a merge file of a public vocabulary; a test compares them with the tokenizer itself."""
    pairs = [" ".join(m) for m in tokens.merges()]
    merges = files.merges(spark, _written(spark, ["#version", *pairs]))
    return bpe.encode(table(spark, sf_dir, "benchmark"), ["item_id"], "text", merges)


def q_json_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every image's JSON list."""
    texts = polygons(spark, sf_dir).withColumn("poly_idx", F.col("poly_id")).withColumn("text", F.concat(F.lit("t"), F.col("poly_id"))).withColumn("conf", F.round("score", 3))
    read = files.read_json_results(results.json_results(texts))
    return read.select("image_id", "at", "text", "text_conf", F.array_join(F.col("poly").cast("array<string>"), " ").alias("poly"))


def q_split_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers out of a list with a mark behind its last."""
    k = F.col("o_orderkey")
    given = F.concat_ws(",", (k % 7).cast("string"), F.lit(""), F.concat(F.lit(" "), (k % 11).cast("string")), F.lit("x"), F.lit(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(split_ints(given).cast("array<string>"), " ", "null").alias("parts"))


def q_frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a frame of its user's stream, numbered from 0."""
    return s.numbered(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("stream_id"), "ts"))


def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the event stream with an hour's watermark: the windows that it has closed."""
    folder = s.scratch(spark)
    s.run_available(s.windowed_counts(streams.event_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/state")
    return spark.read.schema("stream_id long, start timestamp_ntz, n_frames long, value double").parquet(f"{folder}/out")


QUERIES = [q_dictionary_file, q_bpe_file, q_json_read, q_split_ints, q_frame_numbers, q_stream_windows]
SQL = {
    "q_dictionary_file": decoding.SQL["q_ctc_decode"],
    "q_json_read": f"""WITH {POLYGONS_SQL} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY poly_id) - 1)::INT AS "at", 't' || poly_id AS text, round(score, 3) AS text_conf,
concat_ws(' ', x1, y1, x2, y2, x3, y3, x4, y4) AS poly FROM polys""",
    "q_split_ints": "SELECT o_orderkey, (o_orderkey % 7) || ' null ' || (o_orderkey % 11) || ' null' AS parts FROM orders",
    "q_frame_numbers": "SELECT event_id, user_id AS stream_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_num FROM events",
    "q_stream_windows": """WITH e AS (SELECT user_id AS stream_id, date_trunc('hour', ts) AS start, value FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT stream_id, start, count(*) AS n_frames, round(sum(value), 4) AS value FROM e GROUP BY ALL""",
}
