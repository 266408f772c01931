"""Image folders, symbol and merge files, and the text and JSON forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode
from ..operators.results import POLY

IMAGE_ENDINGS = ("jpg", "jpeg", "png")
#: Of a vocabulary's ids, those that no merge takes: bytes, bytes as word ends, two marks.
UNMERGED = 514
RESULT_SCHEMA = "array<struct<text: string, text_conf: double, poly: array<int>>>"


def image_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """path, length and content of the folder's own files with one of the endings, case-sensitive; content is read only where it is used."""
    glob = "*.{" + ",".join(endings) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "content")


def lines(spark: SparkSession, path: str) -> list[str]:
    """A small file's lines in order; a last empty one doesn't count. For symbol and merge lists, which fit the driver."""
    text = spark.read.text(path, wholetext=True).first()
    found = text[0].split("\n") if text else []
    found = [x.removesuffix("\r") for x in found]
    return found[:-1] if found and not found[-1] else found


def dictionary(spark: SparkSession, path: str, decoder: str) -> list[str]:
    """The dictionary of a decoder (ctc, attention or transformer) from a file of one symbol a line."""
    make = {"ctc": decode.ctc_dictionary, "attention": decode.attention_dictionary, "transformer": decode.transformer_dictionary}
    return make[decoder](lines(spark, path))


def merges(spark: SparkSession, path: str, vocabulary: int = 49_408) -> list[tuple[str, str]]:
    """Merge pairs in rank order from a file with a heading line, at most as many as the vocabulary has ids for.

    Lines without two parts count towards that number, but give no pair.
    """
    rows = (x.split() for x in lines(spark, path)[1 : 1 + max(vocabulary - UNMERGED, 0)])
    return [(r[0], r[1]) for r in rows if len(r) > 1]


def text_line() -> Column:
    """``text, [x1, ..., y4]`` of a result row."""
    return F.concat(F.col("text"), F.lit(", ["), F.array_join(F.array(*POLY).cast("array<string>"), ", "), F.lit("]"))


def write_text_lines(texts: DataFrame, folder: str) -> None:
    """A folder of text files for each image (``image_id=...``), a line for each of its texts in polygon order.

    Rows are dealt out and sorted by image, so an image's lines stand together; images without texts have no folder.
    """
    rows = texts.where(F.col("text").isNotNull()).select("image_id", "poly_idx", text_line().alias("value"))
    rows.repartition("image_id").sortWithinPartitions("image_id", "poly_idx").select("image_id", "value").write.partitionBy("image_id").text(folder)


def read_json_results(rows: DataFrame) -> DataFrame:
    """image_id, at, text, text_conf and poly of every entry of the JSON lists (image_id, json); bad JSON gives no rows."""
    entry = F.posexplode(F.from_json("json", RESULT_SCHEMA)).alias("at", "entry")
    return rows.select("image_id", entry).select("image_id", "at", "entry.text", "entry.text_conf", "entry.poly")
