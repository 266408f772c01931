"""Assembly of recognised texts into per-image results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved

POLY = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]


def counts(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of every image, 0 for images without any; one partial aggregation and one join on image_id.

    A row of ``images`` gives a row, repeated ones too; a null image_id has no texts.
    """
    found = texts.groupBy("image_id").agg(F.count("*").alias("text_count"))
    return images.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce("text_count", F.lit(0)).alias("text_count"))


def json_results(texts: DataFrame) -> DataFrame:
    """One JSON list of {text, text_conf, poly} per image, in polygon order (nulls first); images without texts have no row.

    A null text or confidence is left out of its entry; texts of a null image_id are one list. A list is as long as
    its image has texts.
    """
    entry = F.struct("poly_idx", F.struct("text", F.col("conf").alias("text_conf"), F.array(*POLY).alias("poly")).alias("entry"))
    grouped = texts.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return grouped.select("image_id", F.to_json(F.col("all.entry")).alias("json"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_n``, their place from 0 in the order of the columns ``order``: nulls first, equal ones in an order of their own.

    Rows are dealt out by sampled bounds of their order and sorted where they lie; what goes to the driver is one count a
    partition. Rows that are equal in ``order`` are told apart by a hash of all their columns, so a frequent value is dealt out too. The input
    is read twice, for the sample and for the rows; the result is a written table, so places don't change when a task runs again.
    """
    ways = [*(F.col(f"`{c}`") for c in order), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))]
    placed = rows.repartitionByRange(*ways).sortWithinPartitions(*ways).withColumn("_at", F.monotonically_increasing_id())
    held = saved(placed, "numbered")
    part = F.shiftright("_at", 33)
    before, bases = 0, []
    for r in sorted(held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        bases.append((r["part"], before))
        before += r["n"]
    start = F.broadcast(rows.sparkSession.createDataFrame(bases, "_part long, _base long"))  # a row a partition
    within = F.col("_at") - F.shiftleft(part, 33)
    return held.join(start, part == F.col("_part")).withColumn("_n", F.col("_base") + within).drop("_at", "_part", "_base")


def batches(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``batch`` and ``slot`` of rows in the order of some columns (see ``numbered``): full batches, then a ragged one."""
    return numbered(rows, *order).withColumn("batch", F.floor(F.col("_n") / size)).withColumn("slot", F.col("_n") % size).drop("_n")
