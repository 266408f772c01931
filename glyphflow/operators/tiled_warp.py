"""Crops of regions from images that lie in tiles: no image is ever one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places beyond this are outside of any image.
FAR = 1e9


def crops(regions: DataFrame, tiles: DataFrame, key: list[str], height: int, width: int, tile_height: int, tile_width: int) -> DataFrame:
    """``key`` and ``crop`` (array of height * width values) of every region (``key`` with image_id, m: the nine coefficients from crop to image places).

    ``tiles`` (image_id, top, left, h, w, p) lie side by side at multiples of the tile size. Every pixel of a crop asks for the four pixels around
    its place, by image and tile; what comes back is weighted and summed up. Bilinear; 0 outside the image, where
    there is no tile, and at infinity. Regions without coefficients have no row; repeated keys are summed up, so keys are unique.
    """
    m = lambda i: F.get("m", F.lit(i))
    pixels = regions.where(F.get("m", F.lit(8)).isNotNull()).select(*key, "m", F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("k"))
    u, v = (F.col("k") % width).cast("double"), F.floor(F.col("k") / width).cast("double")
    z = F.nullif(m(6) * u + m(7) * v + m(8), F.lit(0.0))
    near = lambda c: F.when(F.abs(c) < FAR, c)
    placed = pixels.select(*key, "k", near((m(0) * u + m(1) * v + m(2)) / z).alias("x"), near((m(3) * u + m(4) * v + m(5)) / z).alias("y"))
    whole = placed.withColumns({"x0": F.col("x").cast("int"), "y0": F.col("y").cast("int")}).withColumns({"fx": F.abs(F.col("x") - F.col("x0")), "fy": F.abs(F.col("y") - F.col("y0"))})
    part = lambda f, d: F.col(f) if d else 1 - F.col(f)
    around = [F.struct((F.col("y0") + dy).alias("yy"), (F.col("x0") + dx).alias("xx"), (part("fy", dy) * part("fx", dx)).alias("weight")) for dy in (0, 1) for dx in (0, 1)]
    asked = whole.select(*key, "k", F.explode(F.array(*around)).alias("q")).select(*key, "k", "q.*")
    start = lambda c, n: (F.floor(F.col(c) / n) * n).cast("int")
    asked = asked.withColumns({"top": start("yy", tile_height), "left": start("xx", tile_width)})
    row, col = F.col("yy") - F.col("top"), F.col("xx") - F.col("left")
    held = asked.join(tiles.select("image_id", "top", "left", "h", "w", "p"), ["image_id", "top", "left"], "left")
    value: Column = F.when((row < F.col("h")) & (col < F.col("w")), F.get("p", row * F.col("w") + col).cast("double"))
    summed = held.groupBy(*key, "k").agg(F.sum(F.coalesce(F.col("weight") * value, F.lit(0.0))).alias("v"))
    return summed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("all")).select(*key, F.col("all.v").alias("crop"))
