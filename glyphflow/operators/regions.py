"""Regions of maps that are larger than a row: labelled in tiles, joined over tile borders, with their nesting and scores.

A region is foreground (above the threshold) connected by eight neighbours or background connected by four. Every contour
is the outer border of a foreground region or the border of a hole, a background region that doesn't reach the map's
edge; both lie in raster order of their first pixel. What a contour encloses is its region with all regions nested in it,
so scores are sums over the nesting tree, and no border has to be followed over tile edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Rounds, saved
from . import scores
from .components import connected_components

TILE = "image_id long, top int, left int, h int, w int, height int, width int, p array<double>"
RUNS = "image_id long, label long, on boolean, y int, x0 int, x1 int, total double, edge int"
#: Bits of ``edge``: the run lies in the tile's top line, in its bottom line, begins at its left edge, ends at its right edge.
UP, DOWN, LEFT, RIGHT = 1, 2, 4, 8
#: Far beyond any nesting: rounds grow with the logarithm of its depth.
MOST_ROUNDS = 60


def tiles_of(maps: DataFrame, height: int, width: int) -> DataFrame:
    """Maps (image_id, h, w, p) cut into tiles of ``height`` x ``width`` at most, side by side. Maps that are null or empty give none."""
    full = maps.where((F.col("h") > 0) & (F.col("w") > 0) & F.col("p").isNotNull()).select(F.col("image_id").cast("long"), F.col("h").alias("height"), F.col("w").alias("width"), "p")
    rows = full.withColumn("top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(height))))
    every = rows.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(width))))
    th, tw = F.least(F.lit(height), F.col("height") - F.col("top")), F.least(F.lit(width), F.col("width") - F.col("left"))
    own = F.flatten(F.transform(F.sequence(F.lit(0), th - 1), lambda y: F.slice("p", (F.col("top") + y) * F.col("width") + F.col("left") + 1, tw)))
    cut = every.withColumn("own", own.cast("array<double>"))
    return cut.select("image_id", "top", "left", th.alias("h"), tw.alias("w"), "height", "width", F.col("own").alias("p"))


def label_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1, first) of every run of equal pixels of a mask, in raster order; ``first`` is the number of its region's first run."""
    h, w = on.shape
    starts = np.ones((h, w), bool)
    starts[:, 1:] = on[:, 1:] != on[:, :-1]
    y, x0 = np.nonzero(starts)
    x1 = np.append(x0[1:], 0) - 1
    x1[np.append(y[1:] != y[:-1], True)] = w - 1
    run = (np.cumsum(starts) - 1).reshape(h, w)
    pairs = [np.stack([run[:-1][same], run[1:][same]], 1) for same in [on[:-1] == on[1:]]]
    for a, b in ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))):  # foreground meets over corners too
        both = on[:-1, a] & on[1:, b]
        pairs.append(np.stack([run[:-1, a][both], run[1:, b][both]], 1))
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in np.unique(np.concatenate(pairs), axis=0).tolist():
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return y, x0, x1, np.array([find(i) for i in range(len(y))], int)


def runs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Every run of equal pixels of every tile (image_id, top, left, h, w, height, width, p), with its region's label within the tile.

    A label is the number, in the whole map's raster order, of the region's first pixel in the tile. ``total`` is the sum of the run's
    values, ``edge`` tells which of the tile's edges it touches.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                prob = np.array(r["p"], float).reshape(r["h"], r["w"])
                on = prob > threshold
                y, x0, x1, first = label_runs(on)
                own = (y + r["top"]) * r["width"] + x0 + r["left"]
                edge = UP * (y == 0) + DOWN * (y == r["h"] - 1) + LEFT * (x0 == 0) + RIGHT * (x1 == r["w"] - 1)
                columns = [own[first], on[y, x0], (y + r["top"]).astype(np.int32), (x0 + r["left"]).astype(np.int32), (x1 + r["left"]).astype(np.int32), np.add.reduceat(prob.ravel(), y * r["w"] + x0), edge.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.repeat(r["image_id"], len(y)).cast(pa.int64()), *map(pa.array, columns)], ["image_id", "label", "on", "y", "x0", "x1", "total", "edge"])

    return tiles.where((F.col("h") > 0) & (F.col("w") > 0) & F.col("p").isNotNull()).select(*(c.split()[0] for c in TILE.split(", "))).mapInArrow(scan, RUNS)


def _border_links(found: DataFrame) -> DataFrame:
    """(a, b) of labels, as structs with their image, that meet over a tile border: an equality join of border pixels alone."""
    touches = lambda bits: F.col("edge").bitwiseAND(F.lit(bits)) != 0
    line = F.when(touches(UP | DOWN), F.sequence("x0", "x1")).otherwise(F.array_distinct(F.concat(F.when(touches(LEFT), F.array("x0")).otherwise(F.array().cast("array<int>")), F.when(touches(RIGHT), F.array("x1")).otherwise(F.array().cast("array<int>")))))
    pixels = found.where("edge > 0").select("image_id", "on", "y", F.explode(line).alias("x"), F.struct("image_id", "label").alias("node"))
    ways = F.when(F.col("on"), F.expr("array((0, 1), (1, 0), (1, 1), (1, -1))")).otherwise(F.expr("array((0, 1), (1, 0))"))
    ahead = pixels.select("image_id", "on", F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("node").alias("a"), F.explode(ways).alias("way"))
    ahead = ahead.select("image_id", "on", (F.col("fy") + F.col("way.col1")).alias("y"), (F.col("fx") + F.col("way.col2")).alias("x"), "a")
    return ahead.join(pixels.withColumnRenamed("node", "b"), ["image_id", "on", "y", "x"]).where("a <> b").select("a", "b").distinct()


def labelled(tiles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Runs with the label of their region in the whole map (``region``), and the regions.

    A region has image_id, region (the number of its first pixel), on, n, total, y and x of its first pixel, and ``open``: whether it
    reaches the map's edge. Labels of tiles are summed up before they are joined to regions, so a region that fills the map
    is one row a tile there.
    """
    found = saved(runs(tiles, threshold), "runs")
    roots = saved(connected_components(_border_links(found)).select("node.image_id", "node.label", F.col("root.label").alias("region")), "region-roots")
    sizes = tiles.select("image_id", "height", "width").distinct()
    known = found.join(roots, ["image_id", "label"], "left").withColumn("region", F.coalesce("region", "label")).drop("label")
    parts = found.groupBy("image_id", "label").agg(
        F.first("on").alias("on"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n"), F.sum("total").alias("total"), F.min(F.struct("y", F.col("x0").alias("x"))).alias("at"),
        F.max("y").alias("y1"), F.min("x0").alias("xa"), F.max("x1").alias("xb"),
    )
    whole = parts.join(roots, ["image_id", "label"], "left").groupBy("image_id", F.coalesce("region", "label").alias("region")).agg(
        F.first("on").alias("on"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("at").alias("at"), F.max("y1").alias("y1"), F.min("xa").alias("xa"), F.max("xb").alias("xb")
    )
    reach = (F.col("at.y") == 0) | (F.col("y1") == F.col("height") - 1) | (F.col("xa") == 0) | (F.col("xb") == F.col("width") - 1)
    return known, whole.join(sizes, "image_id").select("image_id", "region", "on", "n", "total", "at.y", "at.x", reach.alias("open"))


def _enclosed(regions: DataFrame, found: DataFrame) -> DataFrame:
    """``regions`` with ``outer`` (the region around it; null outside all) and n and total of all that it encloses, itself included.

    The region around another holds the pixel left of its first one. Sums go up the tree by pointer doubling: after k rounds a
    region has summed up what lies less than 2^k levels below it.
    """
    inner = regions.where(F.col("on") | ~F.col("open"))
    before = found.select("image_id", "y", (F.col("x1") + 1).alias("x"), F.col("region").alias("outer"))
    outside = regions.where(~F.col("on") & F.col("open")).select("image_id", F.col("region").alias("outer"), F.lit(True).alias("outside"))
    placed = inner.join(before, ["image_id", "y", "x"], "left").join(outside, ["image_id", "outer"], "left")
    rounds = Rounds(regions.sparkSession, "nesting")
    now = rounds.saved(placed.withColumn("outer", F.when(F.col("outside").isNull(), F.col("outer"))).withColumn("up", F.col("outer")).drop("outside"))
    for _ in range(MOST_ROUNDS):
        if now.where("up is not null").isEmpty():
            return now.drop("up")
        below = now.where("up is not null").groupBy("image_id", F.col("up").alias("region")).agg(F.sum("n").alias("more_n"), F.sum("total").alias("more_total"))
        above = now.select("image_id", F.col("region").alias("up"), F.col("up").alias("next"))
        summed = now.join(below, ["image_id", "region"], "left").join(above, ["image_id", "up"], "left")
        more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        now = rounds.saved(summed.select("image_id", "region", "on", more("n"), more("total"), "y", "x", "open", "outer", F.col("next").alias("up")))
    raise RuntimeError(f"regions are nested deeper than {MOST_ROUNDS} rounds reach")


def _hole_borders(found: DataFrame, nested: DataFrame, tiles: DataFrame, height: int, width: int) -> DataFrame:
    """image_id, region, y, x, v: the pixels of the region around each hole that are its neighbours, by one of four ways.

    Stretches of a hole meet the runs of their own and the adjoining lines by image, line and column of tiles, which no run crosses.
    """
    column = F.floor(F.col("x0") / width).cast("int")
    holes = nested.where(~F.col("on")).select("image_id", "region", "outer")
    own = found.where(~F.col("on")).select("image_id", "region", "y", "x0", "x1").join(holes, ["image_id", "region"])
    stretch = lambda dy, a, b: F.struct((F.col("y") + dy).alias("y"), a.alias("x0"), b.alias("x1"))
    x0, x1 = F.col("x0"), F.col("x1")
    beside = own.select("image_id", "region", "outer", F.explode(F.array(stretch(-1, x0, x1), stretch(1, x0, x1), stretch(0, x0 - 1, x0 - 1), stretch(0, x1 + 1, x1 + 1))).alias("s"))
    beside = beside.select("image_id", "region", "outer", "s.*").withColumn("column", column)
    around = found.where("on").select("image_id", F.col("region").alias("outer"), "y", F.col("x0").alias("a"), F.col("x1").alias("b"), column.alias("column"))
    met = beside.join(around, ["image_id", "outer", "y", "column"]).where("a <= x1 and x0 <= b")
    pixels = met.select("image_id", "region", "y", F.explode(F.sequence(F.greatest("x0", "a"), F.least("x1", "b"))).alias("x")).distinct()
    placed = pixels.withColumns({"top": F.floor(F.col("y") / height).cast("int") * height, "left": F.floor(F.col("x") / width).cast("int") * width})
    value = F.get("p", (F.col("y") - F.col("top")) * F.col("w") + F.col("x") - F.col("left"))
    return placed.join(tiles.select("image_id", "top", "left", "w", "p"), ["image_id", "top", "left"]).select("image_id", "region", "y", "x", value.alias("v"))


def region_contours(tiles: DataFrame, threshold: float, height: int, width: int) -> DataFrame:
    """image_id, contour_idx, hole, n_pixels, score, box_w, box_h, box: every contour of every map cut into ``height`` x ``width`` tiles.

    ``tiles`` (image_id, top, left, h, w, height, width, p) lie side by side and cover their maps; image_id is unique to a map. The
    numbers are those of a whole map's contours: ``contour_idx`` counts outer borders and holes in raster order of their first
    pixel, ``score`` is the mean of the ``n_pixels`` pixels inside or on the border, the box is the least around it.
    A map without a pixel above the threshold has no rows, nor has a null or empty tile; a NaN pixel is background.

    No task holds more than a tile; across tiles only runs at the border, regions' sums and two points a line of each contour are shuffled.
    """
    known, regions = labelled(tiles, threshold)
    found = saved(known, "region-runs")
    regions = saved(regions, "regions")
    summed = _enclosed(regions, found)
    beside = saved(_hole_borders(found, summed, tiles, height, width), "hole-borders")
    added = beside.groupBy("image_id", "region").agg(F.count("*").alias("more_n"), F.sum("v").alias("more_total"))
    bordered = summed.join(added, ["image_id", "region"], "left")
    n = F.col("n") + F.coalesce("more_n", F.lit(0))
    # a hole's border begins left of its first pixel
    start = F.struct("y", F.when(F.col("on"), F.col("x")).otherwise(F.col("x") - 1).alias("x"))
    listed = bordered.select("image_id", "region", (~F.col("on")).alias("hole"), n.alias("n_pixels"), ((F.col("total") + F.coalesce("more_total", F.lit(0.0))) / n).alias("score"), start.alias("start"))
    listed = listed.withColumn("contour_idx", F.row_number().over(Window.partitionBy("image_id").orderBy("start")) - 1)
    spread = found.where("on").select("image_id", "region", "y", "x0", "x1").unionByName(beside.select("image_id", "region", "y", F.col("x").alias("x0"), F.col("x").alias("x1")))
    boxes = scores.least_boxes(spread, ["image_id", "region"])
    return listed.join(boxes, ["image_id", "region"]).select("image_id", "contour_idx", "hole", "n_pixels", "score", "box_w", "box_h", "box")
