"""Contours of binary masks: borders followed a map at a time, their scores and rotated boxes in Spark.

Contours are borders of 8-connected foreground, outer and hole borders alike, in raster order of their first pixel
(Suzuki and Abe 1985), with straight runs reduced to their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from . import scores

BORDERS = "image_id long, contour_idx int, pts array<struct<x: int, y: int>>"
#: Neighbours clockwise from the east, as (dy, dx).
_STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def _follow(mask: np.ndarray, marks: np.ndarray, y: int, x: int, back: int, number: int) -> list[tuple[int, int]]:
    """One border from (y, x), entered from direction ``back``; padded coordinates."""
    first = next((d for k in range(8) if mask[y + _STEPS[d := (back + k) % 8][0], x + _STEPS[d][1]]), None)
    if first is None:
        marks[y, x] = -number
        return [(x, y)]
    start, goal = (y, x), (y + _STEPS[first][0], x + _STEPS[first][1])
    path, at, came = [], start, first
    while True:
        east = False
        for k in range(1, 9):
            d = (came - k) % 8
            ny, nx = at[0] + _STEPS[d][0], at[1] + _STEPS[d][1]
            if mask[ny, nx]:
                break
            east |= d == 0
        path.append((at[1], at[0]))
        if east:
            marks[at] = -number
        elif marks[at] == 1:
            marks[at] = number
        if (ny, nx) == start and at == goal:
            return path
        at, came = (ny, nx), (d + 4) % 8


def _corners(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Without the inner points of straight runs."""
    n = len(path)
    if n < 3:
        return path
    turn = lambda i: (path[i][0] - path[i - 1][0], path[i][1] - path[i - 1][1]) != (path[(i + 1) % n][0] - path[i][0], path[(i + 1) % n][1] - path[i][1])
    return [path[i] for i in range(n) if turn(i)]


def find_contours(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Borders of a boolean mask as lists of (x, y)."""
    padded = np.pad(mask.astype(bool), 1)
    marks = padded.astype(np.int64)
    out, number = [], 1
    # a border begins where the background lies to the left or to the right
    ends = padded & ~(np.roll(padded, 1, 1) & np.roll(padded, -1, 1))
    for y, x in np.argwhere(ends):
        outer = marks[y, x] == 1 and not padded[y, x - 1]
        hole = not outer and marks[y, x] >= 1 and not padded[y, x + 1]
        if outer or hole:
            number += 1
            path = _follow(padded, marks, int(y), int(x), 4 if outer else 0, number)
            out.append([(px - 1, py - 1) for px, py in _corners(path)])
    return out


def borders(prob_maps: DataFrame, threshold: float) -> DataFrame:
    """image_id, contour_idx, pts of every contour of every map (image_id, h, w, p: row-major array) above the threshold.

    Only the following of a border is done in Python. A map is one row, so it is never split (``regions`` takes larger
    ones in tiles); maps stream through the tasks. A null or empty map and one without contours give no rows; a NaN is
    background.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images, numbers, points = [], [], []
            for image, h, w, p in zip(*(b.column(c).to_pylist() for c in ("image_id", "h", "w", "p")), strict=True):
                for k, pts in enumerate(find_contours(np.array(p, float).reshape(h, w) > threshold)):
                    images.append(image)
                    numbers.append(k)
                    points.append([{"x": x, "y": y} for x, y in pts])
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((images, numbers, points), kinds, strict=True)], ["image_id", "contour_idx", "pts"])

    full = prob_maps.where(F.col("p").isNotNull() & (F.size("p") > 0) & (F.size("p") == F.col("h") * F.col("w")))
    return full.select(F.col("image_id").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("p").cast("array<double>")).mapInArrow(scan, BORDERS)


def contours(prob_maps: DataFrame, threshold: float) -> DataFrame:
    """``borders`` with score and box: image_id, contour_idx, pts, score, box_w, box_h, box; image_id is unique to a map.

    The score, the mean of the pixels inside or on the border, comes from scan lines and prefix sums, the least box from
    array expressions on the border's own row. Repeated maps of one image_id are not told apart.
    """
    boxed = borders(prob_maps, threshold).withColumn("corners", scores.hull(F.col("pts"))).withColumn("b", scores.least_box(F.col("corners")))
    # written, so that no filter on a box is put through its expressions
    found = saved(boxed.select("image_id", "contour_idx", "pts", "b.*"), "borders")
    scored = scores.polygon_scores(found, prob_maps, ["image_id", "contour_idx"]).drop("n_pixels")
    return found.join(scored, ["image_id", "contour_idx"]).select("image_id", "contour_idx", "pts", "score", "box_w", "box_h", "box")


def candidates(found: DataFrame, max_candidates: int, score_threshold: float) -> DataFrame:
    """The first ``max_candidates`` contours of an image (all, if 0 or less), then those that score enough and are 1 px wide."""
    if max_candidates > 0:
        found = found.where(F.col("contour_idx") < max_candidates)
    return found.where((F.col("score") >= score_threshold) & (F.least("box_w", "box_h") >= 1))
