"""Tiling of large images: canvas, tile grid and which tile owns a canvas pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_count(size: Column, tile: int, overlap: int) -> Column:
    """Tiles along an axis: one at least."""
    step = tile - overlap
    return F.greatest(F.lit(1), F.ceil((size - tile) / float(step)).cast("int") + 1)


def canvas(size: Column, tile: int, overlap: int) -> Column:
    """Length of the padded axis that the tiles cover exactly."""
    return (tile_count(size, tile, overlap) - 1) * (tile - overlap) + tile


def owner(at: Column, count: Column, tile: int, overlap: int) -> Column:
    """The tile whose result a canvas position takes: seams lie half an overlap into each neighbour."""
    return F.greatest(F.lit(0), F.least(count - 1, F.floor((at - overlap // 2) / float(tile - overlap)).cast("int")))


def tiles(height: Column, width: Column, tile: int, overlap: int) -> Column:
    """All tiles, row by row: array of (row, col, top, left)."""
    step = tile - overlap
    rows, cols = tile_count(height, tile, overlap), tile_count(width, tile, overlap)
    row = lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.struct(r.alias("row"), c.alias("col"), (r * step).alias("top"), (c * step).alias("left")))
    return F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), row))
