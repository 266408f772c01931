"""From probability maps to texts: the whole recognition dataflow, in one and in several tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OcrConfig
from ..functions import decode, pixels, tiling
from ..functions import geometry as g
from ..operators import contours, results, scores, tiled_warp
from ..operators.recognise import Detector, MatrixRecogniser, Recogniser, StubDetector, StubMatrixRecogniser, StubRecogniser, detect, on_canvas, recognise
from ..operators.regions import tiles_of
from ..storage import saved
from .inputs import POLYGONS_SQL, SYMBOLS, map_polygons, rasters


def regions(maps: DataFrame, config: OcrConfig, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, poly_idx, x1..y4, m of every text region of probability maps (image_id, h, w, p; image_id unique, the table cheap to read again).

    The first ``max_candidates`` contours of a map count, of these the ones that score enough; their boxes, 1 px wide at least,
    are grown and their corners put in order. With ``sizes`` (image_id, height, width) contours are brought to these sizes
    before they are boxed. A box's growth is that of its exact corners, which are rounded then (half to even). ``m`` is null for a
    region that can't be cropped.
    """
    found = saved(contours.borders(maps, config.binarize_threshold), "borders")
    if config.max_candidates > 0:
        found = found.where(F.col("contour_idx") < config.max_candidates)
    key = ["image_id", "contour_idx"]
    good = scores.polygon_scores(found, maps, key).where(F.col("score") >= config.polygon_threshold).select(*key)
    kept = found.join(good, key)
    if sizes is not None:
        to = maps.select("image_id", "h", "w").join(sizes.select("image_id", "height", "width"), "image_id")
        x, y = (g.source_scale(F.col("height"), F.col("width"), F.col("h"), F.col("w"), config.keep_aspect_ratio))
        placed = to.select("image_id", x.alias("sx"), y.alias("sy"))
        scaled = F.transform("pts", lambda p: F.struct((p["x"] * F.col("sx")).cast("int").alias("x"), (p["y"] * F.col("sy")).cast("int").alias("y")))
        kept = kept.join(placed, "image_id").select(*key, scaled.alias("pts"))
    parts = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    boxed = kept.repartition(parts, *key).withColumn("corners", scores.hull(F.col("pts"))).withColumn("b", scores.least_box(F.col("corners")))
    # written, here and below, so that what is asked of a region is not put through its geometry
    boxed = saved(boxed.select("image_id", "contour_idx", "b"), "boxes")
    exact = [(F.get("b.box", F.lit(i))["x"], F.get("b.box", F.lit(i))["y"]) for i in range(4)]
    flat = [c for p in exact for c in p]
    corners = boxed.select("image_id", F.col("contour_idx").alias("poly_idx"), F.least("b.box_w", "b.box_h").alias("short"), *(c.alias(f"d{n}") for c, n in zip(flat, results.POLY, strict=True)))
    whole = corners.select("image_id", "poly_idx", "short", *(F.rint(f"d{n}").cast("int").alias(n) for n in results.POLY), g.growth([(F.col(f"dx{i}"), F.col(f"dy{i}")) for i in range(1, 5)], config.unclip_ratio).alias("by"))
    grown = saved(g.with_unclipped(whole, config.unclip_ratio, F.col("by")), "regions").where("short >= 1").drop("short", "by").dropna()
    formed = g.with_corners(grown, config.rotation_threshold)
    m = F.array(*g.homography([(F.col(f"{c}.x"), F.col(f"{c}.y")) for c in ("tl", "tr", "br", "bl")], config.crop_width, config.crop_height))
    return formed.select("image_id", "poly_idx", *results.POLY, m.alias("m"))


def texts(prob_maps: DataFrame, config: OcrConfig, model: Recogniser | MatrixRecogniser, symbols: list[str] = SYMBOLS, images: DataFrame | None = None) -> DataFrame:
    """image_id, poly_idx, x1..y4, text, conf of every region of probability maps (image_id, h, w, p), cropped from ``images``.

    Without ``images`` (the same columns, image_id unique, any size and any number of channels) regions are cropped from the maps.
    Images without text give no rows, a region that can't be cropped has a null text. An image's regions
    are gathered (``max_candidates`` at most) and meet it in one row.
    """
    maps = saved(prob_maps.select("image_id", "h", "w", "p"), "maps")
    shown = maps if images is None else images.select("image_id", "h", "w", "p")
    found = regions(maps, config, None if images is None else shown.select("image_id", F.col("h").alias("height"), F.col("w").alias("width")))
    region = F.struct("poly_idx", F.array(*results.POLY).alias("poly"), F.when(F.get("m", F.lit(8)).isNotNull(), F.col("m")).alias("m"))
    # dealt out by a number of their own: few bytes are much work for a model, and small partitions would be put together
    parts = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = found.groupBy("image_id").agg(F.array_sort(F.collect_list(region)).alias("regions")).join(shown.repartition(parts, "image_id"), "image_id")
    matrices = config.decoder == "transformer"
    steps = recognise(gathered.select("image_id", "h", "w", "p", "regions"), model, config.crop_height, config.crop_width, config.upside_down, matrices, config.recognise_batch)
    if config.decoder == "ctc":
        text, conf = decode.ctc(F.col("ids"), F.col("probs"), decode.ctc_dictionary(symbols))
    elif config.decoder == "attention":
        text, conf = decode.attention(F.col("ids"), F.col("probs"), decode.attention_dictionary(symbols))
    else:
        text, conf = decode.transformer(F.col("scores"), decode.transformer_dictionary(symbols), config.only_alnum, config.only_lowercase)
    if config.only_alnum:
        text = F.regexp_replace(text, "[^a-zA-Z0-9]", "")
    if config.only_lowercase:
        text = decode.ascii_lower(text)
    read = steps.select("image_id", "poly_idx", "poly", F.struct(conf.alias("conf"), (-F.col("orientation")).alias("o"), text.alias("text")).alias("s"))
    best = read.groupBy("image_id", "poly_idx", "poly").agg(F.max("s").alias("s"))
    return best.select("image_id", "poly_idx", *(F.get("poly", F.lit(i)).alias(n) for i, n in enumerate(results.POLY)), "s.text", "s.conf")


def cut_tiles(maps: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Tiles (image_id, height, width, row, col, h, w, p) that cover maps (image_id, h, w, p), each of its own size; beyond a map they hold 0."""
    sized = maps.select("image_id", F.col("h").alias("height"), F.col("w").alias("width"), "p")
    grid = sized.select("image_id", "height", "width", "p", F.explode(tiling.tiles(F.col("height"), F.col("width"), tile, overlap)).alias("t"))

    def line(y: Column) -> Column:
        own = F.slice("p", y * F.col("width") + F.col("t.left") + 1, F.least(F.lit(tile), F.col("width") - F.col("t.left")))
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        return F.when(y < F.col("height"), F.concat(own, zeros(F.lit(tile) - F.size(own)))).otherwise(zeros(F.lit(tile)))

    own = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda y: line(F.col("t.top") + y)))
    cut = grid.withColumn("own", own)
    return cut.select("image_id", "height", "width", F.col("t.row").alias("row"), F.col("t.col").alias("col"), F.lit(tile).alias("h"), F.lit(tile).alias("w"), F.col("own").alias("p"))


def merged_tiles(tile_maps: DataFrame, tile: int, overlap: int) -> DataFrame:
    """One map (image_id, h, w, p) per image from its tiles' maps (image_id, height, width, row, col, p): each pixel comes from its owner.

    A tile owns a rectangle. It is cut into slices of lines before the shuffle, and an image's slices are put end to
    end in order; no row stands for a pixel.
    """
    rows, cols = (tiling.tile_count(F.col(n), tile, overlap) for n in ("height", "width"))
    canvas = [(n - 1) * (tile - overlap) + tile for n in (rows, cols)]
    # from half an overlap in, but for the outermost tiles
    low = lambda at: F.when(F.col(at) == 0, 0).otherwise(F.col(at) * (tile - overlap) + overlap // 2)
    high = lambda at, count, end: F.when(F.col(at) == count - 1, end).otherwise((F.col(at) + 1) * (tile - overlap) + overlap // 2)
    own = tile_maps.withColumns({"y0": low("row"), "y1": high("row", rows, canvas[0]), "x0": low("col"), "x1": high("col", cols, canvas[1])})
    # what lies beyond the map is dropped with the padding
    own = own.withColumns({"y1": F.least("y1", "height"), "x1": F.least("x1", "width")}).where("y0 < y1 and x0 < x1")
    lines = F.transform(F.sequence(F.col("y0"), F.col("y1") - 1), lambda y: F.struct(y.alias("y"), F.col("x0").alias("x"), F.slice("p", (y - F.col("row") * (tile - overlap)) * tile + F.col("x0") - F.col("col") * (tile - overlap) + 1, F.col("x1") - F.col("x0")).alias("v")))
    grouped = own.select("image_id", "height", "width", lines.alias("lines")).groupBy("image_id", "height", "width").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("all"))
    return grouped.select("image_id", F.col("height").alias("h"), F.col("width").alias("w"), F.flatten("all.v").alias("p"))


def image_texts(images: DataFrame, config: OcrConfig, detector: Detector, model: Recogniser | MatrixRecogniser, tiled: bool = False, symbols: list[str] = SYMBOLS) -> DataFrame:
    """``texts`` of images (image_id, h, w, p; image_id unique), each of any size.

    Whole images are detected at ``detect_height`` x ``detect_width`` (their own size, if 0), in one scale with ``keep_aspect_ratio``, and
    their regions are brought back to the image and cropped from it. For ``tiled``, an image of one channel is fitted into the canvas
    that its tiles cover, detected tile by tile, merged and recognised there, and its polygons are scaled back, cut to whole numbers.
    """
    if not tiled:
        maps = detect(images.select("image_id", "h", "w", "p"), detector, config.detect_height, config.detect_width, config.keep_aspect_ratio, config.detect_batch)
        return texts(maps, config, model, symbols, images)
    overlap = int(config.tile * config.overlap_rate)
    canvases = saved(on_canvas(images, config.tile, overlap), "canvases")
    tiles = cut_tiles(canvases.select("image_id", "h", "w", "p"), config.tile, overlap)
    merged = merged_tiles(detect(tiles, detector, batch=config.detect_batch), config.tile, overlap)
    read = texts(merged, config, model, symbols, canvases).join(canvases.select("image_id", "rescale"), "image_id")
    return read.select("image_id", "poly_idx", *((F.col(n) * F.col("rescale")).cast("int").alias(n) for n in results.POLY), "text", "conf")


def _enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 8 x 8 enlarged to 16 x 16, dealt out: they come from one small file, and every map is much work."""
    maps = rasters(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    return maps.select("image_id", F.lit(16).alias("h"), F.lit(16).alias("w"), pixels.resize(F.col("p"), 8, 8, 16, 16).alias("p"))


def q_rect_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every enlarged map through detection, geometry, the stub model and decoding."""
    return image_texts(_enlarged(spark, sf_dir), OcrConfig(binarize_threshold=0.1, polygon_threshold=0.1, upside_down=True), StubDetector(), StubRecogniser())


def q_tiled_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in tiles of 8 with half an overlap, recognised once on the merged maps, by the transformer decoder."""
    config = OcrConfig(binarize_threshold=0.1, polygon_threshold=0.1, decoder="transformer", tile=8, overlap_rate=0.5)
    return image_texts(_enlarged(spark, sf_dir), config, StubDetector(), StubMatrixRecogniser(), tiled=True)


def q_tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps cut into tiles of 4 with overlap 2 and merged again: every pixel comes back once."""
    grid = rasters(spark, sf_dir).select("image_id", "p", F.explode(tiling.tiles(F.lit(8), F.lit(8), 4, 2)).alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.get("p", (F.col("t.top") + F.floor(k / 4).cast("int")) * 8 + F.col("t.left") + k % 4))
    tiles = grid.select("image_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("t.row").alias("row"), F.col("t.col").alias("col"), cut.alias("own"))
    merged = merged_tiles(tiles.withColumnRenamed("own", "p"), 4, 2)
    return merged.select("image_id", F.posexplode("p").alias("at", "v"))


def q_tiled_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crop, 5 wide and 3 high, of every order's box (see q_polygon_scores) from its map, which lies in tiles of 3 x 5."""
    laid = map_polygons(spark, sf_dir)
    at = lambda i: (F.get("pts", F.lit(i))["x"], F.get("pts", F.lit(i))["y"])
    m = F.array(*g.homography([at(i) for i in (1, 2, 3, 0)], 5, 3))
    found = tiled_warp.crops(laid.select("image_id", "poly_id", m.alias("m")), tiles_of(rasters(spark, sf_dir), 3, 5), ["image_id", "poly_id"], 3, 5, 3, 5)
    return found.select("image_id", "poly_id", F.posexplode("crop").alias("k", "v")).select("image_id", "poly_id", "k", F.round(F.col("v") + 0.0, 6).alias("v"))


_TILED_WARP = f"""WITH {POLYGONS_SQL},
laid AS (SELECT poly_id, poly_id % 1000 AS image_id, {', '.join(f'trunc(x{i} * 0.02::DOUBLE - 6) AS x{i}, trunc(y{i} * 0.03::DOUBLE - 8) AS y{i}' for i in range(1, 5))} FROM polys WHERE poly_id % 1000 IN (SELECT vec_id FROM embeddings)),
c AS (SELECT image_id, poly_id, x2 AS x0, y2 AS y0, x3 AS x1, y3 AS y1, x4 AS x2, y4 AS y2, x1 AS x3, y1 AS y3 FROM laid),
s AS (SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS sy FROM c),
t AS (SELECT *, nullif(dx1 * dy2 - dx2 * dy1, 0) AS den FROM s),
n AS (SELECT *, (sx * dy2 - dx2 * sy) / den AS g, (dx1 * sy - sx * dy1) / den AS h FROM t WHERE den IS NOT NULL),
k AS (SELECT image_id, poly_id, k, nullif(g / 5.0::DOUBLE * (k % 5) + h / 3.0::DOUBLE * (k // 5) + 1, 0) AS z,
             (x1 - x0 + g * x1) / 5.0::DOUBLE * (k % 5) + (x3 - x0 + h * x3) / 3.0::DOUBLE * (k // 5) + x0 AS a, (y1 - y0 + g * y1) / 5.0::DOUBLE * (k % 5) + (y3 - y0 + h * y3) / 3.0::DOUBLE * (k // 5) + y0 AS b
      FROM n, (SELECT unnest(range(15)) AS k)),
p AS (SELECT image_id, poly_id, k, CASE WHEN abs(a / z) < 1e9 THEN a / z END AS x, CASE WHEN abs(b / z) < 1e9 THEN b / z END AS y FROM k),
q AS (SELECT image_id, poly_id, k, trunc(y) + dy AS yy, trunc(x) + dx AS xx, CASE dy WHEN 0 THEN 1 - abs(y - trunc(y)) ELSE abs(y - trunc(y)) END * CASE dx WHEN 0 THEN 1 - abs(x - trunc(x)) ELSE abs(x - trunc(x)) END AS wt
      FROM p, (VALUES (0), (1)) i(dy), (VALUES (0), (1)) j(dx))
SELECT image_id, poly_id, k::INT AS k, round(sum(CASE WHEN yy BETWEEN 0 AND 7 AND xx BETWEEN 0 AND 7 THEN wt * embedding[greatest(0, least(63, yy * 8 + xx))::INT + 1]::DOUBLE ELSE 0 END) + 0.0, 6) AS v
FROM q JOIN embeddings ON vec_id = image_id GROUP BY ALL"""
QUERIES = [q_rect_pipeline, q_tiled_pipeline, q_tile_merge, q_tiled_warp]
SQL = {
    "q_tiled_warp": _TILED_WARP,
    "q_tile_merge": 'SELECT vec_id AS image_id, k AS "at", embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64))::INT AS k)',
}
