"""Queries on polygons: filters, growth, ordering, homographies, scaling, tiles and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tiling
from ..operators import results
from .inputs import POLYGONS_SQL, polygons, table


def _points(points, names=("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")) -> list:
    return [c.alias(n) for c, n in zip((v for p in points for v in p), names, strict=True)]


def q_poly_area_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.vertices()
    return polygons(spark, sf_dir).select("poly_id", g.area(p).alias("area"), F.round(g.perimeter(p), 6).alias("perimeter"))


def q_unclip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polygon, flat, sheared and self-crossing ones too; one with a zero-length edge has null vertices."""
    return g.with_unclipped(polygons(spark, sf_dir), 1.53).select("poly_id", *results.POLY)


def q_format_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = g.with_corners(polygons(spark, sf_dir), 0.75)
    return made.select("poly_id", *(F.col(f"{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in "xy"))


def q_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of every polygon's crop, and where its centre comes from; null where the polygon is singular."""
    corners = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in (2, 3, 4, 1)]
    m = g.homography(corners, 100, 32)
    u, v = g.project(m, F.lit(50.0), F.lit(16.0))
    # round() takes other ways in other engines; this is plain arithmetic
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6
    return polygons(spark, sf_dir).select("poly_id", *(six(c).alias(f"m{i}") for i, c in enumerate(m)), six(u).alias("u"), six(v).alias("v"))


def q_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("poly_id", *(c.alias(n) for c, n in zip(g.bounding_box(g.vertices()), ("left", "top", "width", "height"), strict=True)))


def q_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("poly_id", *_points(g.rescale(g.vertices(), F.lit(1.37), F.lit(0.83))))


def q_score_filter_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five candidates of an image, in their own order, of which those stay that score 0.3 and are 1 px high."""
    first = polygons(spark, sf_dir).withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("poly_id")))
    return first.where("idx <= 5").where((F.col("score") >= 0.3) & (F.least("hw", "hh") >= 1)).select("image_id", "poly_id", "idx", "score")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("image_id"), (64 + k * 31 % 1200).cast("int").alias("h"), (64 + k * 17 % 2000).cast("int").alias("w"))


def q_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _sizes(spark, sf_dir).select("image_id", F.explode(tiling.tiles(F.col("h"), F.col("w"), 320, 160)).alias("t"))
    return grid.select("image_id", "t.row", "t.col", "t.top", "t.left")


def q_tile_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("image_id", tiling.canvas(F.col("h"), 320, 96).alias("canvas_h"), tiling.canvas(F.col("w"), 320, 96).alias("canvas_w"))


def q_tile_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile that owns each polygon's first vertex on a 1024-wide canvas."""
    count = tiling.tile_count(F.lit(1100), 320, 160)
    return polygons(spark, sf_dir).select("poly_id", tiling.owner(F.col("x1"), count, 320, 160).alias("col"), tiling.owner(F.col("y1"), count, 320, 160).alias("row"))


def q_batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return results.batches(rows, 32, "o_orderkey")


def q_polygon_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons dealt into the recogniser's batches of 16, in order over all images."""
    return results.batches(polygons(spark, sf_dir).select("poly_id", "image_id"), 16, "poly_id")


def q_tile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles dealt into the detector's batches of 4, image by image and row by row."""
    grid = _sizes(spark, sf_dir).select("image_id", F.explode(tiling.tiles(F.col("h"), F.col("w"), 320, 160)).alias("t"))
    # a canvas of these sizes has under 100 tiles a side
    placed = grid.select((F.col("image_id") * 10_000 + F.col("t.row") * 100 + F.col("t.col")).alias("tile_no"))
    return results.batches(placed, 4, "tile_no")


def q_flatten_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    return results.counts(images, polygons(spark, sf_dir))


def q_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = polygons(spark, sf_dir).withColumn("poly_idx", F.col("poly_id")).withColumn("text", F.concat(F.lit("t"), F.col("poly_id"))).withColumn("conf", F.round("score", 3))
    return results.json_results(texts)


def q_object_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the polygons that belong to each frame of the event stream, joined by image, with cut labels."""
    frames = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("image_id")).agg(F.count("*").alias("frames"))
    left, top, width, height = g.bounding_box(g.vertices())
    objects = polygons(spark, sf_dir).select("image_id", "poly_id", left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"), F.substring(F.concat(F.lit("object-"), F.col("poly_id")), 1, 12).alias("label"))
    return objects.join(frames, "image_id").select("image_id", "poly_id", "left", "top", "width", "height", "label", "frames")


_CORNERS = "[[x1, y1], [x2, y2], [x3, y3], [x4, y4]]"
_UNCLIP = f"""WITH {POLYGONS_SQL},
v AS (SELECT poly_id, {_CORNERS}::DOUBLE[][] AS p FROM polys),
a AS (SELECT *, abs(list_sum(list_transform(range(1, 5), lambda i: p[i][1] * p[i % 4 + 1][2] - p[i % 4 + 1][1] * p[i][2]))) / 2 AS area,
             list_sum(list_transform(range(1, 5), lambda i: sqrt((p[i][1] - p[i % 4 + 1][1]) ** 2 + (p[i][2] - p[i % 4 + 1][2]) ** 2))) AS len FROM v),
e AS (SELECT poly_id, i, area * 1.53 / nullif(len, 0) AS d, p[i][1] AS ax, p[i][2] AS ay, p[i % 4 + 1][1] AS bx, p[i % 4 + 1][2] AS by_ FROM a, (SELECT unnest(range(1, 5)) AS i)),
n AS (SELECT *, bx - ax AS vx, by_ - ay AS vy, nullif(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2), 0) AS n FROM e),
m AS (SELECT poly_id, i, ax + vy * d / n AS x0, ay - vx * d / n AS y0, bx + vy * d / n AS x1, by_ - vx * d / n AS y1, vx / n AS ux, vy / n AS uy FROM n),
j AS (SELECT c.poly_id, c.i, a.x0 AS x0, a.y0 AS y0, a.x1 AS x1, a.y1 AS y1, a.ux, a.uy, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1, c.ux AS cux, c.uy AS cuy,
             a.ux * c.ux + a.uy * c.uy AS cos, a.ux * c.uy - a.uy * c.ux AS crs FROM m c JOIN m a ON a.poly_id = c.poly_id AND a.i = (c.i + 2) % 4 + 1),
r AS (SELECT poly_id, i, trunc(CASE WHEN abs(cos) > 0.7 THEN (x0 + cx1) / 2 ELSE x0 + ((cx0 - x0) * cuy - (cy0 - y0) * cux) / nullif(crs, 0) * ux END)::INT AS x,
             trunc(CASE WHEN abs(cos) > 0.7 THEN (y0 + cy1) / 2 ELSE y0 + ((cx0 - x0) * cuy - (cy0 - y0) * cux) / nullif(crs, 0) * uy END)::INT AS y FROM j)
SELECT poly_id, {', '.join(f'max(CASE WHEN i = {i} THEN {c} END) AS {c}{i}' for i in range(1, 5) for c in 'xy')} FROM r GROUP BY poly_id"""
_HOMOGRAPHY = f"""WITH {POLYGONS_SQL},
c AS (SELECT poly_id, x2::DOUBLE AS x0, y2::DOUBLE AS y0, x3::DOUBLE AS x1, y3::DOUBLE AS y1, x4::DOUBLE AS x2, y4::DOUBLE AS y2, x1::DOUBLE AS x3, y1::DOUBLE AS y3 FROM polys),
s AS (SELECT *, x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS sy FROM c),
t AS (SELECT *, nullif(dx1 * dy2 - dx2 * dy1, 0) AS den FROM s),
u AS (SELECT *, (sx * dy2 - dx2 * sy) / den AS g, (dx1 * sy - sx * dy1) / den AS k FROM t),
m AS (SELECT poly_id, (x1 - x0 + g * x1) / 100 AS m0, (x3 - x0 + k * x3) / 32 AS m1, x0 + 0 * den AS m2, (y1 - y0 + g * y1) / 100 AS m3, (y3 - y0 + k * y3) / 32 AS m4, y0 + 0 * den AS m5, g / 100 AS m6, k / 32 AS m7, 1.0 + 0 * den AS m8 FROM u)
SELECT poly_id, {', '.join(f'floor(m{i} * 1e6 + 0.5) / 1e6 AS m{i}' for i in range(9))}, floor((m0 * 50 + m1 * 16 + m2) / nullif(m6 * 50 + m7 * 16 + m8, 0) * 1e6 + 0.5) / 1e6 AS u, floor((m3 * 50 + m4 * 16 + m5) / nullif(m6 * 50 + m7 * 16 + m8, 0) * 1e6 + 0.5) / 1e6 AS v FROM m"""
_FORMAT = f"""WITH {POLYGONS_SQL},
v AS (SELECT poly_id, unnest([{{'x': x1, 'i': 0, 'y': y1}}, {{'x': x2, 'i': 1, 'y': y2}}, {{'x': x3, 'i': 2, 'y': y3}}, {{'x': x4, 'i': 3, 'y': y4}}]) AS q FROM polys),
o AS (SELECT poly_id, q.x AS x, q.y AS y, row_number() OVER (PARTITION BY poly_id ORDER BY q.x, q.i) AS k FROM v),
w AS (SELECT poly_id, {', '.join(f'max(CASE WHEN k = {k} THEN {c} END) AS {c}{k}' for k in range(1, 5) for c in 'xy')} FROM o GROUP BY poly_id),
f AS (SELECT poly_id, CASE WHEN y1 <= y2 THEN [x1, y1] ELSE [x2, y2] END AS tl, CASE WHEN y1 <= y2 THEN [x2, y2] ELSE [x1, y1] END AS bl,
             CASE WHEN y3 <= y4 THEN [x3, y3] ELSE [x4, y4] END AS tr, CASE WHEN y3 <= y4 THEN [x4, y4] ELSE [x3, y3] END AS br FROM w),
h AS (SELECT *, sqrt((tl[1] - tr[1]) ** 2 + (tl[2] - tr[2]) ** 2) < 0.75 * sqrt((tl[1] - bl[1]) ** 2 + (tl[2] - bl[2]) ** 2) AS turn FROM f)
SELECT poly_id, {', '.join(f'CASE WHEN turn THEN {b}[{i}] ELSE {a}[{i}] END AS {a}_{c}' for a, b in (('tl', 'bl'), ('tr', 'tl'), ('br', 'tr'), ('bl', 'br')) for i, c in ((1, 'x'), (2, 'y')))} FROM h"""
_SIZES = "s AS (SELECT o_orderkey AS image_id, (64 + o_orderkey * 31 % 1200)::INT AS h, (64 + o_orderkey * 17 % 2000)::INT AS w FROM orders)"
_BOX = "least(x1, x2, x3, x4) AS \"left\", least(y1, y2, y3, y4) AS top, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS width, greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS height"
QUERIES = [q_poly_area_perimeter, q_unclip, q_format_points, q_homography, q_bbox, q_rescale, q_score_filter_limit, q_tile_grid, q_tile_canvas, q_tile_owner, q_batch_assign, q_polygon_batches, q_tile_batches, q_flatten_counts, q_json_results, q_object_meta]
SQL = {
    "q_poly_area_perimeter": f"""WITH {POLYGONS_SQL} SELECT poly_id, abs((x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y4 - x4 * y3 + x4 * y1 - x1 * y4)::DOUBLE) / 2 AS area,
round(sqrt(((x1 - x2) ** 2 + (y1 - y2) ** 2)::DOUBLE) + sqrt(((x2 - x3) ** 2 + (y2 - y3) ** 2)::DOUBLE) + sqrt(((x3 - x4) ** 2 + (y3 - y4) ** 2)::DOUBLE) + sqrt(((x4 - x1) ** 2 + (y4 - y1) ** 2)::DOUBLE), 6) AS perimeter FROM polys""",
    "q_unclip": _UNCLIP,
    "q_format_points": _FORMAT,
    "q_homography": _HOMOGRAPHY,
    "q_bbox": f"WITH {POLYGONS_SQL} SELECT poly_id, {_BOX} FROM polys",
    "q_rescale": f"WITH {POLYGONS_SQL} SELECT poly_id, {', '.join(f'trunc({c}{i} * {s}::DOUBLE)::INT AS {c}{i}' for i in range(1, 5) for c, s in (('x', 1.37), ('y', 0.83)))} FROM polys",
    "q_score_filter_limit": f"""WITH {POLYGONS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY poly_id)::INT AS idx FROM polys)
SELECT image_id, poly_id, idx, score FROM f WHERE idx <= 5 AND score >= 0.3 AND least(hw, hh) >= 1""",
    "q_tile_grid": f"""WITH {_SIZES}, c AS (SELECT *, greatest(1, ceil((h - 320) / 160.0)::INT + 1) AS nr, greatest(1, ceil((w - 320) / 160.0)::INT + 1) AS nc FROM s),
r AS (SELECT image_id, nc, unnest(range(0, nr))::INT AS "row" FROM c), g AS (SELECT image_id, "row", unnest(range(0, nc))::INT AS col FROM r)
SELECT image_id, "row", col, "row" * 160 AS top, col * 160 AS "left" FROM g""",
    "q_tile_canvas": f"WITH {_SIZES} SELECT image_id, greatest(0, ceil((h - 320) / 224.0)::INT) * 224 + 320 AS canvas_h, greatest(0, ceil((w - 320) / 224.0)::INT) * 224 + 320 AS canvas_w FROM s",
    "q_tile_owner": f"WITH {POLYGONS_SQL} SELECT poly_id, greatest(0, least(5, floor((x1 - 80) / 160.0)))::INT AS col, greatest(0, least(5, floor((y1 - 80) / 160.0)))::INT AS \"row\" FROM polys",
    "q_batch_assign": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS batch, (row_number() OVER (ORDER BY o_orderkey) - 1) % 32 AS slot FROM orders",
    "q_polygon_batches": "SELECT o_orderkey AS poly_id, o_custkey AS image_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS batch, (row_number() OVER (ORDER BY o_orderkey) - 1) % 16 AS slot FROM orders",
    "q_tile_batches": f"""WITH {_SIZES}, c AS (SELECT *, greatest(1, ceil((h - 320) / 160.0)::INT + 1) AS nr, greatest(1, ceil((w - 320) / 160.0)::INT + 1) AS nc FROM s),
r AS (SELECT image_id, nc, unnest(range(0, nr)) AS y FROM c), g AS (SELECT image_id * 10000 + y * 100 + unnest(range(0, nc)) AS tile_no FROM r)
SELECT tile_no, (row_number() OVER (ORDER BY tile_no) - 1) // 4 AS batch, (row_number() OVER (ORDER BY tile_no) - 1) % 4 AS slot FROM g""",
    "q_flatten_counts": "SELECT c_custkey AS image_id, count(o_orderkey) AS text_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "q_json_results": f"""WITH {POLYGONS_SQL}
SELECT image_id, '[' || string_agg('{{"text":"t' || poly_id || '","text_conf":' || round(score, 3) || ',"poly":[' || concat_ws(',', x1, y1, x2, y2, x3, y3, x4, y4) || ']}}', ',' ORDER BY poly_id) || ']' AS json FROM polys GROUP BY image_id""",
    "q_object_meta": f"""WITH {POLYGONS_SQL}, f AS (SELECT user_id AS image_id, count(*) AS frames FROM events GROUP BY user_id)
SELECT image_id, poly_id, {_BOX}, substr('object-' || poly_id, 1, 12) AS label, frames FROM polys JOIN f USING (image_id)""",
}
