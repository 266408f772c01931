"""Queries on pixels and maps: normalisation, thresholds, mask means, resizing, contours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels
from ..operators import contours, regions, scores
from .inputs import COLOURS_SQL, POLYGONS_SQL, colours, map_polygons, rasters


def _channels() -> list:
    return [F.col(c) for c in "bgr"]


def q_normalize_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, g, r = pixels.normalise_bgr(*_channels())
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(b, 9).alias("nb"), F.round(g, 9).alias("ng"), F.round(r, 9).alias("nr"))


def q_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.gray(*_channels())
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", gray.alias("gray"), F.round(pixels.normalise_gray(gray), 9).alias("scaled"))


def q_rgb_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = pixels.normalise_rgb(*_channels())
    return colours(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(r, 9).alias("nr"), F.round(g, 9).alias("ng"), F.round(b, 9).alias("nb"))


def q_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("image_id", F.array_join(F.transform("p", lambda v: pixels.binarize(v, 0.1).cast("string")), " ").alias("mask"))


def q_mask_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value and number of the pixels above the threshold; null for none."""
    up = F.filter("p", lambda v: v > 0.1)
    total = F.aggregate(up, F.lit(0.0), lambda a, v: a + v)
    return rasters(spark, sf_dir).select("image_id", F.size(up).alias("n"), F.round(total / F.nullif(F.size(up), F.lit(0)), 9).alias("mean"))


def q_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every map resized from 8 x 8 to 5 x 6, as pixel rows."""
    made = rasters(spark, sf_dir).select("image_id", F.posexplode(pixels.resize(F.col("p"), 8, 8, 5, 6)).alias("at", "v"))
    return made.select("image_id", "at", F.round("v", 9).alias("v"))


def q_keep_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every map resized from 8 x 8 into a canvas of 5 x 9 in one scale, as pixel rows."""
    made = rasters(spark, sf_dir).select("image_id", F.posexplode(pixels.resize_keep_aspect(F.col("p"), 8, 8, 5, 9)).alias("at", "v"))
    return made.select("image_id", "at", F.round("v", 9).alias("v"))


def q_detector_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's input of every map: three planes of 4 x 4, resized and normalised."""
    planes = pixels.detector_input((F.col("p"), F.reverse("p"), F.transform("p", lambda v: v * 2)), 8, 8, 4, 4)
    return rasters(spark, sf_dir).select("image_id", F.posexplode(planes).alias("at", "v")).select("image_id", "at", F.round("v", 9).alias("v"))


def q_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("image_id", F.posexplode(pixels.flipped(F.col("p"))).alias("at", "v"))


def q_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contours.contours(rasters(spark, sf_dir), 0.1)


def _sides() -> list:
    return [F.round(F.greatest("box_w", "box_h"), 6).alias("long"), F.round(F.least("box_w", "box_h"), 6).alias("short")]


def q_contour_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three contours of every map, of which those stay that score 0.1 and are 1 px wide."""
    found = contours.candidates(contours.contours(rasters(spark, sf_dir), 0.1), 3, 0.1)
    return found.select("image_id", "contour_idx", F.round("score", 9).alias("score"), *_sides())


def q_region_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contour of every map, found in tiles of 3 x 5 and joined over their borders."""
    found = regions.region_contours(regions.tiles_of(rasters(spark, sf_dir), 3, 5), 0.1, 3, 5)
    return found.select("image_id", "contour_idx", "hole", "n_pixels", F.round("score", 9).alias("score"), *_sides())


def q_polygon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of its map inside or on every order's box, and its pixels."""
    found = scores.polygon_scores(map_polygons(spark, sf_dir), rasters(spark, sf_dir), ["image_id", "poly_id"])
    return found.select("image_id", "poly_id", "n_pixels", F.round("score", 9).alias("score"))


#: Contours by flooding: foreground by eight neighbours and background by four. An outer border encloses what four-neighbour steps from
#: the edge don't reach without crossing its region; a hole encloses what eight-neighbour steps don't reach, and the foreground beside it.
_FLOOD = """WITH RECURSIVE
px AS (SELECT vec_id AS image_id, k, k // 8 AS y, k % 8 AS x, embedding[k + 1]::DOUBLE AS v, embedding[k + 1]::DOUBLE > 0.1::DOUBLE AS up FROM embeddings, (SELECT unnest(range(64)) AS k)),
step AS (SELECT a.k AS k, b.k AS k2, abs(a.y - b.y) + abs(a.x - b.x) = 1 AS straight FROM (SELECT unnest(range(64)) AS k, k // 8 AS y, k % 8 AS x) a, (SELECT unnest(range(64)) AS k, k // 8 AS y, k % 8 AS x) b
         WHERE greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
links AS (SELECT a.image_id, a.up, a.k, b.k AS k2 FROM px a JOIN step USING (k) JOIN px b ON b.image_id = a.image_id AND b.k = step.k2 AND b.up = a.up WHERE a.up OR straight),
reach(image_id, a, k) AS (SELECT image_id, k, k FROM px UNION SELECT r.image_id, r.a, l.k2 FROM reach r JOIN links l ON l.image_id = r.image_id AND l.k = r.k),
label AS (SELECT image_id, k, min(a) AS region FROM reach GROUP BY ALL),
cell AS (SELECT * FROM px JOIN label USING (image_id, k)),
edge AS (SELECT image_id, region, up, bool_or(y IN (0, 7) OR x IN (0, 7)) AS open FROM cell GROUP BY ALL),
whole AS (SELECT * FROM edge WHERE up OR NOT open),
outside(image_id, region, k) AS (
  SELECT w.image_id, w.region, c.k FROM whole w JOIN cell c USING (image_id) WHERE (c.y IN (0, 7) OR c.x IN (0, 7)) AND c.region <> w.region
  UNION SELECT o.image_id, o.region, c.k FROM outside o JOIN step USING (k) JOIN cell c ON c.image_id = o.image_id AND c.k = step.k2
        JOIN whole w ON w.image_id = o.image_id AND w.region = o.region WHERE c.region <> o.region AND (NOT w.up OR straight)),
beside AS (SELECT DISTINCT w.image_id, w.region, b.k FROM whole w JOIN cell a ON a.image_id = w.image_id AND a.region = w.region JOIN step ON step.k = a.k AND straight
           JOIN cell b ON b.image_id = a.image_id AND b.k = step.k2 JOIN cell s ON s.image_id = w.image_id AND s.k = w.region - 1 AND s.region = b.region WHERE NOT w.up),
filled AS (SELECT w.image_id, w.region, c.k FROM whole w JOIN cell c USING (image_id) ANTI JOIN outside o ON o.image_id = w.image_id AND o.region = w.region AND o.k = c.k UNION SELECT * FROM beside),
score AS (SELECT image_id, region, count(*) AS n_pixels, sum(v) / count(*) AS score FROM filled JOIN px USING (image_id, k) GROUP BY ALL),
spots AS (SELECT w.image_id, w.region, c.k, c.y, c.x FROM whole w JOIN cell c USING (image_id, region) WHERE w.up UNION ALL SELECT image_id, region, k, k // 8, k % 8 FROM beside),
ends AS (SELECT image_id, region, y, min(x) AS x FROM spots GROUP BY ALL UNION SELECT image_id, region, y, max(x) FROM spots GROUP BY ALL),
ways AS (SELECT DISTINCT a.image_id, a.region, b.x - a.x AS dx, b.y - a.y AS dy FROM ends a JOIN ends b USING (image_id, region)),
boxes AS (SELECT image_id, region, dx, dy, (dx * dx + dy * dy)::DOUBLE AS n2, (max(x * dx + y * dy) - min(x * dx + y * dy))::DOUBLE AS w, (max(y * dx - x * dy) - min(y * dx - x * dy))::DOUBLE AS h
          FROM ways JOIN ends USING (image_id, region) GROUP BY ALL),
box AS (SELECT image_id, region, min({'area': coalesce(w * h / nullif(n2, 0), 1e9), 'back': coalesce(-greatest(w * w / nullif(n2, 0), h * h / nullif(n2, 0)), 0),
               'long': coalesce(greatest(w, h) / nullif(sqrt(n2), 0), 0), 'short': coalesce(least(w, h) / nullif(sqrt(n2), 0), 0)}) AS b FROM boxes GROUP BY ALL),
listed AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN up THEN region ELSE region - 1 END) - 1)::INT AS contour_idx, NOT up AS hole, n_pixels, score, round(b.long, 6) AS "long", round(b.short, 6) AS "short"
           FROM whole JOIN score USING (image_id, region) JOIN box USING (image_id, region))
"""
_GRAY = "((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15)"
QUERIES = [q_normalize_bgr, q_gray, q_rgb_clip, q_binarize, q_mask_mean, q_bilinear, q_keep_aspect, q_detector_input, q_flip, q_contours, q_contour_candidates, q_region_contours, q_polygon_scores]
SQL = {
    "q_normalize_bgr": f"""WITH {COLOURS_SQL} SELECT l_orderkey, l_linenumber, round((b - 104.00698793::DOUBLE) * 0.00392156::DOUBLE, 9) AS nb,
round((g - 116.66876762::DOUBLE) * 0.00392156::DOUBLE, 9) AS ng, round((r - 122.67891434::DOUBLE) * 0.00392156::DOUBLE, 9) AS nr FROM pixels""",
    "q_gray": f"WITH {COLOURS_SQL} SELECT l_orderkey, l_linenumber, {_GRAY}::INT AS gray, round(({_GRAY} - 127.5::DOUBLE) * 0.00784313::DOUBLE, 9) AS scaled FROM pixels",
    "q_rgb_clip": f"""WITH {COLOURS_SQL} SELECT l_orderkey, l_linenumber, round((r / 255.0::DOUBLE - 0.4814546::DOUBLE) / 0.26862954::DOUBLE, 9) AS nr,
round((g / 255.0::DOUBLE - 0.4578275::DOUBLE) / 0.26130258::DOUBLE, 9) AS ng, round((b / 255.0::DOUBLE - 0.4082107::DOUBLE) / 0.27577711::DOUBLE, 9) AS nb FROM pixels""",
    "q_binarize": "SELECT vec_id AS image_id, array_to_string(list_transform(embedding::DOUBLE[], lambda v: CASE WHEN v > 0.1::DOUBLE THEN 255 ELSE 0 END), ' ') AS mask FROM embeddings",
    "q_mask_mean": """WITH u AS (SELECT vec_id AS image_id, list_filter(embedding::DOUBLE[], lambda v: v > 0.1::DOUBLE) AS u FROM embeddings)
SELECT image_id, len(u)::INT AS n, round(list_sum(u) / nullif(len(u), 0), 9) AS mean FROM u""",
    "q_bilinear": """WITH k AS (SELECT unnest(range(0, 30))::INT AS at_),
c AS (SELECT at_, (floor(at_ / 6.0::DOUBLE) + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE AS y, (at_ % 6 + 0.5::DOUBLE) * (8 / 6.0::DOUBLE) - 0.5::DOUBLE AS x FROM k),
f AS (SELECT at_, trunc(y)::INT AS y0, trunc(x)::INT AS x0, y - trunc(y) AS fy, x - trunc(x) AS fx FROM c),
t AS (SELECT at_, y0 + dy AS yy, x0 + dx AS xx, CASE dy WHEN 0 THEN 1 - fy ELSE fy END * CASE dx WHEN 0 THEN 1 - fx ELSE fx END AS wt FROM f, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
s AS (SELECT vec_id AS image_id, at_, sum(CASE WHEN yy BETWEEN 0 AND 7 AND xx BETWEEN 0 AND 7 THEN embedding[greatest(0, least(63, yy * 8 + xx)) + 1]::DOUBLE * wt ELSE 0 END) AS v FROM embeddings, t GROUP BY ALL)
SELECT image_id, at_ AS "at", round(v, 9) AS v FROM s""",
    "q_keep_aspect": """WITH k AS (SELECT unnest(range(0, 45))::INT AS at_),
c AS (SELECT at_, at_ // 9 AS r, at_ % 9 AS q, least(7.0, greatest(0.0, (at_ // 9 + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) AS y, least(7.0, greatest(0.0, (at_ % 9 + 0.5::DOUBLE) * 1.6::DOUBLE - 0.5::DOUBLE)) AS x FROM k),
f AS (SELECT at_, q, trunc(y)::INT AS y0, trunc(x)::INT AS x0, y - trunc(y) AS fy, x - trunc(x) AS fx FROM c),
t AS (SELECT at_, q, y0 + dy AS yy, x0 + dx AS xx, CASE dy WHEN 0 THEN 1 - fy ELSE fy END * CASE dx WHEN 0 THEN 1 - fx ELSE fx END AS wt FROM f, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
s AS (SELECT vec_id AS image_id, at_, sum(CASE WHEN q < 5 AND yy <= 7 AND xx <= 7 THEN embedding[least(63, yy * 8 + xx) + 1]::DOUBLE * wt ELSE 0 END) AS v FROM embeddings, t GROUP BY ALL)
SELECT image_id, at_ AS "at", round(v, 9) AS v FROM s""",
    "q_detector_input": """WITH k AS (SELECT unnest(range(0, 48))::INT AS at_),
v AS (SELECT vec_id AS image_id, at_, at_ // 16 AS c, (at_ % 16) // 4 * 2 AS y, at_ % 4 * 2 AS x, embedding FROM embeddings, k),
m AS (SELECT image_id, at_, c, CASE c WHEN 1 THEN (embedding[64 - y * 8 - x]::DOUBLE + embedding[63 - y * 8 - x] + embedding[56 - y * 8 - x] + embedding[55 - y * 8 - x]) / 4
             ELSE (embedding[y * 8 + x + 1]::DOUBLE + embedding[y * 8 + x + 2] + embedding[y * 8 + x + 9] + embedding[y * 8 + x + 10]) / 4 * CASE c WHEN 2 THEN 2 ELSE 1 END END AS v FROM v)
SELECT image_id, at_ AS "at", round((v - CASE c WHEN 0 THEN 104.00698793::DOUBLE WHEN 1 THEN 116.66876762::DOUBLE ELSE 122.67891434::DOUBLE END) * 0.00392156::DOUBLE, 9) AS v FROM m""",
    "q_flip": """SELECT vec_id AS image_id, k AS "at", embedding[64 - k]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64))::INT AS k)""",
    "q_contour_candidates": _FLOOD + 'SELECT image_id, contour_idx, round(score, 9) AS score, "long", "short" FROM listed WHERE contour_idx < 3 AND score >= 0.1 AND "short" >= 1',
    "q_region_contours": _FLOOD + 'SELECT image_id, contour_idx, hole, n_pixels, round(score, 9) AS score, "long", "short" FROM listed',
    "q_polygon_scores": f"""WITH {POLYGONS_SQL},
laid AS (SELECT poly_id, poly_id % 1000 AS image_id, {', '.join(f'trunc(x{i} * 0.02::DOUBLE - 6)::INT AS x{i}, trunc(y{i} * 0.03::DOUBLE - 8)::INT AS y{i}' for i in range(1, 5))} FROM polys WHERE poly_id % 1000 IN (SELECT vec_id FROM embeddings)),
px AS (SELECT vec_id AS image_id, k // 8 AS gy, k % 8 AS gx, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k)),
edges AS ({' UNION ALL '.join(f'SELECT image_id, poly_id, x{i} AS ax, y{i} AS ay, x{i % 4 + 1} AS bx, y{i % 4 + 1} AS by_ FROM laid' for i in range(1, 5))}),
tests AS (SELECT poly_id, edges.image_id, gy, gx, v, (bx - ax) * (gy - ay) = (by_ - ay) * (gx - ax) AND gx BETWEEN least(ax, bx) AND greatest(ax, bx) AND gy BETWEEN least(ay, by_) AND greatest(ay, by_) AS edge,
                 (ay > gy) <> (by_ > gy) AND gx < (bx - ax) * (gy - ay) / nullif(by_ - ay, 0)::DOUBLE + ax AS passed FROM edges JOIN px USING (image_id)),
inside AS (SELECT poly_id, image_id, gy, gx, any_value(v) AS v FROM tests GROUP BY ALL HAVING bool_or(edge) OR count(*) FILTER (passed) % 2 = 1)
SELECT l.image_id, l.poly_id, count(v) AS n_pixels, coalesce(round(sum(v) / nullif(count(v), 0), 9), 0) AS score FROM laid l LEFT JOIN inside USING (image_id, poly_id) GROUP BY ALL""",
}
