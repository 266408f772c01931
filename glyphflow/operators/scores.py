"""Scores and boxes of polygons in column expressions: scan-line spans against prefix sums, and least boxes of hulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a line between two sums that are kept: a prefix sum adds at most so many values to one of them.
STRIDE = 32


def line_prefixes(maps: DataFrame) -> DataFrame:
    """image_id, y, ``sums`` (w + 1 values: what lies left of each place) of every line of maps (image_id, h, w, p)."""
    lines = maps.where((F.col("h") > 0) & (F.col("w") > 0) & F.col("p").isNotNull()).select("image_id", "w", "p", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    cut = lines.select("image_id", "y", "w", F.slice("p", F.col("y") * F.col("w") + 1, F.col("w")).alias("line"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    stretch = lambda k: F.slice("line", k * STRIDE + 1, F.lit(STRIDE))
    whole = cut.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor(F.col("w") / STRIDE).cast("int")), lambda k: add(stretch(k))))
    whole = whole.withColumn("before", F.transform("blocks", lambda v, k: add(F.slice("blocks", F.lit(1), k))))
    inside = lambda x: F.floor(x / STRIDE).cast("int")
    sums = F.transform(F.sequence(F.lit(0), F.col("w")), lambda x: F.get("before", inside(x)) + add(F.slice("line", inside(x) * STRIDE + 1, x % STRIDE)))
    return whole.select("image_id", "y", sums.alias("sums"))


def scan_lines(polygons: DataFrame, maps: DataFrame, key: list[str]) -> DataFrame:
    """``key``, y, spans: where each line of the map runs inside or on a polygon (``key`` with image_id, pts), cut to the map.

    Spans are arrays of (x0, x1), both inside, ordered; they may overlap. Inside is even-odd.
    """
    sized = polygons.join(maps.select("image_id", "h", "w"), "image_id")
    edges = sized.select(*key, "h", "w", F.explode(F.transform("pts", lambda q, i: F.struct(q.alias("a"), F.get("pts", (i + 1) % F.size("pts")).alias("b")))).alias("e"))
    ax, ay, bx, by = (F.col(f"e.{c}").cast("long") for c in ("a.x", "a.y", "b.x", "b.y"))
    edges = edges.select(*key, "w", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), F.greatest(F.least(ay, by), F.lit(0)).alias("low"), F.least(F.greatest(ay, by), F.col("h") - 1).alias("high"))
    met = edges.where("low <= high").withColumn("y", F.explode(F.sequence("low", "high")))
    ax, ay, bx, by, y = (F.col(c) for c in ("ax", "ay", "bx", "by", "y"))
    run = (bx - ax) * (y - ay)
    crossing = F.when((ay > y) != (by > y), run / F.nullif((by - ay), F.lit(0)) + ax)
    on = F.when(ay == by, F.struct(F.least(ax, bx).alias("x0"), F.greatest(ax, bx).alias("x1")))
    on = on.when(F.try_mod(run, by - ay) == 0, F.struct((ax + F.expr("try_divide((bx - ax) * (y - ay), by - ay)").cast("long")).alias("x0"), (ax + F.expr("try_divide((bx - ax) * (y - ay), by - ay)").cast("long")).alias("x1")))
    lines = met.withColumns({"cross": crossing, "on": on}).groupBy(*key, "y").agg(F.first("w").alias("w"), F.array_sort(F.collect_list("cross")).alias("cross"), F.collect_set("on").alias("on"))
    pairs = F.when(F.size("cross") > 0, F.transform(F.sequence(F.lit(0), F.floor(F.size("cross") / 2).cast("int") - 1), lambda k: F.struct(F.ceil(F.get("cross", 2 * k)).alias("x0"), (F.ceil(F.get("cross", 2 * k + 1)) - 1).alias("x1"))))
    every = F.concat("on", F.coalesce(pairs, F.array().cast("array<struct<x0: bigint, x1: bigint>>")))
    cut = F.transform(every, lambda s: F.struct(F.greatest(s["x0"], F.lit(0)).alias("x0"), F.least(s["x1"], F.col("w") - 1).alias("x1")))
    return lines.select(*key, "y", F.array_sort(F.filter(cut, lambda s: s["x0"] <= s["x1"])).alias("spans"))


def polygon_scores(polygons: DataFrame, maps: DataFrame, key: list[str]) -> DataFrame:
    """``key``, n_pixels, score: the mean value of the map's pixels inside or on each polygon.

    ``polygons`` has ``key`` (image_id among it) and pts (array of whole x and y, closed by itself), ``maps`` unique image_id, h,
    w and p (row-major). A polygon's scan lines meet the lines' prefix sums by image and line, and a span costs two
    look-ups, however long it is. A polygon outside its map has 0 pixels and score 0; one without points
    or without a map has no row; a null value inside makes the score null. Repeated keys count as one polygon of all their edges.
    """
    spans = scan_lines(polygons, maps, key).join(line_prefixes(maps), ["image_id", "y"])

    def step(acc: Column, s: Column) -> Column:
        first = F.greatest(s["x0"], acc["reach"] + 1)
        new = first <= s["x1"]
        total = acc["total"] + F.get("sums", (s["x1"] + 1).cast("int")) - F.get("sums", first.cast("int"))
        return F.struct(
            F.greatest(acc["reach"], s["x1"]).alias("reach"), F.when(new, acc["n"] + s["x1"] - first + 1).otherwise(acc["n"]).alias("n"), F.when(new, total).otherwise(acc["total"]).alias("total")
        )

    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
    lines = spans.select(*key, F.aggregate("spans", start, step).alias("line")).groupBy(*key).agg(F.sum("line.n").alias("n_pixels"), F.sum("line.total").alias("total"))
    known = polygons.where(F.size("pts") > 0).join(maps.select("image_id"), "image_id", "left_semi").select(*key).distinct()
    score = F.when(F.coalesce(F.col("n_pixels"), F.lit(0)) == 0, 0.0).otherwise(F.col("total") / F.col("n_pixels"))
    return known.join(lines, key, "left").select(*key, F.coalesce("n_pixels", F.lit(0).cast("long")).alias("n_pixels"), score.alias("score"))


def _turn(a: Column, b: Column, c: Column) -> Column:
    """Twice the area of a triangle, above 0 where it turns left; whole numbers."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def hull(points: Column) -> Column:
    """The convex hull's corners of an array of structs with whole x and y, in order around it; fewer than three points stay as they are.

    A point is added to a half hull by keeping its corners up to the tangent: those before which the turn stays left.
    """
    kind = "array<struct<x: bigint, y: bigint>>"
    ordered = F.array_sort(F.array_distinct(points.cast(kind)))

    def half(ordered: Column) -> Column:
        def add(kept: Column, q: Column) -> Column:
            tangent = F.filter(kept, lambda c, i: (i == 0) | (_turn(F.get(kept, i - 1), c, q) > 0))
            return F.concat(tangent, F.array(q))

        chain = F.aggregate(ordered, F.array().cast(kind), add)
        return F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0)))

    return F.when(F.size(ordered) < 3, ordered).otherwise(F.concat(half(ordered), half(F.reverse(ordered))))


def least_box(corners: Column) -> Column:
    """The rotated rectangle of least area on an edge of a hull: struct of box_w, box_h and box (bottom left, top left, top right, bottom right).

    The width lies along the side that is nearer to the level one. Of equal areas the longer box counts, then the edge of smaller direction: the result doesn't depend on the order of the corners.
    Extents are whole numbers over the edge's length, so equal areas are equal numbers. A single point has a box of no size; none gives null.
    """

    def way(i: Column) -> Column:
        a, b = F.get(corners, i), F.get(corners, (i + 1) % F.size(corners))
        return F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    def turned(e: Column) -> Column:
        """The one of the four directions of a rectangle on the edge that points right, by less than 45 degrees up and 45 at most down."""
        dx, dy = e["dx"], e["dy"]
        as_struct = lambda x, y: F.struct(x.alias("dx"), y.alias("dy"))
        right, down, left = (dx > 0) & (dy > -dx) & (dy <= dx), (dy > 0) & (dx >= -dy) & (dx < dy), (dx < 0) & (dy >= dx) & (dy < -dx)
        return F.when(right, as_struct(dx, dy)).when(down, as_struct(dy, -dx)).when(left, as_struct(-dx, -dy)).otherwise(as_struct(-dy, dx))

    def of(e: Column) -> Column:
        along, across = F.transform(corners, lambda p: p["x"] * e["dx"] + p["y"] * e["dy"]), F.transform(corners, lambda p: p["y"] * e["dx"] - p["x"] * e["dy"])
        return F.struct(e["dx"].alias("dx"), e["dy"].alias("dy"), F.array_min(along).alias("s0"), F.array_max(along).alias("s1"), F.array_min(across).alias("t0"), F.array_max(across).alias("t1"))

    def measured(e: Column) -> Column:
        n2 = (e["dx"] * e["dx"] + e["dy"] * e["dy"]).cast("double")
        w, h = (e["s1"] - e["s0"]).cast("double"), (e["t1"] - e["t0"]).cast("double")
        return F.struct((w * h / n2).alias("area"), (-F.greatest(w * w / n2, h * h / n2)).alias("long"), e["dx"].alias("dx"), e["dy"].alias("dy"), *(e[c].alias(c) for c in ("s0", "s1", "t0", "t1")))

    ways = F.filter(F.transform(F.sequence(F.lit(0), F.size(corners) - 1), way), lambda e: (e["dx"] != 0) | (e["dy"] != 0))
    best = F.array_min(F.transform(F.transform(F.transform(ways, turned), of), measured))

    def box(e: Column) -> Column:
        n2 = (e["dx"] * e["dx"] + e["dy"] * e["dy"]).cast("double")
        n = F.sqrt(n2)
        corner = lambda s, t: F.struct(((e[s] * e["dx"] - e[t] * e["dy"]) / n2).alias("x"), ((e[s] * e["dy"] + e[t] * e["dx"]) / n2).alias("y"))
        return F.struct(((e["s1"] - e["s0"]) / n).alias("box_w"), ((e["t1"] - e["t0"]) / n).alias("box_h"), F.array(corner("s0", "t1"), corner("s0", "t0"), corner("s1", "t0"), corner("s1", "t1")).alias("box"))

    point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    lone = F.struct(F.lit(0.0).alias("box_w"), F.lit(0.0).alias("box_h"), F.array_repeat(point(F.get(corners, F.lit(0))), 4).alias("box"))
    one = F.get(F.transform(F.array(best), box), F.lit(0))
    return F.when(F.size(corners) == 1, lone).when(F.size(corners) > 1, one)


def least_boxes(points: DataFrame, key: list[str]) -> DataFrame:
    """``key``, box_w, box_h, box of the points (``key``, y, x0, x1: stretches of lines, or single pixels with x0 = x1) of each key.

    Only a line's first and last point can be corners of a hull, so points are reduced to these where they lie and
    again behind the shuffle; a key's hull is built from two points a line.
    """
    lines = points.groupBy(*key, "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    ends = F.flatten(F.collect_list(F.array(*(F.struct(F.col(c).cast("long").alias("x"), F.col("y").cast("long").alias("y")) for c in ("x0", "x1")))))
    made = lines.groupBy(*key).agg(ends.alias("ends")).withColumn("corners", hull(F.col("ends"))).withColumn("b", least_box(F.col("corners")))
    return made.select(*key, "b.*")
