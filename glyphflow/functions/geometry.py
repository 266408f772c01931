"""Geometry of text polygons as column expressions on four vertices; no UDF, so all of it stays in generated code.

A polygon is four (x, y) pairs of columns in order around the shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def vertices(prefix: str = "") -> list[Point]:
    """Columns x1, y1 .. x4, y4."""
    return [(F.col(f"{prefix}x{i}"), F.col(f"{prefix}y{i}")) for i in range(1, 5)]


def distance(a: Point, b: Point) -> Column:
    dx, dy = (a[0] - b[0]).cast("double"), (a[1] - b[1]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def area(p: list[Point]) -> Column:
    """Shoelace, without sign."""
    twice = reduce(lambda s, t: s + t, (p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4)))
    return F.abs(twice.cast("double")) / 2


def perimeter(p: list[Point]) -> Column:
    return reduce(lambda s, t: s + t, (distance(p[i], p[(i + 1) % 4]) for i in range(4)))


def growth(p: list[Point], ratio: float) -> Column:
    """How far the edges of a polygon move outward: area * ratio / perimeter; null without a perimeter."""
    return area(p) * ratio / F.nullif(perimeter(p), F.lit(0.0))


def with_unclipped(df: DataFrame, ratio: float, by: Column | None = None) -> DataFrame:
    """Columns x1..y4 grown by ``by`` (their ``growth``, if not given) and cut to integers.

    Every edge moves outward along its normal and neighbouring edges meet in their intersection; where they are nearly
    parallel (|cos| > 0.7) the middle of their far ends takes its place: of the vertex before, moved with the first edge, and the
    vertex behind, moved with the second. A zero-length edge gives null vertices. Shared parts are columns of their own, so
    that expressions stay small.
    """
    p = vertices()
    df = df.withColumn("_by", growth(p, ratio) if by is None else by)
    for i in range(4):
        (ax, ay), (bx, by) = p[i], p[(i + 1) % 4]
        vx, vy = (bx - ax).cast("double"), (by - ay).cast("double")
        df = df.withColumn(f"_n{i}", F.nullif(F.sqrt(vx * vx + vy * vy), F.lit(0.0)))
        n, d = F.col(f"_n{i}"), F.col("_by")
        df = df.withColumns({f"_ox{i}": vy * d / n, f"_oy{i}": -vx * d / n, f"_ux{i}": vx / n, f"_uy{i}": vy / n})
    new = {}
    for i in range(4):
        k = (i + 3) % 4  # the edge that ends in vertex i; edge i begins there
        a0 = (p[k][0] + F.col(f"_ox{k}"), p[k][1] + F.col(f"_oy{k}"))
        b0 = (p[i][0] + F.col(f"_ox{i}"), p[i][1] + F.col(f"_oy{i}"))
        b1 = (p[(i + 1) % 4][0] + F.col(f"_ox{i}"), p[(i + 1) % 4][1] + F.col(f"_oy{i}"))
        u, v = (F.col(f"_ux{k}"), F.col(f"_uy{k}")), (F.col(f"_ux{i}"), F.col(f"_uy{i}"))
        cross = F.nullif(u[0] * v[1] - u[1] * v[0], F.lit(0.0))
        t = ((b0[0] - a0[0]) * v[1] - (b0[1] - a0[1]) * v[0]) / cross
        flat = F.abs(u[0] * v[0] + u[1] * v[1]) > 0.7
        new[f"_x{i + 1}"] = F.when(flat, (a0[0] + b1[0]) / 2).otherwise(a0[0] + t * u[0]).cast("int")
        new[f"_y{i + 1}"] = F.when(flat, (a0[1] + b1[1]) / 2).otherwise(a0[1] + t * u[1]).cast("int")
    df = df.withColumns(new).withColumns({c[1:]: F.col(c) for c in new})
    return df.drop("_by", *new, *(f"_{c}{i}" for c in ("n", "ox", "oy", "ux", "uy") for i in range(4)))


def with_corners(df: DataFrame, rotation_threshold: float = 0.0) -> DataFrame:
    """Columns tl, tr, br, bl (structs of x and y): the two left vertices by height, then the two right.

    The corners are turned by one where width / height is below the threshold. Equal x are told apart by the vertex number.
    """
    points = F.array(*(F.struct(x.alias("x"), F.lit(i).alias("i"), y.alias("y")) for i, (x, y) in enumerate(vertices())))
    df = df.withColumn("_o", F.array_sort(points))
    df = df.withColumns({f"_p{i}": F.struct(F.get("_o", F.lit(i))["x"].alias("x"), F.get("_o", F.lit(i))["y"].alias("y")) for i in range(4)})
    left, right = F.col("_p0.y") <= F.col("_p1.y"), F.col("_p2.y") <= F.col("_p3.y")
    pick = lambda test, a, b: F.when(test, F.col(a)).otherwise(F.col(b))
    df = df.withColumns({"_tl": pick(left, "_p0", "_p1"), "_bl": pick(left, "_p1", "_p0"), "_tr": pick(right, "_p2", "_p3"), "_br": pick(right, "_p3", "_p2")})
    pt = lambda c: (F.col(f"{c}.x"), F.col(f"{c}.y"))
    df = df.withColumn("_turn", distance(pt("_tl"), pt("_tr")) < rotation_threshold * distance(pt("_tl"), pt("_bl")))
    turned = {"tl": pick(F.col("_turn"), "_bl", "_tl"), "tr": pick(F.col("_turn"), "_tl", "_tr"), "br": pick(F.col("_turn"), "_tr", "_br"), "bl": pick(F.col("_turn"), "_br", "_bl")}
    return df.withColumns(turned).drop("_o", "_turn", "_tl", "_tr", "_br", "_bl", *(f"_p{i}" for i in range(4)))


def homography(p: list[Point], width: int, height: int) -> list[Column]:
    """The nine row-major coefficients that map (0,0), (w,0), (w,h), (0,h) to the quad (Heckbert 1989); null if degenerate."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((x.cast("double"), y.cast("double")) for x, y in p)
    dx1, dx2, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    den = F.nullif(dx1 * dy2 - dx2 * dy1, F.lit(0.0))
    g, k = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    w, h = float(width), float(height)
    return [(x1 - x0 + g * x1) / w, (x3 - x0 + k * x3) / h, x0 + 0 * den, (y1 - y0 + g * y1) / w, (y3 - y0 + k * y3) / h, y0 + 0 * den, g / w, k / h, F.lit(1.0) + 0 * den]


def project(m: list[Column], u: Column, v: Column) -> Point:
    """Where a homography takes (u, v)."""
    z = F.nullif(m[6] * u + m[7] * v + m[8], F.lit(0.0))
    return (m[0] * u + m[1] * v + m[2]) / z, (m[3] * u + m[4] * v + m[5]) / z


def bounding_box(p: list[Point]) -> tuple[Column, Column, Column, Column]:
    """left, top, width, height."""
    xs, ys = [x for x, _ in p], [y for _, y in p]
    return F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)


def rescale(p: list[Point], sx: Column, sy: Column) -> list[Point]:
    """Scaled, cut to integers toward zero."""
    return [((x * sx).cast("int"), (y * sy).cast("int")) for x, y in p]


def source_scale(height: Column, width: Column, to_height: Column | int, to_width: Column | int, keep_aspect: bool) -> tuple[Column, Column]:
    """(x, y) scales from a canvas back to the source: one for both axes where the resize kept the aspect."""
    sx, sy = (n / (to.cast("double") if isinstance(to, Column) else float(to)) for n, to in ((width, to_width), (height, to_height)))
    return (F.greatest(sx, sy), F.greatest(sx, sy)) if keep_aspect else (sx, sy)
