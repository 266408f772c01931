"""Regions over tiles, scan-line scores and least boxes against whole-map contours and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import components, contours, regions, scores, tiled_warp
from glyphflow.operators.recognise import warp

from . import by_hand

MAPS = "image_id long, h int, w int, p array<double>"


def maps_of(spark, arrays):
    return spark.createDataFrame([(k, *a.shape, a.ravel().tolist()) if a is not None else (k, 3, 3, None) for k, a in arrays.items()], MAPS)


def rings(n: int) -> np.ndarray:
    y, x = np.mgrid[:n, :n]
    return (np.minimum.reduce([y, x, n - 1 - y, n - 1 - x]) % 2 == 0) * 0.9


def some_maps() -> dict:
    draw = np.random.default_rng(3)
    made = {k: np.where(draw.random(s := (int(draw.integers(1, 22)), int(draw.integers(1, 22)))) < share, 0.5 + draw.random(s) / 2, draw.random(s) / 3) for k, share in enumerate([0.2, 0.4, 0.5, 0.6, 0.7, 0.9] * 4)}
    return made | {100: rings(13), 101: np.ones((5, 7)), 102: np.zeros((4, 4)), 103: None, 104: np.full((1, 1), 0.7), 105: rings(12)[:, 1:], 106: np.where(np.eye(9) > 0, 0.6, np.nan)}


def area_of(pts) -> float:
    w, h, _ = by_hand.min_area_box(pts)
    return w * h


@pytest.mark.parametrize(("height", "width"), [(3, 4), (1, 1), (50, 50)])
def test_tiles_give_the_contours_of_whole_maps(spark, height, width):
    made = some_maps()
    tiles = regions.tiles_of(maps_of(spark, made), height, width)
    got = {(r["image_id"], r["contour_idx"]): r for r in regions.region_contours(tiles, 0.45, height, width).collect()}
    want = {(k, i): (a, pts) for k, a in made.items() if a is not None for i, pts in enumerate(contours.find_contours(np.nan_to_num(a) > 0.45))}
    assert got.keys() == want.keys() and len(want) > 150
    for key, (a, pts) in want.items():
        assert got[key]["score"] == pytest.approx(by_hand.contour_score(a, pts), rel=1e-9, nan_ok=True)
        assert got[key]["box_w"] * got[key]["box_h"] == pytest.approx(area_of(pts), abs=1e-9)
    assert sum(r["hole"] for r in got.values()) > 20


def test_nesting_deeper_than_one_round(spark):
    tiles = regions.tiles_of(maps_of(spark, {1: rings(41)}), 10, 10)
    got = regions.region_contours(tiles, 0.5, 10, 10).where("not hole").orderBy("contour_idx").collect()
    assert [r["n_pixels"] for r in got] == [(41 - 4 * k) ** 2 for k in range(11)]


def test_no_tiles(spark):
    assert regions.region_contours(regions.tiles_of(spark.createDataFrame([], MAPS), 4, 4), 0.5, 4, 4).count() == 0


def test_polygon_scores_match_brute_force(spark):
    draw = random.Random(7)
    wide = np.random.default_rng(1).random((9, 71))
    maps = maps_of(spark, {1: wide, 2: np.random.default_rng(2).random((12, 10)), 3: np.full((2, 2), np.nan), 4: None})
    rows = []
    for k in range(150):
        image = draw.choice([1, 1, 2])
        n = draw.choice([1, 2, 3, 4, 4, 5, 8])
        rows.append((image, k, [(draw.randrange(-6, 78 if image == 1 else 14), draw.randrange(-4, 14)) for _ in range(n)]))
    rows += [(3, 900, [(0, 0), (1, 1)]), (9, 901, [(0, 0)]), (1, 902, []), (1, 903, [(500, 500), (600, 700)]), (1, 904, None), (2, 905, [(0, 0), (0, 5), (0, 0), (5, 0)]), (1, 906, [(-(10**8), 2), (10**8, 2), (10**8, 4), (-(10**8), 4)])]
    polygons = spark.createDataFrame(rows, "image_id long, poly_idx int, pts array<struct<x: int, y: int>>")
    got = {r["poly_idx"]: r for r in scores.polygon_scores(polygons, maps, ["image_id", "poly_idx"]).collect()}
    arrays = {1: wide, 2: np.random.default_rng(2).random((12, 10))}
    for image, k, pts in rows:
        if k < 900 or k == 905:
            want = np.nan_to_num(by_hand.contour_score(arrays[image], pts))  # no pixel at all: 0
            assert got[k]["score"] == pytest.approx(want, abs=1e-12), (k, pts)
    assert got.keys() == {*range(150), 900, 903, 905, 906}
    assert np.isnan(got[900]["score"]) and (got[903]["n_pixels"], got[903]["score"]) == (0, 0.0)
    assert got[906]["n_pixels"] == 3 * 71


def test_hulls_and_least_boxes(spark):
    draw = random.Random(5)
    sets = [[(draw.randrange(-20, 20), draw.randrange(-20, 20)) for _ in range(draw.choice([1, 2, 3, 5, 30]))] for _ in range(80)] + [[(0, 0)] * 3, [(0, 0), (1, 1), (2, 2)], [(3, y) for y in range(6)], []]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(sets)], "k int, pts array<struct<x: int, y: int>>")
    got = {r["k"]: r for r in rows.withColumn("corners", scores.hull(F.col("pts"))).withColumn("b", scores.least_box(F.col("corners"))).collect()}
    by_points = {r["k"]: r for r in scores.least_boxes(rows.select("k", F.explode("pts").alias("p")).select("k", "p.y", F.col("p.x").alias("x0"), F.col("p.x").alias("x1")), ["k"]).collect()}
    for k, pts in enumerate(sets):
        if not pts:
            assert got[k]["b"] is None and k not in by_points
            continue
        assert {tuple(c) for c in got[k]["corners"]} == {tuple(map(int, c)) for c in by_hand.hull(pts)}
        b = got[k]["b"]
        assert b["box_w"] * b["box_h"] == pytest.approx(area_of(pts), abs=1e-9)
        box, (u, v) = np.array([tuple(c) for c in b["box"]]), (np.array([tuple(c) for c in b["box"]])[[2, 0]] - np.array(tuple(b["box"][1])))
        assert np.linalg.norm(u) == pytest.approx(b["box_w"]) and np.linalg.norm(v) == pytest.approx(b["box_h"]) and u @ v == pytest.approx(0, abs=1e-6)
        assert u[0] >= 0 and abs(u[1]) <= u[0] + 1e-9
        if b["box_w"] > 0 and b["box_h"] > 0:
            inside = (np.array(pts) - box[1]) @ np.stack([u / (u @ u), v / (v @ v)], 1)
            assert (inside > -1e-9).all() and (inside < 1 + 1e-9).all()
        assert {c: by_points[k][c] for c in ("box_w", "box_h")} == {c: b[c] for c in ("box_w", "box_h")}


def test_components(spark):
    draw = random.Random(1)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3)]
    root = {i: i for pair in links for i in pair if i is not None}
    for _ in range(60):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(n, r) for n, r in root.items() if n != r}


def test_crops_from_tiles_equal_crops_from_whole_maps(spark):
    draw = np.random.default_rng(8)
    made = {1: draw.random((11, 17)), 2: draw.random((6, 5)), 3: None}
    matrices = [[1.0, 0.2, 1.3, -0.1, 0.9, 2.2, 0.0, 0.0, 1.0], [2.1, 0.0, -3.0, 0.3, 1.7, -2.5, 0.01, -0.02, 1.0], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.25, 0.0, -1.0], [0.0] * 9, [1e12, 0, 0, 0, 1, 0, 0, 0, 1.0]]
    rows = [(i, k, [float(x) for x in m]) for i in (1, 2, 3) for k, m in enumerate(matrices)] + [(1, 9, None), (8, 0, matrices[0])]
    regions_of = spark.createDataFrame(rows, "image_id long, poly_idx int, m array<double>")
    tiles = regions.tiles_of(maps_of(spark, made), 4, 3)
    got = {(r["image_id"], r["poly_idx"]): r["crop"] for r in tiled_warp.crops(regions_of, tiles, ["image_id", "poly_idx"], 6, 7, 4, 3).collect()}
    assert got.keys() == {(i, k) for i, k, m in rows if m}
    for (i, k), crop in got.items():
        want = np.zeros((6, 7)) if made.get(i) is None else warp(made[i][..., None], np.array([matrices[k]]), 6, 7)[0, ..., 0]
        assert np.array(crop).reshape(6, 7) == pytest.approx(want, abs=1e-9), (i, k)
    assert tiled_warp.crops(regions_of.limit(0), tiles, ["image_id", "poly_idx"], 6, 7, 4, 3).count() == 0
