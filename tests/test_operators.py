"""Hand-computed cases of the recognition operators."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.config import OcrConfig
from glyphflow.functions import decode, pixels, tiling
from glyphflow.functions import geometry as g
from glyphflow.functions.text import token_words
from glyphflow.functions import text as t
from glyphflow.operators import bpe, contours, results
from glyphflow.operators.contours import find_contours
from glyphflow.operators.recognise import StubDetector, StubMatrixRecogniser, StubRecogniser, warp
from glyphflow.operators.results import POLY
from glyphflow.plans import catalogue, recognition
from glyphflow.sources import files

from .by_hand import contour_score, min_area_box, plain_warp
from .conftest import SF


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ints(*values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


@pytest.mark.parametrize(("ids", "text", "conf"), [((1, 1, 0, 1, 2, 2, 0), "aab", 0.5 * 0.5 * 0.5), ((0, 0, 0), "", 1.0), ((1, 9, 2), "ab", 0.25), ((), "", 1.0)])
def test_ctc(spark, ids, text, conf):
    probs = F.array(*(F.lit(0.5) for _ in ids)) if ids else F.array().cast("array<double>")
    a, b = decode.ctc(ints(*ids), probs, decode.ctc_dictionary(["a", "b"]))
    assert tuple(one(spark, a, b)) == (text, pytest.approx(conf))


def test_attention_and_transformer(spark):
    a, b = decode.attention(ints(2, 3, 1, 2), F.array(*map(F.lit, (0.5, 0.5, 0.1, 0.1))), decode.attention_dictionary(["a", "b"]))
    assert tuple(one(spark, a, b)) == ("ab", 0.25)
    rows = F.array(*(F.array(*map(F.lit, r)) for r in ((0.1, 0.8, 0.1), (0.0, 0.1, 0.5), (0.5, 0.2, 0.5))))
    a, b = decode.transformer(rows, decode.transformer_dictionary(["A", "b"])[:3], only_lowercase=True)
    assert tuple(one(spark, a, b)) == ("ab", pytest.approx(0.8 * 0.5 * 0.5))


def test_fixed_tokens_and_bytes(spark):
    assert one(spark, decode.fixed_tokens(ints(1, 2, 3), 9, 6))[0] == [1, 2, 3, 0, 0, 0]
    assert one(spark, decode.fixed_tokens(ints(1, 2, 3, 4), 9, 3))[0] == [1, 2, 9]
    assert tuple(one(spark, *decode.cut_bytes(F.lit("é" * 40), 63))) == ("é" * 31, 80)


def test_unclip_and_corners(spark):
    box = spark.createDataFrame([(100, 140, 100, 100, 200, 100, 200, 140)], POLY)
    assert tuple(g.with_unclipped(box, 1.5).select(*POLY).first()) == (78, 161, 78, 78, 221, 78, 221, 161)
    row = g.with_corners(box).first()
    assert [tuple(row[c]) for c in ("tl", "tr", "br", "bl")] == [(100, 100), (200, 100), (200, 140), (100, 140)]
    assert g.with_unclipped(spark.createDataFrame([(1, 1) * 4], POLY), 1.5).first()["x1"] is None


def test_homography_maps_corners(spark):
    quad = [(10.0, 20.0), (110.0, 30.0), (100.0, 80.0), (5.0, 70.0)]
    m = g.homography([(F.lit(x), F.lit(y)) for x, y in quad], 100, 32)
    for (u, v), want in zip(((0, 0), (100, 0), (100, 32), (0, 32)), quad, strict=True):
        assert tuple(one(spark, *g.project(m, F.lit(float(u)), F.lit(float(v))))) == pytest.approx(want)


def test_tiles(spark):
    assert tuple(one(spark, tiling.canvas(F.lit(1000), 320, 160), tiling.tile_count(F.lit(1000), 320, 160))) == (1120, 6)
    assert tuple(one(spark, tiling.canvas(F.lit(320), 320, 160), tiling.tile_count(F.lit(100), 320, 160))) == (320, 1)


def test_text(spark):
    assert one(spark, t.token_words(F.lit("x_y 's")))[0] == ["x", "y", "'s"]
    assert one(spark, t.basic_clean(F.lit(" &amp;lt;b&gt; ")))[0] == "<b>"


def test_bpe(spark):
    assert bpe.merge_word("the", {("t", "h"): 0, ("th", "e</w>"): 1}) == ["the</w>"]
    rows = spark.createDataFrame([(1, "the The"), (2, None), (3, "")], "k int, text string")
    got = {r["k"]: r["ids"] for r in bpe.encode(rows, ["k"], "text", [("t", "h"), ("th", "e</w>")]).collect()}
    assert got == {1: [513, 513], 2: [], 3: []}


def test_bpe_keys_may_repeat_and_be_null(spark):
    rows = spark.createDataFrame([(1, "the"), (1, "of the"), (None, "the the"), (None, None)], "k int, text string")
    got = sorted(((r["k"], r["ids"]) for r in bpe.encode(rows, ["k"], "text", [("t", "h"), ("th", "e</w>")]).collect()), key=str)
    assert got == sorted([(1, [513]), (1, [78, 325, 513]), (None, [513, 513]), (None, [])], key=str)
    assert bpe.encode(rows.limit(0), ["k"], "text", []).count() == 0


def test_long_tokens_merge_as_a_plain_loop_does():
    draw, begins = random.Random(2), time.process_time()

    def plain(word, ranks):
        parts = [*word[:-1], word[-1] + bpe.END]
        while pairs := [p for p in zip(parts, parts[1:], strict=False) if p in ranks]:
            pair, merged = min(pairs, key=ranks.get), []
            while parts:
                n = 2 if tuple(parts[:2]) == pair else 1
                merged.append("".join(parts[:n]))
                parts = parts[n:]
            parts = merged
        return parts

    for _ in range(400):
        some = ["a", "b", "aa", "ab", "ba", "aab", "a</w>", "b</w>", "ab</w>"]
        ranks = {pair: k for k, pair in enumerate(dict.fromkeys((draw.choice(some[:6]), draw.choice(some)) for _ in range(12)))}
        word = "".join(draw.choice("aab") for _ in range(draw.randint(1, 40)))
        assert bpe.merge_word(word, ranks) == plain(word, ranks)
    bpe.merge_word("".join(draw.choice("ab") for _ in range(100_000)), ranks)
    assert time.process_time() - begins < 5


def test_batches_of_skewed_and_null_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") * F.col("id")).alias("k"), "id").repartition(5)
    got = results.batches(rows, 16, "k").orderBy("batch", "slot").collect()
    assert [(r["batch"], r["slot"]) for r in got] == [(n // 16, n % 16) for n in range(3000)]
    keys = [r["k"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and sorted(r["id"] for r in got) == [*range(3000)]
    assert results.batches(rows.limit(0), 16, "k").count() == 0
    twice = results.batches(spark.createDataFrame([("b", 1), ("a", 2), ("b", 1)], "k string, v int"), 2, "k", "v")
    assert sorted(tuple(r) for r in twice.collect()) == [("a", 2, 0, 0), ("b", 1, 0, 1), ("b", 1, 1, 0)]


def test_results_of_odd_rows(spark):
    images = spark.createDataFrame([(1,), (1,), (2,), (None,)], "image_id int")
    found = spark.createDataFrame([(1, None, *range(8), "a", 0.5), (1, 0, *range(8), None, None), (None, 3, *range(8), "c", 0.5)], ["image_id", "poly_idx", *POLY, "text", "conf"])
    assert sorted(((r["image_id"], r["text_count"]) for r in results.counts(images, found).collect()), key=str) == sorted([(1, 2), (1, 2), (2, 0), (None, 0)], key=str)
    assert sorted(r["json"][:12] for r in results.json_results(found).collect()) == ['[{"text":"a"', '[{"text":"c"']
    assert results.json_results(found.limit(0)).count() == results.counts(images.limit(0), found).count() == 0


def test_contours_of_odd_maps(spark):
    maps = spark.createDataFrame([(1, 2, 2, None), (2, 0, 0, []), (3, 2, 2, [1.0]), (4, 1, 2, [0.9, float("nan")]), (5, 2, 2, [0.0] * 4), (6, 2, 2, None)], "image_id long, h int, w int, p array<double>")
    got = contours.contours(maps, 0.5).collect()
    assert [(r["image_id"], r["contour_idx"], r["score"], r["box_w"]) for r in got] == [(4, 0, 0.9, 0.0)]
    assert recognition.texts(maps, OcrConfig(), StubRecogniser()).count() == 0
    assert recognition.image_texts(maps, OcrConfig(tile=8), StubDetector(), StubRecogniser(), tiled=True).count() == 0


def test_images_of_any_size_are_detected_at_one(spark):
    big = np.zeros((40, 90))
    big[8:20, 10:50] = 1.0
    images = spark.createDataFrame([(1, 40, 90, big.ravel().tolist()), (2, 90, 40, big.T.ravel().tolist()), (3, 20, 45, big[::2, ::2].ravel().tolist())], "image_id long, h int, w int, p array<double>")
    for keep in (False, True):
        config = OcrConfig(detect_height=32, detect_width=48, keep_aspect_ratio=keep, unclip_ratio=0.01, binarize_threshold=0.4)
        got = {r["image_id"]: r for r in recognition.image_texts(images, config, StubDetector(), StubRecogniser()).collect()}
        assert got.keys() == {1, 2, 3}
        for k, (x0, y0, x1, y1) in {1: (10, 8, 49, 19), 2: (8, 10, 19, 49), 3: (5, 4, 24, 9)}.items():
            r = got[k]
            assert abs(min(r["x1"], r["x2"]) - x0) <= 3 and abs(max(r["x3"], r["x4"]) - x1) <= 4 and abs(min(r["y2"], r["y3"]) - y0) <= 3 and abs(max(r["y1"], r["y4"]) - y1) <= 4
            assert r["text"] and r["conf"] > 0.5
    tiles = recognition.image_texts(images, OcrConfig(tile=16, overlap_rate=0.5, unclip_ratio=0.01, binarize_threshold=0.4), StubDetector(), StubRecogniser(), tiled=True)
    spread = {r["image_id"]: r for r in tiles.collect()}
    assert abs(spread[1]["x3"] - 49) <= 4 and abs(spread[3]["x3"] - 24) <= 3 and spread.keys() == {1, 2, 3}


def test_colour_crops_and_batches(spark):
    seen = []

    class Model(StubRecogniser):
        def __call__(self, crops):
            assert crops.ndim == 4 and crops.shape[3] == 3 and len(crops) <= 2
            seen.append(len(crops))
            return super().__call__(crops)

    image = np.zeros((12, 20, 3))
    image[3:8, 2:7] = image[3:8, 12:17] = (1.0, 0.8, 0.6)
    images = spark.createDataFrame([(k, 12, 20, image.ravel().tolist()) for k in range(3)], "image_id long, h int, w int, p array<double>")
    config = OcrConfig(recognise_batch=2, detect_batch=2)
    assert recognition.image_texts(images, config, StubDetector(), Model()).count() == 6
    same = warp(image, np.stack([np.eye(3), np.diag([1.0, 1.0, 0.0])]), 12, 20)
    assert (same[0] == image).all() and (same[1] == 0).all()


def test_far_ends_of_nearly_straight_corners(spark):
    """A quad with a nearly straight corner: there the middle of the moved neighbours takes the corner's place."""
    quad = (0, 100, 0, 0, 100, -10, 200, 0)
    p, n = np.array(quad, float).reshape(4, 2), 4
    area = abs(sum(p[i][0] * p[(i + 1) % n][1] - p[(i + 1) % n][0] * p[i][1] for i in range(n))) / 2
    by = area * 1.5 / sum(np.linalg.norm(p[i] - p[i - 1]) for i in range(n))
    moved = []
    for i in range(n):
        e = p[i] - p[i - 1]
        shift = np.array([e[1], -e[0]]) * by / np.linalg.norm(e)
        moved.append((p[i - 1] + shift, p[i] + shift))
    want = np.trunc((moved[2][0] + moved[3][1]) / 2)
    got = g.with_unclipped(spark.createDataFrame([quad], POLY), 1.5).first()
    assert (got["x3"], got["y3"]) == tuple(want)


def test_contours():
    mask = np.zeros((6, 7), bool)
    mask[1:5, 1:6] = True
    assert find_contours(mask) == [[(1, 1), (1, 4), (5, 4), (5, 1)]]
    assert sorted(min_area_box(find_contours(mask)[0])[:2]) == [3.0, 4.0]
    assert contour_score(mask * 0.5, find_contours(mask)[0]) == pytest.approx(0.5)
    mask[2:4, 2:5] = False
    assert len(find_contours(mask)) == 2
    assert find_contours(np.zeros((3, 3), bool)) == []
    noise = np.random.default_rng(0).random((12, 12)) > 0.5
    assert all(0 <= x < 12 and 0 <= y < 12 and noise[y, x] for c in find_contours(noise) for x, y in c)


def test_config():
    assert OcrConfig.from_properties("decoder: attention\nunclip_ratio:2").unclip_ratio == 2.0
    assert OcrConfig.from_json('{"upside_down": true}').upside_down
    for bad in ({"binarize_threshold": 0}, {"unclip_ratio": -1}, {"decoder": "x"}, {"overlap_rate": 1.0}):
        with pytest.raises(ValueError):
            OcrConfig(**bad)


def test_files(spark, tmp_path):
    for name in ("b.jpg", "a.png", "c.JPG", "d.txt"):
        (tmp_path / name).write_bytes(b"xy")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.jpg").write_bytes(b"z")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).select("path").collect()) == ["a.png", "b.jpg"]
    (tmp_path / "symbols.txt").write_text("a\nb\n c\n\n")
    path = str(tmp_path / "symbols.txt")
    assert files.lines(spark, path) == ["a", "b", " c", ""]
    assert files.dictionary(spark, path, "ctc") == ["", "a", "b", " c", ""]
    assert files.dictionary(spark, path, "attention")[:3] == ["[GO]", "[s]", "a"]
    assert files.dictionary(spark, path, "transformer")[-2:] == ["[B]", "[P]"]
    (tmp_path / "merges.txt").write_text("#version\nt h\nbad\nth e</w>\no n\n")
    assert files.merges(spark, str(tmp_path / "merges.txt")) == [("t", "h"), ("th", "e</w>"), ("o", "n")]
    assert files.merges(spark, str(tmp_path / "merges.txt"), files.UNMERGED + 3) == [("t", "h"), ("th", "e</w>")]
    assert files.merges(spark, str(tmp_path / "merges.txt"), 5) == []


def test_text_and_json_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, *range(8), "b, c", 0.5), (1, 0, *range(8), "a", 0.25), (2, 0, *range(8), None, None)], ["image_id", "poly_idx", *POLY, "text", "conf"])
    files.write_text_lines(rows, str(tmp_path / "out"))
    written = {p.parent.name: p.read_text() for p in (tmp_path / "out").glob("*/*.txt")}
    assert written == {"image_id=1": "a, [0, 1, 2, 3, 4, 5, 6, 7]\nb, c, [0, 1, 2, 3, 4, 5, 6, 7]\n"}
    read = files.read_json_results(results.json_results(rows)).orderBy("image_id", "at").collect()
    assert [(r["image_id"], r["at"], r["text"], r["text_conf"], r["poly"]) for r in read] == [(1, 0, "a", 0.25, [*range(8)]), (1, 1, "b, c", 0.5, [*range(8)]), (2, 0, None, None, [*range(8)])]
    bad = spark.createDataFrame([(1, "{"), (2, None), (3, "[]")], "image_id int, json string")
    assert files.read_json_results(bad).where("text is not null").count() == 0


def test_split_values(spark):
    assert one(spark, t.split_values(F.lit("a,,b,")))[0] == ["a", "", "b"]
    assert one(spark, t.split_values(F.lit("")))[0] == one(spark, t.split_values(F.lit(None).cast("string")))[0] == []
    assert one(spark, t.split_ints(F.lit("1, 2,x,")))[0] == [1, 2, None]


def test_merge_file_equals_the_tokenizer(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["item_id"]: r["ids"] for r in catalogue.queries()["q_bpe_file"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert len(got) == len(rows) > 0
    assert all(got[r["item_id"]] == library.encode(r["text"], add_special_tokens=False).ids for r in rows if r["text"].isascii())


def test_keep_aspect(spark):
    flat = F.array(*[F.lit(2.0)] * 8)
    got = one(spark, pixels.resize_keep_aspect(flat, 2, 4, 4, 4))[0]
    assert got == [2.0] * 8 + [0.0] * 8
    assert pixels.keep_aspect_scale(720, 1280, 736, 1280) == 1.0 and pixels.keep_aspect_scale(100, 50, 50, 50) == 2.0
    assert tuple(one(spark, *g.source_scale(F.lit(720), F.lit(1280), 360, 320, True))) == (4.0, 4.0)
    assert tuple(one(spark, *g.source_scale(F.lit(720), F.lit(1280), 360, 320, False))) == (4.0, 2.0)


def _pages(spark, n=40):
    draw = np.random.default_rng(7)
    rows = [(i, 24, 20, np.kron(draw.random((6, 5)) > 0.55, np.ones((4, 4))).ravel().tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 24, 20, [0.0] * 480)], "image_id long, h int, w int, p array<double>")


@pytest.mark.parametrize("decoder", ["ctc", "attention", "transformer"])
def test_tiled_and_whole_images_read_alike(spark, decoder):
    config = OcrConfig(decoder=decoder, upside_down=True, tile=8, overlap_rate=0.5, only_lowercase=True)
    model = StubMatrixRecogniser() if decoder == "transformer" else StubRecogniser()
    whole = recognition.image_texts(_pages(spark), config, StubDetector(), model).collect()
    tiled = recognition.image_texts(_pages(spark), config, StubDetector(), model, tiled=True).collect()
    assert sorted(whole, key=str) == sorted(tiled, key=str) and len(whole) > 40
    assert 40 not in {r["image_id"] for r in whole}
    assert all(r["conf"] is None or 0 < r["conf"] <= 1 for r in whole)


def test_texts_against_a_plain_walk(spark):
    config = OcrConfig(upside_down=True)
    model, got = StubRecogniser(), {}
    for r in recognition.texts(_pages(spark), config, model).collect():
        got[r["image_id"], r["poly_idx"]] = (tuple(r[c] for c in POLY), r["text"], r["conf"])
    want = {}
    for page in _pages(spark).collect():
        prob = np.array(page["p"]).reshape(24, 20)
        for k, pts in enumerate(find_contours(prob > config.binarize_threshold)[: config.max_candidates]):
            w, h, box = min_area_box(pts)
            if contour_score(prob, pts) < config.polygon_threshold or min(w, h) < 1:
                continue
            by = w * h * config.unclip_ratio / (2 * (w + h))
            grown = g.with_unclipped(spark.createDataFrame([tuple(int(np.rint(v)) for p in box for v in p)], POLY), config.unclip_ratio, F.lit(by))
            made = g.with_corners(grown).select(*POLY, "tl", "tr", "br", "bl").first()
            quad = [(made[c]["x"], made[c]["y"]) for c in ("tl", "tr", "br", "bl")]
            system, target = [], []
            for (x, y), (u, v) in zip(quad, ((0, 0), (100, 0), (100, 32), (0, 32)), strict=True):
                system += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
                target += [x, y]
            crop = plain_warp(prob, np.append(np.linalg.solve(system, target), 1.0), 32, 100)
            best = None
            for way in (crop, crop[::-1, ::-1]):
                ids, probs = (x[0] for x in model(way[None]))
                kept = [i for i in range(len(ids)) if ids[i] and (not i or ids[i] != ids[i - 1])]
                read = ("".join("abcdefghijklmnopqrstuvwxyz0123456789"[ids[i] - 1] for i in kept), float(np.prod(probs[kept])))
                best = read if best is None or read[1] > best[1] + 1e-12 else best
            want[page["image_id"], k] = (tuple(made[c] for c in POLY), *best)
        if len(want) > 25:
            break
    for key, (poly, text, conf) in want.items():
        assert got[key][:2] == (poly, text) and got[key][2] == pytest.approx(conf)


def test_brute_contours():
    draw = np.random.default_rng(3)
    for _ in range(60):
        mask = draw.random((9, 11)) > draw.choice([0.3, 0.5, 0.7])
        found = find_contours(mask)
        background = ~np.pad(mask, 1)
        assert len(found) == len(_parts(mask, 8)) + len(_parts(background, 4)) - 1
        marked = {p for c in found for p in c}
        assert all(mask[y, x] and not background[y : y + 3, x : x + 3].sum() == 0 for x, y in marked)
        prob = draw.random(mask.shape)
        for c in found:
            inside = [prob[y, x] for y in range(9) for x in range(11) if _inside(c, x, y)]
            assert contour_score(prob, c) == pytest.approx(np.mean(inside))


def _parts(mask, ways):
    left, out = {(int(y), int(x)) for y, x in np.argwhere(mask)}, []
    while left:
        queue = [left.pop()]
        out.append(1)
        while queue:
            y, x = queue.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (ways == 8 or not dy or not dx) and (y + dy, x + dx) in left:
                        left.remove((y + dy, x + dx))
                        queue.append((y + dy, x + dx))
    return out


def _inside(c, x, y):
    """On an edge, or an odd number of edges to the right."""
    odd = False
    for (ax, ay), (bx, by) in zip(c, c[1:] + c[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_bpe_encodes_rows_where_they_are(spark):
    texts = [None, "", "the hat"] + [f"word{i % 7} the a{i}" for i in range(2_500)]
    merges = [("t", "h"), ("th", "e</w>"), ("o", "r")]
    rows = spark.createDataFrame([(None if i == 1 else i // 2, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    made = bpe.encode(rows, ["id"], "text", merges)
    ranks, ids = {m: k for k, m in enumerate(merges)}, bpe.vocabulary(merges)
    words = spark.createDataFrame([(t,) for t in texts], "text string").select(token_words(bpe.clean(F.col("text")))).coalesce(1).collect()
    want = [[ids[x] for w in r[0] for x in bpe.merge_word(w, ranks)] for r in words]
    assert [(r["id"], r["ids"]) for r in made.collect()] == [(None if i == 1 else i // 2, x) for i, x in enumerate(want)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
