"""Rectification and recognition of text regions around a pluggable model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Recogniser(Protocol):
    """A model: crops (n, height, width), or with colours (n, height, width, channels), in, step ids and probabilities (n, steps) out. It is pickled to the tasks."""

    def __call__(self, crops: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class Detector(Protocol):
    """A model: images (n, height, width) in, text probabilities of the same shape out. It is pickled to the tasks."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class MatrixRecogniser(Protocol):
    """A model: crops (n, height, width) in, scores (n, steps, symbols) out. It is pickled to the tasks."""

    def __call__(self, crops: np.ndarray) -> np.ndarray: ...


class StubDetector:
    """Stands in for a model: brightness is taken for the probability of text."""

    def __call__(self, images: np.ndarray) -> np.ndarray:
        return np.clip(images if images.ndim == 3 else images.mean(3), 0, 1)


class StubRecogniser:
    """Stands in for a model, as no weights are included: a step's id is its column's mean brightness class."""

    def __init__(self, steps: int = 8, classes: int = 37):
        self.steps, self.classes = steps, classes

    def __call__(self, crops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        crops = crops if crops.ndim == 3 else crops.mean(3)
        columns = np.stack([part.mean((1, 2)) for part in np.array_split(crops, self.steps, axis=2)], 1)
        share = np.clip(columns, 0, 1)
        return np.minimum((share * self.classes).astype(int), self.classes - 1), 0.5 + share / 2


class StubMatrixRecogniser(StubRecogniser):
    """The same as score matrices: the class's score stands out."""

    def __call__(self, crops: np.ndarray) -> np.ndarray:
        ids, probs = super().__call__(crops)
        out = np.zeros((*ids.shape, self.classes))
        np.put_along_axis(out, ids[..., None], probs[..., None], 2)
        return out


def resized(image: np.ndarray, height: int, width: int, keep_aspect: bool) -> np.ndarray:
    """An image (h, w, channels) at another size, bilinear at pixel centres, outside it 0.

    With ``keep_aspect`` it is brought to the largest size of its aspect that fits (a pixel at least), at the top left, and the rest is 0;
    samples at its edge take the nearest pixel then.
    """
    h, w, _ = image.shape
    if (h, w) == (height, width):
        return image
    rows, cols = height, width
    if keep_aspect:
        rows, cols = (max(1, int(width * h / w)), width) if w * height >= h * width else (height, max(1, int(height * w / h)))
    y, x = (np.arange(rows) + 0.5) * (h / rows) - 0.5, (np.arange(cols) + 0.5) * (w / cols) - 0.5
    if keep_aspect:
        y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    out = np.zeros((height, width, image.shape[2]))
    out[:rows, :cols] = _sampled(image, np.broadcast_to(y[:, None], (rows, cols)), np.broadcast_to(x, (rows, cols)))
    return out


def _sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values of an image (h, w, channels) at places of any shape; 0 outside it and where a place is no number."""
    lost = ~(np.isfinite(y) & np.isfinite(x)) | (np.abs(y) > 1e9) | (np.abs(x) > 1e9)
    y, x = np.where(lost, -9.0, y), np.where(lost, -9.0, x)
    y0, x0 = np.trunc(y).astype(np.int64), np.trunc(x).astype(np.int64)
    out = np.zeros((*y.shape, image.shape[2]))
    for dy in (0, 1):
        for dx in (0, 1):
            yy, xx = y0 + dy, x0 + dx
            inside = (yy >= 0) & (yy < image.shape[0]) & (xx >= 0) & (xx < image.shape[1])
            weight = (np.abs(y - y0) if dy else 1 - np.abs(y - y0)) * (np.abs(x - x0) if dx else 1 - np.abs(x - x0))
            out[inside] += weight[inside][:, None] * image[yy[inside], xx[inside]]
    return out


def warp(image: np.ndarray, matrices: np.ndarray, height: int, width: int) -> np.ndarray:
    """Crops (n, height, width, channels) of an image (h, w, channels) through n 3 x 3 matrices from crop to image places, all at once.

    Bilinear; 0 outside the image and where a matrix takes a place to infinity.
    """
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    places = np.stack([u, v, np.ones_like(u)]).astype(float)
    x, y, z = np.moveaxis(np.tensordot(matrices.reshape(-1, 3, 3), places, 1), 1, 0)
    z = np.where(z == 0, np.nan, z)
    return _sampled(image, y / z, x / z)


def pixels_of(h: int, w: int, p) -> np.ndarray:
    """(h, w, channels) of a row-major array with one or more values a pixel."""
    return np.array(p, float).reshape(h, w, -1)


def _shown(stack: np.ndarray) -> np.ndarray:
    """What models get: (n, h, w) of one channel, else (n, h, w, channels)."""
    return stack[..., 0] if stack.shape[-1] == 1 else stack


def _whole(h: int | None, w: int | None, p) -> bool:
    """Whether values fill an image's size. Asked in Python, so that no filter works out an image's expression once more."""
    return bool(h and w and p is not None and len(p) and h > 0 and w > 0 and len(p) % (h * w) == 0)


def detect(images: DataFrame, model: Detector, height: int = 0, width: int = 0, keep_aspect: bool = False, batch: int = 16) -> DataFrame:
    """Probability maps (image_id, h, w, p) of images of the same columns, ``batch`` of one size and number of channels at a time.

    With a ``height`` and ``width`` images are brought to that size first, and maps have it. Other columns stay with their image. Images
    that are null or empty, or whose values don't fill their size, give no rows.
    """
    kept = [c for c in images.columns if c not in ("h", "w", "p")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes: dict[tuple, list[int]] = {}
            found: dict[int, np.ndarray] = {}
            for k, (h, w, p) in enumerate(zip(b.column("h").to_pylist(), b.column("w").to_pylist(), b.column("p"), strict=True)):
                if _whole(h, w, values := p.values):
                    x = pixels_of(h, w, values.to_numpy(zero_copy_only=False))
                    found[k] = resized(x, height or h, width or w, keep_aspect)
                    sizes.setdefault(found[k].shape, []).append(k)
            for (h, w, _), own in sizes.items():
                for at in range(0, len(own), batch):
                    part = own[at : at + batch]
                    maps = np.asarray(model(_shown(np.stack([found[k] for k in part])))).reshape(len(part), -1)
                    n = pa.array([h] * len(part), pa.int32()), pa.array([w] * len(part), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("kept").take(pa.array(part)), *n, pa.ListArray.from_arrays(np.arange(0, maps.size + 1, maps.shape[1], dtype=np.int32), pa.array(maps.ravel().astype(float)))], ["kept", "h", "w", "p"])

    given = images.select(F.struct(*kept).alias("kept"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("p").cast("array<double>"))
    schema = StructType([given.schema["kept"], *StructType.fromDDL("h int, w int, p array<double>")])
    return given.mapInArrow(scan, schema).select("kept.*", "h", "w", "p")


def on_canvas(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Images (image_id, h, w, p), each of any size, resized in their aspect into the canvas that tiles of that size cover exactly.

    ``rescale`` are the image's pixels for one of the canvas.
    """
    step = tile - overlap

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                if not _whole(r.h, r.w, r.p):
                    continue
                image = pixels_of(r.h, r.w, r.p)
                h, w = (max(0, -(-(n - tile) // step)) * step + tile for n in (r.h, r.w))
                scale = 1.0 if (h, w) == (r.h, r.w) else r.w / w if r.w * h >= r.h * w else r.h / h
                rows.append((r.image_id, h, w, resized(image, h, w, True).ravel().tolist(), scale))
            yield pd.DataFrame(rows, columns=["image_id", "h", "w", "p", "rescale"])

    sized = images.where((F.col("h") > 0) & (F.col("w") > 0))
    return sized.select(F.col("image_id").cast("long"), F.col("h").cast("int"), F.col("w").cast("int"), F.col("p").cast("array<double>")).mapInPandas(scan, "image_id long, h int, w int, p array<double>, rescale double")


def recognise(images: DataFrame, model: Recogniser | MatrixRecogniser, height: int = 32, width: int = 100, upside_down: bool = False, matrices: bool = False, batch: int = 64) -> DataFrame:
    """Steps of every region of images (image_id, h, w, p, regions), each region once per orientation.

    ``regions`` is an array of structs with poly_idx, poly (array<int>) and m (the nine coefficients, or null). The
    output has image_id, poly_idx, poly, orientation, and ids with probs or, for ``matrices``, scores. An image meets
    its regions in its own row, so its pixels travel once; its regions are cropped in one step, and the model gets ``batch`` crops
    at a time over all images of an Arrow batch. A region without coefficients has one row, without steps.
    """
    columns = ["scores"] if matrices else ["ids", "probs"]

    def read(crops: list[np.ndarray], asked: list[tuple]) -> Iterator[pd.DataFrame]:
        stack = _shown(np.concatenate(crops))
        for at in range(0, len(asked), batch):
            part, own = stack[at : at + batch], asked[at : at + batch]
            for way in (0, 1)[: 1 + upside_down]:
                made = model(part[:, ::-1, ::-1] if way else part)
                known = {"image_id": [a for a, _, _ in own], "poly_idx": [k for _, k, _ in own], "poly": [list(q) for _, _, q in own], "orientation": way}
                yield pd.DataFrame(known | dict(zip(columns, (x.tolist() for x in ((made,) if matrices else made)), strict=True)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            crops, asked, lost, channels = [], [], [], 0
            for r in b.itertuples():
                image = pixels_of(r.h, r.w, r.p)
                whole = [x for x in r.regions if x["m"] is not None]
                lost += [(r.image_id, x["poly_idx"], list(x["poly"])) for x in r.regions if x["m"] is None]
                if crops and (image.shape[2] != channels or len(asked) >= 16 * batch):
                    yield from read(crops, asked)
                    crops, asked = [], []
                channels = image.shape[2]
                if whole:
                    crops.append(warp(image, np.array([list(x["m"]) for x in whole], float), height, width))
                    asked += [(r.image_id, x["poly_idx"], x["poly"]) for x in whole]
            if crops:
                yield from read(crops, asked)
            if lost:
                yield pd.DataFrame({"image_id": [a for a, _, _ in lost], "poly_idx": [k for _, k, _ in lost], "poly": [q for _, _, q in lost], "orientation": 0} | dict.fromkeys(columns, None))

    kinds = "scores array<array<double>>" if matrices else "ids array<int>, probs array<double>"
    return images.mapInPandas(scan, f"image_id long, poly_idx int, poly array<int>, orientation int, {kinds}")
