"""Per-pixel arithmetic on channel columns and on raster arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel means (blue, green, red) and scale of the detector's input.
MEANS = (104.00698793, 116.66876762, 122.67891434)
SCALE = 0.00392156
#: Gray weights in 1/32768 (blue, green, red), offset and scale of the recogniser's input.
GRAY = (3735, 19235, 9798)
GRAY_MEAN, GRAY_SCALE = 127.5, 0.00784313
#: Red, green, blue mean and deviation of the image-text model's input.
RGB_MEAN = (0.4814546, 0.4578275, 0.4082107)
RGB_STD = (0.26862954, 0.26130258, 0.27577711)


def normalise_bgr(b: Column, g: Column, r: Column) -> tuple[Column, ...]:
    return tuple((c - m) * SCALE for c, m in zip((b, g, r), MEANS, strict=True))


def gray(b: Column, g: Column, r: Column) -> Column:
    """Fixed-point gray of whole channel values."""
    whole = [c.cast("int") for c in (b, g, r)]
    return F.shiftright(sum((c * w for c, w in zip(whole, GRAY, strict=True)), F.lit(1 << 14)), 15)


def normalise_gray(value: Column) -> Column:
    return (value - GRAY_MEAN) * GRAY_SCALE


def normalise_rgb(b: Column, g: Column, r: Column) -> tuple[Column, ...]:
    """Red, green and blue."""
    return tuple((c / 255.0 - m) / s for c, m, s in zip((r, g, b), RGB_MEAN, RGB_STD, strict=True))


def binarize(p: Column, threshold: float) -> Column:
    """255 above the threshold, else 0."""
    return F.when(p > threshold, 255).otherwise(0)


def bilinear(raster: Column, height: int, width: int, y: Column, x: Column, border: float = 0.0) -> Column:
    """The raster (row-major array) at a fractional place; outside it lies the border."""
    y0, x0 = y.cast("int"), x.cast("int")
    fy, fx = y - y0, x - x0

    def at(yy: Column, xx: Column) -> Column:
        inside = (yy >= 0) & (yy < height) & (xx >= 0) & (xx < width)
        return F.when(inside, F.get(raster, yy * width + xx).cast("double")).otherwise(F.lit(border))

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return top * (1 - fy) + low * fy


def _taps(places: list[float], size: int) -> Column:
    """For each place along an axis its two neighbours (0 where outside) and their weights (0 where outside), as constants of the plan."""
    rows = []
    for x in places:
        low = int(x)
        held = [(k, w) if 0 <= k < size else (0, 0.0) for k, w in ((low, 1 - (x - low)), (low + 1, x - low))]
        rows.append(F.struct(*(F.lit(v).alias(n) for n, v in zip(("a", "wa", "b", "wb"), (v for pair in held for v in pair), strict=True))))
    return F.array(*rows)


def _sampled(raster: Column, width: int, rows: Column, cols: Column, zeros: int = 0) -> Column:
    """The raster at every pair of the places of ``_taps``, row by row with so many ``zeros`` behind each: a sample is four look-ups."""
    value = lambda y, x: F.get(raster, y * width + x).cast("double")
    line = lambda y, c: value(y, c["a"]) * c["wa"] + value(y, c["b"]) * c["wb"]
    across = lambda r: F.transform(cols, lambda c: line(r["a"], c) * r["wa"] + line(r["b"], c) * r["wb"])
    return F.flatten(F.transform(rows, lambda r: F.concat(across(r), F.array_repeat(F.lit(0.0), zeros)) if zeros else across(r)))


def resize(raster: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Bilinear resize at pixel centres: (d + 0.5) * scale - 0.5; what lies outside counts as 0."""
    places = lambda n, to: [(k + 0.5) * (n / to) - 0.5 for k in range(to)]
    return _sampled(raster, width, _taps(places(height, to_height), height), _taps(places(width, to_width), width))


def flipped(raster: Column) -> Column:
    """The raster turned by 180 degrees."""
    return F.reverse(raster)


def keep_aspect_scale(height: float, width: float, to_height: int, to_width: int) -> float:
    """Source pixels for each pixel of the largest resize that keeps the aspect and fits the canvas."""
    return width / to_width if width / height >= to_width / to_height else height / to_height


def resize_keep_aspect(raster: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Bilinear resize in one scale, at the canvas's top left; what the image doesn't reach is 0.

    A sample's neighbours beyond the image count as the nearest pixel's own value, so the image's edge isn't darkened.
    """
    scale = keep_aspect_scale(height, width, to_height, to_width)
    rows, cols = int(height / scale + 1e-9), int(width / scale + 1e-9)
    places = lambda n, to: [min(max((k + 0.5) * scale - 0.5, 0.0), n - 1.0) for k in range(to)]
    made = _sampled(raster, width, _taps(places(height, rows), height), _taps(places(width, cols), width), to_width - cols)
    return F.concat(made, F.array_repeat(F.lit(0.0), (to_height - rows) * to_width)) if rows < to_height else made


def detector_input(channels: tuple[Column, Column, Column], height: int, width: int, to_height: int, to_width: int, keep_aspect: bool = False) -> Column:
    """Blue, green and red planes of an image (row-major arrays), resized and normalised, one plane after the other."""
    fit = resize_keep_aspect if keep_aspect else resize

    def plane(channel: Column, mean: float) -> Column:
        return F.transform(fit(channel, height, width, to_height, to_width), lambda v: (v - mean) * SCALE)

    return F.concat(*(plane(c, m) for c, m in zip(channels, MEANS, strict=True)))
