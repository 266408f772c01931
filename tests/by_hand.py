"""Contour scores and least boxes worked out pixel by pixel and edge by edge, to hold the library against."""

import numpy as np


def contour_score(prob: np.ndarray, pts: list[tuple[int, int]]) -> float:
    """Mean probability over the pixels inside or on the polygon, clipped to the image."""
    p = np.array(pts)
    x0, y0 = np.maximum(p.min(0), 0)
    x1, y1 = np.minimum(p.max(0), (prob.shape[1] - 1, prob.shape[0] - 1))
    if x1 < x0 or y1 < y0:
        return 0.0
    gy, gx = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    inside, on = np.zeros(gx.shape, bool), np.zeros(gx.shape, bool)
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
        cross = (bx - ax) * (gy - ay) - (by - ay) * (gx - ax)
        on |= (cross == 0) & (gx >= min(ax, bx)) & (gx <= max(ax, bx)) & (gy >= min(ay, by)) & (gy <= max(ay, by))
        if ay != by:
            inside ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][inside | on].mean())


def hull(pts: list[tuple[int, int]]) -> np.ndarray:
    """Convex hull, monotone chain."""
    p = sorted(set(pts))
    if len(p) < 3:
        return np.array(p, float)

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def min_area_box(pts: list[tuple[int, int]]) -> tuple[float, float, np.ndarray]:
    """(width, height, corners bottom-left, top-left, top-right, bottom-right) of the least rectangle on a hull edge.

    The width points right, by less than 45 degrees up and 45 at most down; of equal areas the longer box, then the smaller direction.
    """
    ends = hull(pts)
    if len(ends) < 2:
        return 0.0, 0.0, np.repeat(ends, 4, 0)
    found = []
    for dx, dy in np.roll(ends, -1, 0) - ends:
        while not (dx > 0 and -dx < dy <= dx):
            dx, dy = -dy, dx
        s, t = ends @ (dx, dy), ends @ (-dy, dx)
        n2 = dx * dx + dy * dy
        w, h = np.ptp(s), np.ptp(t)
        found.append((w * h / n2, -max(w * w / n2, h * h / n2), dx, dy, s, t))
    _, _, dx, dy, s, t = min(found, key=lambda f: f[:4])
    n2 = dx * dx + dy * dy
    corners = np.array([[s.min(), t.max()], [s.min(), t.min()], [s.max(), t.min()], [s.max(), t.max()]]) @ np.array([[dx, dy], [-dy, dx]]) / n2
    return float(np.ptp(s) / n2**0.5), float(np.ptp(t) / n2**0.5), corners


def plain_warp(image: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """A crop, pixel by pixel."""
    out = np.zeros((height, width))
    a, b, c, d, e, f, g, h, i = matrix
    at = lambda y, x: image[y, x] if 0 <= y < image.shape[0] and 0 <= x < image.shape[1] else 0.0
    for v in range(height):
        for u in range(width):
            z = g * u + h * v + i
            x, y = (a * u + b * v + c) / z, (d * u + e * v + f) / z
            x0, y0 = int(x), int(y)
            fx, fy = abs(x - x0), abs(y - y0)
            out[v, u] = (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy
    return out
