"""Preparation of page images for recognition, with numpy alone: grey, straight, clean, contrasted."""

from __future__ import annotations

import math

import numpy as np

LEAST_ANGLE, MOST_ANGLE = 0.3, 15.0


def to_gray(image: np.ndarray) -> np.ndarray:
    """One channel from BGR, by the usual luma weights."""
    if image.ndim == 2:
        return image
    return np.clip(image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299 + 0.5, 0, 255).astype(np.uint8)


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of integer points, by the extreme points of each row."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    first = np.concatenate([[True], order[1:, 0] != order[:-1, 0]])
    last = np.concatenate([first[1:], [True]])
    edge = order[first | last].astype(float)
    return np.array(half(edge)[:-1] + half(edge[::-1])[:-1])


def skew_angle(image: np.ndarray) -> float | None:
    """Tilt of the smallest rectangle around the dark pixels, folded to at most 45 degrees; None for a blank page."""
    dark = np.column_stack(np.where(image < 128))
    if len(dark) < 100:
        return None
    hull = _hull(dark)
    if len(hull) < 3:
        return 0.0
    sides = np.roll(hull, -1, axis=0) - hull
    best, best_area = 0.0, math.inf
    for angle in np.unique(np.round(np.arctan2(sides[:, 1], sides[:, 0]) % (math.pi / 2), 6)):
        turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
        box = np.ptp(hull @ turn.T, axis=0)
        if box[0] * box[1] < best_area - 1e-9:
            best, best_area = math.degrees(angle), box[0] * box[1]
    return best - 90 if best > 45 else best


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Rotated about its middle, same size, edges repeated; cubic along both axes."""
    h, w = image.shape
    turn = math.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = w / 2, h / 2
    return _sample(image, (x - cx) * math.sin(turn) + (y - cy) * math.cos(turn) + cy, (x - cx) * math.cos(turn) - (y - cy) * math.sin(turn) + cx)


def _cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (1.25 * t - 2.25) * t * t + 1, np.where(t < 2, ((-0.75 * t + 3.75) * t - 6) * t + 3, 0.0))


def _sample(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    h, w = image.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros(y.shape)
    for dy in range(-1, 3):
        wy = _cubic(y - (y0 + dy))
        row = np.clip(y0 + dy, 0, h - 1)
        for dx in range(-1, 3):
            out += wy * _cubic(x - (x0 + dx)) * image[row, np.clip(x0 + dx, 0, w - 1)]
    return np.clip(out + 0.5, 0, 255).astype(np.uint8)


def deskew(image: np.ndarray) -> np.ndarray:
    """Straightened if tilted by 0.3 to 15 degrees; more is a misjudgement, less not worth it."""
    angle = skew_angle(image)
    return image if angle is None or not LEAST_ANGLE <= abs(angle) <= MOST_ANGLE else rotate(image, -angle)


def median3(image: np.ndarray) -> np.ndarray:
    padded = np.pad(image, 1, mode="edge")
    return np.median(np.stack([padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = 10.0) -> np.ndarray:
    """Median of 3 x 3 for large images, else non-local means over a 7 x 7 patch and a 21 x 21 window."""
    if image.size > 4_000_000:
        return median3(image)
    h, w = image.shape
    reach, half = 10, 3
    padded = np.pad(image.astype(np.float32), reach + half, mode="reflect" if min(h, w) > reach + half else "edge")
    inner = padded[reach:-reach, reach:-reach] if reach else padded
    total, weights = np.zeros((h, w)), np.zeros((h, w))
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            moved = padded[reach + dy : reach + dy + inner.shape[0], reach + dx : reach + dx + inner.shape[1]]
            square = np.pad((inner - moved) ** 2, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
            side = 2 * half + 1
            distance = (square[side:, side:] - square[:-side, side:] - square[side:, :-side] + square[:-side, :-side]) / side**2
            weight = np.exp(-distance / strength**2)
            total += weight * moved[half : half + h, half : half + w]
            weights += weight
    return np.clip(total / weights + 0.5, 0, 255).astype(np.uint8)


def enhance_contrast(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Histogram equalisation by tiles with a limit, blended between tile centres."""
    h, w = image.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(image, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    limit = max(1, int(clip * th * tw / 256))
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            histogram = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            excess = int(np.maximum(histogram - limit, 0).sum())
            histogram = np.minimum(histogram, limit) + excess // 256
            rest = excess % 256
            if rest:
                histogram[:: max(256 // rest, 1)][:rest] += 1
            tables[i, j] = np.clip(np.round(histogram.cumsum() * 255.0 / (th * tw)), 0, 255)
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    pick = lambda a, b: tables[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], image]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x0 + 1) * fx
    bottom = pick(y0 + 1, x0) * (1 - fx) + pick(y0 + 1, x0 + 1) * fx
    return np.clip(top * (1 - fy) + bottom * fy + 0.5, 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold with the greatest variance between the two classes."""
    histogram = np.bincount(image.ravel(), minlength=256) / image.size
    below = histogram.cumsum()
    mean = (histogram * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def maybe_binarize(image: np.ndarray) -> np.ndarray:
    """Black and white, unless over half of the pixels are of middle grey (photographs)."""
    if not image.size or np.bincount(image.ravel(), minlength=256)[64:192].sum() / image.size > 0.5:
        return image
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def prepare(image: np.ndarray) -> np.ndarray:
    """All steps before recognition."""
    return maybe_binarize(enhance_contrast(denoise(deskew(to_gray(image)))))


def scale_for_ocr(image: np.ndarray, least: int = 960) -> np.ndarray:
    """Enlarged so that the short side has at least ``least`` pixels."""
    h, w = image.shape[:2]
    if not min(h, w) or min(h, w) >= least:
        return image
    scale = least / min(h, w)
    rows, columns = int(h * scale), int(w * scale)
    y, x = (np.arange(rows) + 0.5) / scale - 0.5, (np.arange(columns) + 0.5) / scale - 0.5
    return _sample(image, np.repeat(y[:, None], columns, 1), np.repeat(x[None, :], rows, 0))
