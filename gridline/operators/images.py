"""Image preparation on arrays: pluggable decoding, fused stages.

An image is a uint8 array (rows, columns[, channels]). Stages run fused in one
function for each image, so that pixels cross to Python once. Perspective,
deskew, denoising and local distortion need a vision library and are plugged
in by name; the others are plain array code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[np.ndarray], np.ndarray]

# Fixed values. Stage settings that results depend on.
SIDE, SIDE_TYPE, BORDER = 736, "min", 50
SHARPEN_SIGMA, SHARPEN_AMOUNT, SHARPEN_SIZE = 1.0, 1.5, 5
LIGHT_SIZE = 55
CLIP, TILES = 2.0, 8
SKEW_MOST, SKEW_LEAST, CORNER_LEAST = 12.0, 0.5, 10.0
DENOISE, DENOISE_PATCH, DENOISE_WINDOW = 10.0, 7, 21


@dataclass(frozen=True)
class Stages:
    """Which stages run, in this order; given settings override these."""

    order: tuple[str, ...] = ("invert", "perspective", "deskew", "resize", "denoise", "sharpen", "lighting", "contrast", "binarize", "distortion")
    on: dict[str, bool] = field(default_factory=lambda: {"invert": False, "binarize": False, "distortion": False})

    def active(self) -> list[str]:
        return [s for s in self.order if self.on.get(s, True)]


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of a blue-green-red image."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def scale_of(height: Column, width: Column, side: int = SIDE, kind: str = SIDE_TYPE) -> Column:
    """The factor that brings the shorter side up to side (`min`), or the longer one down to it (`max`)."""
    if kind == "min":
        return F.greatest(F.lit(float(side)) / F.least(height, width), F.lit(1.0))
    return F.least(F.lit(float(side)) / F.greatest(height, width), F.lit(1.0))


def resize(image: np.ndarray, side: int = SIDE, kind: str = SIDE_TYPE, border: int = BORDER) -> np.ndarray:
    """Scaled by scale_of's factor (bilinear), with a white border that shifts all coordinates by 50."""
    height, width = image.shape[:2]
    factor = max(1.0, side / min(height, width)) if kind == "min" else min(1.0, side / max(height, width))
    if factor != 1.0:
        image = _bilinear(image, max(1, round(height * factor)), max(1, round(width * factor)))
    pad = [(border, border), (border, border)] + [(0, 0)] * (image.ndim - 2)
    return np.pad(image, pad, constant_values=255)


def _bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    def axis(new: int, old: int):
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    (t, b, fy), (left, r, fx) = axis(height, image.shape[0]), axis(width, image.shape[1])
    extra = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *extra), fx.reshape(1, -1, *extra)
    x = image.astype(float)
    rows = x[t] * (1 - fy) + x[b] * fy
    return np.rint(rows[:, left] * (1 - fx) + rows[:, r] * fx).astype(np.uint8)


def _blur(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution with the same kernel along both axes, edges mirrored."""
    out, half = image.astype(float), len(kernel) // 2
    for axis in (0, 1):
        pad = [(half, half) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="symmetric" if out.shape[axis] <= half else "reflect")
        out = sum(k * np.take(wide, range(i, i + out.shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return out


def gaussian(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


def sharpen(image: np.ndarray) -> np.ndarray:
    """The image and 1.5 times its difference from a blurred one."""
    x = image.astype(float)
    return np.clip(np.rint(x + SHARPEN_AMOUNT * (x - _blur(image, gaussian(SHARPEN_SIZE, SHARPEN_SIGMA)))), 0, 255).astype(np.uint8)


def lighting(image: np.ndarray) -> np.ndarray:
    """Gray levels relative to their surroundings, so that shadows go."""
    g = gray(image)
    around = _blur(g, gaussian(LIGHT_SIZE, 0.3 * ((LIGHT_SIZE - 1) * 0.5 - 1) + 0.8))
    return np.clip(np.rint(255.0 * g / np.maximum(around, 1e-6)), 0, 255).astype(np.uint8)


def contrast(image: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Histogram equalisation in tiles, counts clipped, levels blended between tiles."""
    g = gray(image)
    height, width = g.shape
    ys, xs = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (height, width))
    maps = np.zeros((len(ys) - 1, len(xs) - 1, 256))
    for i in range(len(ys) - 1):
        for j in range(len(xs) - 1):
            part = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            counts = np.minimum(counts, limit) + np.maximum(counts - limit, 0).sum() / 256
            maps[i, j] = 255 * counts.cumsum() / part.size

    def axis(edges: np.ndarray, n: int):
        centres = (edges[:-1] + edges[1:] - 1) / 2
        at = np.interp(np.arange(n), centres, np.arange(len(centres)))
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, len(centres) - 1), at - low

    (t, b, fy), (left, r, fx) = axis(ys, height), axis(xs, width)
    fy, fx = fy[:, None], fx[None, :]
    pick = lambda rows, cols: maps[rows[:, None], cols[None, :], g]
    top = pick(t, left) * (1 - fx) + pick(t, r) * fx
    bottom = pick(b, left) * (1 - fx) + pick(b, r) * fx
    return np.clip(np.rint(top * (1 - fy) + bottom * fy), 0, 255).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The gray level that splits the histogram with the largest variance between the parts."""
    counts = np.bincount(gray(image).ravel(), minlength=256).astype(float)
    below, total = counts.cumsum(), counts.sum()
    mean = (counts * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below / total - mean) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def binarize(image: np.ndarray) -> np.ndarray:
    g = gray(image)
    return np.where(g > otsu(image), 255, 0).astype(np.uint8)


def skew(angles: Column, most: float = 12.0, least: float = 0.5) -> Column:
    """The median of a page's line angles within 12 degrees; 0 under half a degree."""
    near = F.sort_array(F.filter(angles, lambda a: F.abs(a) <= most))
    n = F.size(near)
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return F.when((n == 0) | (F.abs(middle) < least), F.lit(0.0)).otherwise(middle)


def largest(areas: Column, n: int = 5, least: float = 10.0) -> Column:
    """The n largest areas over least."""
    return F.slice(F.sort_array(F.filter(areas, lambda a: a > least), asc=False), 1, n)


def warp(image: np.ndarray, matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image of height and width whose pixel (x, y) is taken from matrix @ (x, y, 1), between pixels bilinear, beyond the edge the nearest."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    u, v, w = (matrix[i, 0] * x + matrix[i, 1] * y + matrix[i, 2] for i in range(3))
    u, v = np.clip(u / w, 0, image.shape[1] - 1), np.clip(v / w, 0, image.shape[0] - 1)
    left, top = np.floor(u).astype(int), np.floor(v).astype(int)
    right, bottom = np.minimum(left + 1, image.shape[1] - 1), np.minimum(top + 1, image.shape[0] - 1)
    fx, fy = u - left, v - top
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    pixel = image.astype(float)
    above = pixel[top, left] * (1 - fx) + pixel[top, right] * fx
    below = pixel[bottom, left] * (1 - fx) + pixel[bottom, right] * fx
    return np.rint(above * (1 - fy) + below * fy).astype(np.uint8)


def rotate(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned around its middle by degrees, counter-clockwise."""
    height, width = image.shape[:2]
    cx, cy, a = width // 2, height // 2, np.deg2rad(angle)
    cos, sin = np.cos(a), np.sin(a)
    back = np.array([[cos, -sin, cx - cos * cx + sin * cy], [sin, cos, cy - sin * cx - cos * cy], [0, 0, 1]])
    return warp(image, back, height, width)


def slope(image: np.ndarray, most: float = SKEW_MOST, step: float = 0.25) -> float:
    """The angle at which a page's rows of pixels differ most, within 12 degrees: that of its lines of text.

    Dark pixels are projected along each angle; lines that lie in it give
    sharp peaks. Where line angles are known, use skew.
    """
    dark = np.argwhere(gray(image) <= otsu(image)).astype(float)
    if not len(dark):
        return 0.0
    best = (-1.0, 0.0)
    for angle in sorted(np.arange(-most, most + step, step), key=abs):
        rows = dark[:, 0] * np.cos(np.deg2rad(angle)) - dark[:, 1] * np.sin(np.deg2rad(angle))
        counts = np.bincount(np.round(rows - rows.min()).astype(int))
        sharp = float((np.diff(counts.astype(float)) ** 2).sum())
        if sharp > best[0] * 1.0001:
            best = sharp, float(angle)
    return best[1]


def deskew(image: np.ndarray, least: float = SKEW_LEAST) -> np.ndarray:
    angle = slope(image)
    return image if abs(angle) < least else rotate(image, angle)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The matrix that takes four points to four others."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(rows, float), np.asarray(target, float).ravel()), 1.0).reshape(3, 3)


def corners(image: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right and bottom left of the bright sheet: its farthest pixels along both diagonals."""
    y, x = np.nonzero(gray(image) > otsu(image))
    if not len(x):
        height, width = image.shape[:2]
        return np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    at = [np.argmin(x + y), np.argmax(x - y), np.argmax(x + y), np.argmin(x - y)]
    return np.stack([x[at], y[at]], axis=1).astype(float)


def corner_angles(points: np.ndarray) -> np.ndarray:
    """The angles of a quadrangle in degrees."""
    out = []
    for i in range(4):
        a, b = points[i - 1] - points[i], points[(i + 1) % 4] - points[i]
        out.append(np.degrees(np.arccos(np.clip(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-10), -1, 1))))
    return np.array(out)


def straighten(image: np.ndarray, points: np.ndarray, least: float = CORNER_LEAST) -> np.ndarray:
    """The quadrangle of points as an upright rectangle of its longer sides; the image itself if no corner is 10 degrees off."""
    if np.abs(corner_angles(points) - 90).max() < least:
        return image
    side = lambda a, b: float(np.linalg.norm(points[a] - points[b]))
    width, height = int(max(side(2, 3), side(1, 0))), int(max(side(1, 2), side(0, 3)))
    if width < 2 or height < 2:
        return image
    upright = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    return warp(image, homography(upright, points), height, width)


def perspective(image: np.ndarray) -> np.ndarray:
    """The sheet of a photographed page, seen from above, without its white margins."""
    flat = straighten(image, corners(image))
    if flat is image:
        return image
    y, x = np.nonzero(gray(flat) < 255)
    return flat[y.min() : y.max() + 1, x.min() : x.max() + 1] if len(x) else flat


def _boxed(values: np.ndarray, side: int) -> np.ndarray:
    """Means over squares of side pixels, edges repeated."""
    half = side // 2
    sums = np.pad(np.pad(values, half, mode="edge").cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (sums[side:, side:] - sums[:-side, side:] - sums[side:, :-side] + sums[:-side, :-side]) / side**2


def denoise(image: np.ndarray, strength: float = DENOISE, patch: int = DENOISE_PATCH, window: int = DENOISE_WINDOW) -> np.ndarray:
    """Non-local means: a pixel is the mean of those around it, weighted by how alike their surroundings are.

    One pass over the image for each place of the window, so that memory is a
    few images.
    """
    source = gray(image).astype(float)
    half, (height, width) = window // 2, source.shape
    wide = np.pad(source, half, mode="reflect" if min(source.shape) > half else "edge")
    total, weights = np.zeros_like(source), np.zeros_like(source)
    for dy in range(window):
        for dx in range(window):
            other = wide[dy : dy + height, dx : dx + width]
            weight = np.exp(-_boxed((source - other) ** 2, patch) / strength**2)
            total += weight * other
            weights += weight
    return np.rint(total / weights).astype(np.uint8)


BUILT_IN: dict[str, Stage] = {
    "invert": invert, "perspective": perspective, "deskew": deskew, "resize": resize, "denoise": denoise,
    "sharpen": sharpen, "lighting": lighting, "contrast": contrast, "binarize": binarize,
}


def prepare(image: np.ndarray, stages: Stages = Stages(), plugged: dict[str, Stage] | None = None, mode: str = "custom", seen: Callable[[str, np.ndarray], None] | None = None) -> np.ndarray:
    """The image after all active stages; mode `paddleocr` only resizes.

    A stage that is on and has no code is an error. seen gets the name and the
    image of every stage.
    """
    known = BUILT_IN | (plugged or {})
    active = ["resize"] if mode == "paddleocr" else stages.active()
    missing = [name for name in active if name not in known]
    if missing:
        raise ValueError(f"stages without code: {', '.join(missing)}")
    for name in active:
        image = known[name](image)
        if seen:
            seen(name, image)
    return image


def stage_images(images: DataFrame, stages: Stages = Stages(), plugged: dict[str, Stage] | None = None) -> DataFrame:
    """path, stage, name, height, width, channels, data: the image after each active stage, to be written by any sink.

    name is the file's stem and the stage. A broken image has no rows; its
    error is prepare_all's matter.
    """

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows: list[tuple] = []
                stem = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                keep = lambda name, out, r=r, rows=rows, stem=stem: rows.append((r.path, name, f"{stem}_{name}", out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], out.tobytes()))
                try:
                    shape = (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)
                    prepare(np.frombuffer(r.data, np.uint8).reshape(shape), stages, plugged, seen=keep)
                except Exception:  # noqa: BLE001 - see above
                    rows = []
                yield pd.DataFrame(rows, columns=["path", "stage", "name", "height", "width", "channels", "data"])

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, stage string, name string, height int, width int, channels int, data binary")


def prepare_all(images: DataFrame, stages: Stages = Stages(), plugged: dict[str, Stage] | None = None) -> DataFrame:
    """path, height, width, channels, data, error of images(path, height, width, channels, data)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    shape = (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)
                    out = prepare(np.frombuffer(r.data, np.uint8).reshape(shape), stages, plugged)
                    rows.append((r.path, out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], out.tobytes(), None))
                except Exception as e:  # noqa: BLE001 - a bad image is a row with its error
                    rows.append((r.path, None, None, None, None, str(e)))
            frame = pd.DataFrame(rows, columns=["path", "height", "width", "channels", "data", "error"])
            yield frame.astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, height int, width int, channels int, data binary, error string")
