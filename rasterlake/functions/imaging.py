"""Image transforms on arrays of shape (height, width, 4), uint8 RGBA: the vectorised form for row-per-image tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

f32 = np.float32
#: Output bytes at most, for decoding and for every transform that grows an image.
MAX_BYTES = 512 << 20


class ImageError(ValueError):
    """A transform that doesn't fit an image; code names the reason."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


def check_size(width: int, height: int) -> None:
    if width < 1 or height < 1 or width > 2**31 - 1 or height > 2**31 - 1 or width * height * 4 > MAX_BYTES:
        raise ImageError("OutputTooLarge" if width > 0 and height > 0 else "InvalidDimensions", f"{width}x{height}")


def _with_alpha(rgb: np.ndarray, like: np.ndarray) -> np.ndarray:
    return np.dstack([rgb.astype(np.uint8), like[..., 3]])


# ---- colour -------------------------------------------------------------------------------------------------------------------


def invert(img: np.ndarray) -> np.ndarray:
    return _with_alpha(255 - img[..., :3], img)


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounds non-negative and negative halves away from zero."""
    x = x.astype(np.float64)
    return np.where(x >= 0, np.floor(x + 0.5), np.ceil(x - 0.5))


def grayscale(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., i].astype(f32) for i in range(3))
    y = _half_up(f32(0.299) * r + f32(0.587) * g + f32(0.114) * b)
    return _with_alpha(np.dstack([y, y, y]), img)


#: Rows of the sepia matrix (fixed values).
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))


def sepia(img: np.ndarray) -> np.ndarray:
    r, g, b = (img[..., i].astype(f32) for i in range(3))
    rows = [np.minimum(_half_up(f32(p) * r + f32(q) * g + f32(s) * b), 255) for p, q, s in SEPIA]
    return _with_alpha(np.dstack(rows), img)


def brightness(img: np.ndarray, delta: int) -> np.ndarray:
    return _with_alpha(np.clip(img[..., :3].astype(np.int32) + delta, 0, 255), img)


def contrast_factor(delta: int) -> np.float32:
    d = f32(max(-255, min(255, delta)))
    return f32(f32(f32(259) * f32(d + f32(255))) / f32(f32(255) * f32(f32(259) - d)))


def contrast(img: np.ndarray, delta: int) -> np.ndarray:
    c = img[..., :3].astype(f32)
    return _with_alpha(np.clip(_half_up(contrast_factor(delta) * (c - f32(128)) + f32(128)), 0, 255), img)


# ---- geometry -----------------------------------------------------------------------------------------------------------------


def rotate_left(img: np.ndarray) -> np.ndarray:
    return np.rot90(img, 1).copy()


def rotate_right(img: np.ndarray) -> np.ndarray:
    return np.rot90(img, -1).copy()


def mirror_horizontal(img: np.ndarray) -> np.ndarray:
    return img[:, ::-1].copy()


def mirror_vertical(img: np.ndarray) -> np.ndarray:
    return img[::-1].copy()


def crop(img: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    if x >= w or y >= h:
        raise ImageError("CropOriginOutOfBounds", f"({x}, {y}) in {w}x{h}")
    if x + width > w or y + height > h:
        raise ImageError("CropExtentOutOfBounds", f"{width}x{height} at ({x}, {y}) in {w}x{h}")
    return img[y : y + height, x : x + width].copy()


def translate(img: np.ndarray, dx: int, dy: int, expand: bool, fill: tuple[int, int, int, int]) -> np.ndarray:
    h, w = img.shape[:2]
    out_w, out_h = (w + abs(dx), h + abs(dy)) if expand else (w, h)
    check_size(out_w, out_h)
    left, top = (max(dx, 0), max(dy, 0)) if expand else (dx, dy)
    out = np.empty((out_h, out_w, 4), dtype=np.uint8)
    out[:] = np.array(fill, dtype=np.uint8)
    x0, x1, y0, y1 = max(left, 0), min(left + w, out_w), max(top, 0), min(top + h, out_h)
    if x0 < x1 and y0 < y1:
        out[y0:y1, x0:x1] = img[y0 - top : y1 - top, x0 - left : x1 - left]
    return out


def _store(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0, 0, np.where(v >= 255, 255, np.trunc(np.clip(v, 0, 255) + f32(0.5)))).astype(np.uint8)


def _cubic(x: np.ndarray) -> np.ndarray:
    """Weights at distances x >= 0, of the cubic with parameter -0.5; products are taken from left to right."""
    a = f32(-0.5)
    near = (a + f32(2)) * x * x * x - (a + f32(3)) * x * x + f32(1)
    far = a * x * x * x - f32(5) * a * x * x + f32(8) * a * x - f32(4) * a
    return np.where(x <= 1, near, np.where(x < 2, far, f32(0))).astype(f32)


def _taps(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four samples around a position that lies t behind the second."""
    return [_cubic((f32(1) + t).astype(f32)), _cubic(t), _cubic((f32(1) - t).astype(f32)), _cubic((f32(2) - t).astype(f32))]


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, how: str, at: tuple[int, int] = (0, 0), size: tuple[int, int] | None = None) -> np.ndarray:
    """img at float32 positions; outside by more than 1e-3: transparent black. img may be a part of an image of that (height, width)
    from the place ``at`` (row, column) on, if it holds all pixels around the positions."""
    h, w = size or img.shape[:2]
    top_row, left_col = at
    eps = f32(1e-3)
    outside = (x < -eps) | (y < -eps) | (x > f32(w - 1) + eps) | (y > f32(h - 1) + eps)
    x, y = np.clip(x, f32(0), f32(w - 1)), np.clip(y, f32(0), f32(h - 1))
    if how == "nearest":
        xi = np.minimum(np.trunc(x + f32(0.5)).astype(np.int64), w - 1)
        yi = np.minimum(np.trunc(y + f32(0.5)).astype(np.int64), h - 1)
        out = img[yi - top_row, xi - left_col].copy()
    elif how == "bilinear":
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        x1, y1 = np.minimum(x0 + 1, w - 1) - left_col, np.minimum(y0 + 1, h - 1) - top_row
        tx, ty = (x - x0.astype(f32))[..., None].astype(f32), (y - y0.astype(f32))[..., None].astype(f32)
        p, x0, y0 = img.astype(f32), x0 - left_col, y0 - top_row
        top = p[y0, x0] * (f32(1) - tx) + p[y0, x1] * tx
        low = p[y1, x0] * (f32(1) - tx) + p[y1, x1] * tx
        out = _store(top * (f32(1) - ty) + low * ty)
    elif how == "bicubic":
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        p, total = img.astype(f32), np.zeros((*x.shape, 4), dtype=f32)
        across, down = _taps((x - x0.astype(f32)).astype(f32)), _taps((y - y0.astype(f32)).astype(f32))
        for j, wy in enumerate(down, -1):
            for i, wx in enumerate(across, -1):
                total = total + p[np.clip(y0 + j, 0, h - 1) - top_row, np.clip(x0 + i, 0, w - 1) - left_col] * (wx * wy)[..., None]
        out = _store(total)
    else:
        raise ValueError(how)
    out[outside] = 0
    return out


@dataclass(frozen=True)
class Mapping:
    """An output size, and the source positions (float32) of a grid of its columns and rows; step: most source pixels per output pixel."""

    width: int
    height: int
    positions: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    step: float = 1.0

    def apply(self, img: np.ndarray, how: str) -> np.ndarray:
        return sample(img, *self.positions(np.arange(self.width), np.arange(self.height)), how)


def resize_map(w: int, h: int, width: int, height: int) -> Mapping:
    check_size(width, height)
    sx, sy = f32(w) / f32(width), f32(h) / f32(height)

    def positions(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.clip((xs.astype(f32) + f32(0.5)) * sx - f32(0.5), f32(0), f32(w - 1)).astype(f32)
        y = np.clip((ys.astype(f32) + f32(0.5)) * sy - f32(0.5), f32(0), f32(h - 1)).astype(f32)
        return tuple(np.meshgrid(x, y))

    return Mapping(width, height, positions, max(w / width, h / height))


def resize(img: np.ndarray, width: int, height: int, how: str) -> np.ndarray:
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    return resize_map(w, h, width, height).apply(img, how)


def wrap_tenths(tenths: int) -> int:
    """Into [-1800, 1800)."""
    return (tenths + 1800) % 3600 - 1800


def rotation(tenths: int) -> tuple[np.float32, np.float32]:
    """sin and cos; the angle in radians is a product in single precision."""
    angle = f32(f32(tenths) / f32(10)) * f32(f32(math.pi) / f32(180))
    return f32(math.sin(float(angle))), f32(math.cos(float(angle)))


def _near_int(v: np.float32) -> int:
    near = np.floor(v + f32(0.5))
    return max(1, int(near if abs(v - near) < f32(1e-4) else np.ceil(v)))


def rotate_map(w: int, h: int, tenths: int, expand: bool) -> Mapping:
    """The inverse map about the centres (+: clockwise)."""
    s, c = rotation(wrap_tenths(tenths))
    out_w, out_h = w, h
    if expand:
        out_w = _near_int(f32(w) * abs(c) + f32(h) * abs(s))
        out_h = _near_int(f32(w) * abs(s) + f32(h) * abs(c))
    check_size(out_w, out_h)
    cx, cy, ox, oy = (f32(f32(v - 1) / f32(2)) for v in (w, h, out_w, out_h))

    def positions(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.meshgrid(xs.astype(f32) - ox, ys.astype(f32) - oy)
        return (x * c + y * s + cx).astype(f32), (-x * s + y * c + cy).astype(f32)

    return Mapping(out_w, out_h, positions, 1.5)


def rotate_any(img: np.ndarray, tenths: int, how: str, expand: bool) -> np.ndarray:
    """Exact quarter turns where they fit (+90 degrees: counter-clockwise), else the inverse map about the centres (+: clockwise)."""
    tenths = wrap_tenths(tenths)
    h, w = img.shape[:2]
    if tenths == 0:
        return img
    if tenths == -1800:
        return img[::-1, ::-1].copy()
    if tenths in (900, -900) and (expand or w == h):
        return rotate_left(img) if tenths == 900 else rotate_right(img)
    return rotate_map(w, h, tenths, expand).apply(img, how)


def turn_map(w: int, h: int, tenths: int) -> Mapping:
    """Exact quarter and half turns, and none, as positions."""
    ways = {0: lambda x, y: (x, y), -1800: lambda x, y: (w - 1 - x, h - 1 - y), 900: lambda x, y: (w - 1 - y, x), -900: lambda x, y: (y, h - 1 - x)}
    way = ways[wrap_tenths(tenths)]
    out = (h, w) if tenths % 1800 else (w, h)
    return Mapping(*out, lambda xs, ys: tuple(v.astype(f32) for v in way(*np.meshgrid(xs, ys))))


def skew_determinant(x_milli: int, y_milli: int) -> float:
    det = 1.0 - (x_milli / 1000.0) * (y_milli / 1000.0)
    if abs(det) < 1e-4:
        raise ImageError("SkewNearSingular", f"{x_milli}, {y_milli}")
    return det


def skew_map(w: int, h: int, x_milli: int, y_milli: int, expand: bool) -> Mapping:
    kx, ky, det = x_milli / 1000.0, y_milli / 1000.0, skew_determinant(x_milli, y_milli)
    cx, cy, out_w, out_h = (w - 1) / 2.0, (h - 1) / 2.0, w, h
    if expand:
        corners_x = [dx + kx * dy for dx in (-cx, cx) for dy in (-cy, cy)]
        corners_y = [ky * dx + dy for dx in (-cx, cx) for dy in (-cy, cy)]
        out_w, out_h = (max(1, math.ceil(max(v) - min(v)) + 1) for v in (corners_x, corners_y))
    check_size(out_w, out_h)
    inverse = 1.0 / det

    def positions(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.meshgrid(xs - (out_w - 1) / 2.0, ys - (out_h - 1) / 2.0)
        return ((x - kx * y) * inverse + cx).astype(f32), ((y - ky * x) * inverse + cy).astype(f32)

    return Mapping(out_w, out_h, positions, (1 + max(abs(kx), abs(ky))) * abs(inverse))


def skew(img: np.ndarray, x_milli: int, y_milli: int, how: str, expand: bool) -> np.ndarray:
    if x_milli == 0 and y_milli == 0:
        return img
    h, w = img.shape[:2]
    return skew_map(w, h, x_milli, y_milli, expand).apply(img, how)


# ---- convolution --------------------------------------------------------------------------------------------------------------


def convolve(img: np.ndarray, weights: list[int], size: int, divisor: int, bias: int, factors=None) -> np.ndarray:
    """Integer convolution with replicated edges; the sum is divided truncating toward zero, then biased and clamped."""
    half = size // 2
    big = sum(map(abs, weights)) * 255 >= 2**62
    p = np.pad(img[..., :3].astype(object if big else np.int64), ((half, half), (half, half), (0, 0)), mode="edge")
    h, w = img.shape[:2]
    if factors is None:
        total = sum(p[j : j + h, i : i + w] * weights[j * size + i] for j in range(size) for i in range(size))
    else:
        col, row = factors
        across = sum(p[:, i : i + w] * row[i] for i in range(size))
        total = sum(across[j : j + h] * col[j] for j in range(size))
    sign = np.where((total < 0) != (divisor < 0), -1, 1)
    out = sign * (abs(total) // abs(divisor)) + bias
    return _with_alpha(np.clip(out, 0, 255).astype(np.int64), img)


def separable(weights: list[int], size: int) -> tuple[list[int], list[int]] | None:
    """(column, row) with weights[j, i] = column[j] * row[i] in integers, or None."""
    if size == 1:
        return [1], list(weights)
    grid = [weights[j * size : (j + 1) * size] for j in range(size)]
    pivot = next((r for r in grid if any(r)), None)
    if pivot is None:
        return [0] * size, [0] * size
    unit = math.gcd(*pivot)
    row = [v // unit for v in pivot]
    at = next(i for i, v in enumerate(row) if v)
    col = []
    for r in grid:
        factor, rest = divmod(r[at], row[at])
        if rest or any(v != factor * u for v, u in zip(r, row, strict=True)):
            return None
        col.append(factor)
    return col, row
