"""Wu colour quantization over a 33-cell cube of five-bit colours, on the moments of the occupied cells alone."""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Boxes of so many cells are cut without arrays; cells of images up to so many are also kept as lists.
SMALL, LISTED = 24, 1024


def _square(m: np.ndarray) -> np.ndarray:
    """Squared length of the colour sums in m (count, red, green, blue, squares last), each cast first."""
    r, g, b = (m[..., i].astype(np.float64) for i in (1, 2, 3))
    return r * r + g * g + b * b


def _spread(m: list[int]) -> float:
    """Variance times count of a box, from its moments."""
    n, r, g, b, squares = m
    r, g, b = float(r), float(g), float(b)
    return float(squares) - (r * r + g * g + b * b) / n if n else 0.0


def _best_cut_of_few(orders: list[list[int]], at, own, total: list[int]) -> tuple[int, int]:
    """As _best_cut, for a box of few cells, ordered along each axis: only the occupied places can begin a better score."""
    if len(orders[0]) == 2:  # any cut gives the same two parts
        i, j = orders[0]
        axis = next(k for k in range(3) if at[k][i] != at[k][j])
        return axis, min(at[axis][i], at[axis][j])
    best, found = -math.inf, (-1, -1)
    n, r, g, b, _ = map(float, total)
    for axis, (order, place) in enumerate(zip(orders, at, strict=True)):
        n0 = r0 = g0 = b0 = 0.0
        last = place[order[0]]
        for i in order:
            k = place[i]
            if k != last:
                if n0 > 0 and n > n0:
                    r1, g1, b1 = r - r0, g - g0, b - b0
                    score = (r0 * r0 + g0 * g0 + b0 * b0) / n0 + (r1 * r1 + g1 * g1 + b1 * b1) / (n - n0)
                    if score > best:
                        best, found = score, (axis, last)
                last = k
            m = own[i]
            n0 += m[0]
            r0 += m[1]
            g0 += m[2]
            b0 += m[3]
    return found


def _best_cut(cells: np.ndarray, moments: np.ndarray) -> tuple[int, int]:
    """Axis and cut (last place below it) of the best score, of all cuts along all axes at once; the first of equals, -1 without any."""
    at = (cells + (0, 32, 64)).ravel()
    sums = np.stack([np.bincount(at, np.repeat(moments[:, c], 3), 96) for c in range(4)], -1).reshape(3, 32, 4).cumsum(1)
    below, above = sums[:, :-1], sums[:, -1:] - sums[:, :-1]
    n, rest = below[..., 0], above[..., 0]
    score = np.where((n > 0) & (rest > 0), _square(below) / np.maximum(n, 1) + _square(above) / np.maximum(rest, 1), -np.inf)
    k = int(np.argmax(score))
    return (k // 31, k % 31) if score.flat[k] > -np.inf else (-1, -1)


def split(cells: np.ndarray, moments: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette of shape (k, 3), index of each cell) of occupied cells (n, 3) with their moments (n, 5): count, channel sums, squares.

    The box of greatest variance is cut first, the last of equals; work and memory follow the occupied cells, 32,768 at most.
    """
    if not 2 <= most <= 256:
        raise ValueError("max_colors must be 2 to 256")
    boxes, sums = [np.arange(len(cells))], [moments.sum(0).tolist()]
    listed = len(cells) <= LISTED  # else the cells of small boxes are filled in
    at, own = (cells.T.tolist(), moments.tolist()) if listed else (({}, {}, {}), {})
    heap = [(-_spread(sums[0]), 0)]  # the greatest first, of equals the last
    while len(boxes) < most:
        v, pick = heapq.heappop(heap)
        if v >= 0:
            break
        box = boxes[-pick]
        if isinstance(box, np.ndarray) and len(box) <= SMALL:
            ids = box.tolist()
            if not listed:
                own.update(zip(ids, moments[box].tolist(), strict=True))
                for k in range(3):
                    at[k].update(zip(ids, cells[box, k].tolist(), strict=True))
            box = boxes[-pick] = [sorted(ids, key=places.__getitem__) for places in at]  # in the order of each axis
        few = isinstance(box, list)
        if few:
            axis, cut = _best_cut_of_few(box, at, own, sums[-pick])
        else:
            axis, cut = _best_cut(cells[box], moments[box])
        if axis < 0:
            heapq.heappush(heap, (0.0, pick))
            continue
        if few:
            side, size = at[axis], len(box[0])
            if size == 2:
                i, j = box[0] if side[box[0][0]] <= cut else box[0][::-1]
                parts = [[i]], [[j]]
            else:
                parts = [[i for i in order if side[i] <= cut] for order in box], [[i for i in order if side[i] > cut] for order in box]
            some = parts[0][0]
            below = own[some[0]] if len(some) == 1 else [sum(m) for m in zip(*[own[i] for i in some], strict=True)]
            alone = len(some) == 1, len(parts[1][0]) == 1
        else:
            low = cells[box, axis] <= cut
            parts, below = [box[low], box[~low]], moments[box[low]].sum(0).tolist()
            alone = len(parts[0]) == 1, len(parts[1]) == 1
        above = [x - y for x, y in zip(sums[-pick], below, strict=True)]
        boxes[-pick], sums[-pick] = parts[0], below
        boxes.append(parts[1])
        sums.append(above)
        # a cell alone is never cut
        heapq.heappush(heap, (0.0 if alone[0] else -_spread(below), pick))
        heapq.heappush(heap, (0.0 if alone[1] else -_spread(above), 1 - len(boxes)))
    tags, palette = np.zeros(len(cells), np.int64), []
    for i, (box, (n, r, g, b, _)) in enumerate(zip(boxes, sums, strict=True)):
        palette.append([(v + n // 2) // n for v in (r, g, b)] if n else [0, 0, 0])
        tags[box[0] if isinstance(box, list) else box] = i
    return np.array(palette, np.uint8), tags


def quantize(rgb: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(palette of shape (k, 3), index of each pixel) of rgb (n, 3) uint8, with at most that many colours (2 to 256)."""
    p = rgb.astype(np.int64)
    flat, cell = np.unique((p[:, 0] >> 3) << 10 | (p[:, 1] >> 3) << 5 | p[:, 2] >> 3, return_inverse=True)
    columns = (np.ones(len(p), np.int64), p[:, 0], p[:, 1], p[:, 2], (p * p).sum(1))
    moments = np.stack([np.bincount(cell, weights=c, minlength=len(flat)).astype(np.int64) for c in columns], -1)
    palette, tags = split(np.stack([flat >> 10, flat >> 5 & 31, flat & 31], -1), moments, most)
    return palette, tags[cell]
