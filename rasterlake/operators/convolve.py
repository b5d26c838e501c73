"""Convolution on pixels: two windows, along rows and then columns, whose shifts fall back to the edge pixel.

Pixels are dealt once, to square tiles; those within half a kernel of a tile go to it as well, so both windows stay within a tile's task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.imaging import ImageError, separable


@dataclass(frozen=True)
class Kernel:
    """Odd n x n integer weights, a divisor that isn't zero, and a bias."""

    weights: tuple[int, ...]
    size: int
    divisor: int = 1
    bias: int = 0

    def __post_init__(self) -> None:
        if self.size < 1 or self.size % 2 == 0:
            raise ImageError("InvalidSize", str(self.size))
        if len(self.weights) != self.size**2:
            raise ImageError("InvalidWeightCount", str(len(self.weights)))
        if self.divisor == 0:
            raise ImageError("ZeroDivisor")

    @property
    def factors(self) -> tuple[list[int], list[int]] | None:
        return separable(list(self.weights), self.size)

    @property
    def cost(self) -> int:
        return 2 * self.size if self.factors else self.size**2


def binomial_row(size: int) -> list[int]:
    row = [1]
    for _ in range(size - 1):
        row = [a + b for a, b in zip([0, *row], [*row, 0], strict=True)]
    return row


def preset(name: str, size: int = 3) -> Kernel:
    """blur, sharpen, edge, emboss or identity of size 1, 3, 5 or 7."""
    h, cells = size // 2, [(j, i) for j in range(size) for i in range(size)]
    row = binomial_row(size)
    blur, unit = [row[j] * row[i] for j, i in cells], [int(j == h and i == h) for j, i in cells]
    total = sum(row) ** 2
    if name == "identity":
        return Kernel(tuple(unit), size)
    if name == "blur":
        return Kernel(tuple(blur), size, total)
    if name == "sharpen":
        if size == 3:
            return Kernel((0, -1, 0, -1, 5, -1, 0, -1, 0), 3)
        return Kernel(tuple(2 * total * u - b for u, b in zip(unit, blur, strict=True)), size, total)
    if name == "edge":
        return Kernel(tuple(size**2 - 1 if u else -1 for u in unit), size)
    if name == "emboss":
        return Kernel(tuple((i - h) + (j - h) for j, i in cells), size, 1, 128)
    raise ValueError(name)


def resize_kernel(k: Kernel, size: int) -> Kernel:
    """The same weights about the centre, cut or padded with zeros."""
    d = k.size // 2 - size // 2
    at = lambda j, i: k.weights[(j + d) * k.size + i + d] if 0 <= j + d < k.size and 0 <= i + d < k.size else 0
    return Kernel(tuple(at(j, i) for j in range(size) for i in range(size)), size, k.divisor, k.bias)


def parse_kernel(text: str, divisor: int = 1, bias: int = 0) -> Kernel:
    """Rows of integers; an error names its row and column."""
    rows = [r.replace(",", " ").split() for r in text.strip().splitlines()]
    out = []
    for j, r in enumerate(rows):
        for i, cell in enumerate(r):
            try:
                out.append(int(cell))
            except ValueError:
                raise ImageError("InvalidWeight", f"row {j + 1}, column {i + 1}: {cell}") from None
    return Kernel(tuple(out), len(rows), divisor, bias)


def _shift(c: Column, k: int, order: Window, whole: Window) -> Column:
    if k == 0:
        return c
    moved = F.lag(c, -k).over(order) if k < 0 else F.lead(c, k).over(order)
    return F.coalesce(moved, (F.first(c) if k < 0 else F.last(c)).over(whole))


#: Side of a tile in pixels: what one group of the shuffle holds, whatever the image's size.
TILE = 256


def with_halo(pixels: DataFrame, half: int, tile: int) -> DataFrame:
    """pixels with ty, tx: one row for each tile that they are in or at most ``half`` pixels away from, dealt by tile."""

    def tiles(c: str):
        return F.sequence(F.expr(f"greatest(0, {c} - {half}) div {tile}").cast("int"), F.expr(f"({c} + {half}) div {tile}").cast("int"))

    out = pixels.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))
    return out.repartition("image_id", "ty", "tx")


def convolve(pixels: DataFrame, kernel: Kernel, tile: int = TILE) -> DataFrame:
    """One shuffle, of pixels with the halos of their tiles; a window's partition is a row or a column of a tile."""
    n, half, factors = kernel.size, kernel.size // 2, kernel.factors
    key = ("image_id", "ty", "tx")
    across = Window.partitionBy(*key, "y").orderBy("x")
    down = Window.partitionBy(*key, "x").orderBy("y")
    all_of = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pixels = with_halo(pixels.select("image_id", "y", "x", *"rgba"), half, tile)
    taps = {(c, i): _shift(F.col(c).cast("long"), i - half, across, all_of(across)) for c in "rgb" for i in range(n)}
    if factors:
        col, row = factors
        mid = pixels.select(*key, "y", "x", "a", *[sum(taps[c, i] * row[i] for i in range(n)).alias(f"{c}_0") for c in "rgb"])
        sums = {c: sum(_shift(F.col(f"{c}_0"), j - half, down, all_of(down)) * col[j] for j in range(n)) for c in "rgb"}
    else:
        mid = pixels.select(*key, "y", "x", "a", *[v.alias(f"{c}_{i}") for (c, i), v in taps.items()])
        part = lambda c, j: sum(F.col(f"{c}_{i}") * kernel.weights[j * n + i] for i in range(n))
        sums = {c: sum(_shift(part(c, j), j - half, down, all_of(down)) for j in range(n)) for c in "rgb"}
    out = mid.select(*key, "y", "x", "a", *[v.alias(f"s{c}") for c, v in sums.items()])
    out = out.filter(F.expr(f"y div {tile} = ty and x div {tile} = tx"))
    norm = lambda c: F.least(F.greatest(F.expr(f"s{c} div {kernel.divisor}") + kernel.bias, F.lit(0)), F.lit(255)).cast("int")
    return out.select("image_id", "y", "x", *[norm(c).alias(c) for c in "rgb"], "a")
