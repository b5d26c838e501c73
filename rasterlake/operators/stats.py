"""Aggregates and save checks over pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of grids that are passed on at once (and those of one image more).
GRID_ROWS = 1 << 16


def histogram(pixels: DataFrame) -> DataFrame:
    """Moments of the five-bit colour cells of each image (partial aggregates before the shuffle)."""
    cell = {f"c{c}": (F.shiftright(F.col(c), 3) + 1) for c in "rgb"}
    square = F.sum(sum(F.col(c) * F.col(c) for c in "rgb"))
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in "rgb"], square.alias("sq")]
    return pixels.withColumns(cell).groupBy("image_id", *cell).agg(*sums)


def summed_volume(hist: DataFrame) -> DataFrame:
    """Inclusive prefix counts of the occupied cells along red, green and blue of a dense grid over the occupied values.

    Only the occupied cells are shuffled: an image's (32,768 at most) meet in one row, and its grid is made and summed there.
    """
    kind = hist.schema["image_id"].dataType
    cells = hist.filter("image_id is not null").groupBy("image_id").agg(F.collect_list(F.struct("cr", "cg", "cb", "n")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            of = np.stack([c.to_numpy().astype(np.int64) for c in flat.flatten()], -1)
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())].tolist()
            who, grids, held = [], [], 0
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                grids.append(_volumes(of[a:b]))
                who.append(k)
                held += grids[-1].shape[1]
                if held >= GRID_ROWS or k + 1 == batch.num_rows:
                    ids = batch.column(0).take(pa.array(np.repeat(who, [g.shape[1] for g in grids])))
                    axes = np.concatenate(grids, 1)
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array(c.astype(np.int32)) for c in axes[:3]], pa.array(axes[3])], names=["image_id", "cr", "cg", "cb", "volume"])
                    who, grids, held = [], [], 0

    out = T.StructType([T.StructField("image_id", kind), *[T.StructField(c, T.IntegerType()) for c in ("cr", "cg", "cb")], T.StructField("volume", T.LongType())])
    return cells.mapInArrow(run, out)


def _volumes(cells: np.ndarray) -> np.ndarray:
    """Rows red, green, blue and volume of the grid over the occupied values of cells (n, 4): places and count."""
    axes, at = zip(*(np.unique(cells[:, c], return_inverse=True) for c in range(3)), strict=True)
    grid = np.zeros([len(a) for a in axes], np.int64)
    np.add.at(grid, at, cells[:, 3])
    for c in range(3):
        grid = grid.cumsum(c)
    return np.stack([*(g.ravel() for g in np.meshgrid(*axes, indexing="ij")), grid.ravel()])


def color_counts(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.count_distinct(F.struct("r", "g", "b")).alias("colors"), F.max((F.col("a") < 255).cast("int")).alias("transparent"))


def _grid(name: str, top: int, rounded: bool) -> Column:
    """Whether a channel survives quantization to 0..top; decoding rounds in the check and truncates in the decoder."""
    q = f"(({name} * {top} + 127) div 255)"
    back = f"({q} * 255 + {top // 2}) div {top}" if rounded else f"{q} * 255 div {top}"
    return F.expr(back) == F.col(name)


def grid_exact(pixels: DataFrame, green_bits: int, rounded: bool = True) -> DataFrame:
    """Whether every pixel lies on the 5-5-5 or 5-6-5 grid; rounded=False: whether a 16-bit round trip gives it back."""
    tops = {"r": 31, "g": (1 << green_bits) - 1, "b": 31}
    ok = None
    for c, top in tops.items():
        one = _grid(c, top, rounded)
        ok = one if ok is None else ok & one
    return pixels.groupBy("image_id").agg(F.min(ok.cast("int")).alias("exact"))


def save_warnings(pixels: DataFrame, fmt: str) -> DataFrame:
    """Reasons why saving in a format loses information, per image. Formats of 24 and 32 bits get no transparency warning, though
    they drop alpha."""
    limit = {"rgb1": 2, "rgb4": 16, "rle4": 16, "rgb8": 256, "rle8": 256}.get(fmt)
    stats = color_counts(pixels)
    reasons = []
    if fmt not in ("rgb24", "rgb32", "bitfields32"):
        reasons.append(F.when(F.col("transparent") == 1, F.lit("transparency")))
    if limit:
        reasons.append(F.when(F.col("colors") > limit, F.lit("colors")))
    if fmt in ("rgb16", "bitfields16_555", "bitfields16_565"):
        stats = stats.join(grid_exact(pixels, 6 if fmt.endswith("565") else 5), "image_id")
        reasons.append(F.when(F.col("exact") == 0, F.lit("depth")))
    text = F.concat_ws(",", *reasons) if reasons else F.lit("")
    return stats.select("image_id", text.alias("warnings"))


def runs(pixels: DataFrame, channel: str = "r") -> DataFrame:
    """Maximal runs of equal values along rows: gaps and islands within one row of an image."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    new = (F.coalesce(F.lag(channel).over(w) != F.col(channel), F.lit(True))).cast("int")
    island = pixels.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return island.groupBy("image_id", "y", "run").agg(F.min("x").alias("x"), F.count("*").alias("length"), F.first(channel).alias("value")).drop("run")
