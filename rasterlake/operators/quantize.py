"""Colour quantization of pixels: moments are aggregated in Spark, cuts see the moments alone, and pixels get their index by a join."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import wu
from rasterlake.operators import stats

CELL = ("cr", "cg", "cb")


def tags(moments: DataFrame, most: int) -> DataFrame:
    """(image_id, cr, cg, cb, index, pr, pg, pb): palette index and colour of every occupied cell of stats.histogram.

    An image is at most 32,768 rows here, however many pixels it has.
    """
    if not 2 <= most <= 256:
        raise ValueError("max_colors must be 2 to 256")
    columns = ["image_id", *CELL, "n", "sr", "sg", "sb", "sq"]

    def cut(rows: np.ndarray) -> np.ndarray:
        palette, index = wu.split(rows[:, 1:4] - 1, rows[:, 4:], most)
        return np.column_stack([rows[:, :4], index, palette[index].astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(columns)), np.int64)  # the last image of a batch may go on in the next one
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns])])
            starts = np.flatnonzero(np.r_[True, held[1:, 0] != held[:-1, 0]]) if len(held) else np.zeros(0, np.int64)
            ends = [*starts[1:].tolist(), *([len(held)] if batch is None and len(held) else [])]
            if ends:
                out = np.concatenate([cut(held[x:y]) for x, y in zip(starts.tolist(), ends, strict=False)])
                held = held[ends[-1] :]
                arrays = [pa.array(out[:, 0]), *[pa.array(out[:, k].astype(np.int32)) for k in range(1, 8)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["image_id", *CELL, "index", "pr", "pg", "pb"])

    ordered = moments.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("long").alias(c) for c in columns[1:]])
    ordered = ordered.repartition("image_id").sortWithinPartitions("image_id", *CELL)
    return ordered.mapInArrow(run, "image_id long, cr int, cg int, cb int, index int, pr int, pg int, pb int")


def index_pixels(pixels: DataFrame, most: int) -> DataFrame:
    """pixels with index, pr, pg, pb of a palette of at most that many colours for each image."""
    moments = stats.histogram(pixels)
    cells = {f"c{c}": F.shiftright(F.col(c), 3) + 1 for c in "rgb"}
    return pixels.withColumns(cells).join(tags(moments, most), ["image_id", *CELL]).drop(*CELL)


def collection_tags(pixels: DataFrame, most: int) -> DataFrame:
    """(cr, cg, cb, index, pr, pg, pb) of one palette for all images together: 32,768 rows at most."""
    return tags(stats.histogram(pixels.withColumn("image_id", F.lit(0).cast("long"))), most).drop("image_id")


def index_collection(pixels: DataFrame, most: int) -> DataFrame:
    """pixels with index, pr, pg, pb of one palette for the whole collection; the tags are broadcast, for their number is bounded."""
    cells = {f"c{c}": F.shiftright(F.col(c), 3) + 1 for c in "rgb"}
    return pixels.withColumns(cells).join(F.broadcast(collection_tags(pixels, most)), list(CELL)).drop(*CELL)


def palettes(tagged: DataFrame) -> DataFrame:
    """(image_id, index, r, g, b) of the palettes in the result of :func:`tags`."""
    return tagged.select("image_id", "index", F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b")).distinct()
