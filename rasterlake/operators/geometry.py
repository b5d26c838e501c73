"""Geometry on pixels: projections of the coordinates. Pixels that carry the size of their image (w, h) need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_size(pixels: DataFrame) -> DataFrame:
    """pixels with w and h of their image; where they aren't columns yet, from one small aggregate that is joined back."""
    if {"w", "h"} <= set(pixels.columns):
        return pixels
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return pixels.join(size, "image_id")


def _move(pixels: DataFrame, x: str, y: str, turned: bool = False) -> DataFrame:
    p = with_size(pixels)
    size = [F.col("h").alias("w"), F.col("w").alias("h")] if turned else ["w", "h"]
    return p.select("image_id", F.expr(y).cast("int").alias("y"), F.expr(x).cast("int").alias("x"), *"rgba", *size)


def mirror_horizontal(pixels: DataFrame) -> DataFrame:
    return _move(pixels, "w - 1 - x", "y")


def mirror_vertical(pixels: DataFrame) -> DataFrame:
    return _move(pixels, "x", "h - 1 - y")


def rotate_left(pixels: DataFrame) -> DataFrame:
    return _move(pixels, "y", "w - 1 - x", True)


def rotate_right(pixels: DataFrame) -> DataFrame:
    return _move(pixels, "h - 1 - y", "x", True)


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The rectangle of every image that holds it wholly; images that don't yield no pixels."""
    p = with_size(pixels).filter((F.col("w") >= x + width) & (F.col("h") >= y + height))
    p = p.filter(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    size = [F.lit(width).alias("w"), F.lit(height).alias("h")]
    return p.select("image_id", (F.col("y") - y).cast("int").alias("y"), (F.col("x") - x).cast("int").alias("x"), *"rgba", *size)


def translate(pixels: DataFrame, dx: int, dy: int, expand: bool, fill: tuple[int, int, int, int]) -> DataFrame:
    """Moved pixels that stay inside, and fill where no pixel came: of each image, its first pixel yields these."""
    left, top = (max(dx, 0), max(dy, 0)) if expand else (dx, dy)
    p = with_size(pixels)
    wide, tall = (F.col("w") + (abs(dx) if expand else 0)).cast("int"), (F.col("h") + (abs(dy) if expand else 0)).cast("int")
    names = ("image_id", "y", "x", *"rgba", "w", "h")
    moved = p.select("image_id", (F.col("y") + top).cast("int").alias("y"), (F.col("x") + left).cast("int").alias("x"), *"rgba", wide.alias("w"), tall.alias("h"))
    moved = moved.filter((F.col("x") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") >= 0) & (F.col("y") < F.col("h")))
    grid = p.filter((F.col("x") == 0) & (F.col("y") == 0)).select("image_id", F.col("w").alias("ow"), F.col("h").alias("oh"), wide.alias("w"), tall.alias("h"))
    grid = grid.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    covered = F.col("x").between(left, F.col("ow") + left - 1) & F.col("y").between(top, F.col("oh") + top - 1)
    bare = grid.filter(~covered).select("image_id", "y", "x", *[F.lit(v).alias(c) for c, v in zip("rgba", fill, strict=True)], "w", "h")
    return moved.select(*names).unionByName(bare.select(*names))
