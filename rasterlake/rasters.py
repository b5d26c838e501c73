"""Rasters: pixels derived from ordinary tables, and conversion between row-per-pixel and row-per-image form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"
#: Bytes of images whose pixels are passed on at once (and those of one image more).
BATCH_BYTES = 1 << 18
IMAGES = "image_id long, width int, height int, rgba binary"


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x2 image per embedding: each group of four elements is one pixel."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "embedding")
    p = e.select("image_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    v = lambda c: (F.floor(F.abs(F.element_at("embedding", F.col("p") * 4 + c + 1).cast("double")) * 10000) % 256).cast("int")
    return p.select("image_id", F.expr("p div 8").cast("int").alias("y"), (F.col("p") % 8).alias("x"), *[v(i).alias(c) for i, c in enumerate("rgba")], F.lit(8).alias("w"), F.lit(2).alias("h"))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16x8 image per 128 events; the last image is filled up with black pixels."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    last = F.col("last")
    missing = F.when(last % 128 < 127, F.sequence(last + 1, last - last % 128 + 127))
    fill = e.agg(F.max("event_id").alias("last")).select(F.explode(missing).alias("event_id"), F.lit(0).alias("user_id"), F.lit(0.0).alias("value"))
    v = F.round(F.col("value") * 100).cast("long")
    p = e.unionByName(fill).select(
        F.expr("event_id div 128").alias("image_id"), F.expr("(event_id % 128) div 16").cast("int").alias("y"),
        (F.col("event_id") % 16).cast("int").alias("x"), v.alias("v"), "user_id",
    )
    return p.select("image_id", "y", "x", (F.col("v") % 256).cast("int").alias("r"), F.expr("cast((v div 256) % 256 as int)").alias("g"), ((F.col("user_id") * 37) % 256).cast("int").alias("b"), F.lit(255).alias("a"), F.lit(16).alias("w"), F.lit(8).alias("h"))


def event_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 1024x2 indexed image per 2,048 events, of long runs, plain noise and short runs in turn; the last one is filled up with zeros."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    block = F.expr("event_id div 300")
    e = e.select("event_id", F.when(block % 3 == 0, block % 11).when(block % 3 == 1, F.col("v") % 256).otherwise(F.col("v") % 3).cast("int").alias("index"))
    last = F.col("last")
    missing = F.when(last % 2048 < 2047, F.sequence(last + 1, last - last % 2048 + 2047))
    e = e.unionByName(e.agg(F.max("event_id").alias("last")).select(F.explode(missing).alias("event_id"), F.lit(0).alias("index")))
    return e.select(F.expr("event_id div 2048").alias("image_id"), F.expr("cast((event_id % 2048) div 1024 as int)").alias("y"), (F.col("event_id") % 1024).cast("int").alias("x"), "index")


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel per row, without coordinates: for point operators."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = lambda col, k, f: (F.round(F.col(col) * k).cast("int") * f)
    return t.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") * 5).alias("r"), c("l_discount", 100, 25).alias("g"), c("l_tax", 100, 30).alias("b"), F.lit(255).alias("a"))


def assemble(pixels: DataFrame) -> DataFrame:
    """images of pixels: one row per image, bytes in row order."""
    word = F.lpad(F.hex(((F.col("r") * 256 + F.col("g")) * 256 + F.col("b")).cast("long") * 256 + F.col("a")), 8, "0")
    rows = F.array_sort(F.collect_list(F.struct("y", "x", word.alias("w"))))
    size = [(F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height")]
    out = pixels.groupBy("image_id").agg(*size, rows.alias("rows"))
    return out.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("rows", lambda x: x["w"]), "")).alias("rgba"))


def pixel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels of batches of images, many images to a batch."""

    def pixels(rows: list[tuple]) -> pa.RecordBatch:
        ids, widths, data = zip(*rows, strict=True)
        size = np.array([len(x) // 4 for x in data])
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        y, x = np.divmod(at.astype(np.int32), np.repeat(np.array(widths, np.int32), size))
        px = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 4).astype(np.int32)
        cols = [np.repeat(np.array(ids, np.int64), size), y, x, *px.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["image_id", "y", "x", *"rgba"])

    for batch in batches:
        held, size = [], 0
        for i, w, rgba in zip(*(batch.column(k) for k in (0, 1, 3)), strict=True):
            if not rgba.is_valid:
                continue
            held.append((i.as_py(), w.as_py(), rgba.as_py()))
            size += len(held[-1][2])
            if size >= BATCH_BYTES:
                yield pixels(held)
                held, size = [], 0
        if held:
            yield pixels(held)


def explode_pixels(images: DataFrame) -> DataFrame:
    """pixels of images(image_id, width, height, rgba); images without bytes (failed rows) yield none."""
    return images.select("image_id", "width", "height", "rgba").mapInArrow(pixel_batches, PIXELS)


def pixel_at(images: DataFrame, x: int, y: int) -> DataFrame:
    """Channels of one pixel of every image; null outside."""
    at = F.when((F.lit(x) < F.col("width")) & (F.lit(y) < F.col("height")) & F.lit(x >= 0 and y >= 0), (F.lit(y) * F.col("width") + x) * 4)
    byte = lambda k: F.conv(F.hex(F.substring("rgba", (at + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return images.select("image_id", *[F.when(at.isNotNull(), byte(k)).alias(c) for k, c in enumerate("rgba")])
