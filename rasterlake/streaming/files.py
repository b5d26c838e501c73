"""Bitmap files as a stream: the same stateless operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlake.sources.dib import decode_images


def stream_images(spark: SparkSession, path: str) -> DataFrame:
    """images(path, width, height, rgba, status) of the bitmap files that arrive under path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.bmp").load(path)
    return decode_images(files.select("path", "content"), id_col="path")
