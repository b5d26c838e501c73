"""Replay that is resumed image by image from tables of pipeline prefixes in shared storage.

Each prefix whose summed cost reaches the threshold has a table of its own, named by the prefix and the kind of replay. Its rows are keyed by
image and a hash of the source, so a changed image is replayed anew. Images that fail in a prefix have no row in its table: they go on
from their last good one, and don't keep others from being stored. Tables are ordinary Parquet, so they outlive executors and sessions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.plans.pipeline import Executor, Pipeline

KEY = ["image_id", "source"]
ROWS = "image_id long, source long, width int, height int, rgba binary"


class CheckpointTables:
    """Tables under a folder that all executors share; ``most``: of a pipeline's prefixes the longest so many are stored."""

    def __init__(self, spark: SparkSession, folder: str, threshold: int = 15, most: int = 5) -> None:
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        self.planner = Executor(threshold, most)

    def path(self, pipeline: Pipeline, n: int, strict: bool) -> str:
        return f"{self.folder}/prefix-{hashlib.sha256(repr((strict, pipeline.ops[:n])).encode()).hexdigest()[:32]}"

    def levels(self, pipeline: Pipeline) -> list[int]:
        cuts = self.planner.cuts(pipeline.ops)
        return cuts[-self.most :] if self.most else []

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, path: str) -> DataFrame:
        """A table's rows; none if it hasn't been written. Two runs at once may store an image twice: one row counts."""
        at, files = self._file(path)
        if not files.exists(at):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(path).dropDuplicates(KEY)

    def stored(self, pipeline: Pipeline, strict: bool = True) -> dict[int, int]:
        """Images in the table of each prefix, by its length."""
        return {n: self.read(self.path(pipeline, n, strict)).count() for n in self.levels(pipeline)}

    def run(self, images: DataFrame, pipeline: Pipeline, strict: bool = True) -> DataFrame:
        """What ``pipeline.apply(images, strict)`` gives; image ids must be unique. Stores what the tables don't have yet."""
        source = images.select("image_id", F.xxhash64("width", "height", "rgba").alias("source"), "width", "height", "rgba")
        keys = source.select(*KEY)
        states = {0: source}
        for n in self.levels(pipeline):
            path, before = self.path(pipeline, n, strict), max(states)
            known = self.read(path).select(*KEY)
            missing = states[before].join(known, KEY, "left_anti")
            if missing.limit(1).count():
                done = Pipeline(pipeline.ops[:n]).apply(missing, strict, before).filter("size(failed) = 0").join(keys, "image_id")
                done.select("image_id", "source", "width", "height", "rgba").write.mode("append").parquet(path)
            states[n] = self.read(path).join(keys, KEY, "left_semi")
        out, order = None, sorted(states)
        for n, after in zip(order, [*order[1:], None], strict=True):
            last = states[n] if after is None else states[n].join(states[after].select(*KEY), KEY, "left_anti")
            part = pipeline.apply(last, strict, n)
            out = part if out is None else out.unionByName(part)
        return out

    def keep(self, pipeline: Pipeline, strict: bool = True) -> None:
        """Delete the tables of all prefixes but those of a pipeline."""
        own = {self.path(pipeline, n, strict).rsplit("/", 1)[1] for n in self.levels(pipeline)}
        top, files = self._file(self.folder)
        for found in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(top, "prefix-*")) or ():
            if found.getPath().getName() not in own:
                files.delete(found.getPath(), True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder in the session's ``spark.checkpoint.dir``, or in the warehouse where that is unset."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}"
