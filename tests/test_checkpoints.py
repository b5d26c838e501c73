"""Replay from tables: what is stored, what a second run computes, and equality with a plain replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.plans import checkpoints
from rasterlake.plans import pipeline as pl

RNG = np.random.default_rng(3)
STEPS = pl.Pipeline((pl.Brightness(5), pl.RotateLeft(), pl.Crop(0, 0, 4, 4), pl.InvertColors(), pl.Grayscale()))


def images(spark, sizes):
    rows = [(k, w, h, RNG.integers(0, 256, w * h * 4, dtype=np.uint8).tobytes()) for k, (w, h) in enumerate(sizes)]
    return spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary")


def rows(df):
    return sorted((r.image_id, r.width, r.height, r.rgba and bytes(r.rgba), tuple(map(tuple, r.failed))) for r in df.collect())


@pytest.mark.parametrize("strict", [True, False])
def test_resumed_replay(spark, tmp_path, strict):
    df = images(spark, [(6, 5), (2, 2), (4, 9), (1, 7)])  # the second and the last are too small for the crop
    tables = checkpoints.CheckpointTables(spark, str(tmp_path / "t"), threshold=1, most=9)
    want = rows(STEPS.apply(df, strict))
    assert rows(tables.run(df, STEPS, strict)) == want
    levels = tables.levels(STEPS)
    assert tables.stored(STEPS, strict) == {n: 4 if n <= 2 else 2 for n in levels} and max(levels) > 2
    assert rows(tables.run(df, STEPS, strict)) == want and tables.stored(STEPS, strict)[levels[-1]] == 2
    # A longer pipeline goes on from there; a new and a changed image are replayed, the others aren't stored again.
    longer = STEPS.push(pl.MirrorVertical()).push(pl.Contrast(20))
    more = df.filter("image_id <> 0").unionByName(images(spark, [(8, 8)]))
    assert rows(tables.run(more, longer, strict)) == rows(longer.apply(more, strict))
    assert tables.stored(STEPS, strict)[1] == 5  # the changed image has a row of its own
    tables.keep(longer, strict)
    assert tables.stored(STEPS, strict)[1] == 5
    tables.keep(pl.Pipeline((pl.Sepia(),)), strict)
    assert set(tables.stored(STEPS, strict).values()) == {0}
    assert tables.run(df.limit(0), STEPS, strict).count() == 0


def test_tables_are_read(spark, tmp_path):
    df = images(spark, [(6, 5)])
    tables = checkpoints.CheckpointTables(spark, str(tmp_path / "t"), threshold=1, most=1)
    n = tables.levels(STEPS)[-1]
    key = df.select(F.xxhash64("width", "height", "rgba")).first()[0]
    spark.createDataFrame([(0, key, 1, 1, bytes((7, 8, 9, 10)))], checkpoints.ROWS).write.parquet(tables.path(STEPS, n, True))
    assert n == len(STEPS.ops) and rows(tables.run(df, STEPS)) == [(0, 1, 1, bytes((7, 8, 9, 10)), ())]


def test_limits(spark, tmp_path):
    df = images(spark, [(6, 5)])
    none = checkpoints.CheckpointTables(spark, str(tmp_path / "t"), threshold=1, most=0)
    assert none.levels(STEPS) == [] and rows(none.run(df, STEPS)) == rows(STEPS.apply(df))
