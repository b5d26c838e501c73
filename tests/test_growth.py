"""Operators whose intermediate rows must not outgrow their input."""

import itertools
import random

from pyspark.sql import functions as F

from rasterlake.operators import stats


def test_summed_volume_shuffles_only_occupied_cells(spark):
    rnd = random.Random(3)
    rows = [(i, *(rnd.randint(1, 32) for _ in range(3))) for i in range(5) for _ in range(12)]
    hist = spark.createDataFrame(rows, "image_id long, cr int, cg int, cb int").groupBy("image_id", "cr", "cg", "cb").agg(F.count("*").alias("n"))
    out = stats.summed_volume(hist)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan  # a grid has up to 4,096 rows for 16 cells
    want = set()
    for i in range(5):
        own = [r[1:] for r in rows if r[0] == i]
        for at in itertools.product(*({c[k] for c in own} for k in range(3))):
            want.add((i, *at, sum(all(c[k] <= at[k] for k in range(3)) for c in own)))
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    assert stats.summed_volume(hist.limit(0)).count() == 0


def test_small_images_share_batches():
    import numpy as np
    import pyarrow as pa

    from rasterlake import rasters
    from rasterlake.operators import tiles

    rng = np.random.default_rng(2)
    data = [None if k == 5 else rng.integers(0, 256, 64, dtype=np.uint8).tobytes() for k in range(3000)]
    n = len(data)
    images = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([8] * n, pa.int32()), pa.array([2] * n, pa.int32()), pa.array(data, pa.binary())], names=["image_id", "width", "height", "rgba"])
    got = list(rasters.pixel_batches(iter([images])))
    assert len(got) <= 2  # one a row before
    want = [(i, p // 8, p % 8, *x[4 * p : 4 * p + 4]) for i, x in enumerate(data) if x for p in range(16)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    place = {c: 0 for c in tiles.PLACE} | {"w": 8, "h": 2, "width": 8, "height": 2}
    whole = pa.RecordBatch.from_pylist([{"image_id": i, **place, "rgba": x} for i, x in enumerate(data)], schema=tiles.KINDS)
    cut = list(tiles._mapper(lambda rows: tiles._cut(rows, 3))(iter([whole])))
    assert len(cut) <= 4 and sum(b.num_rows for b in cut) == 3 * (n - 1) + 1


def test_cuts_of_few_cells_are_those_of_many():
    import numpy as np

    from rasterlake.functions import wu

    rng = np.random.default_rng(4)
    for size in [2, 2, 3, 4, 7, 12, 24] * 30:
        cells = np.unique(rng.integers(0, rng.integers(2, 33), (size, 3)), axis=0)
        if len(cells) < 2:
            continue
        n = rng.integers(1, 5, len(cells))
        colour = cells * 8 + rng.integers(0, 8, cells.shape)
        moments = np.column_stack([n, colour * n[:, None], (colour * colour).sum(1) * n])
        assert wu._best_cut_of_few(cells.tolist(), moments.tolist()) == wu._best_cut(cells, moments)
