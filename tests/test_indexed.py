"""Run-length streams and quantization as Spark expressions against the byte-wise and whole-image forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterlake import rasters
from rasterlake.functions import wu
from rasterlake.operators import quantize, rle, stats
from rasterlake.sources import dib

rnd = random.Random(4)
GRAYS = tuple((i, i, i, 0) for i in range(6))


def image(width, height, colours):
    a = np.array([[rnd.randrange(colours) for _ in range(width)] for _ in range(height)])
    for row in a:
        at = rnd.randrange(width)
        row[at : at + rnd.randrange(400)] = rnd.randrange(colours)
    return a


@pytest.fixture(scope="module")
def images():
    return [image(rnd.choice([1, 2, 3, 5, 17, 300, 700]), rnd.randint(1, 4), rnd.choice([1, 2, 3, 16])) for _ in range(40)]


@pytest.mark.parametrize("four", [False, True])
def test_streams(spark, images, four):
    rows = [(k, y, x, int(a[y, x])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    pixels = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "index"]))
    streams = rle.encode_streams(pixels, four).withColumn("colours", F.lit(16)).cache()
    got = {r.image_id: (bytes(r.body), r.width, r.height) for r in streams.collect()}
    assert got == {k: (dib.encode_rle(a, four), *a.shape[::-1]) for k, a in enumerate(images)}
    back = rle.stream_pixels(rle.place_opcodes(streams, four))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert rle.encode_streams(pixels.limit(0), four).count() == 0


def stream(four):
    value = lambda: rnd.randrange(6 if rnd.random() < 0.98 else 9) * (17 if four else 1)
    out = bytearray()
    for _ in range(rnd.randint(0, 8)):
        kind = rnd.random()
        if kind < 0.4:
            out += bytes((rnd.randint(1, 4), value()))
        elif kind < 0.7:
            out += b"\0\0" if kind < 0.65 else b"\0\1"
        elif kind < 0.8:
            out += bytes((0, 2, rnd.randint(0, 3), rnd.randint(0, 2)))
        else:
            n = rnd.randint(3, 6)
            body = bytes(value() for _ in range((n + 1) // 2 if four else n))
            out += bytes((0, n)) + body + b"\0" * (len(body) % 2)
    return bytes(out[: rnd.randint(0, len(out))] if rnd.random() < 0.1 else out)


@pytest.mark.parametrize("four", [False, True])
def test_any_stream(spark, four):
    cases = [(k, rnd.randint(1, 12), rnd.randint(1, 4) * rnd.choice([1, 1, -1]), stream(four), 6) for k in range(600)]
    cases += [(600, 300, 1, bytes((0, 200)) + bytes(200) + bytes((100, 1, 0, 1)), 6), (601, 2, 1, b"", 6), (602, 9, 1, b"\x02", 6)]
    ops = rle.place_opcodes(spark.createDataFrame(cases, "image_id long, width int, height int, body binary, colours int"), four).cache()
    errors = {r.image_id: r.error for r in rle.stream_errors(ops).collect()}
    pixels = {}
    for r in rle.stream_pixels(ops).collect():
        pixels.setdefault(r.image_id, {})[r.y, r.x] = r["index"]
    palette, met = np.array([(i, i, i, 255) for i in range(6)], np.uint8), set()
    for k, w, h, body, _ in cases:
        d = dib.Dib(variant="INFO", signature=b"BM", file_size=0, reserved_1=b"", reserved_2=b"", pixel_data_offset=0, width=w, height=h, planes=1, bit_count=4 if four else 8, compression=2 if four else 1, palette=GRAYS, bitmap_array=body)
        try:
            want, code = dib._unrle(d, palette), None
        except dib.DibError as e:
            want, code = None, e.code
        met.add(code)
        assert errors.get(k) == code
        if want is None:
            assert k not in pixels
            continue
        got = np.zeros_like(want)
        for at, i in pixels.get(k, {}).items():
            got[at] = palette[i]
        assert (got == want).all()
    assert met == {None, rle.BAD_BOUNDS, rle.BAD_INDEX, rle.BAD_STREAM}


def test_quantization_by_cells(spark):
    pixels = rasters.event_pixels(spark, "/root/testdata/sf0.001").cache()
    whole = {r.image_id: np.frombuffer(r.rgba, np.uint8).reshape(-1, 4)[:, :3] for r in rasters.assemble(pixels).collect()}
    for most in (2, 7, 256):
        got = {}
        for r in quantize.index_pixels(pixels, most).collect():
            got.setdefault(r.image_id, {})[r.y * 16 + r.x] = (r["index"], r.pr, r.pg, r.pb)
        for k, rgb in whole.items():
            palette, index = wu.quantize(rgb, most)
            assert [got[k][i] for i in range(len(rgb))] == [(i, *palette[i]) for i in index.tolist()]
    palette, index = wu.quantize(np.concatenate([whole[k] for k in sorted(whole)]), 5)
    one = {tuple(r) for r in quantize.index_collection(pixels, 5).select("index", "pr", "pg", "pb").distinct().collect()}
    assert one == {(i, *palette[i].tolist()) for i in set(index.tolist())}
    assert quantize.index_pixels(pixels.limit(0), 4).count() == 0
    with pytest.raises(ValueError, match="max_colors"):
        quantize.index_pixels(pixels, 1)


@pytest.mark.parametrize("fmt", ["rle8", "rle4"])
def test_files_from_pixels(spark, fmt):
    pixels, four = rasters.event_pixels(spark, "/root/testdata/sf0.001").withColumn("b", F.lit(9)), fmt == "rle4"
    tagged = quantize.tags(stats.histogram(pixels), 16 if four else 256)
    indexed = quantize.index_pixels(pixels, 16 if four else 256)
    files = rle.wrap_streams(rle.encode_streams(indexed, four), quantize.palettes(tagged), four)
    want = {r.image_id: bytes(r.content) for r in dib.encode_images(rasters.assemble(pixels), fmt).collect()}
    assert {r.image_id: bytes(r.content) for r in files.collect()} == want
