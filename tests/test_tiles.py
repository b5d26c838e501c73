"""Transforms on tiles against those on whole images, and the shuffles of a convolution."""

import numpy as np
import pytest

from rasterlake.functions import imaging as im
from rasterlake.operators import convolve, tiles

RNG = np.random.default_rng(7)
IMAGES = {k: RNG.integers(0, 256, (h, w, 4), dtype=np.uint8) for k, (h, w) in enumerate([(37, 50), (1, 1), (64, 16), (16, 16), (3, 90)])}


@pytest.fixture(scope="module")
def images(spark):
    rows = [(k, a.shape[1], a.shape[0], a.tobytes()) for k, a in IMAGES.items()]
    return spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary").cache()


def whole(blocks):
    out = {}
    for r in blocks.collect():
        assert r.error is None
        img, seen = out.setdefault(r.image_id, (np.zeros((r.height, r.width, 4), np.uint8), np.zeros((r.height, r.width), int)))
        img[r.y : r.y + r.h, r.x : r.x + r.w] = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
        seen[r.y : r.y + r.h, r.x : r.x + r.w] += 1
    assert all((seen == 1).all() for _, seen in out.values())
    return {k: img for k, (img, _) in out.items()}


CASES = [
    (lambda t, n: tiles.resize(t, 23, 71, "bicubic", n), lambda a: im.resize(a, 23, 71, "bicubic")),
    (lambda t, n: tiles.resize(t, 5, 2, "nearest", n), lambda a: im.resize(a, 5, 2, "nearest")),
    (lambda t, n: tiles.resize(t, 16, 16, "bilinear", n), lambda a: im.resize(a, 16, 16, "bilinear")),
    (lambda t, n: tiles.skew(t, 350, -200, "bicubic", True, n), lambda a: im.skew(a, 350, -200, "bicubic", True)),
    (lambda t, n: tiles.skew(t, 0, 0, "bicubic", True, n), lambda a: a),
]
for _tenths, _expand in ((0, False), (300, True), (-125, False), (1800, False), (900, True), (900, False), (-900, True), (2700, False)):
    CASES.append((lambda t, n, a=_tenths, e=_expand: tiles.rotate_any(t, a, "bilinear", e, n), lambda i, a=_tenths, e=_expand: im.rotate_any(i, a, "bilinear", e)))


@pytest.mark.parametrize("case", range(len(CASES)))
def test_tiled_equals_whole(images, case):
    tiled, plain = CASES[case]
    got = whole(tiled(tiles.cut_images(images, 16), 16))
    assert got.keys() == IMAGES.keys()
    for k, a in IMAGES.items():
        assert (got[k] == plain(a)).all(), k


def test_shrinking_gathers_no_image(images):
    """An output block reads about a tile of its source, however far the image shrinks."""
    blocks = tiles.resize(tiles.cut_images(images, 16), 4, 4, "bilinear", 16).filter("image_id = 0")
    assert blocks.count() == 16 / 1 and blocks.agg({"w": "max"}).first()[0] == 1


def test_retiling(images):
    turned = tiles.rotate_any(tiles.cut_images(images, 16), 300, "nearest", True, 16)
    again = tiles.retile(turned, 16)
    assert all(r.y % 16 == 0 and r.x % 16 == 0 and (r.w == 16 or r.x + r.w == r.width) for r in again.collect())
    back = whole(tiles.skew(again, 100, 0, "bilinear", False, 16))
    for k, a in IMAGES.items():
        assert (back[k] == im.skew(im.rotate_any(a, 300, "nearest", True), 100, 0, "bilinear", False)).all()


def test_images_that_grow_too_large_stay_as_rows(images):
    got = tiles.resize(tiles.cut_images(images, 16), 100_000, 100_000, "nearest", 16).collect()
    assert {(r.image_id, r.error, r.rgba) for r in got} == {(k, "OutputTooLarge", None) for k in IMAGES}
    assert tiles.block_pixels(tiles.cut_images(images.limit(0), 16)).count() == 0


@pytest.mark.parametrize("tile", [4, 256])
def test_convolution_takes_one_shuffle(images, tile):
    kernel = convolve.Kernel(tuple((7 * i * i + 3 * i) % 11 - 5 for i in range(25)), 5, 3, 7)
    pixels = tiles.block_pixels(tiles.cut_images(images, 16))
    out = convolve.convolve(pixels, kernel, tile)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {k: np.zeros_like(a) for k, a in IMAGES.items()}
    for r in out.collect():
        got[r.image_id][r.y, r.x] = (r.r, r.g, r.b, r.a)
    for k, a in IMAGES.items():
        assert (got[k] == im.convolve(a, list(kernel.weights), 5, 3, 7)).all()
