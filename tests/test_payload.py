"""Payload operators on pixels against the row-per-image form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake import rasters
from rasterlake.functions import steg
from rasterlake.functions.imaging import ImageError
from rasterlake.operators import payload

CASES = [((1, 0, 0, 0), 9, 12, b""), ((0, 2, 0, 0), 40, 7, b"two"), ((1, 2, 1, 0), 16, 8, b"some bytes of text"), ((8, 8, 8, 8), 3, 1, b"ab"), ((0, 0, 0, 3), 64, 3, bytes(range(60))), ((3, 0, 5, 1), 23, 11, bytes(range(250))), ((2, 0, 0, 1), 5, 130, bytes(200))]


def images(rng):
    return {i: rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for i, (_, w, h, _) in enumerate(CASES)}


def pixel_table(spark, imgs):
    rows = [(i, y, x, *map(int, img[y, x]), img.shape[1], img.shape[0]) for i, img in imgs.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int, w int, h int")


def back(pixels, imgs):
    out = {i: np.zeros_like(img) for i, img in imgs.items()}
    for p in pixels.collect():
        out[p.image_id][p.y, p.x] = p.r, p.g, p.b, p.a
    return out


def outcome(img):
    try:
        hit = steg.detect(img)
        return (list(hit[0]), hit[1], None) if hit else (None, None, None)
    except ImageError as e:
        return None, None, e.code


def test_embed_detect_extract_remove(spark):
    imgs = images(np.random.default_rng(5))
    payloads = spark.createDataFrame([(i, list(c), bytearray(p)) for i, (c, _, _, p) in enumerate(CASES)], "image_id long, config array<int>, payload binary")
    pixels = pixel_table(spark, imgs)
    hidden = payload.embed(pixels, payloads)
    assert hidden.columns == pixels.columns
    want = {i: steg.embed(imgs[i], c, p) for i, (c, _, _, p) in enumerate(CASES)}
    got = back(hidden, imgs)
    for i in imgs:
        assert (got[i] == want[i]).all(), CASES[i]
    found = payload.detect(hidden)
    assert {r.image_id: (r.config, r.length, r.error) for r in found.collect()} == {i: (list(c), len(p), None) for i, (c, _, _, p) in enumerate(CASES)}
    assert {r.image_id: bytes(r.payload) for r in payload.extract(hidden, found).collect()} == {i: p for i, (_, _, _, p) in enumerate(CASES)}
    clean = back(payload.remove(hidden, found), imgs)
    for i, (c, *_) in enumerate(CASES):
        assert (clean[i] == steg.remove(want[i], c)).all()


def test_payloads_that_do_not_fit(spark):
    imgs = images(np.random.default_rng(6))
    bad = [(0, [1, 0, 0, 0], bytearray(4)), (1, [0, 0, 0, 0], bytearray(1)), (2, [9, 0, 0, 0], bytearray(1)), (3, [1, 1, 1, 0], bytearray(0)), (4, [0, 0, 0, 3], None)]
    payloads = spark.createDataFrame(bad, "image_id long, config array<int>, payload binary")
    pixels = pixel_table(spark, imgs)
    codes = {r.image_id: r.code for r in payload.check(pixels.select("image_id", "w", "h").distinct(), payloads).collect()}
    assert codes == {0: "InsufficientCapacity", 1: "NoChannels", 2: "InvalidChannelDepth", 3: "InsufficientCapacity", 4: None}
    got = back(payload.embed(pixels, payloads), imgs)
    for i in imgs:
        assert (got[i] == imgs[i]).all() == (i != 4)
    assert {r.image_id for r in payload.detect(payload.embed(pixels, payloads)).filter("config is not null").collect()} == {4}
    empty = payload.embed(pixels.limit(0), payloads)
    assert empty.count() == 0 and payload.detect(empty).count() == 0


def test_detect_names_the_same_hit_and_error(spark):
    """Headers that are broken in their version, number or length, several in one image, and images of one colour."""
    rng = np.random.default_rng(7)
    imgs = {}
    for i in range(60):
        img = rng.integers(0, 256, (6, 20, 4), dtype=np.uint8)
        config = tuple(int(v) for v in rng.integers(0, 4, 4))
        if sum(config):
            img = steg.embed(img, config, b"x")
            bits = {0: None, 1: (32, [1]), 2: (48 + 20, [1]), 3: (36, [1]), 4: (34, [1])}[i % 5]
            if bits:
                flat = img.reshape(-1, 4)
                at, one = bits
                steg.write_bits(flat, config, at, steg.read_bits(flat, config, at, 1) ^ np.array(one, np.uint8))
        imgs[i] = img
    imgs[60], imgs[61], imgs[62] = np.zeros((2, 50, 4), np.uint8), np.full((9, 9, 4), 255, np.uint8), np.full((9, 9, 4), 0x53, np.uint8)
    imgs[63] = imgs[0][:1, :1]
    want = {i: outcome(img) for i, img in imgs.items()}
    assert {w[2] for w in want.values()} == {None, "UnsupportedVersion", "PayloadTooLarge"}
    pixels = pixel_table(spark, imgs)
    assert {r.image_id: (r.config, r.length, r.error) for r in payload.detect(pixels).collect()} == want
    whole = rasters.assemble(pixels)
    assert {r.image_id: (r.config, r.length, r.error) for r in payload.detect_images(whole).collect()} == want


@pytest.mark.parametrize("head", [[0, 0, 0, 0], [255, 255, 255, 255], [0x53, 0x54, 0x45, 0x47], [3, 9, 20, 77]])
def test_candidates_are_all_configurations_that_may_hold_a_marker(head):
    flat = np.array([head], np.uint8)
    mark = np.unpackbits(np.frombuffer(steg.MARKER, np.uint8), bitorder="little")
    every = [steg.decode_config(v) for v in range(1, steg.CONFIGS)]
    assert steg._candidates(head) == [c for c in every if (steg.read_bits(flat, c, 0, sum(c)) == mark[: sum(c)]).all()]


def test_hot_image_is_shared_among_tasks(spark):
    """One image holds all pixels: its blocks are dealt by (image, block), so embedding deals them evenly."""
    pixels = spark.range(64 * 400).select(F.lit(1).alias("image_id"), F.expr("cast(id div 160 as int)").alias("y"), F.expr("cast(id % 160 as int)").alias("x"), *[F.lit(7).alias(c) for c in "rgba"], F.lit(160).alias("w"), F.lit(160).alias("h"))
    payloads = spark.createDataFrame([(1, [1, 1, 1, 0], bytearray(b"payload" * 1300))], "image_id int, config array<int>, payload binary")
    hidden = payload.embed(pixels, payloads)
    found = payload.detect(hidden)
    assert bytes(payload.extract(hidden, found).first().payload) == b"payload" * 1300
    assert payload.blocks_of(payloads).agg(F.max(F.size("bytes"))).first()[0] == 24


def test_blocks_do_as_pixels(spark):
    from rasterlake.operators import blocks

    imgs = images(np.random.default_rng(9))
    # 2, 3: images of sizes that 64 doesn't divide, repeated; 7: a payload that doesn't fit; 8: none; 9: null.
    cases = {i: (c, 2 if i in (2, 5) else 1, p) for i, (c, _, _, p) in enumerate(CASES)} | {7: ((1, 0, 0, 0), 3, bytes(900)), 9: ((0, 0, 0, 4), 2, None)}
    imgs |= {i: np.random.default_rng(i).integers(0, 256, (7, 13, 4), dtype=np.uint8) for i in (7, 8, 9)}
    rows = [(i, img.shape[1], img.shape[0], bytearray(img.tobytes()), cases.get(i, (0, 1))[1]) for i, img in imgs.items()]
    whole = {i: np.tile(imgs[i], (t, 1, 1)) for i, _, _, _, t in rows}
    table = blocks.tile_down(spark.createDataFrame(rows, "image_id long, width int, height int, rgba binary, times long"))
    payloads = spark.createDataFrame([(i, list(c), None if p is None else bytearray(p)) for i, (c, _, p) in cases.items()], "image_id long, config array<int>, payload binary")
    hidden = blocks.embed(table, payloads)
    assert hidden.columns == list(blocks.COLS) and hidden.agg(F.max(F.octet_length("rgba"))).first()[0] == 256

    def put(df):
        got = {}
        for r in sorted(df.collect(), key=lambda r: r.block):
            got[r.image_id] = got.get(r.image_id, b"") + bytes(r.rgba)
        return got

    want = {i: steg.embed(whole[i], c, p or b"") if i != 7 else whole[i] for i, (c, _, p) in cases.items()} | {8: whole[8]}
    assert put(hidden) == {i: x.tobytes() for i, x in want.items()}
    found = blocks.detect(hidden)
    assert {r.image_id: (r.config, r.length, r.error) for r in found.collect()} == {i: outcome(x) for i, x in want.items()}
    assert {r.image_id: bytes(r.payload) for r in blocks.extract(hidden, found).collect()} == {i: p or b"" for i, (_, _, p) in cases.items() if i != 7}
    assert put(blocks.remove(hidden, found)) == {i: (steg.remove(x, cases[i][0]) if i not in (7, 8) else x).tobytes() for i, x in want.items()}
