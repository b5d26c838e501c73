import numpy as np
import pytest

from rasterlake import rasters
from rasterlake.functions import imaging as im
from rasterlake.functions import steg, wu
from rasterlake.operators.convolve import Kernel, preset
from rasterlake.plans import pipeline as pl
from rasterlake.sources import dib


def image(*pixels, width=None):
    return np.array(pixels, np.uint8).reshape(-1, width or len(pixels), 4)


L1 = image((10, 20, 30, 255), (40, 50, 60, 255), (70, 80, 90, 255), (100, 110, 120, 255), width=2)
RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (11, 17, 4)).astype(np.uint8)


def test_colour_values():
    assert im.invert(image((10, 20, 30, 40)))[0, 0].tolist() == [245, 235, 225, 40]
    assert im.grayscale(image((100, 150, 200, 128)))[0, 0].tolist() == [141, 141, 141, 128]
    assert im.sepia(image((255, 255, 255, 255)))[0, 0, :2].tolist() == [255, 255]
    assert (im.brightness(L1, 0) == L1).all() and (im.contrast(L1, 0) == L1).all()


@pytest.mark.parametrize("op", [pl.InvertColors(), pl.RotateLeft(), pl.RotateRight(), pl.MirrorHorizontal(), pl.MirrorVertical()])
def test_inverse(op):
    assert (op.inverse().apply(op.apply(NOISE)) == NOISE).all()


def test_geometry():
    assert (im.rotate_any(L1, 900, "nearest", False) == im.rotate_left(L1)).all()
    assert im.wrap_tenths(7215) == 15 and im.wrap_tenths(-3655) == -55 and im.wrap_tenths(-1800) == im.wrap_tenths(1800) == -1800
    wide = NOISE[:3]
    assert im.rotate_any(wide, 900, "nearest", False).shape == wide.shape  # not square, not expanded: the general path
    for how in ("nearest", "bilinear", "bicubic"):
        assert (im.resize(NOISE, 17, 11, how) == NOISE).all() and im.resize(NOISE, 5, 40, how).shape == (40, 5, 4)
        assert (im.skew(NOISE, 0, 0, how, True) == NOISE).all()
    with pytest.raises(im.ImageError) as e:
        pl.Skew(1000, 1000)
    assert e.value.code == "SkewNearSingular"
    assert pl.RotateAny(333, "nearest", True).describe() == "Rotate 33.3 deg (Nearest, Expand)"
    assert pl.Translate(4, -9, False, (0xA1, 0xB2, 0, 0xFF)).describe() == "Translate dx=+4, dy=-9 (Crop, fill #A1B200FF)"


def test_kernels():
    assert preset("blur").factors == ([1, 2, 1], [1, 2, 1])
    with pytest.raises(im.ImageError):
        Kernel((1, 2, 3, 4), 2)
    for k in (preset("blur"), preset("blur", 5)):
        a = im.convolve(NOISE, list(k.weights), k.size, k.divisor, k.bias, k.factors)
        assert (a == im.convolve(NOISE, list(k.weights), k.size, k.divisor, k.bias)).all()
    big = Kernel((2**31 - 1,) * 9, 3)
    assert im.convolve(image((255, 200, 100, 77)), list(big.weights), 3, 1, 0)[0, 0].tolist() == [255, 255, 255, 77]


def test_quantizer():
    colours = RNG.integers(0, 8, (8, 3)).astype(np.uint8) * 32
    palette, index = wu.quantize(np.repeat(colours, 3, 0), 8)
    assert (palette[index] == np.repeat(colours, 3, 0)).all()
    palette, index = wu.quantize(NOISE[..., :3].reshape(-1, 3), 16)
    assert len(palette) <= 16 and index.max() < len(palette)


@pytest.mark.parametrize("header", dib.HEADERS)
@pytest.mark.parametrize("fmt", dib.FORMATS)
def test_codec_round_trip(fmt, header):
    if not dib.compatible(fmt, header):
        with pytest.raises(dib.DibError):
            dib.encode(NOISE, fmt, header)
        return
    parsed = dib.parse(dib.write(dib.encode(NOISE, fmt, header)))
    assert dib.first_violation(parsed) is None and dib.infer_format(parsed) == fmt
    back = dib.decode(parsed)
    assert back.shape == NOISE.shape and (back[..., 3] == 255).all()
    if fmt in ("rgb24", "rgb32", "bitfields32"):
        assert (back[..., :3] == NOISE[..., :3]).all()
    if fmt in ("rgb16", "bitfields16_555", "bitfields16_565"):
        assert abs(back.astype(int) - NOISE)[..., :3].max() <= 9


def test_profile_and_errors():
    d = dib.encode(L1, "rgb24", "V5", {"cs_type": dib.EMBEDDED, "icc_profile": bytes([1, 2, 3, 4])})
    assert d.profile_data == 124 + len(d.bitmap_array) and dib.first_violation(dib.parse(dib.write(d))) is None
    with pytest.raises(dib.DibError) as e:
        dib.parse(b"BM")
    assert e.value.tier == "structural"


def test_steganography():
    img = RNG.integers(0, 256, (16, 16, 4)).astype(np.uint8)
    config, payload = (0, 3, 1, 1), bytes(range(200, 240)) + "größe".encode()
    hidden = steg.embed(img, config, payload)
    assert steg.detect(hidden) == (config, len(payload)) and steg.extract(hidden, config, len(payload)) == payload
    assert steg.capacity((8, 8, 8, 8), 10) == (320 - 80) // 8 and steg.capacity((0, 0, 2, 0), 39) == 0
    assert steg.detect_best_effort(steg.remove(hidden, config)) is None
    assert dib.survives(steg.embed(img, (1, 1, 1, 0), payload), "rgb24") is True and dib.survives(hidden, "rgb24") is False and dib.survives(img, "rgb24") is None
    assert all(steg.encode_config(steg.decode_config(v)) == v for v in range(6561)) and steg.decode_config(6561) is None


def test_pipeline():
    steps = pl.Pipeline((pl.Contrast(20), pl.Sepia(), pl.Crop(0, 5, 2, 2), pl.MirrorVertical()))
    assert steps.run(L1)[1] == [(2, "CropOriginOutOfBounds")] and steps.run(L1)[0] is None
    image_, failed = steps.run(L1, strict=False)
    assert len(failed) == 1 and (image_ == im.mirror_vertical(im.sepia(im.contrast(L1, 20)))).all()
    history = pl.History().apply(pl.RotateLeft()).apply(pl.Sepia())
    undone, inverse = history.undo()
    assert inverse is None and undone.redo() == history
    assert pl.rewrite((pl.RotateLeft(), pl.RotateRight())) == () and history.clear() == pl.History()
    embed = pl.EmbedSteganography((1, 0, 0, 0), b"ab")
    assert pl.needs_confirmation(pl.Sepia(), True) and not pl.needs_confirmation(embed, True) and not pl.needs_confirmation(pl.Sepia(), True, warned=True)
    assert pl.embed_fits(embed, 8, 12) and not pl.embed_fits(embed, 8, 11) and pl.embed_fits(pl.Sepia(), 1, 1)


def test_executor(spark):
    images = spark.createDataFrame([(1, 2, 2, bytearray(L1.tobytes()))], rasters.IMAGES)
    steps = pl.Pipeline((pl.Sepia(), pl.InvertColors(), pl.Brightness(9), pl.Crop(0, 5, 2, 2), pl.Grayscale()))
    run = pl.Executor(threshold=1, most=4, pipeline=steps)
    for strict in (True, False):
        for _ in range(2):  # the second from what is kept
            got, want = (p.select("failed", "rgba").collect() for p in (run.run(images, strict=strict), steps.apply(images, strict)))
            assert got == want and got[0].failed[0]["index"] == 3
        assert sorted(len(k[2]) for k in run.kept if k[1] is strict) == [1, 3]  # none from the failure on
    run.remove(1)
    assert {len(k[2]) for k in run.kept} == {1} and run.pipeline.ops[1] == pl.Brightness(9)
    run.configure(most=0)
    assert not run.kept and run.run(images).count() == 1 and not run.kept
    assert pl.Executor().cuts((pl.Sepia(),) * 40) == [15, 30] and (pl.Executor().threshold, pl.Executor().most) == (15, 5)
    assert pl.History().apply(pl.Sepia()).replay(images).first().rgba == im.sepia(L1).tobytes()


def test_kernels_of_other_sizes():
    from rasterlake.operators.convolve import parse_kernel, resize_kernel

    k = parse_kernel("1, 2 3\n4 5 6\n7 8 9", 3, 1)
    assert resize_kernel(k, 1).weights == (5,) and resize_kernel(k, 5).weights[6:9] == (1, 2, 3) and resize_kernel(k, 5).weights[0] == 0
    with pytest.raises(im.ImageError) as e:
        parse_kernel("1 2 3\n4 x 6\n7 8 9")
    assert "row 2, column 2" in str(e.value)
    for size in (1, 3, 5, 7):
        assert sum(preset("blur", size).weights) == preset("blur", size).divisor and sum(preset("edge", size).weights) == 0


def test_run_length_streams():
    """Streams that the encoder doesn't write: deltas, ends left out, odd blocks; pixels never written stay transparent."""
    base = dib.encode(image(*[(0, 0, 0, 255), (9, 9, 9, 255)] * 6, width=4), "rle8")
    values = [q[0] for q in base.palette]

    def decoded(data: bytes):
        from dataclasses import replace

        out = dib.decode(replace(base, bitmap_array=data, image_size=len(data)))
        return np.where(out[..., 3] == 0, -1, out[..., 0].astype(int))[::-1].tolist()  # bottom row first

    a, b = values
    assert decoded(bytes([2, 1, 0, 2, 1, 1, 1, 0])) == [[b, b, -1, -1], [-1, -1, -1, a], [-1] * 4]
    assert decoded(bytes([0, 3, 1, 0, 1, 0, 0, 0, 4, 0])) == [[b, a, b, -1], [a] * 4, [-1] * 4]
    assert decoded(bytes([4, 1, 0, 1, 4, 0])) == [[b] * 4, [-1] * 4, [-1] * 4]
    for bad in (bytes([5, 0]), bytes([0, 2, 1]), bytes([1, 9]), bytes([0, 4, 0, 0])):
        with pytest.raises(dib.DibError):
            decoded(bad)


def test_quantizer_against_plain_loops():
    """Boxes cut as a plain search over all cuts does, with sums of the pixels themselves."""
    rgb = RNG.integers(0, 256, (300, 3)).astype(np.int64)
    cell = rgb >> 3

    def spread(rows):
        n = len(rows)
        return float((rgb[rows] ** 2).sum()) - sum(float(v) * float(v) for v in rgb[rows].sum(0)) / n if n else 0.0

    def score(rows):
        return sum(float(v) * float(v) for v in rgb[rows].sum(0)) / len(rows)

    boxes = [(np.arange(300), [(-1, 31)] * 3)]
    held = [spread(boxes[0][0])]
    while len(boxes) < 9:
        pick = max((i for i in range(len(boxes)) if held[i] > 0), key=lambda i: (held[i], i))
        rows, bounds = boxes[pick]
        best = None
        for axis in range(3):
            for cut in range(bounds[axis][0] + 1, bounds[axis][1]):
                low, high = rows[cell[rows, axis] <= cut], rows[cell[rows, axis] > cut]
                if len(low) and len(high) and (best is None or score(low) + score(high) > best[0]):
                    best = score(low) + score(high), axis, cut, low, high
        _, axis, cut, low, high = best
        boxes[pick] = low, [*bounds[:axis], (bounds[axis][0], cut), *bounds[axis + 1 :]]
        boxes.append((high, [*bounds[:axis], (cut, bounds[axis][1]), *bounds[axis + 1 :]]))
        held[pick], extra = spread(low), spread(high)
        held.append(extra)
    palette, index = wu.quantize(rgb.astype(np.uint8), 9)
    assert palette.tolist() == [[int(v + len(r) // 2) // len(r) for v in rgb[r].sum(0)] for r, _ in boxes]
    assert all((index[r] == i).all() for i, (r, _) in enumerate(boxes))


def test_images_and_files(spark, tmp_path):
    images = spark.createDataFrame([(1, 2, 2, bytearray(L1.tobytes()))], rasters.IMAGES)
    assert bytes(rasters.assemble(rasters.explode_pixels(images)).first().rgba) == L1.tobytes()
    dib.save_images(images, str(tmp_path / "out"), "rgb24")
    back = spark.read.format("dib").load(str(tmp_path / "out")).first()
    assert bytes(back.rgba) == L1.tobytes()
    files = dib.read_files(spark, str(tmp_path / "out"))
    assert dib.decode_images(files, "path").first().status.ok
    bad = spark.createDataFrame([("x", bytearray(b"no bitmap"))], "path string, content binary")
    assert dib.decode_images(bad, "path").first().status.tier == "structural"
