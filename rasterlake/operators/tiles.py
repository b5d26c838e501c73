"""Images in blocks: geometry with samplers on parts of images, so that a task holds a few tiles and never a whole image.

A block is a rectangle of an image: image_id, y, x (its place), w, h (its size), width, height (the image's) and rgba. Tiles are blocks on
a square grid. For each block of the output the source rectangle follows from its corners (the maps are affine); the tiles under it are
joined, and the block is sampled from them. Images whose result would be too small or too large give one block without pixels and an error.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import imaging as im

SIDE = 256
#: Source pixels around a position that the samplers read.
HALO = 2
#: Bytes of blocks that are passed on at once (and those of one more); entries and pixels that are kept for images of one size.
BATCH_BYTES, KNOWN = 1 << 20, 256
PLACE = ("y", "x", "w", "h", "width", "height")
BLOCKS = "image_id long, " + ", ".join(f"{c} int" for c in PLACE) + ", rgba binary, error string"
KINDS = pa.schema([("image_id", pa.int64()), *[(c, pa.int32()) for c in PLACE], ("rgba", pa.binary()), ("error", pa.string())])


def _block(image_id: int, y: int, x: int, part: np.ndarray, width: int, height: int) -> dict:
    return {"image_id": image_id, "y": y, "x": x, "w": part.shape[1], "h": part.shape[0], "width": width, "height": height, "rgba": part.tobytes()}


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["rgba"], np.uint8).reshape(row["h"], row["w"], 4)


def _cut(rows: Iterator[dict], side: int) -> Iterator[dict]:
    """The parts of blocks within the tiles of the grid."""
    for r in rows:
        if r["rgba"] is None:
            yield r
            continue
        img, y, x = _pixels(r), r["y"], r["x"]
        for ty in range(y // side, (y + r["h"] - 1) // side + 1):
            for tx in range(x // side, (x + r["w"] - 1) // side + 1):
                top, left = max(y, ty * side), max(x, tx * side)
                part = img[top - y : (ty + 1) * side - y, left - x : (tx + 1) * side - x]
                yield _block(r["image_id"], top, left, part, r["width"], r["height"])


def _mapper(make: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema = KINDS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            step = max(1, min(64, BATCH_BYTES // (batch.nbytes // max(1, batch.num_rows) + 1)))  # a row may be a whole image
            for k in range(0, batch.num_rows, step):
                for row in make(iter(batch.slice(k, step).to_pylist())):
                    held.append(row)
                    size += 64 + len(row.get("rgba") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def cut_images(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of images(image_id, width, height, rgba). No shuffle."""
    zero = F.lit(0)
    whole = images.select("image_id", zero.alias("y"), zero.alias("x"), F.col("width").alias("w"), F.col("height").alias("h"), "width", "height", "rgba", F.lit(None).cast("string").alias("error"))
    return whole.mapInArrow(_mapper(lambda rows: _cut(rows, side)), BLOCKS)


def retile(blocks: DataFrame, side: int = SIDE) -> DataFrame:
    """Any blocks as the tiles of a grid: cut at its lines, then put together by tile."""
    parts = blocks.mapInArrow(_mapper(lambda rows: _cut(rows, side)), BLOCKS)
    parts = parts.withColumns({"ty": F.expr(f"y div {side}").cast("int"), "tx": F.expr(f"x div {side}").cast("int")})

    def put(rows: list[dict]) -> dict:
        if rows[0]["rgba"] is None:
            return {c: rows[0][c] for c in KINDS.names}
        img, y, x = _assemble(rows)
        return _block(rows[0]["image_id"], y, x, img, rows[0]["width"], rows[0]["height"])

    return _by_key(parts, ("image_id", "ty", "tx"), put)


def _by_key(rows: DataFrame, key: tuple[str, ...], make: Callable[[list[dict]], dict]) -> DataFrame:
    """make(rows of a key) -> block, for each key: dealt and sorted by key, so that a batch holds many small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                of = tuple(r[c] for c in key)
                if held and of != now:
                    done.append(make(held))
                    held = []
                held.append(r)
                now = of
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=KINDS)
        if held:
            yield pa.RecordBatch.from_pylist([make(held)], schema=KINDS)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, BLOCKS)


def _assemble(rows: list[dict]) -> tuple[np.ndarray, int, int]:
    """The rectangle around blocks, with its place."""
    y, x = min(r["y"] for r in rows), min(r["x"] for r in rows)
    img = np.zeros((max(r["y"] + r["h"] for r in rows) - y, max(r["x"] + r["w"] for r in rows) - x, 4), np.uint8)
    for r in rows:
        img[r["y"] - y : r["y"] - y + r["h"], r["x"] - x : r["x"] - x + r["w"]] = _pixels(r)
    return img, y, x


def block_pixels(blocks: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, a) of blocks; those with an error have none."""

    def pixels(rows: list[dict]) -> pa.RecordBatch:
        size = np.array([r["w"] * r["h"] for r in rows])
        of = {c: np.repeat(np.array([r[c] for r in rows]), size) for c in ("image_id", "y", "x", "w")}
        y, x = np.divmod(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), of["w"])
        px = np.frombuffer(b"".join(r["rgba"] for r in rows), np.uint8).reshape(-1, 4).astype(np.int32)
        cols = [of["image_id"].astype(np.int64), (y + of["y"]).astype(np.int32), (x + of["x"]).astype(np.int32), *px.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["image_id", "y", "x", *"rgba"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for r in batch.to_pylist():
                if r["rgba"] is None:
                    continue
                held.append(r)
                size += len(r["rgba"])
                if size >= BATCH_BYTES:
                    yield pixels(held)
                    held, size = [], 0
            if held:
                yield pixels(held)

    return blocks.mapInArrow(run, "image_id long, y int, x int, r int, g int, b int, a int")


def transform(tiles: DataFrame, mapping: Callable[[int, int], tuple[im.Mapping, str]], side: int = SIDE) -> DataFrame:
    """Blocks of the transformed images; mapping gives the map and the sampler of an image's width and height.

    An output block is as small as keeps its source rectangle to about a tile: shrinking an image doesn't gather it.
    """
    wanted = pa.schema([("image_id", pa.int64()), *[(c, pa.int32()) for c in ("oy", "ox", "ow", "oh", "ty", "tx")], ("error", pa.string())])

    known: dict = {}  # what follows from an image's size alone, as far as it is small

    def asked(r: dict) -> Iterator[dict]:
        try:
            m, _ = mapping(r["width"], r["height"])
        except im.ImageError as e:
            yield {"oy": 0, "ox": 0, "ow": 0, "oh": 0, "ty": 0, "tx": 0, "error": e.code}
            return
        step = max(1, int(side / max(1.0, m.step)))
        for oy in range(0, m.height, step):
            for ox in range(0, m.width, step):
                ow, oh = min(step, m.width - ox), min(step, m.height - oy)
                x, y = m.positions(np.array([ox, ox + ow - 1]), np.array([oy, oy + oh - 1]))
                (x0, x1), (y0, y1) = ([int(np.clip(f(v) + d, 0, n - 1)) for f, d in ((np.min, -HALO), (np.max, HALO))] for v, n in ((x, r["width"]), (y, r["height"])))
                for ty in range(y0 // side, y1 // side + 1):
                    for tx in range(x0 // side, x1 // side + 1):
                        yield {"oy": oy, "ox": ox, "ow": ow, "oh": oh, "ty": ty, "tx": tx}

    def requests(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            size = r["width"], r["height"]
            if size not in known:
                if len(known) >= KNOWN:
                    known.clear()
                few = list(itertools.islice(asked(r), KNOWN + 1))
                known[size] = few if len(few) <= KNOWN else None
            for x in asked(r) if known[size] is None else known[size]:
                yield {"image_id": r["image_id"], **x}

    placed: dict = {}

    def sample(rows: list[dict]) -> dict:
        first = rows[0]
        if first["failed"] is not None:
            return {"image_id": first["image_id"], **dict.fromkeys(PLACE, 0), "error": first["failed"]}
        at = tuple(first[c] for c in ("width", "height", "ox", "oy", "ow", "oh"))
        if at not in placed:
            if len(placed) >= KNOWN:
                placed.clear()
            m, how = mapping(*at[:2])
            placed[at] = m, how, m.positions(np.arange(at[2], at[2] + at[4]), np.arange(at[3], at[3] + at[5]))
        m, how, places = placed[at]
        if first["ow"] * first["oh"] > KNOWN:
            del placed[at]
        img, y, x = _assemble(rows)
        out = im.sample(img, *places, how, (y, x), (first["height"], first["width"]))
        return _block(first["image_id"], first["oy"], first["ox"], out, m.width, m.height)

    schema = "image_id long, oy int, ox int, ow int, oh int, ty int, tx int, failed string"
    corner = tiles.filter("y = 0 and x = 0 and rgba is not null").select("image_id", "width", "height")
    need = corner.mapInArrow(_mapper(requests, wanted), schema.replace("failed", "error")).withColumnRenamed("error", "failed")
    own = tiles.filter("rgba is not null").drop("error").withColumns({"ty": F.expr(f"y div {side}").cast("int"), "tx": F.expr(f"x div {side}").cast("int")})
    return _by_key(need.join(own, ["image_id", "ty", "tx"]), ("image_id", "oy", "ox"), sample)


def resize(tiles: DataFrame, width: int, height: int, how: str = "bilinear", side: int = SIDE) -> DataFrame:
    return transform(tiles, lambda w, h: (im.turn_map(w, h, 0), "nearest") if (w, h) == (width, height) else (im.resize_map(w, h, width, height), how), side)


def rotate_any(tiles: DataFrame, tenths: int, how: str = "bilinear", expand: bool = False, side: int = SIDE) -> DataFrame:
    """Exact turns as in the whole-image form: by 0 and 180 degrees, and by 90 where the result expands or the image is square."""
    angle = im.wrap_tenths(tenths)

    def mapping(w: int, h: int) -> tuple[im.Mapping, str]:
        exact = angle in (0, -1800) or angle in (900, -900) and (expand or w == h)
        return (im.turn_map(w, h, angle), "nearest") if exact else (im.rotate_map(w, h, angle, expand), how)

    return transform(tiles, mapping, side)


def skew(tiles: DataFrame, x_milli: int, y_milli: int, how: str = "bilinear", expand: bool = False, side: int = SIDE) -> DataFrame:
    im.skew_determinant(x_milli, y_milli)
    return transform(tiles, lambda w, h: (im.skew_map(w, h, x_milli, y_milli, expand), how) if x_milli or y_milli else (im.turn_map(w, h, 0), "nearest"), side)
