"""Payloads in the least significant bits of images held in blocks of 64 pixels: the layout of :mod:`rasterlake.operators.payload`.

blocks: image_id, block (its number), w, h (the image's size) and rgba, the bytes of pixels 64 * block and on, in row order. 64 pixels of B
bits each hold exactly 8 B bytes of a stream, so a block and its bytes meet in one row: what is shuffled is 256 bytes a block instead of
64 rows. All joins are by (image_id, block): blocks that an embedding has dealt aren't dealt again by an extraction or a removal.

Images without a payload row pass unchanged, and so do those whose payload doesn't fit; of blocks that miss, the rest is treated alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.functions.steg import HEADER_BITS
from rasterlake.operators import payload
from rasterlake.operators.payload import BLOCK, FIRST, depth

COLS, SIDE = ("image_id", "block", "w", "h", "rgba"), 4 * BLOCK
#: Blocks that are worked on at once.
ROWS = 1024


def tile_down(images: DataFrame, times: str = "times") -> DataFrame:
    """blocks of images (image_id, width, height, rgba and how often each is repeated downwards). No shuffle."""
    n = F.octet_length("rgba").cast("long")
    blocks = F.ceil(n * F.col(times) / SIDE)
    rows = images.withColumn("__size", n).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    begin = (F.col("block") * SIDE) % F.col("__size") + 1
    # A block may reach over the end of a repeat: then the image's bytes go on from its start.
    own = F.substring("rgba", begin.cast("int"), F.lit(SIDE))
    more = F.ceil(SIDE / F.col("__size")).cast("int")
    left = F.least(F.lit(SIDE).cast("long"), F.col("__size") * F.col(times) - F.col("block") * SIDE).cast("int")
    whole = F.unhex(F.substring(F.concat(F.hex(own), F.repeat(F.hex("rgba"), more)), F.lit(1), 2 * left))
    return rows.select("image_id", "block", F.col("width").cast("int").alias("w"), (F.col("height") * F.col(times)).cast("int").alias("h"), F.when(F.octet_length(own) == left, own).otherwise(whole).alias("rgba"))


def _channels(rgba: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(SIDE, b"\0") for x in rgba), np.uint8).reshape(-1, BLOCK, 4)


def _held(block: np.ndarray, count: np.ndarray, b: int, bits: np.ndarray) -> np.ndarray:
    """(rows, pixels, bits of a pixel): which belong to the stream."""
    left = bits[:, None] - (block[:, None] * BLOCK + np.arange(BLOCK)) * b
    left[np.arange(BLOCK) >= count[:, None]] = 0
    return np.arange(b) < left[:, :, None]


def _by_config(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, tuple[int, ...]]]:
    """Rows of a batch with a configuration, by it."""
    configs: dict[tuple, list[int]] = {}
    for k, c in enumerate(batch.column("config").to_pylist()):
        if c is not None:
            configs.setdefault(tuple(c), []).append(k)
    for c, rows in configs.items():
        yield np.array(rows), c


def _slices(work: Callable[[pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                yield work(batch.slice(k, ROWS))

    return run


def _write(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The bits of part (null: zeros) in the pixels that the stream holds."""
    rgba, part = batch.column("rgba").to_pylist(), batch.column("part").to_pylist()
    block, w, h, bits = (batch.column(c).fill_null(0).to_numpy().astype(np.int64) for c in ("block", "w", "h", "bits"))
    for rows, config in _by_config(batch):
        b = sum(config)
        px = _channels([rgba[k] for k in rows]).copy()
        size = [len(rgba[k]) for k in rows]
        held = _held(block[rows], np.array(size) // 4, b, np.where(w[rows] * h[rows] * b >= bits[rows], bits[rows], 0))
        data = b"".join((part[k] or b"").ljust(8 * b, b"\0") for k in rows)
        new = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").reshape(-1, BLOCK, b)
        at = 0
        for k, d in enumerate(config):
            for j in range(d):
                c = px[:, :, k]
                px[:, :, k] = np.where(held[:, :, at], (c & (255 ^ 1 << j)) | new[:, :, at] << j, c)
                at += 1
        raw = px.tobytes()
        for n, (k, m) in enumerate(zip(rows.tolist(), size, strict=True)):
            rgba[k] = raw[n * SIDE : n * SIDE + m]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLS[:4]), pa.array(rgba, pa.binary())], names=list(COLS))


def _kind(blocks: DataFrame) -> T.StructType:
    of = [blocks.schema["image_id"].dataType, T.LongType(), T.IntegerType(), T.IntegerType(), T.BinaryType()]
    return T.StructType([T.StructField(c, t) for c, t in zip(COLS, of, strict=True)])


def _rewritten(blocks: DataFrame, put: DataFrame) -> DataFrame:
    rows = blocks.select(*COLS).join(put, ["image_id", "block"], "left").select(*COLS, "config", "bits", "part")
    return rows.mapInArrow(_slices(_write), _kind(blocks))


def embed(blocks: DataFrame, payloads: DataFrame) -> DataFrame:
    """blocks with the payloads (image_id, config, payload; one row an image, null: empty) of their images in their lowest bits."""
    return _rewritten(blocks, payload.stream_parts(payloads))


def detect(blocks: DataFrame) -> DataFrame:
    """(image_id, config, length, error) of every image, as :func:`payload.detect`. Only the blocks of the first 80 pixels are grouped."""
    first = blocks.filter(F.col("block") * BLOCK < FIRST)
    images = first.groupBy("image_id").agg((F.first("w").cast("long") * F.first("h")).alias("pixels"), F.array_sort(F.collect_list(F.struct("block", "rgba"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = [np.frombuffer(b"".join(x["rgba"] for x in rows)[: 4 * FIRST], np.uint8).reshape(-1, 4).tolist() for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("pixels"), pa.array(px, pa.list_(pa.list_(pa.int32())))], names=["image_id", "pixels", "px"])

    kind = T.StructType([_kind(blocks).fields[0], T.StructField("pixels", T.LongType()), T.StructField("px", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return payload.find(images.mapInArrow(run, kind))


def _places(found: DataFrame) -> DataFrame:
    """(image_id, block, config, bits): the blocks that hold the streams of found (image_id, config, length)."""
    hit = found.filter("config is not null").select("image_id", "config", (F.col("length") * 8 + HEADER_BITS).alias("bits"))
    last = F.floor((F.col("bits") - 1) / (depth(F.col("config")) * BLOCK))
    return hit.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "config", "bits")


def remove(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks with zeros where found (image_id, config, length) says a header and payload are."""
    return _rewritten(blocks, _places(found).withColumn("part", F.lit(None).cast("binary")))


def _read(batch: pa.RecordBatch) -> pa.RecordBatch:
    rgba, out = batch.column("rgba").to_pylist(), [b""] * batch.num_rows
    block, bits = (batch.column(c).to_numpy().astype(np.int64) for c in ("block", "bits"))
    for rows, config in _by_config(batch):
        b = sum(config)
        px = _channels([rgba[k] for k in rows])
        of = [px[:, :, k] >> j & 1 for k, d in enumerate(config) for j in range(d)]
        data = np.packbits(np.stack(of, -1).reshape(len(rows), -1), axis=1, bitorder="little").tobytes()
        size = np.minimum(8 * b, bits[rows] // 8 - block[rows] * 8 * b)
        for n, (k, m) in enumerate(zip(rows.tolist(), size.tolist(), strict=True)):
            out[k] = data[n * 8 * b : n * 8 * b + m]
    return pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("block"), pa.array(out, pa.binary())], names=["image_id", "block", "part"])


def extract_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, block, part): the bytes of each stream, its header included, that lie in each block."""
    rows = blocks.select(*COLS).join(_places(found), ["image_id", "block"]).select("image_id", "block", "rgba", "config", "bits")
    kind = T.StructType([*_kind(blocks).fields[:2], T.StructField("part", T.BinaryType())])
    return rows.mapInArrow(_slices(_read), kind)


def extract(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, payload) of images with a hit in found (image_id, config, length)."""
    return payload.joined(extract_blocks(blocks, found))
