"""Transforms as plan nodes; pipelines of them, with strict and best-effort replay, rewriting, cached prefixes and history."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from rasterlake.functions import imaging as im
from rasterlake.functions import steg
from rasterlake.operators.convolve import Kernel, preset
from rasterlake.sources.dib import DibError, map_rows

WEIGHT = {"nearest": 0, "bilinear": 1, "bicubic": 2}
TITLE = {"nearest": "Nearest", "bilinear": "Bilinear", "bicubic": "Bicubic"}


class Transform:
    """apply(array) -> array; inverse() -> Transform or None; cost: weight in the choice of cached prefixes. Third parties may
    subclass it: any node with these three works in a pipeline."""

    cost = 1

    def apply(self, img: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def inverse(self) -> Transform | None:
        return None

    def describe(self) -> str:
        return type(self).__name__


def _simple(name: str, run, cost: int = 1, inverse: str | None = None, title: str | None = None):
    body = {"cost": cost, "apply": lambda self, img: run(img), "describe": lambda self: title or name}
    if inverse:
        body["inverse"] = lambda self: globals()[inverse]()
    return dataclass(frozen=True)(type(name, (Transform,), body))


InvertColors = _simple("InvertColors", im.invert, 0, "InvertColors", "Invert Colors")
Grayscale = _simple("Grayscale", im.grayscale)
Sepia = _simple("Sepia", im.sepia)
RotateLeft = _simple("RotateLeft", im.rotate_left, 0, "RotateRight", "Rotate Left")
RotateRight = _simple("RotateRight", im.rotate_right, 0, "RotateLeft", "Rotate Right")
MirrorHorizontal = _simple("MirrorHorizontal", im.mirror_horizontal, 0, "MirrorHorizontal", "Mirror Horizontal")
MirrorVertical = _simple("MirrorVertical", im.mirror_vertical, 0, "MirrorVertical", "Mirror Vertical")


@dataclass(frozen=True)
class Brightness(Transform):
    delta: int

    def apply(self, img):
        return im.brightness(img, self.delta)

    def describe(self):
        return f"Brightness {self.delta:+d}"


@dataclass(frozen=True)
class Contrast(Transform):
    delta: int

    def apply(self, img):
        return im.contrast(img, self.delta)

    def describe(self):
        return f"Contrast {max(-255, min(255, self.delta)):+d}"


@dataclass(frozen=True)
class Crop(Transform):
    x: int
    y: int
    width: int
    height: int

    def __post_init__(self):
        if self.width < 1 or self.height < 1 or self.x < 0 or self.y < 0:
            raise im.ImageError("InvalidCropSize")

    def apply(self, img):
        return im.crop(img, self.x, self.y, self.width, self.height)


@dataclass(frozen=True)
class Translate(Transform):
    dx: int
    dy: int
    expand: bool = False
    fill: tuple = (0, 0, 0, 0)
    cost = 2

    def apply(self, img):
        return im.translate(img, self.dx, self.dy, self.expand, self.fill)

    def describe(self):
        return f"Translate dx={self.dx:+d}, dy={self.dy:+d} ({'Expand' if self.expand else 'Crop'}, fill #{bytes(self.fill).hex().upper()})"


@dataclass(frozen=True)
class Resize(Transform):
    width: int
    height: int
    how: str = "bilinear"

    def __post_init__(self):
        if self.width < 1 or self.height < 1:
            raise im.ImageError("InvalidResizeSize")

    @property
    def cost(self):
        return (2, 4, 7)[WEIGHT[self.how]]

    def apply(self, img):
        return im.resize(img, self.width, self.height, self.how)


@dataclass(frozen=True)
class RotateAny(Transform):
    tenths: int
    how: str = "bilinear"
    expand: bool = False

    @property
    def cost(self):
        return (3, 5, 8)[WEIGHT[self.how]]

    def apply(self, img):
        return im.rotate_any(img, self.tenths, self.how, self.expand)

    def describe(self):
        return f"Rotate {im.wrap_tenths(self.tenths) / 10:.1f} deg ({TITLE[self.how]}, {'Expand' if self.expand else 'Crop'})"


@dataclass(frozen=True)
class Skew(Transform):
    x_milli: int
    y_milli: int
    how: str = "bilinear"
    expand: bool = False

    def __post_init__(self):
        im.skew_determinant(self.x_milli, self.y_milli)

    @property
    def cost(self):
        return (3, 5, 8)[WEIGHT[self.how]]

    def apply(self, img):
        return im.skew(img, self.x_milli, self.y_milli, self.how, self.expand)


@dataclass(frozen=True)
class ConvolutionCustom(Transform):
    kernel: Kernel

    @property
    def cost(self):
        return self.kernel.cost

    def apply(self, img):
        k = self.kernel
        return im.convolve(img, list(k.weights), k.size, k.divisor, k.bias, k.factors)


@dataclass(frozen=True)
class ConvolutionPreset(Transform):
    name: str

    @property
    def cost(self):
        return preset(self.name).cost

    def apply(self, img):
        return ConvolutionCustom(preset(self.name)).apply(img)


@dataclass(frozen=True)
class EmbedSteganography(Transform):
    config: tuple
    payload: bytes
    cost = 2

    def apply(self, img):
        return steg.embed(img, self.config, self.payload)


@dataclass(frozen=True)
class RemoveSteganography(Transform):
    config: tuple

    def apply(self, img):
        return steg.remove(img, self.config)


def rewrite(ops: tuple[Transform, ...]) -> tuple[Transform, ...]:
    """Drops a transform and its inverse side by side, and turns by nothing; turns by quarters that expand become exact."""
    out: list[Transform] = []
    for op in ops:
        if isinstance(op, RotateAny):
            t = im.wrap_tenths(op.tenths)
            if t == 0:
                continue
            if op.expand and t in (900, -900):
                op = RotateLeft() if t == 900 else RotateRight()
        if out and out[-1].inverse() is not None and out[-1].inverse() == op:
            out.pop()
        else:
            out.append(op)
    return tuple(out)


SKIPS = pa.list_(pa.struct([("index", pa.int32()), ("code", pa.string())]))


@dataclass(frozen=True)
class Pipeline:
    """An immutable list of transforms."""

    ops: tuple[Transform, ...] = ()

    def push(self, op: Transform) -> Pipeline:
        return Pipeline((*self.ops, op))

    def pop(self) -> Pipeline:
        return Pipeline(self.ops[:-1])

    def remove(self, index: int) -> Pipeline:
        if not 0 <= index < len(self.ops):
            raise IndexError(f"no transform {index} of {len(self.ops)}")
        return Pipeline(self.ops[:index] + self.ops[index + 1 :])

    def describe(self) -> list[str]:
        return [op.describe() for op in self.ops]

    def run(self, img: np.ndarray, strict: bool = True, start: int = 0) -> tuple[np.ndarray | None, list[tuple[int, str]]]:
        """(image, failures); strict replay ends at the first failure, without an image."""
        failed = []
        for i, op in enumerate(self.ops[start:], start):
            try:
                img = op.apply(img)
            except (im.ImageError, DibError) as e:
                failed.append((i, e.code))
                if strict:
                    return None, failed
        return img, failed

    def apply(self, images: DataFrame, strict: bool = True, start: int = 0) -> DataFrame:
        """images with the transforms from start on applied, and failed array<struct<index, code>>: an image that fails doesn't stop
        others."""
        has = "failed" in images.columns

        def make(key, w, h, rgba, before=None) -> dict:
            failed = [(f["index"], f["code"]) for f in before or ()]
            img = None
            if rgba is not None:
                img, new = self.run(np.frombuffer(rgba, np.uint8).reshape(h, w, 4), strict, start)
                failed += new
            out = {"image_id": key, "failed": [{"index": i, "code": c} for i, c in failed]}
            return out if img is None else out | {"width": img.shape[1], "height": img.shape[0], "rgba": np.ascontiguousarray(img).tobytes()}

        kinds = pa.schema([("image_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("failed", SKIPS)])
        schema = "image_id long, width int, height int, rgba binary, failed array<struct<index: int, code: string>>"
        return map_rows(images, ["image_id", "width", "height", "rgba", *["failed"] * has], make, schema, kinds)


class Executor:
    """Replays a pipeline over images and persists prefixes whose summed cost reaches a threshold.

    A prefix is reused only for the same source, the same transforms and the same kind of replay, so an edit needs no invalidation to be
    right; it frees the prefixes that the edited pipeline no longer begins with. When there are too many, the shortest one goes first.
    From the first prefix in which an image fails on nothing is persisted, so failures and skips are those of an uncached replay.
    """

    def __init__(self, threshold: int = 15, most: int = 5, pipeline: Pipeline | None = None) -> None:
        self.threshold, self.most, self.pipeline = threshold, most, pipeline or Pipeline()
        self.kept: dict[tuple, DataFrame] = {}

    def configure(self, threshold: int | None = None, most: int | None = None) -> None:
        """New limits, which hold at once."""
        self.threshold = self.threshold if threshold is None else threshold
        self.most = self.most if most is None else most
        self._evict()

    def edit(self, pipeline: Pipeline) -> None:
        self.pipeline = pipeline
        for key in [k for k in self.kept if pipeline.ops[: len(k[2])] != k[2]]:
            self.kept.pop(key).unpersist()

    def push(self, op: Transform) -> None:
        self.edit(self.pipeline.push(op))

    def pop(self) -> None:
        self.edit(self.pipeline.pop())

    def remove(self, index: int) -> None:
        self.edit(self.pipeline.remove(index))

    def cuts(self, ops: tuple[Transform, ...], start: int = 0) -> list[int]:
        """Lengths of the prefixes to persist; costs are summed from start on. None are where ``most`` is 0."""
        out, total = [], 0
        for i, op in enumerate(ops[start:], start + 1):
            total += op.cost
            if op.cost and total >= self.threshold and self.most > 0:
                out.append(i)
                total = 0
        return out

    def _evict(self) -> None:
        while len(self.kept) > self.most:
            self.kept.pop(min(self.kept, key=lambda k: len(k[2]))).unpersist()

    def run(self, images: DataFrame, pipeline: Pipeline | None = None, strict: bool = True) -> DataFrame:
        """What ``pipeline.apply(images, strict)`` gives, of the executor's own pipeline unless another is given."""
        ops = (self.pipeline if pipeline is None else pipeline).ops
        source, at, df = images.semanticHash(), 0, images
        for n in range(len(ops), 0, -1):
            if (source, strict, ops[:n]) in self.kept:
                at, df = n, self.kept[source, strict, ops[:n]]
                break
        for n in self.cuts(ops, at):
            new = Pipeline(ops[:n]).apply(df, strict, at).persist(StorageLevel.MEMORY_AND_DISK)
            if new.filter("size(failed) > 0").limit(1).count():
                new.unpersist()
                break
            df, at = new, n
            self.kept[source, strict, ops[:n]] = df
            self._evict()
        return Pipeline(ops).apply(df, strict, at)

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


def needs_confirmation(op: Transform, hidden: bool, warned: bool = False) -> bool:
    """Whether a transform may destroy a hidden payload that nobody has been warned of."""
    return hidden and not warned and not isinstance(op, EmbedSteganography | RemoveSteganography)


def embed_fits(op: Transform, width: int, height: int) -> bool:
    """Whether a payload to embed fits an image of that size; other transforms do."""
    if not isinstance(op, EmbedSteganography):
        return True
    bits = sum(op.config) * width * height
    return bits >= steg.HEADER_BITS and len(op.payload) <= steg.capacity(op.config, width * height)


@dataclass(frozen=True)
class History:
    """Applied transforms and those undone; undoing and redoing leave the other as it is, a new transform clears redo."""

    done: tuple[Transform, ...] = ()
    undone: tuple[Transform, ...] = ()

    def apply(self, op: Transform) -> History:
        return History((*self.done, op))

    def undo(self) -> tuple[History, Transform | None]:
        """The history without its last transform, and that one's inverse (None: replay from the source)."""
        if not self.done:
            return self, None
        return History(self.done[:-1], (*self.undone, self.done[-1])), self.done[-1].inverse()

    def redo(self) -> History:
        return History((*self.done, self.undone[-1]), self.undone[:-1]) if self.undone else self

    def remove(self, index: int) -> History:
        return History(Pipeline(self.done).remove(index).ops)

    def clear(self) -> History:
        return History()

    def pipeline(self) -> Pipeline:
        return Pipeline(rewrite(self.done))

    def replay(self, images: DataFrame, strict: bool = True) -> DataFrame:
        """The source with all that is done applied again."""
        return self.pipeline().apply(images, strict)
