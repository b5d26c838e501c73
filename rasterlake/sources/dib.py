"""Device-independent bitmap containers: parse, validate, write, decode, encode; as functions and as DataFrame operators."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import measures, steg, wu
from rasterlake.functions.imaging import MAX_BYTES, ImageError

# Fixed values of the format.
SIZES = {12: "CORE", 40: "INFO", 108: "V4", 124: "V5"}
RGB, RLE8, RLE4, BITFIELDS, JPEG, PNG = range(6)
COMPRESSION = {RGB: "RGB", RLE8: "RLE8", RLE4: "RLE4", BITFIELDS: "BITFIELDS", JPEG: "JPEG", PNG: "PNG"}
CALIBRATED, SRGB, WINDOWS, LINKED, EMBEDDED = 0, 0x73524742, 0x57696E20, 0x4C494E4B, 0x4D424544
MAX_PALETTE, MAX_ICC = 65_536, 16 << 20


class DibError(ValueError):
    """tier: structural (can't be read safely), validation (breaks the format's rules), decode or encode; code: the rule."""

    def __init__(self, tier: str, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.tier, self.code = tier, code


@dataclass(frozen=True)
class Dib:
    """A parsed container; fields that a variant lacks are None."""

    variant: str
    signature: bytes
    file_size: int
    reserved_1: bytes
    reserved_2: bytes
    pixel_data_offset: int
    width: int
    height: int
    planes: int
    bit_count: int
    compression: int | None = None
    image_size: int | None = None
    x_ppm: int | None = None
    y_ppm: int | None = None
    colors_used: int | None = None
    colors_important: int | None = None
    masks: tuple | None = None
    cs_type: int | None = None
    endpoints: tuple | None = None
    gamma: tuple | None = None
    intent: int | None = None
    profile_data: int | None = None
    profile_size: int | None = None
    reserved: bytes | None = None
    palette: tuple = field(default=())  # (blue, green, red, reserved)
    bitmap_array: bytes = b""
    icc_profile: bytes | None = None

    @property
    def kind(self) -> int:
        return RGB if self.compression is None else self.compression

    @property
    def header_size(self) -> int:
        return next(k for k, v in SIZES.items() if v == self.variant)

    def palette_size(self) -> int:
        if self.colors_used:
            return self.colors_used
        if self.bit_count in (1, 4, 8):
            return 1 << self.bit_count
        if self.bit_count in ((24,) if self.variant == "CORE" else (0, 16, 24, 32)):
            return 0
        raise DibError("structural", "UnsupportedStructure", f"palette of {self.bit_count} bits per pixel")

    def payload_size(self) -> int:
        if self.kind not in (RGB, BITFIELDS):
            return self.image_size
        n = row_stride(self.width, self.bit_count) * abs(self.height)
        if not 0 <= n < 2**32 or self.width < 0:
            raise DibError("structural", "ArithmeticOverflow", "payload size")
        return n


def row_stride(width: int, bit_count: int) -> int:
    return (bit_count * width + 31) // 32 * 4


def parse(data: bytes) -> Dib:
    """Structural checks only; bytes after file_size are ignored."""

    def take(at: int, n: int, what: str) -> bytes:
        if at < 0 or at + n > end:
            raise DibError("structural", "Io", f"reading {what}")
        return data[at : at + n]

    end = len(data)
    sig, size, r1, r2, offset = struct.unpack("<2sI2s2sI", take(0, 14, "file header"))
    if size > len(data):
        raise DibError("structural", "Io", "file size exceeds the data")
    end = size
    (dib_size,) = struct.unpack("<I", take(14, 4, "header size"))
    if dib_size not in SIZES:
        raise DibError("structural", "UnsupportedStructure", f"header of {dib_size} bytes")
    head = {"signature": sig, "file_size": size, "reserved_1": r1, "reserved_2": r2, "pixel_data_offset": offset, "variant": SIZES[dib_size]}
    raw, at = take(14, dib_size, "header"), 14 + dib_size
    if dib_size == 12:
        names, values = ("width", "height", "planes", "bit_count"), struct.unpack_from("<HHHH", raw, 4)
    else:
        names = ("width", "height", "planes", "bit_count", "compression", "image_size", "x_ppm", "y_ppm", "colors_used", "colors_important")
        values = struct.unpack_from("<iiHHIIiiII", raw, 4)
    dib = Dib(**head, **dict(zip(names, values, strict=True)))
    if dib_size >= 108:
        v = struct.unpack_from("<4II9I3I", raw, 40)
        dib = replace(dib, masks=v[:4], cs_type=v[4], endpoints=v[5:14], gamma=v[14:17])
    if dib_size == 124:
        v = struct.unpack_from("<III4s", raw, 108)
        dib = replace(dib, intent=v[0], profile_data=v[1], profile_size=v[2], reserved=v[3])
    if dib_size == 40 and dib.compression == BITFIELDS:
        dib = replace(dib, masks=(*struct.unpack("<3I", take(at, 12, "masks")), 0))
        at += 12
    count, entry = dib.palette_size(), 3 if dib_size == 12 else 4
    if count > MAX_PALETTE:
        raise DibError("structural", "StructureUnsafe", f"palette of {count}")
    table = take(at, count * entry, "palette")
    palette = tuple((*table[i : i + entry], *([0] * (4 - entry))) for i in range(0, len(table), entry))
    n = dib.payload_size()
    if n > MAX_BYTES:
        raise DibError("structural", "StructureUnsafe", f"payload of {n}")
    dib = replace(dib, palette=palette, bitmap_array=take(offset, n, "pixels"))
    if dib.cs_type in (LINKED, EMBEDDED) and dib_size == 124:
        if dib.profile_size > MAX_ICC:
            raise DibError("structural", "StructureUnsafe", f"profile of {dib.profile_size}")
        dib = replace(dib, icc_profile=take(14 + dib.profile_data, dib.profile_size, "profile"))
    return dib


def _mask_error(masks: tuple, bits: int) -> str | None:
    for m in masks:
        s = m // (m & -m) if m else 0
        if s & (s + 1):
            return "ColorMask.NonContiguous"
    if any(a & b for i, a in enumerate(masks) for b in masks[i + 1 :]):
        return "ColorMask.Overlapping"
    limit = 0xFFFFFFFF >> max(0, 32 - bits) if bits else 0
    return "ColorMask.ExceedsBitDepth" if any(m & ~limit for m in masks) else None


def first_violation(d: Dib) -> str | None:
    """Code of the first rule that the container breaks, in the order of file, header, palette, payload, masks, layout, profile, end."""
    if d.signature != b"BM":
        return "InvalidFileSignature"
    if any(d.reserved_1 + d.reserved_2):
        return "InvalidFileReservedData"
    core, k = d.variant == "CORE", d.kind
    if d.width <= 0:
        return "InvalidWidth"
    if d.height == 0:
        return "InvalidHeight"
    if d.planes != 1:
        return "InvalidPlanes"
    if d.bit_count not in ((1, 4, 8, 24) if core else (0, 1, 4, 8, 16, 24, 32)):
        return "InvalidBitCount"
    if not core:
        if k not in COMPRESSION:
            return "UnknownCompression"
        fits = {RLE4: (4,), RLE8: (8,), BITFIELDS: (16, 32), RGB: (1, 4, 8, 16, 24, 32), JPEG: (0,), PNG: (0,)}[k]
        if d.bit_count not in fits:
            return "InvalidCompressionForBpp"
        plain = k in (RGB, BITFIELDS)
        if d.height < 0 and not plain:
            return "InvalidCompressionForTopDown"
        if not plain and d.image_size == 0:
            return "CompressedImageMissingSize"
        if plain and d.image_size and d.image_size != row_stride(d.width, d.bit_count) * abs(d.height):
            return "UncompressedImageSizeMismatch"
        if k in (JPEG, PNG) and d.colors_used:
            return "PaletteNotAllowedForCompression"
    if d.variant in ("V4", "V5"):
        if bad := _mask_error(d.masks, d.bit_count):
            return bad
        if d.cs_type not in (CALIBRATED, SRGB, WINDOWS, *((LINKED, EMBEDDED) if d.variant == "V5" else ())):
            return "InvalidColorSpaceType"
    if len(d.palette) != d.palette_size():
        return "ColorTableSizeMismatch"
    if any(q[3] for q in d.palette):
        return "InvalidRgbQuad"
    if len(d.bitmap_array) != d.payload_size():
        return "PixelDataSizeMismatch"
    extra = 0
    if d.variant == "INFO":
        if (k == BITFIELDS) != (d.masks is not None):
            return "InvalidCompressionForBpp"
        if d.masks is not None:
            extra = 12
            if bad := _mask_error(d.masks[:3], d.bit_count):
                return bad
    least = 14 + d.header_size + extra + len(d.palette) * (3 if core else 4)
    if d.pixel_data_offset < least:
        return "PixelDataLayout.OverlapsMetadata"
    end = d.pixel_data_offset + d.payload_size()
    if d.variant == "V5":
        if d.cs_type in (LINKED, EMBEDDED):
            if d.icc_profile is None:
                return "IccProfile.MissingDataForProfileColorSpace"
            if len(d.icc_profile) != d.profile_size:
                return "IccProfile.SizeMismatch"
            if 14 + d.profile_data < 14 + 124 + 4 * len(d.palette):
                return "IccProfile.OverlapsMetadata"
            if 14 + d.profile_data + d.profile_size > d.file_size:
                return "IccProfile.ExceedsFileSize"
            end = max(end, 14 + d.profile_data + d.profile_size)
        elif d.icc_profile is not None or d.profile_data or d.profile_size:
            return "IccProfile.UnexpectedDataForNonProfileColorSpace"
    if end != d.file_size:
        return "PixelDataLayout.ExceedsFileSize" if end > d.file_size else "PixelDataLayout.DoesNotEndAtFileEnd"
    return None


def write(d: Dib) -> bytes:
    """The container's bytes; gaps before offsets are zero."""
    if len(d.bitmap_array) != d.payload_size():
        raise DibError("structural", "PixelDataSizeMismatch")
    if d.pixel_data_offset < 14 or d.pixel_data_offset + len(d.bitmap_array) > d.file_size:
        raise DibError("structural", "PixelDataLayout.ExceedsFileSize")
    if d.icc_profile is not None and 14 + d.profile_data + len(d.icc_profile) > d.file_size:
        raise DibError("structural", "IccProfile.ExceedsFileSize")
    out = struct.pack("<2sI2s2sII", d.signature, d.file_size, d.reserved_1, d.reserved_2, d.pixel_data_offset, d.header_size)
    if d.variant == "CORE":
        out += struct.pack("<HHHH", d.width, d.height, d.planes, d.bit_count)
    else:
        rest = (d.compression, d.image_size, d.x_ppm, d.y_ppm, d.colors_used, d.colors_important)
        out += struct.pack("<iiHHIIiiII", d.width, d.height, d.planes, d.bit_count, *rest)
    if d.variant in ("V4", "V5"):
        out += struct.pack("<4II9I3I", *d.masks, d.cs_type, *d.endpoints, *d.gamma)
    if d.variant == "V5":
        out += struct.pack("<III4s", d.intent, d.profile_data, d.profile_size, d.reserved)
    if d.variant == "INFO" and d.masks is not None:
        out += struct.pack("<3I", *d.masks[:3])
    out += b"".join(bytes(q[: 3 if d.variant == "CORE" else 4]) for q in d.palette)
    parts = [(d.pixel_data_offset, d.bitmap_array), *([(14 + d.profile_data, d.icc_profile)] if d.icc_profile is not None else [])]
    full = bytearray(max([len(out), *(a + len(x) for a, x in parts)]))
    full[: len(out)] = out
    for at, part in parts:
        full[at : at + len(part)] = part
    return bytes(full)


# ---- decoding -----------------------------------------------------------------------------------------------------------------


def _unrle(d: Dib, palette: np.ndarray) -> np.ndarray:
    w, h, data, four = d.width, abs(d.height), d.bitmap_array, d.kind == RLE4
    out, x, y, i = np.zeros((h, w, 4), np.uint8), 0, 0, 0

    def put(values) -> None:
        nonlocal x
        for v in values:
            if x >= w or y >= h:
                raise DibError("decode", "RleOutOfBounds")
            if v >= len(palette):
                raise DibError("decode", "PaletteIndexOutOfRange", f"({x}, {y}): {v}")
            out[y if d.height < 0 else h - 1 - y, x] = palette[v]
            x += 1

    while i + 2 <= len(data):
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            put([(v >> 4, v & 15)[j & 1] for j in range(n)] if four else [v] * n)
        elif v == 0:
            x, y = 0, y + 1
            if y >= h:
                break
        elif v == 1:
            break
        elif v == 2:
            if i + 2 > len(data):
                raise DibError("decode", "InvalidRle", "delta")
            x, y, i = x + data[i], y + data[i + 1], i + 2
            if x > w or y >= h:
                raise DibError("decode", "RleOutOfBounds")
        else:
            size = (v + 1) // 2 if four else v
            block, i = data[i : i + size], i + size + size % 2
            if len(block) < size or i > len(data):
                raise DibError("decode", "InvalidRle", "absolute block")
            put([(block[j // 2] >> 4, block[j // 2] & 15)[j & 1] for j in range(v)] if four else block)
    return out


def decode(d: Dib) -> np.ndarray:
    """(height, width, 4) RGBA, top row first."""
    w, h, k = d.width, abs(d.height), d.kind
    if w <= 0 or h == 0:
        raise DibError("decode", "InvalidDimensions", f"{w}x{d.height}")
    if w * h * 4 > MAX_BYTES:
        raise DibError("decode", "DecodedImageTooLarge")
    palette = np.array([(q[2], q[1], q[0], 255) for q in d.palette], np.uint8).reshape(-1, 4)
    if k in (RLE8, RLE4):
        return _unrle(d, palette)
    if k not in (RGB, BITFIELDS):
        raise DibError("decode", "UnsupportedCompression", str(k))
    stride = row_stride(w, d.bit_count)
    if len(d.bitmap_array) < stride * h:
        raise DibError("decode", "PixelBufferTooSmall")
    rows = np.frombuffer(d.bitmap_array, np.uint8)[: stride * h].reshape(h, stride)
    rows = rows if d.height < 0 else rows[::-1]
    if k == BITFIELDS:
        if d.masks is None:
            raise DibError("decode", "MissingBitfieldMasks")
        if d.bit_count not in (16, 32):
            raise DibError("decode", "InvalidBitfieldsBpp")
        px = np.ascontiguousarray(rows[:, : w * d.bit_count // 8]).view("<u2" if d.bit_count == 16 else "<u4").astype(np.uint64)
        chans = []
        for i, m in enumerate(d.masks):
            low = (m & -m).bit_length() - 1
            scaled = ((px & np.uint64(m)) >> np.uint64(low)) * np.uint64(255) // np.uint64(m >> low) if m else np.full(px.shape, 255 * (i == 3))
            chans.append(scaled.astype(np.uint8))
        return np.dstack(chans)
    if d.bit_count in (1, 4, 8):
        per = 8 // d.bit_count
        shifts = np.arange(per - 1, -1, -1) * d.bit_count
        index = ((rows[..., None] >> shifts) & ((1 << d.bit_count) - 1)).reshape(h, -1)[:, :w]
        if (index >= len(palette)).any():
            raise DibError("decode", "PaletteIndexOutOfRange")
        return palette[index]
    if d.bit_count == 16:
        px = np.ascontiguousarray(rows[:, : 2 * w]).view("<u2").astype(np.uint32)
        return np.dstack([*((px >> s & 31) * 255 // 31 for s in (10, 5, 0)), np.full(px.shape, 255)]).astype(np.uint8)
    if d.bit_count in (24, 32):
        n = d.bit_count // 8
        px = rows[:, : n * w].reshape(h, w, n)
        return np.dstack([px[..., 2], px[..., 1], px[..., 0], np.full((h, w), 255, np.uint8)])
    raise DibError("decode", "UnsupportedBitsPerPixel", str(d.bit_count))


# ---- encoding -----------------------------------------------------------------------------------------------------------------

FORMATS = ("rgb1", "rgb4", "rgb8", "rle4", "rle8", "rgb16", "bitfields16_555", "bitfields16_565", "rgb24", "rgb32", "bitfields32")
HEADERS = ("CORE", "INFO", "V4", "V5")
CORE_FORMATS = ("rgb1", "rgb4", "rgb8", "rgb24")
MASKS = {"bitfields16_555": (0x7C00, 0x3E0, 0x1F, 0), "bitfields16_565": (0xF800, 0x7E0, 0x1F, 0), "bitfields32": (0xFF0000, 0xFF00, 0xFF, 0)}
INDEXED = {"rgb1": 1, "rgb4": 4, "rgb8": 8, "rle4": 4, "rle8": 8}


def compatible(fmt: str, header: str) -> bool:
    return header != "CORE" or fmt in CORE_FORMATS


def preserves_steganography(fmt: str, config: tuple) -> bool:
    return fmt in ("rgb24", "rgb32", "bitfields32") and config[3] == 0


def infer_format(d: Dib) -> str:
    """The save format that a container corresponds to; rgb32 where its masks or compression have none."""
    if d.kind in (RLE8, RLE4):
        return "rle8" if d.kind == RLE8 else "rle4"
    if d.kind == BITFIELDS and d.masks is not None and not d.masks[3]:
        for fmt, bits in (("bitfields16_555", 16), ("bitfields16_565", 16), ("bitfields32", 32)):
            if d.bit_count == bits and tuple(d.masks[:3]) == MASKS[fmt][:3]:
                return fmt
    if d.kind == RGB and d.bit_count in (1, 4, 8, 16, 24):
        return f"rgb{d.bit_count}"
    return "rgb32"


def _runs(row: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, value) of the runs of equal values."""
    at = 0
    for i in range(1, len(row) + 1):
        if i == len(row) or row[i] != row[at]:
            yield at, i - at, row[at]
            at = i


def encode_rle(index: np.ndarray, four: bool) -> bytes:
    """Bottom-up rows; runs of three and more as (count, value), the pixels between them as absolute blocks or single pixels."""
    out = bytearray()

    def literal(values: list[int]) -> None:
        for k in range(0, len(values), 255):
            part = values[k : k + 255]
            if len(part) < 3:
                for v in part:
                    out.extend((1, v << 4 | v if four else v))
                continue
            body = bytes((part[j] << 4) | (part[j + 1] if j + 1 < len(part) else 0) for j in range(0, len(part), 2)) if four else bytes(part)
            out.extend((0, len(part), *body, *b"\0" * (len(body) % 2)))

    for y in range(len(index) - 1, -1, -1):
        row, held = index[y].tolist(), []
        for at, n, v in _runs(row):
            if n < 3:
                held += row[at : at + n]
                continue
            literal(held)
            held = []
            while n:
                k = min(n, 255)
                out.extend((k, v << 4 | v if four else v))
                n -= k
        literal(held)
        out.extend((0, 0) if y else (0, 1))
    return bytes(out)


def encode(img: np.ndarray, fmt: str = "rgb32", header: str = "INFO", metadata: dict | None = None) -> Dib:
    """img as a container. Rows are top-down, but for run-length formats and core headers; alpha is dropped."""
    if not compatible(fmt, header):
        raise DibError("encode", "IncompatibleHeaderFormat", f"{fmt} in {header}")
    h, w = img.shape[:2]
    if header == "CORE" and (w > 65_535 or h > 65_535):
        raise DibError("encode", "CoreDimensionOverflow")
    flip = header == "CORE"
    rows = img[::-1] if flip else img
    r, g, b = (rows[..., i].astype(np.uint32) for i in range(3))
    palette, kind, bits = (), RGB, 32
    pad = lambda a: np.pad(a, ((0, 0), (0, -a.shape[1] % 4))).tobytes()
    if fmt in ("rgb32", "bitfields32"):
        body = np.dstack([b, g, r, np.zeros_like(r)]).astype(np.uint8).tobytes()
        kind = BITFIELDS if fmt == "bitfields32" else RGB
    elif fmt == "rgb24":
        bits, body = 24, pad(np.dstack([b, g, r]).astype(np.uint8).reshape(h, 3 * w))
    elif fmt in ("rgb16", "bitfields16_555", "bitfields16_565"):
        bits, kind = 16, RGB if fmt == "rgb16" else BITFIELDS
        px = np.zeros_like(r)
        for c, m in zip((r, g, b), MASKS.get(fmt, MASKS["bitfields16_555"]), strict=False):
            low = (m & -m).bit_length() - 1
            px |= ((c * (m >> low) + 127) // 255) << low
        body = pad(px.astype("<u2").view(np.uint8).reshape(h, 2 * w))
    else:
        bits = INDEXED[fmt]
        colors, index = wu.quantize(rows[..., :3].reshape(-1, 3), 1 << bits)
        palette, index = tuple((int(c[2]), int(c[1]), int(c[0]), 0) for c in colors), index.reshape(h, w)
        if fmt[:3] == "rle":
            kind, body = (RLE8 if bits == 8 else RLE4), encode_rle(index, bits == 4)
        else:
            per = 8 // bits
            full = np.pad(index, ((0, 0), (0, -w % per))).reshape(h, -1, per)
            body = pad((full << (np.arange(per - 1, -1, -1) * bits)).sum(-1).astype(np.uint8))
        if flip:
            palette += ((0, 0, 0, 0),) * ((1 << bits) - len(palette))
    masks = MASKS[fmt] if kind == BITFIELDS else None
    size = next(k for k, v in SIZES.items() if v == header)
    offset = 14 + size + (12 if masks and header == "INFO" else 0) + len(palette) * (3 if flip else 4)
    base = {"variant": header, "signature": b"BM", "reserved_1": b"\0\0", "reserved_2": b"\0\0", "pixel_data_offset": offset, "width": w, "planes": 1, "bit_count": bits, "palette": palette, "bitmap_array": body}
    if flip:
        return Dib(file_size=offset + len(body), height=h, **base)
    base |= {"height": h if kind in (RLE8, RLE4) else -h, "compression": kind, "image_size": len(body), "x_ppm": 0, "y_ppm": 0, "colors_used": len(palette), "colors_important": 0, "masks": masks}
    end = offset + len(body)
    if header in ("V4", "V5"):
        m = metadata or {}
        cs = m.get("cs_type", SRGB)
        if header == "V4" and cs in (LINKED, EMBEDDED):
            cs, m = SRGB, {}
        base |= {"masks": masks or (0, 0, 0, 0), "cs_type": cs, "endpoints": tuple(m.get("endpoints", (0,) * 9)), "gamma": tuple(m.get("gamma", (0,) * 3))}
        if header == "V5":
            icc = m.get("icc_profile") if cs in (LINKED, EMBEDDED) else None
            if cs in (LINKED, EMBEDDED) and icc is None:
                base["cs_type"] = SRGB
            base |= {"intent": m.get("intent", 4), "profile_data": end - 14 if icc is not None else 0, "profile_size": len(icc or b""), "reserved": b"\0" * 4, "icc_profile": icc}
            end += len(icc or b"")
    return Dib(file_size=end, **base)


def source_metadata(d: Dib) -> dict:
    """Colour-management fields that a re-encoding carries over."""
    if d.variant not in ("V4", "V5"):
        return {}
    keep = ("cs_type", "endpoints", "gamma") + (("intent", "icc_profile") if d.variant == "V5" else ())
    return {k: getattr(d, k) for k in keep if getattr(d, k) is not None}


# ---- DataFrame operators ------------------------------------------------------------------------------------------------------

HEADER_FIELDS = ("variant", "file_size", "pixel_data_offset", "width", "height", "planes", "bit_count", "compression", "image_size", "x_ppm", "y_ppm", "colors_used", "colors_important", "cs_type", "intent", "profile_data", "profile_size")
#: Fields of a palette entry; header fields that are lists: masks, endpoints (2.30 fixed point), gamma (16.16).
QUAD, NUMBERS = ("blue", "green", "red", "reserved"), ("masks", "endpoints", "gamma")
STATUS = pa.struct([("ok", pa.bool_()), ("tier", pa.string()), ("code", pa.string())])
STATUS_SQL = "status struct<ok: boolean, tier: string, code: string>"


def status(error: Exception | None = None) -> dict:
    if error is None:
        return {"ok": True, "tier": None, "code": None}
    return {"ok": False, "tier": getattr(error, "tier", "image"), "code": getattr(error, "code", type(error).__name__)}


def map_rows(df: DataFrame, columns: list[str], make, schema: str, kinds: pa.Schema) -> DataFrame:
    """make(row values) -> dict, row by row in small Arrow batches: image rows are large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                cols = [batch.column(c).slice(k, 64).to_pylist() for c in columns]
                yield pa.RecordBatch.from_pylist([make(*v) for v in zip(*cols, strict=True)], schema=kinds)

    return df.select(*columns).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the bitmap files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def parse_containers(df: DataFrame, id_col: str = "path", content: str = "content") -> DataFrame:
    """Header fields, palette, masks, colour endpoints, gamma, payload length, first violation and status of each container."""
    kind = df.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(id_col, to_arrow_type(df.schema[id_col].dataType))]
    kinds += [(f, pa.string() if f == "variant" else pa.int64()) for f in HEADER_FIELDS]
    kinds += [("palette", pa.list_(pa.struct([(c, pa.int32()) for c in QUAD]))), *[(c, pa.list_(pa.int64())) for c in NUMBERS]]
    kinds += [("palette_len", pa.int64()), ("payload_len", pa.int64()), ("icc_len", pa.int64()), ("violation", pa.string()), ("status", STATUS)]

    def make(key, data) -> dict:
        out = {id_col: key}
        try:
            d = parse(bytes(data or b""))
        except DibError as e:
            return out | {"violation": None, "status": status(e)}
        out |= {f: getattr(d, f) for f in HEADER_FIELDS}
        out |= {"palette": [dict(zip(QUAD, q, strict=True)) for q in d.palette]} | {c: None if getattr(d, c) is None else list(getattr(d, c)) for c in NUMBERS}
        icc = None if d.icc_profile is None else len(d.icc_profile)
        return out | {"palette_len": len(d.palette), "payload_len": len(d.bitmap_array), "icc_len": icc, "violation": first_violation(d), "status": status()}

    fields = ", ".join(f"{f} {'string' if f == 'variant' else 'long'}" for f in HEADER_FIELDS)
    lists = "palette array<struct<blue: int, green: int, red: int, reserved: int>>, " + ", ".join(f"{c} array<long>" for c in NUMBERS)
    schema = f"{id_col} {kind}, {fields}, {lists}, palette_len long, payload_len long, icc_len long, violation string, {STATUS_SQL}"
    return map_rows(df, [id_col, content], make, schema, pa.schema(kinds))


def decode_images(df: DataFrame, id_col: str = "image_id", content: str = "content") -> DataFrame:
    """images(image_id, width, height, rgba, status): parse and decode in one pass; errors are rows with a status."""
    from pyspark.sql.pandas.types import to_arrow_type

    def make(key, data) -> dict:
        try:
            img = decode(parse(bytes(data or b"")))
        except (DibError, ImageError) as e:
            return {id_col: key, "status": status(e)}
        return {id_col: key, "width": img.shape[1], "height": img.shape[0], "rgba": img.tobytes(), "status": status()}

    t = df.schema[id_col].dataType
    kinds = pa.schema([(id_col, to_arrow_type(t)), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("status", STATUS)])
    return map_rows(df, [id_col, content], make, f"{id_col} {t.simpleString()}, width int, height int, rgba binary, {STATUS_SQL}", kinds)


def encode_images(df: DataFrame, fmt: str = "rgb32", header: str = "INFO", metadata: dict | None = None) -> DataFrame:
    """(image_id, content, status) of images(image_id, width, height, rgba)."""
    if not compatible(fmt, header):
        raise DibError("encode", "IncompatibleHeaderFormat", f"{fmt} in {header}")

    def make(key, w, h, rgba) -> dict:
        try:
            return {"image_id": key, "content": write(encode(np.frombuffer(rgba, np.uint8).reshape(h, w, 4), fmt, header, metadata)), "status": status()}
        except (DibError, ImageError) as e:
            return {"image_id": key, "status": status(e)}

    kinds = pa.schema([("image_id", pa.int64()), ("content", pa.binary()), ("status", STATUS)])
    return map_rows(df, ["image_id", "width", "height", "rgba"], make, f"image_id long, content binary, {STATUS_SQL}", kinds)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Length and header fields of the bitmap files under a path, without reading their pixels."""
    from rasterlake.sources.datasource import DibDataSource

    spark.dataSource.register(DibDataSource)
    return spark.read.format("dib").option("pixels", "false").load(path)


def save_images(df: DataFrame, path: str, fmt: str = "rgb32", header: str = "INFO", mode: str = "append") -> None:
    """Write each image as a .bmp file under path, a folder that the executors share; all of them or none."""
    from rasterlake.sources.datasource import DibDataSource

    df.sparkSession.dataSource.register(DibDataSource)
    encode_images(df, fmt, header).filter("status.ok").select("image_id", "content").write.format("dib").mode(mode).save(path)


def survives(img: np.ndarray, fmt: str, header: str = "INFO", metadata: dict | None = None) -> bool | None:
    """Whether an image's hidden payload is found again after it is saved in a format and read; None without a payload."""
    found = steg.detect_best_effort(img)
    if found is None:
        return None
    back = decode(parse(write(encode(img, fmt, header, metadata))))
    again = steg.detect_best_effort(back)
    return again is not None and steg.extract(back, *again) == steg.extract(img, *found)


def payload_warnings(df: DataFrame, fmt: str, header: str = "INFO") -> DataFrame:
    """(image_id, survives, warning) of images: 'payload' where saving destroys what is hidden, next to the reasons of save_warnings."""

    def make(key, w, h, rgba) -> dict:
        kept = survives(np.frombuffer(rgba, np.uint8).reshape(h, w, 4), fmt, header)
        return {"image_id": key, "survives": None if kept is None else int(kept), "warning": "payload" if kept is False else ""}

    kinds = pa.schema([("image_id", pa.int64()), ("survives", pa.int64()), ("warning", pa.string())])
    return map_rows(df, ["image_id", "width", "height", "rgba"], make, "image_id long, survives long, warning string", kinds)


def inspect(df: DataFrame) -> DataFrame:
    """Report columns of parsed containers: orientation, names, sizes with their ratio, endpoints and gamma as numbers."""
    names = F.create_map(*[x for k, v in COMPRESSION.items() for x in (F.lit(k).cast("long"), F.lit(v))])
    decoded = F.col("width") * F.abs("height") * 4
    return df.withColumns({
        "orientation": F.when(F.col("height") < 0, "top-down").otherwise("bottom-up"),
        "compression_name": F.coalesce(F.element_at(names, F.coalesce("compression", F.lit(0).cast("long"))), F.lit("OTHER")),
        "decoded_bytes": decoded, "file_size_text": measures.byte_text(F.col("file_size")), "decoded_text": measures.byte_text(decoded),
        "ratio_text": measures.ratio_text(decoded, F.col("payload_len")),
        "ratio_pct": F.floor(decoded * 100 / F.when(F.col("payload_len") > 0, F.col("payload_len"))),
        "endpoint_values": F.transform("endpoints", lambda v: measures.from_fixed(v, 30)), "gamma_values": F.transform("gamma", lambda v: measures.from_fixed(v, 16)),
    })
