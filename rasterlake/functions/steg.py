"""Payloads in the least significant bits of RGBA pixels: embed, detect, extract, remove.

Stream bit k of a configuration (r, g, b, a) with B bits a pixel lies in pixel k div B, channels in order, lowest bit first. Its first
80 bits are the header: marker, version (3 bits), configuration (13 bits), payload length (32 bits), each lowest bit first.
"""

from __future__ import annotations

import numpy as np

from rasterlake.functions.imaging import ImageError

MARKER, HEADER_BITS, CONFIGS = b"STEG", 80, 9**4


def encode_config(c: tuple[int, int, int, int]) -> int:
    return sum(v * 9**i for i, v in enumerate(c))


def decode_config(v: int) -> tuple[int, int, int, int] | None:
    return tuple(v // 9**i % 9 for i in range(4)) if 0 <= v < CONFIGS else None


def check_config(c: tuple) -> tuple:
    if len(c) != 4 or not all(0 <= v <= 8 for v in c):
        raise ImageError("InvalidChannelDepth", str(c))
    return tuple(c)


def capacity(config: tuple, pixels: int) -> int:
    """Payload bytes that fit."""
    return max(0, (sum(config) * pixels - HEADER_BITS) // 8)


def _planes(config: tuple) -> list[tuple[int, int]]:
    return [(ch, bit) for ch in range(4) for bit in range(config[ch])]


def read_bits(flat: np.ndarray, config: tuple, start: int, n: int) -> np.ndarray:
    """Bits [start, start + n) of the stream over flat (pixels, 4)."""
    planes, b = _planes(config), sum(config)
    k = np.arange(start, start + n)
    ch, bit = (np.array([p[i] for p in planes])[k % b] for i in range(2))
    return (flat[k // b, ch] >> bit) & 1


def write_bits(flat: np.ndarray, config: tuple, start: int, bits: np.ndarray) -> None:
    """In place; the bits of one plane touch a pixel once, so each plane is one assignment."""
    b = sum(config)
    k = np.arange(start, start + len(bits))
    for j, (ch, bit) in enumerate(_planes(config)):
        at = k % b == j
        px = k[at] // b
        flat[px, ch] = (flat[px, ch] & (255 ^ (1 << bit))) | (bits[at].astype(np.uint8) << bit)


def _number(bits: np.ndarray) -> int:
    return int(sum(int(v) << i for i, v in enumerate(bits)))


def _bits(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n)]


def header_bits(config: tuple, length: int) -> np.ndarray:
    marker = np.unpackbits(np.frombuffer(MARKER, np.uint8), bitorder="little")
    return np.r_[marker, _bits(0, 3), _bits(encode_config(config), 13), _bits(length, 32)].astype(np.uint8)


def probe(flat: np.ndarray, config: tuple) -> int | None:
    """Payload length under this configuration, None without a header; ImageError for a version or length that can't be."""
    if sum(config) == 0 or sum(config) * len(flat) < HEADER_BITS:
        return None
    bits = read_bits(flat, config, 0, HEADER_BITS)
    if np.packbits(bits[:32], bitorder="little").tobytes() != MARKER:
        return None
    if _number(bits[32:35]):
        raise ImageError("UnsupportedVersion", str(_number(bits[32:35])))
    if decode_config(_number(bits[35:48])) != tuple(config):
        return None
    length = _number(bits[48:80])
    if length > capacity(config, len(flat)):
        raise ImageError("PayloadTooLarge", str(length))
    return length


def embed(img: np.ndarray, config: tuple, payload: bytes) -> np.ndarray:
    flat = img.reshape(-1, 4).copy()
    if sum(check_config(config)) == 0:
        raise ImageError("NoChannels")
    if sum(config) * len(flat) < HEADER_BITS or len(payload) > capacity(config, len(flat)):
        raise ImageError("InsufficientCapacity", f"{len(payload)} of {capacity(config, len(flat))}")
    data = np.unpackbits(np.frombuffer(payload, np.uint8), bitorder="little")
    write_bits(flat, config, 0, np.r_[header_bits(config, len(payload)), data])
    return flat.reshape(img.shape)


def extract(img: np.ndarray, config: tuple, length: int) -> bytes:
    flat = img.reshape(-1, 4)
    if probe(flat, config) != length:
        raise ImageError("HeaderMismatch")
    return np.packbits(read_bits(flat, config, HEADER_BITS, 8 * length), bitorder="little").tobytes()


def remove(img: np.ndarray, config: tuple) -> np.ndarray:
    flat = img.reshape(-1, 4).copy()
    length = probe(flat, config)
    if length is None:
        raise ImageError("NotFound")
    write_bits(flat, config, 0, np.zeros(HEADER_BITS + 8 * length, np.uint8))
    return flat.reshape(img.shape)


def _candidates(head: list[int]) -> list[tuple[int, int, int, int]]:
    """Configurations whose bits of the first pixel go on with the marker, in order of their numbers: narrowed channel by channel."""
    mark, found = int.from_bytes(MARKER, "little"), [()]
    for v in head:
        found = [(*c, d) for c in found for d in range(9) if not (v ^ mark >> sum(c)) & (1 << d) - 1]
    return sorted((c for c in found if any(c)), key=encode_config)


def detect(img: np.ndarray) -> tuple[tuple[int, int, int, int], int] | None:
    """(configuration, payload length) of the first valid header, alpha outermost and red innermost; else the worst error."""
    flat = img.reshape(-1, 4)
    error = None
    for config in _candidates(flat[0].tolist()) if len(flat) else ():
        try:
            if (length := probe(flat, config)) is not None:
                return config, length
        except ImageError as e:
            if error is None or (e.code == "UnsupportedVersion" and error.code != e.code):
                error = e
    if error is not None:
        raise error
    return None


def detect_best_effort(img: np.ndarray):
    try:
        return detect(img)
    except ImageError:
        return None


def remove_if_present(img: np.ndarray, config: tuple) -> np.ndarray:
    try:
        return remove(img, config)
    except ImageError:
        return img
