"""Sizes, fixed-point numbers, rectangles and payload views as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def byte_text(n: Column) -> Column:
    """Grouped bytes, from 1 KiB on with the value in the largest fitting unit, cut to two decimals."""
    plain = F.concat(F.format_number(n, 0), F.lit(" B"))
    out = plain
    for k, unit in enumerate(UNITS[1:], 1):
        size = 1 << (10 * k)
        whole, part = F.floor(n / size).cast("long"), F.floor(F.pmod(n, F.lit(size)) * 100 / size).cast("string")
        scaled = F.concat(plain, F.lit(" ("), whole.cast("string"), F.lit("."), F.lpad(part, 2, "0"), F.lit(f" {unit})"))
        out = F.when(n >= size, scaled).otherwise(out)
    return out


def ratio_text(decoded: Column, encoded: Column) -> Column:
    """decoded over encoded bytes, to two decimals; null without encoded bytes."""
    return F.when(encoded > 0, F.concat(F.format_string("%.2f", decoded.cast("double") / encoded), F.lit("x")))


def from_fixed(raw: Column, bits: int) -> Column:
    """Value of an unsigned 32-bit number with that many fraction bits (30 or 16)."""
    return raw.cast("double") / float(1 << bits)


def _scaled(value: Column, bits: int) -> Column:
    x = value * float(1 << bits)
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("double")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def to_fixed(value: Column, bits: int) -> Column:
    """Raw number of a value, null where it isn't finite or doesn't fit."""
    raw = _scaled(F.when(_finite(value) & (F.abs(value) < 2.0**33), value), bits)
    return F.when((raw >= 0) & (raw <= float(2**32 - 1)), raw).cast("long")


def to_fixed_clamped(value: Column, bits: int) -> Column:
    """Raw number of the nearest value that fits; 0 of what isn't finite."""
    near = F.least(F.greatest(value, F.lit(-1.0)), F.lit(2.0**33))
    raw = F.least(F.greatest(_scaled(near, bits), F.lit(0.0)), F.lit(float(2**32 - 1)))
    return F.when(_finite(value), raw).otherwise(F.lit(0.0)).cast("long")


def scaled_by(value: Column, factor: Column) -> Column:
    """A size times a factor in single precision, rounded, 1 at least."""
    product = (value.cast("float") * factor.cast("float")).cast("float")
    return F.greatest(F.floor(product.cast("double") + 0.5), F.lit(1)).cast("long")


def scaled_side(base: Column, other_side: Column, base_side: Column) -> Column:
    """The side that goes with base in an image of base_side by other_side."""
    return scaled_by(base, (other_side.cast("float") / base_side.cast("float")).cast("float"))


#: Largest side that a resize may ask for (fixed value).
MAX_SIDE = 16_384


def resize_gate(width: Column, height: Column, now_w: Column, now_h: Column, keep_aspect: bool) -> Column:
    """Struct of width, height and error (null: allowed) of a wanted size."""
    tall = F.when((now_w > 0) & (now_h > 0), scaled_side(width, now_h, now_w)).otherwise(height) if keep_aspect else height
    error = F.when((width < 1) | (height < 1), "too small").when((width > MAX_SIDE) | (tall > MAX_SIDE), "too large")
    return F.struct(width.cast("long").alias("width"), tall.cast("long").alias("height"), error.alias("error"))


def crop_rect(cx: Column, cy: Column, width: Column, height: Column, w: Column, h: Column) -> Column:
    """Struct of x, y, width and height: a rectangle about a centre, moved and cut to lie in an image of w by h."""

    def side(center: Column, want: Column, most: Column) -> tuple[Column, Column]:
        size = F.least(F.greatest(want, F.lit(1)), F.greatest(most, F.lit(1)))
        start = F.greatest(F.least(center, F.greatest(most - 1, F.lit(0))) - F.floor(size / 2), F.lit(0))
        return F.when(start + size > most, most - size).otherwise(start), size

    (x, wide), (y, tall) = side(cx, width, w), side(cy, height, h)
    return F.struct(*[c.cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (wide, "width"), (tall, "height"))])


#: Largest inputs: tenths of a degree, thousandths of a skew, and shifts of brightness and contrast (fixed values).
MOST_TENTHS, MOST_MILLI, MOST_SHIFT = 36_000, 1_000, 255


def _clamped(v: Column, most: int) -> Column:
    return F.greatest(F.least(v, F.lit(most).cast("long")), F.lit(-most).cast("long"))


def _ten_times(v: Column, most: int) -> Column:
    """Ten times a single-precision input, rounded away from zero at halves, within the range."""
    return _clamped(F.round((v.cast("float") * F.lit(10).cast("float")).cast("float").cast("double")).cast("long"), most)


def angle_tenths(degrees: Column) -> Column:
    return _ten_times(degrees, MOST_TENTHS)


def skew_milli(percent: Column) -> Column:
    return _ten_times(percent, MOST_MILLI)


def tone_shift(v: Column) -> Column:
    return _clamped(v.cast("long"), MOST_SHIFT)


def dragged_rect(x: Column, y: Column, width: Column, height: Column, dx: Column, dy: Column, w: int | Column, h: int | Column, across: str, down: str) -> Column:
    """Struct of x, y, width and height: a rectangle of an image of w by h after a drag of its edges.

    across and down say what moves along an axis: ``move`` (the rectangle), ``low`` or ``high`` (one edge), ``none``. At least one
    pixel stays; where the rectangle would leave the image it is moved back if its low edge moves, and cut otherwise.
    """

    def along(at: Column, size: Column, by: Column, most: Column, edge: str) -> tuple[Column, Column]:
        moved = at + by if edge in ("move", "low") else at
        grown = size - by if edge == "low" else size + by if edge == "high" else size
        start = F.greatest(F.least(moved, most - 1), F.lit(0))
        long = F.least(F.greatest(grown, F.lit(1)), most)
        over = start + long > most
        if edge in ("move", "low"):
            return F.when(over, most - long).otherwise(start), long
        return start, F.when(over, most - start).otherwise(long)

    w, h = (F.lit(v) if isinstance(v, int) else v for v in (w, h))
    (left, wide), (top, tall) = along(x, width, dx, w, across), along(y, height, dy, h, down)
    return F.struct(*[c.cast("long").alias(n) for c, n in ((left, "x"), (top, "y"), (wide, "width"), (tall, "height"))])


def payload_view(payload: Column) -> Column:
    """A payload as text where it is UTF-8, else its first 256 bytes in hexadecimal, 16 to a line."""
    raw = F.hex(F.substring(payload, 1, 256))
    spaced = F.rtrim(F.regexp_replace(raw, "(..)", "$1 "))
    lines = F.regexp_replace(spaced, "((?:.. ){15}..) ", "$1\n")
    return F.when(F.is_valid_utf8(payload.cast("string")), payload.cast("string")).otherwise(lines)
