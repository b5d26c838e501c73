"""Payloads in the least significant bits of pixels: embed, detect, extract, remove as joins and column expressions.

The layout is that of :mod:`rasterlake.functions.steg`: bit k of a stream of B bits a pixel lies in pixel k div B, channels in order,
lowest bit first. So 64 pixels hold exactly 8 B bytes: streams are cut into byte strings that meet their pixels by (image, block) and
are read back block by block, and no row of a join or group holds more than 256 bytes or 64 pixels, however large the image. Only
``extract`` puts the blocks of one payload together in one row, for that is its result.

Pixels carry their image's size (``w``, ``h``). Configurations are arrays of four depths (r, g, b, a), a column of the payloads' table,
so images may differ in them. Images without a payload row pass unchanged; payloads that don't fit leave their image unchanged and are
named by :func:`check`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.steg import HEADER_BITS, MARKER

#: Pixels of a block; pixels that a header of one bit a pixel takes.
BLOCK, FIRST = 64, HEADER_BITS
MARK = int.from_bytes(MARKER, "little")


def _up(v: Column, by: Column) -> Column:
    return F.call_function("shiftleft", v, by.cast("int"))


def _down(v: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", v, by.cast("int"))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _ones(n: Column) -> Column:
    return _up(_long(1), n) - 1


def depth(config: Column) -> Column:
    """Bits a pixel."""
    return sum((F.get(config, F.lit(k)) for k in range(1, 4)), F.get(config, F.lit(0)))


def code(config: Column) -> Column:
    """A configuration as a number, red in the lowest place."""
    return sum((F.get(config, F.lit(k)) * 9**k for k in range(1, 4)), F.get(config, F.lit(0)))


def capacity(config: Column, pixels: Column) -> Column:
    """Payload bytes that fit."""
    return F.greatest(_long(0), F.floor((depth(config).cast("long") * pixels - HEADER_BITS) / 8))


def place() -> Column:
    """A pixel's number within its image."""
    return F.col("y").cast("long") * F.col("w") + F.col("x")


def value(config: Column, channels: list[Column]) -> Column:
    """The bits of the stream that a pixel holds, the first one lowest."""
    out, at = _long(0), F.lit(0)
    for k, c in enumerate(channels):
        d = F.get(config, F.lit(k))
        out = out.bitwiseOR(_up(c.cast("long").bitwiseAND(_ones(d)), at))
        at = at + d
    return out


def _layout(config: Column) -> list[Column]:
    """Depths as plain numbers, taken once an image or block: bits a pixel, and of each channel its mask and the bit that it starts at."""
    starts = [sum((F.get(config, F.lit(j)) for j in range(k)), F.lit(0)) for k in range(4)]
    ones = [_ones(F.get(config, F.lit(k))).alias(f"__ones{k}") for k in range(4)]
    return [depth(config).alias("__depth"), *ones, *[v.alias(f"__start{k}") for k, v in enumerate(starts)]]


def _put(rows: DataFrame, bits: Column, mask: Column, names: list[str]) -> DataFrame:
    """rows with the bits under the mask written to their channels; a null mask leaves them."""
    rows = rows.withColumns({"__new": bits, "__mask": mask})
    put = {}
    for k, c in enumerate("rgba"):
        at, old = F.col(f"__start{k}"), F.col(c).cast("long")
        held = _down(F.col("__mask"), at).bitwiseAND(F.col(f"__ones{k}"))
        new = old.bitwiseXOR(old.bitwiseXOR(_down(F.col("__new"), at)).bitwiseAND(held))
        put[c] = F.coalesce(new, old).cast(rows.schema[c].dataType)
    return rows.withColumns(put).select(*names)


def _held() -> Column:
    """Mask of a pixel's bits that belong to its image's stream."""
    return _ones(F.greatest(_long(0), F.least(F.col("__bits") - F.col("__at") * F.col("__depth"), F.col("__depth").cast("long"))))


def _little(n: Column, size: int) -> Column:
    """A number as hex of so many bytes, the lowest first."""
    return F.concat(*[F.lpad(F.hex(_down(n, F.lit(8 * i)).bitwiseAND(_long(255))), 2, "0") for i in range(size)])


def stream(config: Column, payload: Column) -> Column:
    """Header and payload as bytes."""
    fields = F.concat(_little(code(config).cast("long") * 8, 2), _little(F.octet_length(payload).cast("long"), 4))
    return F.concat(F.lit(bytearray(MARKER)), F.unhex(fields), payload)


def _sound(config: Column) -> Column:
    return (F.size(config) == 4) & F.forall(config, lambda d: d.between(0, 8))


def check(sizes: DataFrame, payloads: DataFrame) -> DataFrame:
    """(image_id, code) of payloads and sizes (image_id, w, h): null where the payload fits, else the error of embedding it."""
    pixels = F.col("w").cast("long") * F.col("h")
    b = depth(F.col("config")).cast("long") * pixels
    tight = (b < HEADER_BITS) | (F.octet_length("payload") > capacity(F.col("config"), pixels))
    error = F.when(~_sound(F.col("config")), "InvalidChannelDepth").when(depth(F.col("config")) == 0, "NoChannels").when(tight, "InsufficientCapacity")
    return payloads.join(sizes.select("image_id", "w", "h"), "image_id").select("image_id", error.alias("code"))


def stream_parts(payloads: DataFrame) -> DataFrame:
    """(image_id, block, config, bits, part): the streams of payloads (image_id, config, payload) in the bytes of 64 pixels each."""
    config, s = F.col("config"), F.col("stream")
    rows = payloads.filter(_sound(config) & (depth(config) > 0)).withColumn("stream", stream(config, F.coalesce("payload", F.lit(bytearray()))))
    step = depth(config) * 8
    number = F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length(s) - 1) / step))
    part = lambda i: F.struct(i.alias("block"), F.substring(s, (i * step + 1).cast("int"), step).alias("part"))
    parts = rows.select("image_id", "config", (F.octet_length(s).cast("long") * 8).alias("bits"), F.explode(F.transform(number, part)).alias("p"))
    return parts.select("image_id", F.col("p")["block"].alias("block"), "config", "bits", F.col("p")["part"].alias("part"))


def blocks_of(payloads: DataFrame) -> DataFrame:
    """(image_id, block, config, bits, bytes): as stream_parts, the bytes as numbers."""
    byte = lambda i: F.conv(F.hex(F.substring("part", i + 1, F.lit(1))), 16, 10).cast("long")
    numbers = F.transform(F.sequence(F.lit(0), F.octet_length("part") - 1), byte)
    return stream_parts(payloads).select("image_id", "block", "config", "bits", numbers.alias("bytes"))


def embed(pixels: DataFrame, payloads: DataFrame) -> DataFrame:
    """pixels with the payloads (image_id, config, payload; one row an image, null: empty) of their images in their lowest bits."""
    put = blocks_of(payloads).select(*[F.col(c).alias(f"__{c}") for c in ("image_id", "block", "bits", "bytes")], *_layout(F.col("config")))
    rows = pixels.withColumn("__at", place())
    rows = rows.join(put, (F.col("image_id") == F.col("__image_id")) & (F.expr(f"__at div {BLOCK}") == F.col("__block")), "left")
    fits = F.col("w").cast("long") * F.col("h") * F.col("__depth") >= F.col("__bits")
    rows = rows.withColumns({"__first": (F.col("__at") % BLOCK * F.col("__depth")).cast("int"), "__held": F.when(fits, _held())})
    byte = lambda i: F.coalesce(F.get("__bytes", F.expr("__first div 8").cast("int") + i), _long(0))
    word = byte(0)
    for i in range(1, 5):
        word = word.bitwiseOR(_up(byte(i), F.lit(8 * i)))
    return _put(rows, _down(word, F.col("__first") % 8), F.col("__held"), pixels.columns)


def _word(px: Column, config: Column, start: int, size: int) -> Column:
    """Bits [start, start + size) of a stream, from the first pixels as arrays of channels; size is at most 48."""
    b = depth(config)
    number = F.sequence(F.floor(F.lit(start) / b), F.floor(F.lit(start + size - 1) / b))

    def add(acc: Column, i: Column) -> Column:
        p = F.get(px, i.cast("int"))
        v, at = value(config, [F.get(p, F.lit(k)) for k in range(4)]), i * b - start
        return acc.bitwiseOR(F.when(at >= 0, _up(v, at)).otherwise(_down(v, -at)))

    return F.aggregate(number, _long(0), add).bitwiseAND(_long((1 << size) - 1))


def find(images: DataFrame) -> DataFrame:
    """(image_id, config, length, error) of images (image_id, px: their first 80 pixels as arrays of channels, pixels: how many in all).

    Depths are narrowed channel by channel: of nine depths of a channel those stay whose bits of the first pixel go on with the marker,
    about two each; only what is left is read up to its header's end. The first hit counts, alpha outermost and red innermost; without
    one, an unsupported version is named before a length that can't be.
    """
    px, pixels = F.col("px"), F.col("pixels")
    head = F.get(px, F.lit(0))
    every = F.sequence(F.lit(0), F.lit(8))

    def deeper(found: Column, k: int) -> Column:
        def fits(c: Column, d: Column) -> Column:
            at = F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
            return F.get(head, F.lit(k)).cast("long").bitwiseAND(_ones(d)) == _down(_long(MARK), at).bitwiseAND(_ones(d))

        return F.flatten(F.transform(found, lambda c: F.transform(F.filter(every, lambda d: fits(c, d)), lambda d: F.concat(c, F.array(d)))))

    found = F.array(F.expr("cast(array() as array<int>)"))
    for k in range(4):
        found = deeper(found, k)
    room = F.filter(found, lambda c: (depth(c) > 0) & (depth(c) * pixels >= HEADER_BITS))
    read = F.transform(room, lambda c: F.struct(code(c).alias("code"), c.alias("config"), _word(px, c, 0, 48).alias("low"), _word(px, c, 48, 32).alias("length")))
    marked = F.filter(read, lambda h: h["low"].bitwiseAND(_long((1 << 32) - 1)) == MARK)
    version = lambda h: _down(h["low"], F.lit(32)).bitwiseAND(_long(7))
    rows = images.select("image_id", "pixels", marked.alias("marked"))
    own = F.filter("marked", lambda h: (version(h) == 0) & (_down(h["low"], F.lit(35)) == h["code"]))
    rows = rows.select("image_id", "pixels", F.exists("marked", lambda h: version(h) != 0).alias("other"), own.alias("own"))
    hit = F.array_min(F.filter("own", lambda h: h["length"] <= capacity(h["config"], pixels)))
    rows = rows.select("image_id", F.when(F.col("other"), "UnsupportedVersion").when(F.size("own") > 0, "PayloadTooLarge").alias("error"), hit.alias("hit"))
    return rows.select("image_id", F.col("hit")["config"].alias("config"), F.col("hit")["length"].alias("length"), F.when(F.col("hit").isNull(), F.col("error")).alias("error"))


def detect(pixels: DataFrame) -> DataFrame:
    """(image_id, config, length, error) of every image; three nulls where nothing is hidden. Only the first 80 pixels are shuffled."""
    first = pixels.withColumn("__at", place()).filter(F.col("__at") < FIRST)
    rows = F.array_sort(F.collect_list(F.struct("__at", F.array(*"rgba").alias("c"))))
    images = first.groupBy("image_id").agg(rows.alias("px"), F.max(F.col("w").cast("long") * F.col("h")).alias("pixels"))
    px = F.transform("px", lambda p: p["c"])
    return find(images.withColumn("px", px))


def detect_images(images: DataFrame) -> DataFrame:
    """As detect, of images(image_id, width, height, rgba): from the first bytes of each row, without a shuffle."""
    n = F.col("width").cast("long") * F.col("height")
    byte = lambda i: F.conv(F.hex(F.substring("rgba", i + 1, F.lit(1))), 16, 10).cast("int")
    px = F.transform(F.sequence(F.lit(0), F.least(n, _long(FIRST)).cast("int") - 1), lambda p: F.array(*[byte(p * 4 + k) for k in range(4)]))
    return find(images.select("image_id", n.alias("pixels"), F.when(n > 0, px).otherwise(F.expr("cast(array() as array<array<int>>)")).alias("px")))


def _with(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """pixels of images with a hit, with its config and the bits of its stream; a large image's pixels may be split among tasks."""
    hit = found.filter("config is not null").select(F.col("image_id").alias("__image_id"), F.col("config").alias("__config"), (F.col("length") * 8 + HEADER_BITS).alias("__bits"), *_layout(F.col("config")))
    return pixels.withColumn("__at", place()).join(hit, F.col("image_id") == F.col("__image_id"), "left")


def extract_blocks(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, block, part): the bytes of each stream, its header included, that lie in each 64 pixels."""
    config, b = F.col("__config"), depth(F.col("__config"))
    rows = _with(pixels, found).filter((F.col("__at") * b < F.col("__bits")) & config.isNotNull())
    rows = rows.select("image_id", F.expr(f"__at div {BLOCK}").alias("block"), "__config", "__bits", (F.col("__at") % BLOCK).alias("o"), value(config, [F.col(c) for c in "rgba"]).alias("v"))
    held = rows.groupBy("image_id", "block").agg(F.first("__config").alias("__config"), F.first("__bits").alias("__bits"), F.array_sort(F.collect_list(F.struct("o", "v"))).alias("px"))
    held = held.withColumn("px", F.transform("px", lambda p: p["v"])).withColumn("b", depth(F.col("__config")))

    def byte(i: Column) -> Column:
        bit = lambda t: _up(_down(F.get("px", F.floor((i * 8 + t) / F.col("b")).cast("int")), (i * 8 + t) % F.col("b")).bitwiseAND(_long(1)), F.lit(t))
        return F.lpad(F.hex(sum((bit(t) for t in range(1, 8)), bit(0))), 2, "0")

    size = F.least(F.col("b") * 8, F.col("__bits") / 8 - F.col("block") * F.col("b") * 8).cast("int")
    part = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), ""))
    return held.select("image_id", "block", part.alias("part"))


def joined(parts: DataFrame) -> DataFrame:
    """(image_id, payload) of the parts (image_id, block, part) of streams."""
    rows = parts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("block", F.hex("part").alias("part")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    return rows.select("image_id", F.substring(whole, F.lit(HEADER_BITS // 8 + 1), F.octet_length(whole)).alias("payload"))


def extract(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, payload) of images with a hit in found (image_id, config, length)."""
    return joined(extract_blocks(pixels, found))


def remove(pixels: DataFrame, found: DataFrame) -> DataFrame:
    """pixels with zeros where found (image_id, config, length) says a header and payload are."""
    return _put(_with(pixels, found), _long(0), _held(), pixels.columns)
