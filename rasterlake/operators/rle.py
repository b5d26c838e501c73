"""Run-length streams of indexed images as column expressions: islands become opcodes, running sums of opcodes become pixels.

Encoding deals pixels to (image, row) once, finds the islands of equal values and the stretches of short ones, writes each as opcodes and
joins them per row and image. Decoding stays within the image's row until its opcodes are found: the stream's 16-bit words are cut into
blocks, each block says where a reader that enters it at any word leaves it, a fold over these gives the entries, and the blocks then list
their opcodes. Opcodes are exploded, sums over them give positions. Work on a stream is linear in it; no Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import stats

#: Longest run or literal of an opcode; runs from this length are encoded as such; words to a block of the decoder.
MOST, SHORT, BLOCK = 255, 3, 64
BAD_BOUNDS, BAD_INDEX, BAD_STREAM = "RleOutOfBounds", "PaletteIndexOutOfRange", "InvalidRle"


def _hex(value: Column) -> Column:
    return F.lpad(F.hex(value), 2, "0")


def _byte(data: Column, at: Column) -> Column:
    """The byte of a binary at a place, counted from 0."""
    return F.conv(F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def _chunks(n: Column, make) -> Column:
    """make(first, size) of each chunk of up to MOST of n, joined."""
    at = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / MOST))
    return F.array_join(F.transform(at, lambda k: make(k * MOST, F.least(F.lit(MOST).cast("long"), n - k * MOST))), "")


def encode_streams(pixels: DataFrame, four: bool = False, index: str = "index") -> DataFrame:
    """(image_id, width, height, body) of complete indexed pixels (image_id, y, x, index): 8-bit, or 4-bit, streams, bottom row first."""
    both = lambda v: _hex(v * 17) if four else _hex(v)
    islands = stats.runs(pixels.select("image_id", "y", "x", F.col(index).cast("int").alias("v")), "v")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    long = F.col("length") >= SHORT
    apart = long | F.coalesce(F.lag(long).over(row), F.lit(True))
    islands = islands.withColumn("stretch", F.sum(apart.cast("int")).over(row))
    parts = F.array_sort(F.collect_list(F.struct("x", "length", "value")))
    stretches = islands.groupBy("image_id", "y", "stretch").agg(F.min("x").alias("x"), F.sum("length").alias("n"), F.max("length").alias("longest"), parts.alias("parts"))
    values = F.flatten(F.transform("parts", lambda p: F.array_repeat(p["value"], p["length"].cast("int"))))
    stretches = stretches.withColumn("values", F.when(F.col("longest") < SHORT, values)).withColumn("value", F.col("parts")[0]["value"])

    def literal(first: Column, size: Column) -> Column:
        own = F.slice("values", (first + 1).cast("int"), size.cast("int"))
        digits = F.array_join(F.transform(own, lambda v: F.hex(v) if four else _hex(v)), "")
        pad = F.repeat(F.lit("0"), F.pmod(-size, F.lit(4)).cast("int")) if four else F.repeat(F.lit("00"), (size % 2).cast("int"))
        single = F.array_join(F.transform(own, lambda v: F.concat(F.lit("01"), both(v))), "")
        return F.when(size < SHORT, single).otherwise(F.concat(F.lit("00"), _hex(size), digits, pad))

    run = _chunks(F.col("n"), lambda first, size: F.concat(_hex(size), both(F.col("value"))))
    text = F.when(F.col("longest") >= SHORT, run).otherwise(_chunks(F.col("n"), literal))
    lines = stretches.withColumn("text", text).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "text"))).alias("ops"), F.sum("n").alias("n"))
    line = F.concat(F.array_join(F.transform("ops", lambda o: o["text"]), ""), F.when(F.col("y") > 0, "0000").otherwise("0001"))
    lines = lines.select("image_id", (-F.col("y")).alias("from_below"), line.alias("text"), "n")
    out = lines.groupBy("image_id").agg(F.max("n").cast("int").alias("width"), F.count("*").cast("int").alias("height"), F.array_sort(F.collect_list(F.struct("from_below", "text"))).alias("lines"))
    return out.select("image_id", "width", "height", F.unhex(F.array_join(F.transform("lines", lambda x: x["text"]), "")).alias("body"))


def _little(value: Column, size: int) -> Column:
    """value as hex digits of so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])


def wrap_streams(streams: DataFrame, palettes: DataFrame, four: bool = False) -> DataFrame:
    """(image_id, content): streams as files with the 40-byte header and their palettes (image_id, index, r, g, b; no gaps)."""
    colour = F.concat(_hex(F.col("b")), _hex(F.col("g")), _hex(F.col("r")), F.lit("00"))
    colours = palettes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("index", colour.alias("c")))).alias("colours"))
    n, size, zero = F.size("colours"), F.length("body"), F.lit("00000000")
    offset = 54 + 4 * n
    head = [F.lit("424D"), _little(offset + size, 4), zero, _little(offset, 4), _little(F.lit(40), 4), _little(F.col("width"), 4), _little(F.col("height"), 4), F.lit("0100")]
    head += [_little(F.lit(4 if four else 8), 2), _little(F.lit(2 if four else 1), 4), _little(size, 4), zero, zero, _little(n, 4), zero]
    table = F.array_join(F.transform("colours", lambda c: c["c"]), "")
    return streams.join(colours, "image_id").select("image_id", F.concat(F.unhex(F.concat(*head, table)), F.col("body")).alias("content"))


def _opcodes(n_words: Column, sizes: Column) -> Column:
    """Places of the opcodes among n words, of which each, were it an opcode, would take ``sizes`` words."""
    ints = lambda *v: F.array(*v).cast("array<int>")
    of_block = lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK)

    def exits(b: Column) -> Column:
        own = of_block(b)
        m = F.size(own)

        def back(acc: Column, p: Column) -> Column:  # acc: exits of the words after p
            ahead = F.element_at(own, p)
            return F.concat(F.array(F.when(p + ahead > m, p + ahead - m - 1).otherwise(F.get(acc, ahead - 1))), acc)

        return F.aggregate(F.sequence(m, F.lit(1), F.lit(-1)), ints(), back)

    def enter(acc: Column, e: Column) -> Column:
        leave = F.when(acc["at"] < F.size(e), F.get(e, acc["at"])).otherwise(acc["at"] - F.size(e))
        return F.struct(leave.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def marks(b: Column, entry: Column) -> Column:
        own = of_block(b)

        def step(acc: Column, p: Column) -> Column:
            hit = p == acc["at"]
            return F.struct(F.when(hit, p + F.get(own, p)).otherwise(acc["at"]).alias("at"), F.when(hit, F.concat(acc["out"], F.array(b * BLOCK + p))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.struct(entry.alias("at"), ints().alias("out")), step, lambda acc: acc["out"])

    blocks = F.sequence(F.lit(0), F.floor((n_words - 1) / BLOCK).cast("int"))
    entries = F.aggregate(F.transform(blocks, exits), F.struct(F.lit(0).alias("at"), ints().alias("out")), enter, lambda acc: acc["out"])
    found = F.flatten(F.zip_with(blocks, entries, marks))
    return F.when(n_words > 0, found).otherwise(ints())


def place_opcodes(streams: DataFrame, four: bool = False) -> DataFrame:
    """The opcodes of streams (image_id, width, height, body, colours: the palette's size) with their values, places and first errors.

    The height's sign tells the order of rows, as in a header. Opcodes after the end of the bitmap, or of its last row, don't count.
    """
    word = lambda i: F.conv(F.hex(F.substring("body", (i * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("int")
    n_words = F.floor(F.length("body") / 2).cast("int")
    rows = streams.withColumn("words", F.when(n_words > 0, F.transform(F.sequence(F.lit(0), n_words - 1), word)).otherwise(F.array().cast("array<int>")))

    def size(w: Column) -> Column:
        lo = w % 256
        data = F.floor((lo + 3) / 4) if four else F.floor((lo + 1) / 2)
        return F.when((w >= 256) | (lo < 2), 1).when(lo == 2, 2).otherwise(1 + data).cast("int")

    rows = rows.withColumn("sizes", F.transform("words", size)).withColumn("at", _opcodes(F.size("words"), F.col("sizes")))
    op = lambda i: F.struct(i.alias("at"), F.get("words", i).alias("w"), F.get("sizes", i).alias("size"), F.substring("body", i * 2 + 3, F.get("sizes", i) * 2 - 2).alias("data"))
    ops = rows.select("image_id", "width", "height", "colours", F.explode(F.transform("at", op)).alias("o")).select("image_id", "width", "height", "colours", "o.*")
    hi, lo = F.shiftright("w", 8), F.col("w") % 256
    ops = ops.withColumns({"hi": hi, "lo": lo})
    absolute, delta = F.expr("hi = 0 and lo > 2"), F.expr("hi = 0 and lo = 2")
    nibble = lambda b, j: F.when(j % 2 == 0, F.shiftright(b, 4)).otherwise(b % 16)
    count = F.when(F.col("hi") > 0, F.col("hi")).when(absolute, F.col("lo")).otherwise(0)
    places = F.sequence(F.lit(0), F.col("n") - 1)
    repeated = F.transform(places, lambda j: nibble(F.col("lo"), j)) if four else F.array_repeat("lo", F.col("n"))
    copied = F.transform(places, lambda j: nibble(_byte(F.col("data"), F.floor(j / 2)), j) if four else _byte(F.col("data"), j))
    ops = ops.withColumn("n", count).withColumn("values", F.when(F.col("hi") > 0, repeated).when(absolute, copied).otherwise(F.array().cast("array<int>")))
    dx, dy = (F.when(delta, F.coalesce(_byte(F.col("data"), F.lit(k)), F.lit(0))).otherwise(0) for k in (0, 1))
    before = Window.partitionBy("image_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    ops = ops.withColumns({"dx": dx, "dy": dy, "ends": (F.col("w") == 1).cast("int"), "line": so_far((F.col("w") == 0).cast("int"), before)})
    within = Window.partitionBy("image_id", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ops = ops.withColumns({"ended": so_far("ends", before), "y": F.col("line") + so_far("dy", before), "x": so_far(F.col("n") + F.col("dx"), within)})
    ops = ops.filter((F.col("ended") == 0) & (F.col("y") < F.abs("height")))
    room = F.col("width") - F.col("x")
    odd = F.array_position(F.transform("values", lambda v: v >= F.col("colours")), F.lit(True)) - 1
    error = (
        F.when(F.length("data") < F.col("size") * 2 - 2, BAD_STREAM)
        .when(delta & ((F.col("x") + F.col("dx") > F.col("width")) | (F.col("y") + F.col("dy") >= F.abs("height"))), BAD_BOUNDS)
        .when((odd >= 0) & (odd < room), BAD_INDEX)
        .when(F.col("n") > room, BAD_BOUNDS)
    )
    return ops.select("image_id", "at", "y", "x", "values", F.when(F.col("height") < 0, F.col("y")).otherwise(F.col("height") - 1 - F.col("y")).alias("row"), error.alias("error"))


def stream_errors(ops: DataFrame) -> DataFrame:
    """(image_id, error): the first error of each stream, null without any. Streams without an opcode have no row."""
    return ops.groupBy("image_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("error"))


def stream_pixels(ops: DataFrame) -> DataFrame:
    """(image_id, y, x, index) that streams without an error write; what they skip is absent."""
    bad = F.max(F.col("error").isNotNull()).over(Window.partitionBy("image_id"))
    good = ops.withColumn("bad", bad).filter("not bad")
    out = good.select("image_id", F.col("row").cast("int").alias("y"), "x", F.posexplode("values").alias("k", "index"))
    return out.select("image_id", "y", (F.col("x") + F.col("k")).cast("int").alias("x"), "index")
