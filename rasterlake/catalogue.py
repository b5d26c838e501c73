"""Registered raster queries and their SQL oracles.

Every query returns plain numbers and strings. Oracles derive the same rasters in SQL and do the arithmetic there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake import rasters
from rasterlake.functions import imaging as im
from rasterlake.functions import measures, steg, wu
from rasterlake.operators import blocks, convolve, geometry, payload, point, quantize, rle, stats, tiles
from rasterlake.plans import checkpoints
from rasterlake.plans import pipeline as pl
from rasterlake.sources import dib

EMB = """emb AS (SELECT image_id, p // 8 AS y, p % 8 AS x, v(e, 4 * p) AS r, v(e, 4 * p + 1) AS g, v(e, 4 * p + 2) AS b, v(e, 4 * p + 3) AS a
FROM (SELECT vec_id AS image_id, embedding AS e FROM embeddings), range(16) t(p))"""
for _k in range(3, -1, -1):
    EMB = EMB.replace(f"v(e, 4 * p{f' + {_k}' if _k else ''})", f"(floor(abs(e[4 * p + {_k + 1}]::DOUBLE) * 10000)::BIGINT % 256)")
EVT = """evt AS (SELECT event_id // 128 AS image_id, (event_id % 128) // 16 AS y, event_id % 16 AS x, v % 256 AS r, (v // 256) % 256 AS g,
(user_id * 37) % 256 AS b, 255 AS a FROM (SELECT event_id, user_id, round(value * 100)::BIGINT AS v FROM events
UNION ALL SELECT last + k, 0, 0 FROM (SELECT max(event_id) AS last FROM events), range(1, 128) t(k) WHERE (last + k) // 128 = last // 128))"""
LI = """li AS (SELECT l_orderkey, l_linenumber, l_quantity::INT * 5 AS r, round(l_discount * 100)::INT * 25 AS g, round(l_tax * 100)::INT * 30 AS b,
255 AS a FROM lineitem)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = point.grayscale(rasters.embedding_pixels(spark, sf_dir))
    return gray.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("r").cast("long").alias("luma_sum"))


def summed(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of rows by all values: an order-free digest that a SQL GROUP BY gives too."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


EMB_P = rasters.embedding_pixels
EVT_P = rasters.event_pixels
COLS = ("image_id", "y", "x", "r", "g", "b", "a")
PX = "image_id, y, x, r, g, b, a"

# ---- point operators ----------------------------------------------------------------------------------------------------------

GRAY = "floor(((0.299::FLOAT * {r}::FLOAT + 0.587::FLOAT * {g}::FLOAT) + 0.114::FLOAT * {b}::FLOAT)::DOUBLE + 0.5)::INT"
_row = lambda p, q, s: f"least(255, floor((({p}::FLOAT * r::FLOAT + {q}::FLOAT * g::FLOAT) + {s}::FLOAT * b::FLOAT)::DOUBLE + 0.5)::INT)"
_clamp = lambda e: f"greatest(0, least(255, {e}))"
_factor = float(im.contrast_factor(64))


def _contrast_sql(c: str) -> str:
    v = f"({_factor!r}::FLOAT * ({c}::FLOAT - 128::FLOAT) + 128::FLOAT)::DOUBLE"
    return _clamp(f"(CASE WHEN {v} >= 0 THEN floor({v} + 0.5) ELSE ceil({v} - 0.5) END)::INT")


_all = lambda f: {c: f(c) for c in "rgb"}
POINT = {
    "invert": (point.invert, _all(lambda c: f"255 - {c}")),
    "grayscale": (point.grayscale, _all(lambda c: GRAY.format(r="r", g="g", b="b"))),
    "sepia": (point.sepia, {c: _row(*w) for c, w in zip("rgb", im.SEPIA, strict=True)}),
    "brightness": (lambda d: point.brightness(d, 40), _all(lambda c: _clamp(f"{c} + 40"))),
    "contrast": (lambda d: point.contrast(d, 64), _all(_contrast_sql)),
    "chain": (
        lambda d: point.grayscale(point.brightness(point.invert(d), 10)),
        _all(lambda c: GRAY.format(**{k: f"least(255, 265 - {k})" for k in "rgb"})),
    ),
}
for _name, (_op, _sql) in POINT.items():
    _new = ", ".join(f"{e} AS {c}" for c, e in _sql.items())
    register(f"pt_{_name}", lambda s, d, f=_op: f(EMB_P(s, d)).select(*COLS), f"WITH {EMB} SELECT image_id, y, x, {_new}, a FROM emb")
    register(
        f"pt_{_name}_lineitem",
        lambda s, d, f=_op: summed(f(rasters.lineitem_pixels(s, d)), "r", "g", "b"),
        f"WITH {LI}, o AS (SELECT {_new} FROM li) SELECT r, g, b, count(*) AS n FROM o GROUP BY r, g, b",
    )
register(
    "flagship_luma", flagship,
    f"WITH {EMB} SELECT image_id, count(*) AS pixels, sum({GRAY.format(r='r', g='g', b='b')})::BIGINT AS luma_sum FROM emb GROUP BY image_id",
)

# ---- geometry -----------------------------------------------------------------------------------------------------------------

MOVES = {
    "mirror_h": (geometry.mirror_horizontal, "y", "7 - x"),
    "mirror_v": (geometry.mirror_vertical, "1 - y", "x"),
    "rotate_left": (geometry.rotate_left, "7 - x", "y"),
    "rotate_right": (geometry.rotate_right, "x", "1 - y"),
}
for _name, (_op, _y, _x) in MOVES.items():
    register(
        f"geo_{_name}", lambda s, d, f=_op: f(EMB_P(s, d)).select(*COLS),
        f"WITH {EMB} SELECT image_id, {_y} AS y, {_x} AS x, r, g, b, a FROM emb",
    )
register(
    "geo_crop", lambda s, d: geometry.crop(EVT_P(s, d), 3, 2, 9, 4).select(*COLS),
    f"WITH {EVT} SELECT image_id, y - 2 AS y, x - 3 AS x, r, g, b, a FROM evt WHERE x BETWEEN 3 AND 11 AND y BETWEEN 2 AND 5",
)
_shift_sql = """WITH {emb}, i AS (SELECT DISTINCT image_id FROM emb)
SELECT i.image_id, gy AS y, gx AS x, coalesce(r, 9) AS r, coalesce(g, 8) AS g, coalesce(b, 7) AS b, coalesce(a, 6) AS a
FROM i CROSS JOIN range({h}) t(gy) CROSS JOIN range({w}) u(gx) LEFT JOIN emb ON emb.image_id = i.image_id AND emb.y + {top} = gy AND emb.x + {left} = gx"""
for _name, _expand, (_w, _h, _left, _top) in (("crop", False, (8, 2, -3, 1)), ("expand", True, (11, 3, 0, 1))):
    register(
        f"geo_translate_{_name}", lambda s, d, e=_expand: geometry.translate(EMB_P(s, d), -3, 1, e, (9, 8, 7, 6)).select(*COLS),
        _shift_sql.format(emb=EMB, w=_w, h=_h, left=_left, top=_top),
    )


def wide(make: Callable[[], pl.Transform], pixels=EMB_P) -> Callable[[SparkSession, str], DataFrame]:
    """The transform applied to assembled images, as pixels."""
    return lambda s, d: rasters.explode_pixels(pl.Pipeline((make(),)).apply(rasters.assemble(pixels(s, d)))).select(*COLS)


def _gather(w: int, h: int, sx: str, sy: str, src: str = "emb", cte: str = EMB, sw: int = 8, sh: int = 2) -> str:
    """Nearest sampling at float expressions sx, sy of the target's gx, gy; outside by over 1e-3 is transparent black."""
    f = "::FLOAT"
    return f"""WITH {cte}, i AS (SELECT DISTINCT image_id FROM {src}),
q AS (SELECT gy, gx, ({sx}){f} AS sx, ({sy}){f} AS sy FROM range({h}) t(gy) CROSS JOIN range({w}) u(gx)),
n AS (SELECT gy, gx, sx < -0.001{f} OR sy < -0.001{f} OR sx > {sw - 1}{f} + 0.001{f} OR sy > {sh - 1}{f} + 0.001{f} AS off,
 least({sw - 1}, trunc(greatest(0{f}, least({sw - 1}{f}, sx)) + 0.5{f})::INT) AS nx,
 least({sh - 1}, trunc(greatest(0{f}, least({sh - 1}{f}, sy)) + 0.5{f})::INT) AS ny FROM q)
SELECT i.image_id, gy AS y, gx AS x, CASE WHEN off THEN 0 ELSE r END AS r, CASE WHEN off THEN 0 ELSE g END AS g,
 CASE WHEN off THEN 0 ELSE b END AS b, CASE WHEN off THEN 0 ELSE a END AS a
FROM i CROSS JOIN n JOIN {src} s ON s.image_id = i.image_id AND s.x = nx AND s.y = ny"""


def _scaled(v: str, n: int, m: int) -> str:
    scale = float(np.float32(n) / np.float32(m))
    return f"greatest(0::FLOAT, least({n - 1}::FLOAT, ({v}::FLOAT + 0.5::FLOAT) * {scale!r}::FLOAT - 0.5::FLOAT))"


register("geo_resize_nearest", wide(lambda: pl.Resize(5, 3, "nearest")), _gather(5, 3, _scaled("gx", 8, 5), _scaled("gy", 2, 3)))
_blend = lambda c: f"""greatest(0, least(255, trunc(
 ((p00.{c}::FLOAT * (1::FLOAT - tx) + p10.{c}::FLOAT * tx) * (1::FLOAT - ty) + (p01.{c}::FLOAT * (1::FLOAT - tx) + p11.{c}::FLOAT * tx) * ty) + 0.5::FLOAT)::INT)) AS {c}"""  # noqa: E731
register(
    "geo_resize_bilinear", wide(lambda: pl.Resize(5, 3, "bilinear")),
    f"""WITH {EMB}, q AS (SELECT gy, gx, {_scaled("gx", 8, 5)} AS sx, {_scaled("gy", 2, 3)} AS sy FROM range(3) t(gy) CROSS JOIN range(5) u(gx)),
n AS (SELECT gy, gx, floor(sx)::INT AS x0, floor(sy)::INT AS y0, (sx - floor(sx))::FLOAT AS tx, (sy - floor(sy))::FLOAT AS ty FROM q)
SELECT p00.image_id, gy AS y, gx AS x, {", ".join(_blend(c) for c in "rgba")} FROM n
JOIN emb p00 ON p00.x = x0 AND p00.y = y0
JOIN emb p10 ON p10.image_id = p00.image_id AND p10.x = least(7, x0 + 1) AND p10.y = y0
JOIN emb p01 ON p01.image_id = p00.image_id AND p01.x = x0 AND p01.y = least(1, y0 + 1)
JOIN emb p11 ON p11.image_id = p00.image_id AND p11.x = least(7, x0 + 1) AND p11.y = least(1, y0 + 1)""",
)
_sin, _cos = (float(v) for v in im.rotation(300))
_dx, _dy = "(gx::FLOAT - 7.5::FLOAT)", "(gy::FLOAT - 3.5::FLOAT)"
register(
    "geo_rotate_any_nearest", wide(lambda: pl.RotateAny(300, "nearest"), EVT_P),
    _gather(16, 8, f"{_dx} * {_cos!r}::FLOAT + {_dy} * {_sin!r}::FLOAT + 7.5::FLOAT", f"-{_dx} * {_sin!r}::FLOAT + {_dy} * {_cos!r}::FLOAT + 3.5::FLOAT", "evt", EVT, 16, 8),
)
_det = 1.0 / (1.0 - 0.25 * 0.125)
register(
    "geo_skew_nearest", wide(lambda: pl.Skew(250, 125, "nearest"), EVT_P),
    _gather(16, 8, f"((gx - 7.5::DOUBLE) - 0.25::DOUBLE * (gy - 3.5::DOUBLE)) * {_det!r}::DOUBLE + 7.5::DOUBLE", f"((gy - 3.5::DOUBLE) - 0.125::DOUBLE * (gx - 7.5::DOUBLE)) * {_det!r}::DOUBLE + 3.5::DOUBLE", "evt", EVT, 16, 8),
)


def _sampled(how: str, w: int, h: int, sx: str, sy: str, cte: str = EMB, src: str = "emb", sw: int = 8, sh: int = 2, outside: bool = True) -> str:
    """Bilinear or bicubic sampling at float expressions sx, sy of the target's gx, gy, term by term in single precision."""
    f = "::FLOAT"
    lists = ", ".join(f"list({c} ORDER BY y, x) AS l{c}" for c in "rgba")
    tap = lambda c, i, j: f"l{c}[greatest(0, least({sh - 1}, y0 + ({j}))) * {sw} + greatest(0, least({sw - 1}, x0 + ({i}))) + 1]{f}"
    if how == "bilinear":
        more = ""
        value = lambda c: f"((({tap(c, 0, 0)} * (1{f} - tx)) + {tap(c, 1, 0)} * tx) * (1{f} - ty) + (({tap(c, 0, 1)} * (1{f} - tx)) + {tap(c, 1, 1)} * tx) * ty)"
    else:
        near = f"((1.5{f} * v * v * v - 2.5{f} * v * v) + 1{f})"
        far = f"(((-0.5{f} * v * v * v - -2.5{f} * v * v) + -4{f} * v) - -2{f})"
        weight = lambda v: f"(CASE WHEN {v} <= 1{f} THEN {near.replace('v', v)} WHEN {v} < 2{f} THEN {far.replace('v', v)} ELSE 0{f} END){f}"
        at = lambda t: (f"(1{f} + {t}){f}", t, f"(1{f} - {t}){f}", f"(2{f} - {t}){f}")
        more = ", " + ", ".join(f"{weight(v)} AS w{axis}{k}" for axis in "xy" for k, v in enumerate(at(f"t{axis}")))

        def value(c: str) -> str:
            out = f"0{f}"
            for j in range(4):
                for i in range(4):
                    out = f"({out} + {tap(c, i - 1, j - 1)} * (wx{i} * wy{j}))"
            return out

    stored = lambda c: f"CASE WHEN off THEN 0 ELSE greatest(0, least(255, trunc({value(c)} + 0.5{f})))::INT END AS {c}"
    off = f"sx < -0.001{f} OR sy < -0.001{f} OR sx > {sw - 1}{f} + 0.001{f} OR sy > {sh - 1}{f} + 0.001{f}" if outside else "false"
    return f"""WITH {cte}, i AS (SELECT image_id, {lists} FROM {src} GROUP BY image_id),
q AS (SELECT gy, gx, ({sx}){f} AS sx, ({sy}){f} AS sy FROM range({h}) t(gy) CROSS JOIN range({w}) u(gx)),
m AS (SELECT gy, gx, {off} AS off, greatest(0{f}, least({sw - 1}{f}, sx)) AS vx, greatest(0{f}, least({sh - 1}{f}, sy)) AS vy FROM q),
n AS (SELECT *, floor(vx)::INT AS x0, floor(vy)::INT AS y0, (vx - floor(vx)){f} AS tx, (vy - floor(vy)){f} AS ty FROM m),
k AS (SELECT *{more} FROM n)
SELECT image_id, gy AS y, gx AS x, {", ".join(stored(c) for c in "rgba")} FROM i CROSS JOIN k"""


def _turned(tenths: int, w: int = 8, h: int = 2) -> tuple[str, str]:
    """Source coordinates of a turn that keeps the size; sine and cosine by DuckDB from the angle in single precision."""
    angle = f"({tenths}::FLOAT / 10::FLOAT * (pi()::FLOAT / 180::FLOAT)::FLOAT)::FLOAT::DOUBLE"
    s, c = f"sin({angle})::FLOAT", f"cos({angle})::FLOAT"
    dx, dy = f"(gx::FLOAT - {(w - 1) / 2}::FLOAT)", f"(gy::FLOAT - {(h - 1) / 2}::FLOAT)"
    return f"({dx} * {c} + {dy} * {s}) + {(w - 1) / 2}::FLOAT", f"((-{dx}) * {s} + {dy} * {c}) + {(h - 1) / 2}::FLOAT"


def _skewed(x_milli: int, y_milli: int, w: int = 8, h: int = 2) -> tuple[str, str]:
    kx, ky = f"({x_milli}::DOUBLE / 1000)", f"({y_milli}::DOUBLE / 1000)"
    dx, dy, det = f"(gx - {(w - 1) / 2}::DOUBLE)", f"(gy - {(h - 1) / 2}::DOUBLE)", f"(1::DOUBLE / (1 - {kx} * {ky}))"
    return f"({dx} - {kx} * {dy}) * {det} + {(w - 1) / 2}::DOUBLE", f"({dy} - {ky} * {dx}) * {det} + {(h - 1) / 2}::DOUBLE"


register("geo_resize_bicubic", wide(lambda: pl.Resize(13, 7, "bicubic")), _sampled("bicubic", 13, 7, _scaled("gx", 8, 13), _scaled("gy", 2, 7), outside=False))
for _how in ("bilinear", "bicubic"):
    for _n, _tenths in enumerate((-125, 450, 1234)):
        _name = f"geo_rotate_any_{_how}" + ("" if not _n else f"_{_n}")
        register(_name, wide(lambda t=_tenths, h=_how: pl.RotateAny(t, h), EVT_P), _sampled(_how, 16, 8, *_turned(_tenths, 16, 8), EVT, "evt", 16, 8))
    for _n, (_kx, _ky) in enumerate(((-300, 100), (200, 0))):
        _name = f"geo_skew_{_how}" + ("" if not _n else f"_{_n}")
        register(_name, wide(lambda x=_kx, y=_ky, h=_how: pl.Skew(x, y, h), EVT_P), _sampled(_how, 16, 8, *_skewed(_kx, _ky, 16, 8), EVT, "evt", 16, 8))
register("geo_rotate_any_snap", wide(lambda: pl.RotateAny(900, "bilinear", True)), f"WITH {EMB} SELECT image_id, 7 - x AS y, y AS x, r, g, b, a FROM emb")



def tiled(make: Callable[[DataFrame, int], DataFrame], pixels=EVT_P, side: int = 5) -> Callable[[SparkSession, str], DataFrame]:
    """The transform on tiles of a small side, so that every image has several."""
    return lambda s, d: tiles.block_pixels(make(tiles.cut_images(rasters.assemble(pixels(s, d)), side), side))


# The same SQL as for whole images.
register("geo_resize_bicubic_tiles", tiled(lambda t, n: tiles.resize(t, 13, 7, "bicubic", n), EMB_P, 3), ORACLES["geo_resize_bicubic"])
register("geo_resize_nearest_tiles", tiled(lambda t, n: tiles.resize(t, 5, 3, "nearest", n), EMB_P, 3), ORACLES["geo_resize_nearest"])
register("geo_rotate_any_bilinear_tiles", tiled(lambda t, n: tiles.rotate_any(t, 450, "bilinear", side=n)), ORACLES["geo_rotate_any_bilinear_1"])
register("geo_rotate_any_snap_tiles", tiled(lambda t, n: tiles.rotate_any(t, 900, "bilinear", True, n), EMB_P, 3), ORACLES["geo_rotate_any_snap"])
register("geo_skew_bicubic_tiles", tiled(lambda t, n: tiles.skew(t, -300, 100, "bicubic", side=n)), ORACLES["geo_skew_bicubic"])

# ---- sizes and rectangles ------------------------------------------------------------------------------------------------------

_INTS = "l_orderkey, l_linenumber, l_quantity::INT AS q, (l_partkey % 4000 + 1)::INT AS p, (l_suppkey % 3000 + 1)::INT AS s"


def line_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 4000 + 1).cast("int").alias("p"), (F.col("l_suppkey") % 3000 + 1).cast("int").alias("s"))


def size_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("q").cast("long") * F.col("p") * F.pow(F.lit(37), F.col("l_linenumber")).cast("long")
    return line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", measures.byte_text(n).alias("bytes"))


_unit = lambda k, u: f"WHEN n >= {1 << 10 * k} THEN format('{{:,}}', n) || ' B (' || (n // {1 << 10 * k}) || '.' || lpad((((n % {1 << 10 * k}) * 100) // {1 << 10 * k})::VARCHAR, 2, '0') || ' {u})'"
register(
    "inspect_bytes", size_bytes,
    f"""WITH t AS (SELECT {_INTS} FROM lineitem), u AS (SELECT l_orderkey, l_linenumber, q::BIGINT * p * pow(37, l_linenumber)::BIGINT AS n FROM t)
SELECT l_orderkey, l_linenumber, CASE {_unit(4, "TiB")} {_unit(3, "GiB")} {_unit(2, "MiB")} {_unit(1, "KiB")} ELSE format('{{:,}}', n) || ' B' END AS bytes FROM u""",
)
_side = "greatest(1, floor((q::FLOAT * (p::FLOAT / s::FLOAT)::FLOAT)::FLOAT::DOUBLE + 0.5))::BIGINT"
register(
    "geo_scaled_sizes",
    lambda s, d: line_ints(s, d).select(
        "l_orderkey", "l_linenumber", measures.scaled_side(F.col("q"), F.col("p"), F.col("s")).alias("side"),
        measures.scaled_by(F.col("p"), F.lit(0.37)).alias("scaled"), measures.resize_gate(F.col("q"), F.col("s"), F.col("s"), F.col("p") * 10, True).alias("gate"),
    ).select("l_orderkey", "l_linenumber", "side", "scaled", F.col("gate.height").alias("height"), F.col("gate.error").alias("error")),
    f"""WITH t AS (SELECT {_INTS} FROM lineitem), u AS (SELECT *, greatest(1, floor((q::FLOAT * ((p * 10)::FLOAT / s::FLOAT)::FLOAT)::FLOAT::DOUBLE + 0.5))::BIGINT AS height FROM t)
SELECT l_orderkey, l_linenumber, {_side} AS side, greatest(1, floor((p::FLOAT * 0.37::FLOAT)::FLOAT::DOUBLE + 0.5))::BIGINT AS scaled, height,
CASE WHEN height > 16384 THEN 'too large' END AS error FROM u""",
)
register(
    "geo_crop_rect",
    lambda s, d: line_ints(s, d).select("l_orderkey", "l_linenumber", measures.crop_rect(F.col("q") * 9, F.col("q"), F.col("p"), F.col("s"), F.lit(400), F.lit(900)).alias("c")).select("l_orderkey", "l_linenumber", "c.*"),
    f"""WITH t AS (SELECT {_INTS} FROM lineitem), u AS (SELECT *, least(greatest(p, 1), 400) AS width, least(greatest(s, 1), 900) AS height FROM t)
SELECT l_orderkey, l_linenumber, greatest(0, least(400 - width, least(q * 9, 399) - width // 2)) AS x, greatest(0, least(900 - height, least(q, 899) - height // 2)) AS y, width, height FROM u""",
)
DRAGS = {"move": ("move", "move"), "left": ("low", "none"), "top": ("none", "low"), "low_right": ("high", "high"), "top_right": ("high", "low")}


def crop_drags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles dragged by several handles, in an image of 400 by 900."""
    c = lambda e: F.expr(f"cast({e} as long)")
    rect = c("q * 7"), c("s % 880"), c("p % 90 + 1"), c("q % 20 + 1"), c("p % 901 - 450"), c("s % 401 - 200")
    out = None
    for name, edges in DRAGS.items():
        one = line_ints(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lit(name).alias("handle"), measures.dragged_rect(*rect, 400, 900, *edges).alias("c"))
        out = one if out is None else out.unionByName(one)
    return out.select("l_orderkey", "l_linenumber", "handle", "c.*")


def _drag_sql(at: str, size: str, by: str, most: int, edge: int) -> str:
    low = {"move": f"{at} + {by}", "low": f"{at} + {by}", "high": at, "none": at}
    long = {"move": size, "low": f"{size} - {by}", "high": f"{size} + {by}", "none": size}
    name = "across" if edge == 0 else "down"
    case = lambda d: "CASE " + name + "".join(f" WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
    return f"greatest(0, least({most - 1}, {case(low)})) AS a{edge}, least({most}, greatest(1, {case(long)})) AS n{edge}"


_handles = ", ".join(f"('{k}', '{a}', '{d}')" for k, (a, d) in DRAGS.items())
_back = lambda k, most, name: f"CASE WHEN a{k} + n{k} > {most} AND {name} IN ('move', 'low') THEN {most} - n{k} ELSE a{k} END"
_kept = lambda k, most, name: f"CASE WHEN a{k} + n{k} > {most} AND {name} IN ('high', 'none') THEN {most} - a{k} ELSE n{k} END"
register(
    "geo_crop_drag", crop_drags,
    f"""WITH t AS (SELECT {_INTS} FROM lineitem), v(handle, across, down) AS (VALUES {_handles}),
u AS (SELECT l_orderkey, l_linenumber, handle, across, down, {_drag_sql("q * 7", "(p % 90 + 1)", "(p % 901 - 450)", 400, 0)}, {_drag_sql("s % 880", "(q % 20 + 1)", "(s % 401 - 200)", 900, 1)} FROM t, v)
SELECT l_orderkey, l_linenumber, handle, {_back(0, 400, "across")} AS x, {_back(1, 900, "down")} AS y, {_kept(0, 400, "across")} AS width, {_kept(1, 900, "down")} AS height FROM u""",
)
_ten = lambda v, most: f"greatest(-{most}, least({most}, round(({v}::FLOAT * 10::FLOAT)::FLOAT::DOUBLE)))::BIGINT"
register(
    "input_ranges",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", measures.angle_tenths((F.col("l_extendedprice").cast("double") / 8 - 3000)).alias("tenths"),
        measures.skew_milli(F.col("l_extendedprice").cast("double") / 64 - 120).alias("milli"), measures.tone_shift((F.col("l_partkey") % 700 - 350)).alias("shift"),
    ),
    f"""SELECT l_orderkey, l_linenumber, {_ten("(l_extendedprice::DOUBLE / 8 - 3000)", 36000)} AS tenths, {_ten("(l_extendedprice::DOUBLE / 64 - 120)", 1000)} AS milli,
greatest(-255, least(255, l_partkey % 700 - 350)) AS shift FROM lineitem""",
)
_fixed = lambda v, b: f"floor({v} * {1 << b} + 0.5)"
register(
    "parse_fixed_point",
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.element_at("embedding", 1).cast("double") * 8).alias("v")).select(
        "vec_id", measures.to_fixed(F.col("v"), 30).alias("raw30"), measures.to_fixed_clamped(F.col("v"), 30).alias("near30"),
        measures.to_fixed(F.col("v"), 16).alias("raw16"), measures.from_fixed(measures.to_fixed_clamped(F.col("v"), 16), 16).alias("back16"),
    ),
    f"""WITH t AS (SELECT vec_id, embedding[1]::DOUBLE * 8 AS v FROM embeddings),
u AS (SELECT vec_id, CASE WHEN v >= 0 THEN {_fixed("v", 30)} ELSE -{_fixed("(-v)", 30)} END AS a, CASE WHEN v >= 0 THEN {_fixed("v", 16)} ELSE -{_fixed("(-v)", 16)} END AS b FROM t)
SELECT vec_id, CASE WHEN a BETWEEN 0 AND 4294967295 THEN a::BIGINT END AS raw30, greatest(0, least(4294967295, a))::BIGINT AS near30,
CASE WHEN b BETWEEN 0 AND 4294967295 THEN b::BIGINT END AS raw16, greatest(0, least(4294967295, b)) / 65536 AS back16 FROM u""",
)

# ---- convolution --------------------------------------------------------------------------------------------------------------


def _conv_sql(k: convolve.Kernel) -> str:
    h = k.size // 2
    taps = ", ".join(f"({j - h}, {i - h}, {k.weights[j * k.size + i]})" for j in range(k.size) for i in range(k.size))
    out = ", ".join(f"greatest(0, least(255, (sum(w * s.{c})::BIGINT // {k.divisor}) + {k.bias})) AS {c}" for c in "rgb")
    return f"""WITH {EVT}, k(dy, dx, w) AS (VALUES {taps})
SELECT t.image_id, t.y, t.x, {out}, t.a FROM evt t CROSS JOIN k
JOIN evt s ON s.image_id = t.image_id AND s.y = greatest(0, least(7, t.y + dy)) AND s.x = greatest(0, least(15, t.x + dx))
GROUP BY t.image_id, t.y, t.x, t.a"""


KERNELS = {name: convolve.preset(name) for name in ("blur", "sharpen", "edge", "emboss")} | {
    "blur5": convolve.preset("blur", 5),
    "custom5": convolve.Kernel(tuple((7 * i * i + 3 * i) % 11 - 5 for i in range(25)), 5, 3, 7),
}
for _name, _k in KERNELS.items():
    register(f"conv_{_name}", lambda s, d, k=_k: convolve.convolve(EVT_P(s, d), k).select(*COLS), _conv_sql(_k))
    register(f"conv_{_name}_images", wide(lambda k=_k: pl.ConvolutionCustom(k), EVT_P), _conv_sql(_k))

for _name in ("custom5", "blur5", "edge"):
    if _name in KERNELS:
        register(f"conv_{_name}_tiles", lambda s, d, k=KERNELS[_name]: convolve.convolve(EVT_P(s, d), k, tile=5).select(*COLS), ORACLES[f"conv_{_name}"])

# ---- aggregates and checks ----------------------------------------------------------------------------------------------------

HIST = """h AS (SELECT image_id, (r >> 3) + 1 AS cr, (g >> 3) + 1 AS cg, (b >> 3) + 1 AS cb, count(*) AS n, sum(r)::BIGINT AS sr, sum(g)::BIGINT AS sg,
sum(b)::BIGINT AS sb, sum(r * r + g * g + b * b)::BIGINT AS sq FROM evt GROUP BY ALL)"""
register("agg_histogram", lambda s, d: stats.histogram(EVT_P(s, d)), f"WITH {EVT}, {HIST} SELECT * FROM h")
register(
    "agg_summed_volume", lambda s, d: stats.summed_volume(stats.histogram(EMB_P(s, d))),
    f"""WITH {EMB}, {HIST.replace("FROM evt", "FROM emb")}, gr AS (SELECT DISTINCT image_id, cr FROM h), gg AS (SELECT DISTINCT image_id, cg FROM h),
gb AS (SELECT DISTINCT image_id, cb FROM h), grid AS (SELECT * FROM gr JOIN gg USING (image_id) JOIN gb USING (image_id))
SELECT grid.image_id, grid.cr, grid.cg, grid.cb, sum(h.n)::BIGINT AS volume FROM grid JOIN h ON h.image_id = grid.image_id AND h.cr <= grid.cr
AND h.cg <= grid.cg AND h.cb <= grid.cb GROUP BY ALL UNION ALL
SELECT image_id, cr, cg, cb, 0 FROM grid WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.image_id = grid.image_id AND h.cr <= grid.cr AND h.cg <= grid.cg AND h.cb <= grid.cb)""",
)
_colors = "count(DISTINCT (r, g, b)) AS colors, max((a < 255)::INT) AS transparent"
register("agg_distinct_colors", lambda s, d: stats.color_counts(EVT_P(s, d)), f"WITH {EVT} SELECT image_id, {_colors} FROM evt GROUP BY image_id")
register("agg_transparency", lambda s, d: stats.color_counts(EMB_P(s, d)), f"WITH {EMB} SELECT image_id, {_colors} FROM emb GROUP BY image_id")


def _grid_sql(c: str, top: int, rounded: bool) -> str:
    back = f"((({c} * {top} + 127) // 255) * 255 + {top // 2 if rounded else 0}) // {top}"
    return f"{back} = {c}"


for _bits in (5, 6):
    for _round in (True, False):
        _ok = " AND ".join(_grid_sql(c, (1 << _bits) - 1 if c == "g" else 31, _round) for c in "rgb")
        register(
            f"chk_grid5{_bits}5" + ("" if _round else "_codec"), lambda s, d, b=_bits, r=_round: stats.grid_exact(EMB_P(s, d), b, r),
            f"WITH {EMB} SELECT image_id, min(({_ok})::INT) AS exact FROM emb GROUP BY image_id",
        )
register(
    "chk_save_warnings", lambda s, d: stats.save_warnings(EMB_P(s, d), "rgb4"),
    f"""WITH {EMB} SELECT image_id, concat_ws(',', CASE WHEN max((a < 255)::INT) = 1 THEN 'transparency' END,
CASE WHEN count(DISTINCT (r, g, b)) > 16 THEN 'colors' END) AS warnings FROM emb GROUP BY image_id""",
)
register(
    "rle_runs", lambda s, d: stats.runs(EVT_P(s, d), "g"),
    f"""WITH {EVT}, n AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, g ORDER BY x) AS k FROM evt)
SELECT image_id, y, min(x) AS x, count(*) AS length, g AS value FROM n GROUP BY image_id, y, g, k""",
)

STRIPS = """ev AS (SELECT event_id, CASE (event_id // 300) % 3 WHEN 0 THEN (event_id // 300) % 11 WHEN 1 THEN round(value * 100)::BIGINT % 256
ELSE round(value * 100)::BIGINT % 3 END AS v FROM events),
strips AS (SELECT event_id // 2048 AS image_id, (event_id % 2048) // 1024 AS y, event_id % 1024 AS x, {v} AS v FROM (SELECT * FROM ev UNION ALL
SELECT last + k, 0 FROM (SELECT max(event_id) AS last FROM ev), range(1, 2048) t(k) WHERE (last + k) // 2048 = last // 2048))"""


def _stream_sql(four: bool) -> str:
    """Streams pixel by pixel: each says what it adds to the bytes of the chunk it lies in."""
    hex2 = lambda v: f"format('{{:02X}}', {v})"
    value, digits = (hex2("v * 17"), "format('{:X}', v)") if four else (hex2("v"), hex2("v"))
    pad = "repeat('0', (4 - m % 4) % 4)" if four else "repeat('00', m % 2)"
    return f"""WITH {STRIPS.format(v="v % 16" if four else "v")}, k AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y, v ORDER BY x) AS k FROM strips),
n AS (SELECT *, count(*) OVER i AS n, min(x) OVER i AS x0 FROM k WINDOW i AS (PARTITION BY image_id, y, v, k)),
s AS (SELECT *, CASE WHEN n >= 3 THEN x0 ELSE coalesce(max(CASE WHEN n >= 3 THEN x END) OVER (PARTITION BY image_id, y ORDER BY x), -1) + 1 END AS s FROM n),
m AS (SELECT *, (x - s) % 255 AS p, count(*) OVER (PARTITION BY image_id, y, s, (x - s) // 255) AS m FROM s),
t AS (SELECT image_id, y, x, CASE WHEN n >= 3 THEN CASE WHEN p = 0 THEN {hex2("m")} || {value} ELSE '' END WHEN m < 3 THEN '01' || {value}
ELSE CASE WHEN p = 0 THEN '00' || {hex2("m")} ELSE '' END || {digits} || CASE WHEN p = m - 1 THEN {pad} ELSE '' END END AS t FROM m),
l AS (SELECT image_id, y, count(*) AS w, string_agg(t, '' ORDER BY x) || CASE WHEN y > 0 THEN '0000' ELSE '0001' END AS t FROM t GROUP BY image_id, y)
SELECT image_id, max(w) AS width, count(*) AS height, string_agg(t, '' ORDER BY y DESC) AS body FROM l GROUP BY image_id"""


def strip_streams(spark: SparkSession, sf_dir: str, four: bool) -> DataFrame:
    strips = rasters.event_strips(spark, sf_dir)
    return rle.encode_streams(strips.withColumn("index", F.col("index") % 16) if four else strips, four)


def strip_pixels(spark: SparkSession, sf_dir: str, four: bool) -> DataFrame:
    streams = strip_streams(spark, sf_dir, four).withColumn("colours", F.lit(16 if four else 256))
    return rle.stream_pixels(rle.place_opcodes(streams, four))


def cut_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with streams without (all of) their end mark, with a palette of two colours, and of narrower images."""
    streams = strip_streams(spark, sf_dir, False)
    short = streams.withColumn("body", F.substring("body", F.lit(1), F.length("body") - F.col("image_id").cast("int") % 2 - 1)).withColumn("colours", F.lit(256))
    odd = streams.withColumn("image_id", -1 - F.col("image_id")).withColumn("colours", F.lit(2))
    narrow = streams.withColumn("image_id", 1_000_000_000 + F.col("image_id")).withColumns({"colours": F.lit(256), "width": F.lit(1000)})
    return rle.stream_errors(rle.place_opcodes(short.unionByName(odd).unionByName(narrow)))


for _four in (False, True):
    _name = "rle4" if _four else "rle8"
    register(f"{_name}_stream", lambda s, d, f=_four: strip_streams(s, d, f).select("image_id", "width", "height", F.hex("body").alias("body")), _stream_sql(_four))
    register(f"{_name}_pixels", lambda s, d, f=_four: strip_pixels(s, d, f), f"WITH {STRIPS.format(v='v % 16' if _four else 'v')} SELECT image_id, y, x, v AS index FROM strips")
register(
    "rle8_errors", cut_streams,
    f"""WITH {STRIPS.format(v="v")}, i AS (SELECT image_id, max(CASE WHEN v > 1 THEN 1 END) AS odd FROM strips GROUP BY image_id)
SELECT image_id, NULL AS error FROM i UNION ALL SELECT -1 - image_id, CASE WHEN odd = 1 THEN 'PaletteIndexOutOfRange' END FROM i
UNION ALL SELECT 1000000000 + image_id, 'RleOutOfBounds' FROM i""",
)

# ---- quantizer ----------------------------------------------------------------------------------------------------------------


def wu_report(spark: SparkSession, sf_dir: str, most: int = 16) -> DataFrame:
    def make(key, w, h, rgba) -> dict:
        palette, index = wu.quantize(np.frombuffer(rgba, np.uint8).reshape(-1, 4)[:, :3], most)
        return {"image_id": key, "pixels": len(index), "palette_ok": int(len(palette) <= most), "index_ok": int(index.max() < len(palette))}

    kinds = pa.schema([("image_id", pa.int64()), *[(c, pa.int64()) for c in ("pixels", "palette_ok", "index_ok")]])
    schema = "image_id long, pixels long, palette_ok long, index_ok long"
    return dib.map_rows(rasters.assemble(EVT_P(spark, sf_dir)), ["image_id", "width", "height", "rgba"], make, schema, kinds)


register("wu_invariants", wu_report, f"WITH {EVT} SELECT image_id, count(*) AS pixels, 1 AS palette_ok, 1 AS index_ok FROM evt GROUP BY image_id")

#: With as many colours as occupied cells, each cell becomes a box, and its colour the mean of its pixels.
_MEANS = """c AS (SELECT *, (r >> 3) AS cr, (g >> 3) AS cg, (b >> 3) AS cb FROM {src}), m AS (SELECT image_id, cr, cg, cb,
(sum(r) + count(*) // 2)::BIGINT // count(*) AS mr, (sum(g) + count(*) // 2)::BIGINT // count(*) AS mg, (sum(b) + count(*) // 2)::BIGINT // count(*) AS mb, count(*) AS n FROM c GROUP BY ALL)"""


def wu_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The palettes of 256 colours, with how many pixels have each."""

    def make(key, w, h, rgba) -> dict:
        palette, index = wu.quantize(np.frombuffer(rgba, np.uint8).reshape(-1, 4)[:, :3], 256)
        return {"image_id": key, "colours": [{"r": int(p[0]), "g": int(p[1]), "b": int(p[2]), "n": int(n)} for p, n in zip(palette, np.bincount(index, minlength=len(palette)), strict=True)]}

    kinds = pa.schema([("image_id", pa.int64()), ("colours", pa.list_(pa.struct([(c, pa.int64()) for c in "rgbn"])))])
    out = dib.map_rows(rasters.assemble(EVT_P(spark, sf_dir)), ["image_id", "width", "height", "rgba"], make, "image_id long, colours array<struct<r: long, g: long, b: long, n: long>>", kinds)
    return out.select("image_id", F.inline("colours"))


register("wu_palette", wu_palette, f"WITH {EVT}, {_MEANS.format(src='evt')} SELECT image_id, mr AS r, mg AS g, mb AS b, n FROM m")



def _wu_sql(src: str, most: int, image: str = "image_id") -> str:
    """Cells of src with the palette entry of the recursive cuts: box by box, on sums over the cells of each box."""
    inside = " AND ".join(f"c{k} > lo{k} AND c{k} <= hi{k}" for k in range(3))
    bounds = [f"{e}{k}" for k in range(3) for e in ("lo", "hi")]
    square = lambda p: f"({p}r::DOUBLE * {p}r::DOUBLE + {p}g::DOUBLE * {p}g::DOUBLE + {p}b::DOUBLE * {p}b::DOUBLE)"
    sums = "sum(n)::BIGINT AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b"
    spread = f"sum(q)::DOUBLE - {square('sum(').replace('(r', '(r)').replace('(g', '(g)').replace('(b', '(b)')} / sum(n)::DOUBLE"
    along = "PARTITION BY image_id, axis"
    running = ", ".join(f"(sum({c}) OVER ({along} ORDER BY k))::BIGINT AS {c}, (sum({c}) OVER ({along}) - sum({c}) OVER ({along} ORDER BY k))::BIGINT AS u{c}" for c in "nrgb")
    part = ", ".join(f"CASE WHEN axis = {k} AND part = 1 THEN cut ELSE lo{k} END AS lo{k}, CASE WHEN axis = {k} AND part = 0 THEN cut ELSE hi{k} END AS hi{k}" for k in range(3))
    return f"""cells AS (SELECT {image} AS image_id, r >> 3 AS c0, g >> 3 AS c1, b >> 3 AS c2, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b,
sum(r * r + g * g + b * b) AS q FROM {src} GROUP BY ALL),
boxes AS (SELECT 0 AS step, image_id, 0 AS box, {", ".join(f"{'-1' if x[0] == 'l' else '31'} AS {x}" for x in bounds)}, {spread} AS var FROM cells GROUP BY image_id
UNION ALL (WITH size AS (SELECT image_id, count(*) AS boxes FROM boxes GROUP BY image_id),
pick AS (SELECT b.*, boxes FROM boxes b JOIN size USING (image_id) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY var DESC, box DESC) = 1),
able AS (SELECT * FROM pick WHERE var > 0 AND boxes < {most}),
axes AS (SELECT a.image_id, axis, CASE axis WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS k, {sums} FROM able a JOIN cells c ON c.image_id = a.image_id AND {inside}, range(3) t(axis) GROUP BY ALL),
cuts AS (SELECT image_id, axis, k, {running} FROM axes),
best AS (SELECT image_id, axis, k AS cut FROM cuts WHERE un > 0 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY {square('')} / n::DOUBLE + {square('u')} / un::DOUBLE DESC, axis, k) = 1),
parts AS (SELECT step + 1 AS step, a.image_id, CASE WHEN part = 1 THEN boxes ELSE box END AS box, {part} FROM able a JOIN best USING (image_id), range(2) t(part))
SELECT step, p.image_id, box, {", ".join(bounds)}, {spread} AS var FROM parts p JOIN cells c ON c.image_id = p.image_id AND {inside} GROUP BY step, p.image_id, box, {", ".join(bounds)}
UNION ALL SELECT b.step + 1, b.image_id, b.box, {", ".join("b." + x for x in bounds)}, CASE WHEN b.box = a.box THEN 0 ELSE b.var END
FROM boxes b JOIN able a ON a.image_id = b.image_id LEFT JOIN best ON best.image_id = b.image_id WHERE b.box <> a.box OR best.image_id IS NULL)),
last AS (SELECT * FROM boxes QUALIFY step = max(step) OVER (PARTITION BY image_id)),
tagged AS (SELECT l.image_id, l.box AS index, c0, c1, c2, n, r, g, b, sum(n) OVER w AS bn, sum(r) OVER w AS br, sum(g) OVER w AS bg, sum(b) OVER w AS bb
FROM last l JOIN cells c ON c.image_id = l.image_id AND {inside} WINDOW w AS (PARTITION BY l.image_id, l.box)),
wu AS (SELECT image_id, index, c0, c1, c2, n, {", ".join(f"((b{c} + bn // 2) // bn)::BIGINT AS p{c}" for c in "rgb")} FROM tagged)"""


def wu_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of each palette entry of 16 colours, from aggregated moments."""
    return quantize.index_pixels(EVT_P(spark, sf_dir), 16).groupBy("image_id", "index", "pr", "pg", "pb").agg(F.count("*").alias("n"), F.sum("r").cast("long").alias("reds"), F.sum(F.col("x") + F.col("y")).cast("long").alias("places"))


register(
    "wu_cuts", wu_indexed,
    f"""WITH RECURSIVE {EVT}, {_wu_sql("evt", 16)} SELECT w.image_id, index, pr, pg, pb, count(*) AS n, sum(e.r)::BIGINT AS reds, sum(x + y)::BIGINT AS places FROM wu w
JOIN evt e ON e.image_id = w.image_id AND e.r >> 3 = c0 AND e.g >> 3 = c1 AND e.b >> 3 = c2 GROUP BY w.image_id, index, pr, pg, pb""",
)
register(
    "wu_collection", lambda s, d: quantize.index_collection(EVT_P(s, d), 32).groupBy("index", "pr", "pg", "pb").agg(F.count("*").alias("n"), F.sum("b").cast("long").alias("blues")),
    f"WITH RECURSIVE {EVT}, {_wu_sql('evt', 32, '0')} SELECT index, pr, pg, pb, sum(n)::BIGINT AS n, sum(b)::BIGINT AS blues FROM (SELECT w.*, t.b FROM wu w JOIN tagged t USING (index, c0, c1, c2)) GROUP BY index, pr, pg, pb",
)
register(
    "wu_lineitem", lambda s, d: summed(quantize.index_collection(rasters.lineitem_pixels(s, d), 8), "index", "pr", "pg", "pb"),
    f"WITH RECURSIVE {LI}, {_wu_sql('li', 8, '0')} SELECT index, pr, pg, pb, sum(n)::BIGINT AS n FROM wu GROUP BY index, pr, pg, pb",
)

# ---- codecs -------------------------------------------------------------------------------------------------------------------


def codec(fmt: str, header: str = "INFO", pixels=EMB_P) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = dib.encode_images(rasters.assemble(pixels(spark, sf_dir)), fmt, header)
        return rasters.explode_pixels(dib.decode_images(files)).select(*COLS)

    return run


for _fmt in ("rgb24", "rgb32", "bitfields32"):
    for _header in dib.HEADERS:
        if dib.compatible(_fmt, _header):
            register(f"codec_{_fmt}_{_header.lower()}", codec(_fmt, _header), f"WITH {EMB} SELECT image_id, y, x, r, g, b, 255 AS a FROM emb")
for _fmt, _green in (("rgb16", 31), ("bitfields16_555", 31), ("bitfields16_565", 63)):
    _new = ", ".join(f"(({c} * {t} + 127) // 255) * 255 // {t} AS {c}" for c, t in zip("rgb", (31, _green, 31), strict=True))
    for _header in ("INFO", "V4", "V5"):
        register(f"codec_{_fmt}_{_header.lower()}", codec(_fmt, _header), f"WITH {EMB} SELECT image_id, y, x, {_new}, 255 AS a FROM emb")


def codec_difference(fmt: str, other: str, header: str = "INFO", other_header: str = "INFO") -> Callable[[SparkSession, str], DataFrame]:
    """Pixels in which two encodings of the same images decode differently."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = codec(fmt, header, EVT_P)(spark, sf_dir), codec(other, other_header, EVT_P)(spark, sf_dir)
        both = a.join(b.select("image_id", "y", "x", *[F.col(c).alias(f"o{c}") for c in "rgba"]), ["image_id", "y", "x"], "full")
        same = F.coalesce(sum((F.col(c) == F.col(f"o{c}")).cast("int") for c in "rgba"), F.lit(0)) == 4
        return both.groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum((~same).cast("long")).alias("different"))

    return run


_none = f"WITH {EVT} SELECT image_id, count(*) AS pixels, 0 AS different FROM evt GROUP BY image_id"
for _name, _args in {
    "rle8_eq_rgb8": ("rle8", "rgb8"), "rle4_eq_rgb4": ("rle4", "rgb4"), "rgb1_core_eq_info": ("rgb1", "rgb1", "CORE"),
    "rgb4_core_eq_v4": ("rgb4", "rgb4", "CORE", "V4"), "rgb8_core_eq_v5": ("rgb8", "rgb8", "CORE", "V5"), "rle8_v4_eq_v5": ("rle8", "rle8", "V4", "V5"),
}.items():
    register(f"codec_{_name}", codec_difference(*_args), _none)


for _fmt, _px, _src, _cte in (("rgb8", EVT_P, "evt", EVT), ("rle8", EVT_P, "evt", EVT), ("rgb4", EMB_P, "emb", EMB), ("rle4", EMB_P, "emb", EMB)):
    for _header in dib.HEADERS:
        if dib.compatible(_fmt, _header):
            register(
                f"codec_{_fmt}_{_header.lower()}", codec(_fmt, _header, _px),
                f"""WITH {_cte}, {_MEANS.format(src=_src)} SELECT c.image_id, y, x, mr AS r, mg AS g, mb AS b, 255 AS a FROM c JOIN m ON m.image_id = c.image_id
AND m.cr = c.cr AND m.cg = c.cg AND m.cb = c.cb""",
            )


def two_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event pixels in black and white."""
    tone = F.when(F.col("r") > 127, 255).otherwise(0)
    return EVT_P(spark, sf_dir).withColumns({c: tone for c in "rgb"})


for _header in dib.HEADERS:
    register(
        f"codec_rgb1_{_header.lower()}", codec("rgb1", _header, two_tone),
        f"WITH {EVT}, t AS (SELECT *, CASE WHEN r > 127 THEN 255 ELSE 0 END AS v FROM evt) SELECT image_id, y, x, v AS r, v AS g, v AS b, a FROM t",
    )


def rle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel bytes of run-length encoded images whose rows are one colour: a run a row, row ends, and the end of the image."""
    flat = EVT_P(spark, sf_dir).withColumns({c: (F.col("y") % 2 * 255).cast("int") for c in "rgb"})
    files = dib.encode_images(rasters.assemble(flat), "rle8")
    parsed = dib.parse_containers(files, "image_id").select("image_id", "pixel_data_offset", F.transform("palette", lambda q: q["red"]).alias("reds"))
    body = F.hex(F.expr("substring(content, cast(pixel_data_offset as int) + 1)"))
    return files.join(parsed, "image_id").select("image_id", body.alias("body"), F.array_join(F.array_sort("reds"), ",").alias("reds"))


_flat_rows = "".join(f"1001{'0001' if k == 7 else '0000'}" if k % 2 == 0 else f"1000{'0001' if k == 7 else '0000'}" for k in range(8))
register("codec_rle8_bytes", rle_bytes, f"WITH {EVT} SELECT DISTINCT image_id, '{_flat_rows}' AS body, '0,255' AS reds FROM evt")


def containers(spark: SparkSession, sf_dir: str, fmt: str, header: str) -> DataFrame:
    return dib.encode_images(rasters.assemble(EMB_P(spark, sf_dir)), fmt, header)


LAYOUT = ("image_id", "variant", "file_size", "pixel_data_offset", "width", "height", "bit_count", "compression", "palette_len", "payload_len", "violation")
for _fmt, _header, _head, _bits, _kind in (("rgb24", "INFO", 40, 24, 0), ("bitfields16_565", "INFO", 52, 16, 3), ("rgb32", "V5", 124, 32, 0), ("rgb24", "CORE", 12, 24, None)):
    _pay = (_bits * 8 + 31) // 32 * 4 * 2
    register(
        f"parse_{_fmt}_{_header.lower()}", lambda s, d, f=_fmt, h=_header: dib.parse_containers(containers(s, d, f, h), "image_id").select(*LAYOUT),
        f"""SELECT vec_id AS image_id, '{_header}' AS variant, {14 + _head + _pay} AS file_size, {14 + _head} AS pixel_data_offset, 8 AS width,
{2 if _header == "CORE" else -2} AS height, {_bits} AS bit_count, {"NULL::BIGINT" if _kind is None else _kind} AS compression, 0 AS palette_len,
{_pay} AS payload_len, NULL::VARCHAR AS violation FROM embeddings""",
    )
register(
    "inspect_report",
    lambda s, d: dib.inspect(dib.parse_containers(containers(s, d, "rgb24", "V4"), "image_id")).select("image_id", "orientation", "compression_name", "decoded_bytes", "file_size_text", "ratio_pct", "ratio_text", F.element_at("gamma_values", 1).alias("gamma_red")),
    "SELECT vec_id AS image_id, 'top-down' AS orientation, 'RGB' AS compression_name, 64 AS decoded_bytes, '170 B' AS file_size_text, 133 AS ratio_pct, '1.33x' AS ratio_text, 0.0::DOUBLE AS gamma_red FROM embeddings",
)

register(
    "parse_palette",
    lambda s, d: dib.parse_containers(dib.encode_images(rasters.assemble(EVT_P(s, d)), "rgb8", "V4"), "image_id").select("image_id", "palette_len", F.inline("palette")),
    f"""WITH {EVT}, {_MEANS.format(src="evt")} SELECT image_id, count(*) OVER (PARTITION BY image_id) AS palette_len, mb AS blue, mg AS green, mr AS red, 0 AS reserved FROM m""",
)

#: Fields overwritten in containers (offset, little-endian bytes) and the rule that each breaks first.
CORRUPTIONS = (
    ("rgb24", "INFO", 0, b"XX", "InvalidFileSignature"),
    ("rgb24", "INFO", 6, b"\1", "InvalidFileReservedData"),
    ("rgb24", "INFO", 26, b"\2", "InvalidPlanes"),
    ("rgb24", "INFO", 30, b"\1", "InvalidCompressionForBpp"),
    ("rgb24", "INFO", 34, b"\7", "UncompressedImageSizeMismatch"),
    ("rgb24", "INFO", 10, b"\x14", "PixelDataLayout.OverlapsMetadata"),
    ("rgb8", "INFO", 57, b"\1", "InvalidRgbQuad"),
    ("rle8", "INFO", 22, b"\xfe\xff\xff\xff", "InvalidCompressionForTopDown"),
    ("bitfields16_565", "INFO", 54, b"\x05", "ColorMask.NonContiguous"),
    ("bitfields16_565", "INFO", 54, b"\x00\x10\0\0\0\x10", "ColorMask.Overlapping"),
    ("bitfields16_565", "INFO", 54, b"\0\0\1\0", "ColorMask.ExceedsBitDepth"),
    ("rgb32", "V4", 70, b"\1", "InvalidColorSpaceType"),
    ("rgb32", "V5", 126, b"\1", "IccProfile.UnexpectedDataForNonProfileColorSpace"),
    ("rgb24", "CORE", 22, b"\0", "InvalidPlanes"),
)


def validate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for n, (fmt, header, at, new, _) in enumerate(CORRUPTIONS):
        files = containers(spark, sf_dir, fmt, header)
        head, tail = F.substring("content", 1, at), F.expr(f"substring(content, {at + len(new) + 1})")
        bad = files.select("image_id", F.concat(head, F.lit(bytearray(new)), tail).alias("content"))
        got = dib.parse_containers(bad, "image_id").select("image_id", F.lit(n).alias("rule"), "violation")
        out = got if out is None else out.unionByName(got)
    return out


register(
    "validate_codes", validate_codes,
    "SELECT vec_id AS image_id, rule, violation FROM embeddings CROSS JOIN (VALUES "
    + ", ".join(f"({n}, '{c[4]}')" for n, c in enumerate(CORRUPTIONS)) + ") t(rule, violation)",
)

# ---- steganography ------------------------------------------------------------------------------------------------------------

CONFIG = (1, 2, 1, 0)


def turn_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, payload, image_id): every turn of the conversations and the number of the event image that is to carry it."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.coalesce(F.max("event_id"), F.lit(0))).scalar()
    image = F.pmod(F.coalesce("conv_id", F.lit(0)), 1 + F.floor(last / 128))
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), image.alias("image_id"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations, its whole text as payload (null: empty), with the event image that is to carry it."""
    t = turn_payloads(spark, sf_dir)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # kept as they are: the search for a header is long for rows so small
    return rasters.assemble(EVT_P(spark, sf_dir)).join(t, "image_id").repartition(parts, "conv_id", "turn")


def steg_map(step: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(conv, turn, w, h, rgba, payload) -> dict:
        bits = steg.HEADER_BITS + 8 * len(payload)
        tiles = -(-bits // (sum(CONFIG) * w * h))  # the image again and again, downwards, until the payload fits
        img = np.tile(np.frombuffer(rgba, np.uint8).reshape(h, w, 4), (tiles, 1, 1))
        hidden = steg.embed(img, CONFIG, payload)
        found = steg.detect(hidden)
        if step == "remove":
            clean = steg.remove(hidden, CONFIG)
            changed = int(((clean ^ img) & ~np.uint8(3)).any())
            return {"conv_id": conv, "turn": turn, "config": str(steg.detect_best_effort(clean)), "length": changed, "payload": ""}
        if found is None:
            return {"conv_id": conv, "turn": turn, "config": "none"}
        return {"conv_id": conv, "turn": turn, "config": ",".join(map(str, found[0])), "length": found[1], "payload": steg.extract(hidden, *found).hex()}

    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("config", pa.string()), ("length", pa.int64()), ("payload", pa.string())])
    columns, schema = ["conv_id", "turn", "width", "height", "rgba", "payload"], "conv_id long, turn long, config string, length long, payload string"
    return lambda s, d: dib.map_rows(payloads(s, d), columns, make, schema, kinds)


register(
    "steg_roundtrip", steg_map("find"),
    """SELECT conv_id, turn, '1,2,1,0' AS config, octet_length(encode(whole)) AS length, lower(hex(encode(whole))) AS payload
FROM (SELECT conv_id, turn, coalesce(text, '') AS whole FROM conversations)""",
)
register("steg_remove", steg_map("remove"), "SELECT conv_id, turn, 'None' AS config, 0 AS length, '' AS payload FROM conversations")


def steg_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every size of image that occurs, the capacity under each configuration."""

    def make(pixels) -> dict:
        return {"of": [{"r": c[0], "g": c[1], "b": c[2], "a": c[3], "capacity": steg.capacity(c, pixels)} for c in map(steg.decode_config, range(steg.CONFIGS))]}

    sizes = EVT_P(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("pixels")).select("pixels").distinct()
    kinds = pa.schema([("of", pa.list_(pa.struct([(c, pa.int64()) for c in (*"rgba", "capacity")])))])
    return dib.map_rows(sizes, ["pixels"], make, "of array<struct<r: long, g: long, b: long, a: long, capacity: long>>", kinds).select(F.inline("of"))


register(
    "steg_capacity", steg_capacity,
    "SELECT r, g, b, a, greatest(0, (128 * (r + g + b + a) - 80) // 8) AS capacity FROM range(9) t(r), range(9) u(g), range(9) v(b), range(9) w(a)",
)


def steg_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(key, w, h, rgba) -> dict:
        return {"image_id": key, "found": int(steg.detect_best_effort(np.frombuffer(rgba, np.uint8).reshape(h, w, 4)) is not None)}

    images = rasters.assemble(EMB_P(spark, sf_dir))
    return dib.map_rows(images, ["image_id", "width", "height", "rgba"], make, "image_id long, found long", pa.schema([("image_id", pa.int64()), ("found", pa.int64())]))


register("steg_none", steg_none, "SELECT vec_id AS image_id, 0 AS found FROM embeddings")

#: Configurations that turns use in turn, by their number modulo 3.
DEPTHS = ((1, 2, 1, 0), (0, 1, 0, 3), (2, 0, 8, 1))


def carriers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An image for every turn, in blocks: its event image repeated downwards until the text fits; and the payloads with their depths."""
    key = F.struct("conv_id", "turn")
    config = F.get(F.array(*[F.array(*map(F.lit, c)) for c in DEPTHS]), F.pmod("turn", F.lit(3)).cast("int"))
    t = turn_payloads(spark, sf_dir).withColumn("config", config)
    times = F.ceil((payload.HEADER_BITS + 8 * F.octet_length("payload")) / (128 * payload.depth(F.col("config"))))
    of = t.select(key.alias("turn_id"), "image_id", times.alias("times"))
    images = rasters.assemble(EVT_P(spark, sf_dir)).join(of, "image_id").drop("image_id").withColumnRenamed("turn_id", "image_id")
    return blocks.tile_down(images), t.select(key.alias("image_id"), "config", "payload")


def payload_digest(hidden: DataFrame) -> DataFrame:
    """Weighted sums of the channels of each turn's image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x) // 4 for x in batch.column("rgba").to_pylist()], np.int64)
            px = np.frombuffer(b"".join(batch.column("rgba").to_pylist()), np.uint8).reshape(-1, 4).astype(np.int64)
            begin = np.cumsum(size) - size
            at = np.arange(len(px)) + np.repeat(batch.column("block").to_numpy() * payload.BLOCK - begin, size)
            sums = np.add.reduceat(px * (at % 251 + 1)[:, None], begin) if len(size) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), *(pa.array(np.ascontiguousarray(c)) for c in (size, *sums.T))], names=["image_id", "n", *"rgba"])

    kind = T.StructType([hidden.schema["image_id"], *[T.StructField(c, T.LongType()) for c in ("n", *"rgba")]])
    sums = hidden.mapInArrow(run, kind).groupBy("image_id").agg(*[F.sum(c).alias(c) for c in ("n", *"rgba")])
    return sums.select("image_id.conv_id", "image_id.turn", "n", *"rgba")


def payload_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_digest(blocks.embed(*carriers(spark, sf_dir)))


def payload_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = blocks.embed(*carriers(spark, sf_dir))
    found = blocks.detect(hidden)
    out = found.join(blocks.extract(hidden, found), "image_id", "left")
    return out.select("image_id.conv_id", "image_id.turn", F.array_join("config", ",").alias("config"), "length", "error", F.lower(F.hex("payload")).alias("payload"))


def payload_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = blocks.embed(*carriers(spark, sf_dir))
    return payload_digest(blocks.remove(hidden, blocks.detect(hidden)))


def _carrier_sql(bit: str) -> str:
    """Digest of the turns' images with bit k of the stream replaced by an expression of byte v."""
    depth = lambda c: f"CASE pmod WHEN 0 THEN {DEPTHS[0][c]} WHEN 1 THEN {DEPTHS[1][c]} ELSE {DEPTHS[2][c]} END"
    new = []
    for k, c in enumerate("rgba"):
        first = " + ".join(["0", *[f"d{j}" for j in range(k)]])
        one = bit.replace("{k}", f"(p * bits + {first} + {{j}})")
        held = [f"CASE WHEN d{k} > {j} AND p * bits + {first} + {j} < total THEN (({one.format(j=j)}) - ({c} >> {j}) % 2) * {1 << j} ELSE 0 END" for j in range(8)]
        new.append(f"sum(({c} + {' + '.join(held)}) * (p % 251 + 1))::BIGINT AS {c}")
    return f"""WITH {EVT}, t AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS body, ((turn % 3) + 3) % 3 AS pmod,
coalesce(conv_id, 0) % (SELECT 1 + max(event_id) // 128 FROM events) AS image_id FROM conversations),
u AS (SELECT *, {', '.join(f'{depth(c)} AS d{c}' for c in range(4))}, octet_length(body) AS size FROM t),
s AS (SELECT *, d0 + d1 + d2 + d3 AS bits, 80 + 8 * size AS total, (d0 + 9 * d1 + 81 * d2 + 729 * d3) * 8 AS field FROM u),
x AS (SELECT *, hex('STEG'::BLOB) || printf('%02x%02x', field % 256, field // 256) || printf('%02x%02x%02x%02x', size % 256, size // 256 % 256, size // 65536 % 256, size // 16777216)
|| hex(body) AS stream FROM s),
c AS (SELECT x.*, (tile * 128 + y * 16 + e.x) AS p, r, g, b, a FROM x JOIN evt e USING (image_id), LATERAL (SELECT unnest(range((total + 128 * bits - 1) // (128 * bits))) AS tile))
SELECT conv_id, turn, count(*) AS n, {', '.join(new)} FROM c GROUP BY conv_id, turn"""


register("payload_embed", payload_embed, _carrier_sql("(('0x' || substr(stream, ({k} // 8 * 2 + 1)::INT, 2))::INT >> ({k} % 8)::INT) % 2"))
register(
    "payload_find", payload_find,
    f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{",".join(map(str, DEPTHS[0]))}' WHEN 1 THEN '{",".join(map(str, DEPTHS[1]))}' ELSE '{",".join(map(str, DEPTHS[2]))}' END AS config,
octet_length(encode(coalesce(text, ''))) AS length, NULL::VARCHAR AS error, lower(hex(encode(coalesce(text, '')))) AS payload FROM conversations""",
)
register("payload_remove", payload_remove, _carrier_sql("0"))
register(
    "payload_none", lambda s, d: payload.detect_images(rasters.assemble(EMB_P(s, d))).select("image_id", F.col("config").isNotNull().cast("int").alias("found"), "error"),
    "SELECT vec_id AS image_id, 0 AS found, NULL::VARCHAR AS error FROM embeddings",
)


def steg_survives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a payload in the images survives saving, by format and configuration."""
    out = None
    for fmt, config in SURVIVAL:
        hidden = pl.Pipeline((pl.EmbedSteganography(config, b"hidden"),)).apply(rasters.assemble(EVT_P(spark, sf_dir))).filter("size(failed) = 0")
        got = dib.payload_warnings(hidden, fmt).select("image_id", F.lit(fmt).alias("format"), F.lit(config[3]).alias("alpha_bits"), "survives", "warning")
        out = got if out is None else out.unionByName(got)
    return out


SURVIVAL = (("rgb24", (1, 2, 1, 0)), ("rgb32", (1, 2, 1, 0)), ("bitfields32", (1, 2, 1, 0)), ("rgb32", (1, 0, 0, 1)), ("rgb16", (1, 2, 1, 0)))
register(
    "chk_steg_survives", steg_survives,
    f"""WITH {EVT}, i AS (SELECT DISTINCT image_id FROM evt) SELECT image_id, format, alpha_bits, ok AS survives, CASE WHEN ok = 1 THEN '' ELSE 'payload' END AS warning
FROM i CROSS JOIN (VALUES ('rgb24', 0, 1), ('rgb32', 0, 1), ('bitfields32', 0, 1), ('rgb32', 1, 0), ('rgb16', 0, 0)) f(format, alpha_bits, ok)""",
)


def payload_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.encode("text", "UTF-8")
    binary = F.concat(F.lit(bytearray(b"\xff")), F.unhex(F.md5(text)))
    return t.select("conv_id", "turn", measures.payload_view(text).alias("text_view"), measures.payload_view(binary).alias("binary_view"))


register(
    "steg_payload_view", payload_views,
    """SELECT conv_id, turn, text AS text_view, CASE WHEN text IS NOT NULL THEN 'FF ' || rtrim(regexp_replace(substr(upper(md5(text)), 1, 30), '(..)', '\\1 ', 'g'))
|| chr(10) || substr(upper(md5(text)), 31, 2) END AS binary_view FROM conversations""",
)

# ---- pipelines ----------------------------------------------------------------------------------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two sizes: 8x2 ones and, with negative ids, 16x8 ones."""
    evt = rasters.assemble(EVT_P(spark, sf_dir)).withColumn("image_id", -F.col("image_id") - 1)
    return rasters.assemble(EMB_P(spark, sf_dir)).unionByName(evt)


STEPS = pl.Pipeline((pl.InvertColors(), pl.Crop(0, 0, 10, 4), pl.MirrorHorizontal(), pl.Brightness(5)))


def pipe_status(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = STEPS.apply(_mixed(spark, sf_dir), strict)
        first = F.element_at("failed", 1)
        failed = F.when(F.size("failed") > 0, first["index"])
        return out.select("image_id", "width", "height", failed.alias("failed_index"), F.when(F.size("failed") > 0, first["code"]).alias("code"))

    return run


for _strict in (True, False):
    _w, _h = ("NULL::INT", "NULL::INT") if _strict else ("8", "2")
    register(
        "pipe_strict_status" if _strict else "pipe_best_effort", pipe_status(_strict),
        f"""WITH {EVT} SELECT vec_id AS image_id, {_w} AS width, {_h} AS height, 1 AS failed_index, 'CropExtentOutOfBounds' AS code FROM embeddings
UNION ALL SELECT DISTINCT -image_id - 1, 10, 4, NULL::INT, NULL::VARCHAR FROM evt""",
    )


def pipe_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline of costly transforms, replayed through a cached prefix; the turns cancel out."""
    run = pl.Executor(threshold=1, most=2)
    steps = (pl.Brightness(30), pl.RotateLeft(), pl.MirrorVertical(), pl.MirrorVertical(), pl.RotateRight(), pl.Grayscale())
    images = rasters.assemble(EMB_P(spark, sf_dir))
    return rasters.explode_pixels(run.run(images, pl.Pipeline(pl.rewrite(steps)))).select(*COLS)


_bright = GRAY.format(**{k: f"least(255, {k} + 30)" for k in "rgb"})
register("pipe_cached", pipe_cached, f"WITH {EMB} SELECT image_id, y, x, {', '.join(f'{_bright} AS {c}' for c in 'rgb')}, a FROM emb")


def pipe_cached_failure(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    """As pipe_strict_status and pipe_best_effort, through an executor that persists what costs 1 and more, run twice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = pl.Pipeline((pl.Brightness(5), pl.InvertColors(), pl.Grayscale(), pl.Crop(0, 0, 10, 4), pl.MirrorHorizontal(), pl.Contrast(9)))
        executor, images = pl.Executor(threshold=1, most=2, pipeline=steps), _mixed(spark, sf_dir)
        executor.run(images, strict=strict)
        out = executor.run(images, strict=strict)
        first = F.element_at("failed", 1)
        some = F.size("failed") > 0
        return out.select("image_id", "width", "height", F.when(some, first["index"]).alias("failed_index"), F.when(some, first["code"]).alias("code"))

    return run


for _strict in (True, False):
    _w, _h = ("NULL::INT", "NULL::INT") if _strict else ("8", "2")
    register(
        "pipe_cached_failure" if _strict else "pipe_cached_best_effort", pipe_cached_failure(_strict),
        f"""WITH {EVT} SELECT vec_id AS image_id, {_w} AS width, {_h} AS height, 3 AS failed_index, 'CropExtentOutOfBounds' AS code FROM embeddings
UNION ALL SELECT DISTINCT -image_id - 1, 10, 4, NULL::INT, NULL::VARCHAR FROM evt""",
    )


def pipe_resumed(strict: bool) -> Callable[[SparkSession, str], DataFrame]:
    """As pipe_cached_failure, from tables in shared storage; the second run finds the images that haven't failed in them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = pl.Pipeline((pl.Brightness(5), pl.InvertColors(), pl.Grayscale(), pl.Crop(0, 0, 10, 4), pl.MirrorHorizontal(), pl.Contrast(9)))
        tables, images = checkpoints.CheckpointTables(spark, checkpoints.shared_folder(spark, f"replay-{uuid.uuid4().hex}"), threshold=1, most=2), _mixed(spark, sf_dir)
        tables.run(images, steps, strict)
        out = tables.run(images, steps, strict)
        first, some = F.element_at("failed", 1), F.size("failed") > 0
        pixels = F.length("rgba") / 4
        return out.select("image_id", "width", "height", F.when(some, first["index"]).alias("failed_index"), F.when(some, first["code"]).alias("code"), pixels.cast("long").alias("pixels"))

    return run


for _strict in (True, False):
    _w, _h, _n = ("NULL::INT", "NULL::INT", "NULL::BIGINT") if _strict else ("8", "2", "16")
    register(
        "pipe_resumed" if _strict else "pipe_resumed_best_effort", pipe_resumed(_strict),
        f"""WITH {EVT} SELECT vec_id AS image_id, {_w} AS width, {_h} AS height, 3 AS failed_index, 'CropExtentOutOfBounds' AS code, {_n} AS pixels FROM embeddings
UNION ALL SELECT DISTINCT -image_id - 1, 10, 4, NULL::INT, NULL::VARCHAR, 40 FROM evt""",
    )


def pipe_embed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a payload of 20 bytes would fit the images, and what embedding it then says."""
    op = pl.EmbedSteganography(CONFIG, bytes(20))
    images = pl.Pipeline((op,)).apply(_mixed(spark, sf_dir))
    sizes = _mixed(spark, sf_dir).select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    hide = sizes.select("image_id", F.array(*map(F.lit, op.config)).alias("config"), F.lit(bytearray(op.payload)).alias("payload"))
    fits = payload.check(sizes, hide).select("image_id", F.col("code").isNull().cast("int").alias("fits"))
    return images.join(fits, "image_id").select("image_id", "fits", F.when(F.size("failed") > 0, F.element_at("failed", 1)["code"]).alias("code"))


register(
    "pipe_embed_guard", pipe_embed_guard,
    f"""WITH {EVT} SELECT vec_id AS image_id, 0 AS fits, 'InsufficientCapacity' AS code FROM embeddings
UNION ALL SELECT DISTINCT -image_id - 1, 1, NULL::VARCHAR FROM evt""",
)
