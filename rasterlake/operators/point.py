"""Point operators on pixels: column expressions that Catalyst folds into one projection. Alpha stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.imaging import SEPIA, contrast_factor


def _f(v) -> Column:
    return F.lit(float(v)).cast("float")


def _half_up(c: Column) -> Column:
    d = c.cast("double")
    return F.when(d >= 0, F.floor(d + 0.5)).otherwise(F.ceil(d - 0.5))


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def _row(p: float, q: float, s: float) -> Column:
    r, g, b = (F.col(c).cast("float") for c in "rgb")
    return _half_up((_f(p) * r + _f(q) * g) + _f(s) * b)


def invert(df: DataFrame) -> DataFrame:
    return df.withColumns({c: (F.lit(255) - F.col(c)).cast("int") for c in "rgb"})


def grayscale(df: DataFrame) -> DataFrame:
    luma = _row(0.299, 0.587, 0.114).cast("int")
    return df.withColumns(dict.fromkeys("rgb", luma))


def sepia(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _clamp(_row(*w)) for c, w in zip("rgb", SEPIA, strict=True)})


def brightness(df: DataFrame, delta: int) -> DataFrame:
    return df.withColumns({c: _clamp(F.col(c) + delta) for c in "rgb"})


def contrast(df: DataFrame, delta: int) -> DataFrame:
    k = _f(contrast_factor(delta))
    return df.withColumns({c: _clamp(_half_up(k * (F.col(c).cast("float") - _f(128)) + _f(128))) for c in "rgb"})
