"""Compression classifier: how much better a good-text than a bad-text zstandard dictionary compresses a document.

Dictionaries are trained from labelled rows, good and bad, in two views: the text, and its shape (letters, capitals and digits become
one character each). A text is compressed in blocks of about 300 bytes, so that a bad passage in a long text counts. Its features are,
for either view, the difference of the compressed sizes over their sum, in the whole text and in its worst block; a logistic curve,
fitted on labelled rows that the dictionaries haven't seen and weighted to the classes' shares in all labels, makes them a score. Its
ridge is chosen by the log loss on held-out parts of these rows. Level 6 searches dictionaries more thoroughly than the fast levels, whose
sizes differ too little where a text is a single block.

Contract of :func:`score_quality`
* null text counts as empty; empty texts get the curve's value at differences of zero;
* training takes at most ``max_rows`` rows of a class (smallest id hashes: reruns agree; of an id that repeats the smallest text): of
  those that make the dictionaries a piece from the middle, of those that fit the curve the whole text, like scoring; labels that are
  null or of unknown documents are ignored;
* without labelled rows of both classes every score is 0.5 (predicted 1: nothing is rejected);
* empty tables stay empty; repeated rows score alike; input columns named score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, without

MAX_ROWS, DICT_BYTES, LEVEL, BLOCK = 1200, 256 << 10, 6, 300
#: Ridges that held-out loss chooses from, and the parts of the rows that are held out in turn.
RIDGES, FOLDS = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), 5
#: Characters from the middle of a text that may go into a dictionary.
MIDDLE = 20_000
#: The part of a class's rows that make its dictionaries; the others fit the curve.
DICT_SHARE = 0.6
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


@dataclass
class Model:
    #: Good and bad dictionary of the text, then of its shape.
    dictionaries: list[bytes]
    weights: list[float]
    #: The curve's ridge, and its mean log loss on held-out folds.
    ridge: float = RIDGES[0]
    loss: float = float("nan")


def _compressors(dictionaries: list[bytes]) -> list:
    out = []
    for raw in dictionaries:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def features(text: str | None, compressors: list) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * 4
    n = max(1, round(len(data) / BLOCK))
    ends = [len(data) * i // n for i in range(n + 1)]
    out = []
    for view, (good, bad) in ((data, compressors[:2]), (data.translate(SHAPE), compressors[2:])):
        sizes = [(len(good.compress(view[a:b])), len(bad.compress(view[a:b]))) for a, b in zip(ends, ends[1:], strict=False)]
        g, b = sum(x for x, _ in sizes), sum(y for _, y in sizes)
        out += [(b - g) / (b + g), min((y - x) / (y + x) for x, y in sizes)]
    return out


def _dictionary(data: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Equal shares of the texts' middles, so that a few long ones don't fill the dictionary."""
    share = max(64, size // max(1, len(data)))
    parts = [d[(at := max(0, (len(d) - share) // 2)) : at + share] for d in data]
    return b"\n".join(parts)[:size] or b"\n" * 8


def _share_weights(y: np.ndarray, share: float) -> np.ndarray:
    return np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float) -> list[float]:
    """Weights and offset by Newton's method with a ridge on standardised features, not on the offset; share: of class 1 in all labels."""
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    each = _share_weights(y, share)
    held = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p) * each)[:, None]).T @ z + held, z.T @ ((y - p) * each) - held @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [*(w[:-1] / scale), w[-1] - (w[:-1] * mean / scale).sum()]


def _fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[list[float], float, float]:
    """Curve, ridge and loss: of RIDGES the one with the least log loss on rows that a fit hasn't seen, each row held out once."""
    fold = np.zeros(len(y), int)
    for v in (0, 1):
        fold[y == v] = np.arange((y == v).sum()) % FOLDS
    folds = [k for k in range(FOLDS) if len(set(y[fold != k])) == 2 and (fold == k).any()]
    losses = []
    for ridge in RIDGES if folds else ():
        loss = weight = 0.0
        for k in folds:
            w = np.array(_logistic(x[fold != k], y[fold != k], share, ridge))
            margin = (x[fold == k] @ w[:-1] + w[-1]) * (2 * y[fold == k] - 1)
            each = _share_weights(y, share)[fold == k]
            loss, weight = loss + float(each @ np.logaddexp(0, -margin)), weight + float(each.sum())
        losses.append(loss / weight)
    best = int(np.argmin(losses)) if losses else len(RIDGES) - 1
    return _logistic(x, y, share, RIDGES[best]), RIDGES[best], losses[best] if losses else float("nan")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """A model from labelled rows (labels: id, label), None without both classes. Collects pieces of at most 2 * max_rows texts."""
    sample = None
    for value in (0, 1):
        own = labels.filter(F.col(label_col) == value).select(F.col(id_col).alias("__label_id"), F.lit(value).alias("y"))
        own = own.distinct().orderBy(F.xxhash64(F.col("__label_id").cast("string")), "__label_id").limit(max_rows)
        sample = own if sample is None else sample.unionByName(own)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), F.col("id") == F.col("__label_id"))
    rows = cut(known.filter("length(t) > 0").groupBy("id", "y").agg(F.min("t").alias("t")))
    ids = rows.select("y", "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id").collect()
    sides = {v: [r.id for r in ids if r.y == v] for v in (0, 1)}
    if min(map(len, sides.values())) < 2:
        return None
    n = {r[label_col]: r["count"] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    first = {v: {i: k for k, i in enumerate(s[: max(1, int(len(s) * DICT_SHARE))])} for v, s in sides.items()}
    of_dictionary = [(i, v) for v in first for i in first[v]]
    chosen = docs.sparkSession.createDataFrame(of_dictionary, "id " + rows.schema["id"].dataType.simpleString() + ", y int")
    from_middle = F.substring("t", F.greatest(F.lit(1), F.floor((F.length("t") - MIDDLE) / 2).cast("int") + 1), F.lit(MIDDLE)).alias("t")
    got = rows.join(F.broadcast(chosen), ["id", "y"]).select("id", "y", from_middle).collect()
    got = {v: [r.t.encode("utf-8", "surrogatepass") for r in sorted((r for r in got if r.y == v), key=lambda r: first[v][r.id])] for v in (0, 1)}
    words = [_dictionary(got[v]) for v in (1, 0)]
    shapes = [_dictionary([t.translate(SHAPE) for t in got[v]]) for v in (1, 0)]
    shared = docs.sparkSession.sparkContext.broadcast(words + shapes)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = _compressors(shared.value)
        for frame in frames:
            yield pd.DataFrame([(y, *features(t, tools)) for y, t in zip(frame["y"], frame["t"], strict=True)], columns=["y", "a", "b", "c", "d"])

    rest = rows.join(F.broadcast(chosen), ["id", "y"], "left_anti").select("y", "t").mapInPandas(measure, "y int, a double, b double, c double, d double")
    rest = np.array(sorted(tuple(map(float, r)) for r in rest.collect()))
    weights, ridge, loss = _fit(rest[:, 1:], rest[:, 0], n[1] / (n[0] + n[1]))
    return Model(words + shapes, [float(w) for w in weights], ridge, loss)


def score_column(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    """The score of text_col, from 0 to 1; the model is four bounded dictionaries, broadcast."""
    if model is None:
        return F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools, w = _compressors(shared.value.dictionaries), np.array(shared.value.weights)
        for texts in batches:
            x = np.array([features(t, tools) for t in texts], dtype=float).reshape(-1, 4)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500))))

    return score(F.col(text_col).cast("string"))


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5). One scan, no shuffle."""
    out = without(docs, "score", "predicted").withColumn("score", score_column(docs, model, text_col))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without those predicted bad; rows keep all their columns."""
    return docs.filter(score_column(docs, model, text_col) >= 0.5)
