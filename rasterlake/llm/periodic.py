"""Periodic runs of words by divide and conquer over interned word ids (Main and Lorentz).

A run is a maximal stretch of words that repeats with smallest period q at least ``EXPONENT`` times and has ``SHORTEST`` words or more. Words
are interned within a slice of rows. A run as long as this repeats each of its three-word stretches three times, so only stretches of
positions whose three words (hashed, which may only keep too much) occur that often in their text go on. These are halved again and again:
Z-functions at each midpoint, forwards and backwards, give how far every period reaches to both sides, hence all repetitions that cross it;
those that the neighbouring words extend belong to a larger half and are dropped; of equal intervals the smallest period stays.

Contract of :func:`find_runs`
* words are the stretches without ``[\\x20\\x09-\\x0D]``; null text counts as empty and has no words and no runs;
* ``runs`` lists start, length and period (numbers of words) by start, then period; overlapping runs of different periods all count;
* ``collapsed`` is the text without the words that any run contains after its first period, joined by one space (never null);
* texts of any length are searched whole: a text of n words takes about n log n steps in one task, whatever its runs; a slice holds
  ``SLICE`` bytes or one row; repeated and null ids, and empty tables, are rows like others;
* the result has the id, ``n_words``, ``runs`` and ``collapsed``; other columns are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import byte_slices

EXPONENT, SHORTEST = 4, 6
#: Bytes of text searched at once, and slots of the counts of three-word stretches.
SLICE, SLOTS = 4 << 20, 1 << 22


def z_function(s: list[int]) -> list[int]:
    """How long s and s from each place on agree."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def runs_of(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of s, in order."""
    n, ends_of = len(s), {}
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < SHORTEST:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        left, right = s[lo:mid][::-1], s[mid:hi]
        # A run has at least half its words, two periods, on one side of the midpoint.
        most_left, most_right = len(left) // 2, len(right) // 2
        ahead = z_function([*right, -1, *s[mid - most_left : hi]])
        back = z_function([*left, -1, *s[lo : mid + most_right][::-1]])
        after, before = len(right) + 1 + most_left, len(left) + 1 + most_right
        found = [(mid - q - back[q], mid + ahead[after - q], q) for q in range(1, most_left + 1) if ahead[after - q] and back[q] + ahead[after - q] >= (EXPONENT - 1) * q]
        found += [(mid - back[before - q], mid + q + ahead[q], q) for q in range(1, most_right + 1) if back[before - q] and ahead[q] + back[before - q] >= (EXPONENT - 1) * q]
        for a, b, q in found:
            if b - a >= SHORTEST and (a == 0 or s[a - 1] != s[a - 1 + q]) and (b == n or s[b] != s[b - q]) and q < ends_of.get((a, b), n):
                ends_of[a, b] = q
    return sorted((a, b - a, q) for (a, b), q in ends_of.items())


def _stretches(codes: np.ndarray, row: np.ndarray, slots: int) -> Iterator[tuple[int, int]]:
    """Places (begin, end) outside of which no run lies."""
    if len(codes) < SHORTEST:
        return
    whole = row[2:] == row[:-2]
    a, b, c, of = (x.astype(np.uint64) for x in (codes[:-2], codes[1:-1], codes[2:], row[2:]))
    h = a
    for part in (b, c, of):
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15) ^ h >> np.uint64(29)
    h = ((h ^ h >> np.uint64(32)) & np.uint64(slots - 1)).astype(np.int64)
    often = whole & (np.bincount(h[whole], minlength=slots)[h] >= EXPONENT - 1)
    edge = np.diff(np.r_[False, often, False].astype(np.int8))
    new_row = np.r_[False, row[2:][1:] != row[2:][:-1]]
    for begin, end in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        cuts = [begin, *(begin + np.flatnonzero(new_row[begin + 1 : end]) + 1).tolist(), end]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y - x >= SHORTEST - 2:
                yield x, y + 2


def search_texts(texts: list[bytes], slots: int = SLOTS) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    codes = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(texts)), sizes)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in _stretches(codes, row, slots):
        found = runs_of(codes[begin:end].tolist())
        if found:
            k = int(row[begin])
            at = begin - int(begins[k])
            runs.setdefault(k, []).extend((a + at, n, q) for a, n, q in found)
    out = []
    for k, ws in enumerate(words):
        own = sorted(runs.get(k, ()), key=lambda r: (r[0], r[2]))
        n = len(ws)
        if own:
            step = np.zeros(n + 1, np.int64)
            for a, length, q in own:
                step[a + q] += 1
                step[a + length] -= 1
            ws = [w for w, d in zip(ws, np.cumsum(step[:-1]).tolist(), strict=True) if not d]
        out.append((n, own, b" ".join(ws)))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE, slots: int = SLOTS) -> DataFrame:
    """The id, n_words, runs array<struct<start, length, period>> and collapsed text of every row. One scan, no shuffle."""
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(pc.binary_length(batch.column(1)).to_pylist(), slice_bytes):
                n, runs, texts = zip(*search_texts(batch.column(1).slice(a, b - a).to_pylist(), slots), strict=True)
                runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs]
                cols = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_words", "runs", "collapsed"])

    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit("")).cast("binary")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col(id_col), text.alias("__text")).mapInArrow(search, schema)
