"""Document fingerprints by randomised edit embedding.

A walk reads a text's characters; at each step j it writes the current character and moves on if a shared random bit of (j, character)
is set. Two texts that differ by few edits meet again soon after each edit, so the edit distance shows as Hamming distance of what the
walks write. Of that, 64 fixed steps per octave (steps 2^k to 2^(k+1)) are kept, four hashed bits each: the fingerprint. Runs of these
samples are bands: documents that share a band are candidates, and the likeness of the whole fingerprints verifies them. No pair that
shares a band is left out unless its documents are in one component already, or their summaries (a bound from below of the weight in which
they differ) rule it out. Prints and bands are matched by 64- and 32-bit hashes; likeness is of the prints themselves.

Contract of :func:`fingerprint_documents`
* null text counts as empty; its fingerprint is empty, its likeness 1 to another empty one and 0 to any other;
* texts of any length are walked whole; memory is that of one batch and one document;
* equal texts have equal fingerprints and likeness 1; offsets and lengths are code points;
* the next document is that of the next id (null ids first, equal ids by text), after the last the first; a lone row is its own;
* an empty table stays empty; only the id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, discard, maybe_broadcast, small
from rasterlake.llm.partenum import FLUSH, U64, _joining, _runs, components, mix

SEED, PERIOD, CLASSES = 20_240_601, 2048, 128  # powers of two
#: Samples to an octave, samples to a band, first octave, likeness at which a pair is near.
SAMPLES, BAND, FIRST, NEAR = 64, 8, 5, 0.75
#: Samples of a summary; pairs tested at once; pairs a row that are verified without a choice of nearest ones; rows broadcast at most.
HELD, PAIRS, PASSED, BROADCAST = 2 * SAMPLES, 1 << 18, 4, 200_000
#: Members of a band that are paired at once (about 100 bytes each), and times as many where summaries alone are.
HOT, WIDE = 1 << 14, 8
#: A member of a band on its way to where the band meets: band, the band before it (0: none), entity, component (as xor of the entity: mostly
#: 0), samples written and a shorter summary. Members that meet at once, so few that those of one print seldom lie together.
MEMBER, BUCKET = np.dtype([("s", "<u4"), ("p", "<u4"), ("e", "<i8"), ("c", "<i8"), ("n", "<u2"), ("w", "<u8", (3,))]), 60_000
#: Bands of each print by which groups of near copies are found first, for groups of more than so many.
PICKS, GROUP = 3, 8
ORDERS = mix(np.arange(1, PICKS + 1, dtype=U64))
#: Members from which a band is paired in tiles of so many rows and columns; times that a pair in tiles is cheaper than one alone.
TILED, TILE, CHEAPER = 64, (128, 1024), 13
#: Weight of each sample (by octave), the weight of all before it, and masks of the bits below a place.
WEIGHT = np.maximum(2.0, 2.0 ** (np.arange(48 * SAMPLES) // SAMPLES))
TOTAL = np.r_[0.0, np.cumsum(WEIGHT)]
BELOW = np.array([(1 << k) - 1 for k in range(SAMPLES + 1)], dtype=U64)
#: Code points of texts that walk together; fewer walks than this go on one by one; digits of samples.
AT_ONCE, FEW, HEX = 1 << 21, 64, np.frombuffer(b"0123456789abcdef", dtype=np.uint8)
#: Edges that a task joins before the rounds over all.
CONTRACTED = 100_000
#: Ranges of ids at most; documents to a range.
MAX_RANGES, RANGE_ROWS = 4096, 2000


class Walker:
    """The shared random functions, the same in every process."""

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        moves = rng.random((CLASSES, PERIOD)) < 0.5
        moves[:, ::16] = True  # none stays for ever
        ints = list(range(PERIOD))
        self.next: list[list[int]] = []
        self.table = np.empty((CLASSES, PERIOD), dtype=np.int32)
        for k, row in enumerate(moves):
            at = np.where(np.r_[row, row], np.arange(2 * PERIOD), 4 * PERIOD)
            at = np.minimum.accumulate(at[::-1])[::-1][:PERIOD]
            self.table[k] = (at + 1) % PERIOD
            self.next.append([ints[i] for i in self.table[k].tolist()])
        self.table = self.table.reshape(-1)
        self.rng_steps: dict[int, np.ndarray] = {}

    def steps(self, octave: int) -> np.ndarray:
        """The sampled steps of an octave, in order."""
        if octave not in self.rng_steps:
            low = (1 << octave) if octave > FIRST else 0
            rng = np.random.Generator(np.random.PCG64([SEED, octave]))
            self.rng_steps[octave] = np.sort(rng.integers(low, 1 << (octave + 1), SAMPLES))
        return self.rng_steps[octave]

    def walk(self, codes: np.ndarray, step: int = 0) -> np.ndarray:
        """The step at which each character is first written, and that after the last."""
        out: list[int] = []
        add, state = out.append, step % PERIOD
        for row in map(self.next.__getitem__, (codes % CLASSES).tolist()):
            add(state)
            state = row[state]
        add(state)
        moved = np.diff(np.array(out, dtype=np.int64)) % PERIOD
        moved[moved == 0] = PERIOD
        return np.r_[step, step + np.cumsum(moved)]

    def sample(self, codes: np.ndarray, at: np.ndarray) -> str:
        if not len(codes):
            return ""
        out, end, octave = [], int(at[-1]), FIRST
        while octave == FIRST or (1 << octave) < end:
            steps = self.steps(octave)
            i = np.minimum(np.searchsorted(at, steps, side="right") - 1, len(codes) - 1)
            out.append(np.where(steps < end, _nibbles(codes[i], steps), np.uint8(45)).tobytes().decode())
            octave += 1
        return "".join(out)


def likeness(a: str, b: str) -> float:
    """Estimated share of steps at which the walks agree beyond chance, 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, "-").encode(), dtype=np.uint8) for s in (a, b))
    octave = np.arange(n) // SAMPLES
    weight = np.where(octave == 0, 2.0, 2.0**octave) * ((x != 45) | (y != 45))
    share = float((weight * (x == y)).sum() / max(weight.sum(), 1e-9))
    return min(1.0, max(0.0, (share - 1 / 16) / (15 / 16)))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def bands(fingerprint: str) -> np.ndarray:
    """64-bit keys of the bands: full runs of samples, with their place. A print too short for one has its whole as a band."""
    n = len(fingerprint.rstrip("-")) // BAND
    if not n:
        return np.frombuffer(hashlib.md5(fingerprint.encode()).digest()[:8], dtype=U64)
    runs = np.frombuffer(fingerprint[: n * BAND].encode(), dtype=U64)
    return mix(runs ^ mix(np.arange(1, n + 1, dtype=U64)))


def picks(keys: np.ndarray) -> list[int]:
    """The bands that come first in PICKS random orders, as signed hashes of order and band."""
    return mix(keys ^ ORDERS[:, None]).min(1).view(np.int64).tolist()


def packed(entry: np.ndarray) -> bytes:
    """Members as bytes, field by field."""
    return b"".join(np.ascontiguousarray(entry[f]).tobytes() for f in MEMBER.names)


def unpacked(data: bytes) -> np.ndarray:
    out, at = np.empty(len(data) // MEMBER.itemsize, dtype=MEMBER), 0
    for f in MEMBER.names:
        column = np.ndarray(out[f].shape, out[f].dtype, data, at)
        out[f], at = column, at + column.nbytes
    return out


class Walks:
    """Walks of many texts at once: ``codes`` one after the other, ``sizes`` of them each. All take a step together, the longest first,
    until few are left. ``first`` gives each walk's first step, modulo PERIOD."""

    def __init__(self, walker: Walker, codes: np.ndarray, sizes: np.ndarray, first: np.ndarray | None = None) -> None:
        self.codes, self.sizes, self.starts = codes, sizes, np.cumsum(sizes) - sizes
        last = (np.zeros(len(sizes)) if first is None else first % PERIOD).astype(np.int32)
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order))
        active = len(order) - np.searchsorted(sizes[order][::-1], np.arange(int(sizes.max(initial=0))), side="right")
        upto = np.r_[0, np.cumsum(active)]  # what is read at the same time lies together
        place = np.take(upto.astype(np.int32), np.arange(len(codes), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), sizes))
        place += np.repeat(rank, sizes)
        rows, turned = np.empty(len(codes), dtype=np.int32), np.empty(len(codes), dtype=np.int32)
        rows[place] = (codes & (CLASSES - 1)).astype(np.int32) * PERIOD
        now = last[order]
        table, together = walker.table, int(np.searchsorted(-active, -FEW, side="right"))
        for at, to, k in zip(upto[:together].tolist(), upto[1:].tolist(), active.tolist(), strict=False):
            turned[at:to] = now[:k]
            now[:k] = table[rows[at:to] + now[:k]]
        states = turned[place]  # at which each character is first written, modulo PERIOD
        for r in range(int(active[together]) if together < len(active) else 0):
            d = order[r]
            begin, end = int(self.starts[d]) + together, int(self.starts[d] + sizes[d])
            out: list[int] = []
            add, state = out.append, int(now[r])
            for row in map(walker.next.__getitem__, (codes[begin:end] & (CLASSES - 1)).tolist()):
                add(state)
                state = row[state]
            states[begin:end], now[r] = out, state
        last[order] = now
        after = np.empty_like(states)
        after[:-1] = states[1:]
        some = sizes > 0
        after[(self.starts + sizes - 1)[some]] = last[some]
        moved = ((after - states - 1) & (PERIOD - 1)) + 1
        self.ends = np.cumsum(moved, dtype=np.int64)  # of each character, counted on through all texts
        self.base = self.begin(self.starts)  # of each text
        self.length = self.begin(self.starts + sizes) - self.base  # in steps

    def begin(self, place: np.ndarray) -> np.ndarray:
        """The step at which the walks come to that place in ``codes``, counted on through all texts."""
        return np.where(place > 0, self.ends[place - 1], 0) if len(self.ends) else np.zeros(len(place), dtype=np.int64)

    def written(self, text: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Places in ``codes`` of what the texts write at those steps (counted from their own first one)."""
        return np.searchsorted(self.ends, self.base[text] + step, side="right")


def _nibbles(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Four hashed bits of (character, step), as ASCII digits."""
    mix = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (steps.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return HEX[(mix >> np.uint64(60)).astype(np.int64)]


def _octaves(length: np.ndarray) -> np.ndarray:
    """Octaves in the print of a walk of so many steps: 0 without any."""
    _, bits = np.frexp(np.maximum(length - 1, 0).astype(np.float64))  # 2^(bits-1) < length
    return np.where(length > 0, np.maximum(bits - FIRST, 1), 0)


def _likenesses(x: np.ndarray, y: np.ndarray, octaves_x: np.ndarray, octaves_y: np.ndarray) -> np.ndarray:
    """likeness() of each row of x with that of y: prints as ASCII, filled up with '-', of so many octaves."""
    weight = WEIGHT[: x.shape[1]]
    total = ((x != 45) | (y != 45)) @ weight
    share = (((x == y) & (x != 45)) @ weight / np.maximum(total, 1e-9) - 1 / 16) / (15 / 16)
    return np.where((x == y).all(1) & (octaves_x == octaves_y), 1.0, np.clip(share, 0.0, 1.0))


def edited_rows(walker: Walker, keys: list, texts: list[str], of: list[int]) -> list[list]:
    """Columns NAMES of the texts at places ``of``, each followed in texts by the next document. An edited text's walk is that of the
    text up to the edit."""
    codes = [codes_of(t) for t in texts]
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    walks = Walks(walker, np.concatenate(codes), sizes)
    d = np.array(of, dtype=np.int64)
    n, keep = sizes[d], sizes[d] - sizes[d] // 4
    news = [codes[k + 1][: len(codes[k]) // 4] for k in of]
    # the edit's first step: where the text's walk was then (that after its last character if it keeps all)
    step = walks.begin(walks.starts[d] + keep) - walks.base[d]
    tails = Walks(walker, np.concatenate(news), np.array([len(c) for c in news], dtype=np.int64), step)
    end = step + tails.length
    width = max(int(_octaves(np.r_[walks.length, end]).max()), 1)
    steps = np.concatenate([walker.steps(FIRST + k) for k in range(width)])
    prints = np.full((len(texts), len(steps)), 45, dtype=np.uint8)
    r, c = np.nonzero(steps < walks.length[:, None])
    prints[r, c] = _nibbles(walks.codes[walks.written(r, steps[c])], steps[c])
    edited = np.where(steps < step[:, None], prints[d], np.uint8(45))
    r, c = np.nonzero((steps >= step[:, None]) & (steps < end[:, None]))
    edited[r, c] = _nibbles(tails.codes[tails.written(r, steps[c] - step[r])], steps[c])
    shas = []
    for k, kept in zip(of, keep.tolist(), strict=True):
        text = texts[k][:kept] + texts[k + 1][: len(texts[k]) // 4]
        shas.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
    own, other = _octaves(walks.length), _octaves(end)
    strings = lambda rows, octaves: [x[: SAMPLES * k].tobytes().decode() for x, k in zip(rows, octaves.tolist(), strict=True)]
    near = _likenesses(prints[d], edited, own[d], other), _likenesses(prints[d], prints[d + 1], own[d], own[d + 1])
    return [[keys[k] for k in of], n.tolist(), shas, strings(prints[d], own[d]), strings(edited, other), *[x.tolist() for x in near]]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form (its last quarter replaced by the next document's head).

    Ids are dealt to ranges by their quantiles; each range also gets the first document of the next one, so that every document meets
    its successor after one shuffle of the compressed texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    probs = [i / ranges for i in range(1, ranges)]
    bounds = np.unique(rows.select(F.col("id").cast("double")).approxQuantile("id", probs, 0.1 / ranges)) if probs and n else np.zeros(0)
    lowest = -(2**63)
    key = F.coalesce("id", F.lit(lowest))
    side = F.lit(0)
    if len(bounds):
        at = F.array(*[F.lit(float(b)) for b in bounds])
        side = F.size(F.filter(at, lambda b: b <= key.cast("double")))
    firsts = sorted((int(r.side), int(r.low)) for r in rows.groupBy(side.alias("side")).agg(F.min(key).alias("low")).collect())
    before = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}  # the range that precedes (cyclically) the one it begins
    ends = bounds

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                k = lowest if i is None else i
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                z, tie = pack.compress(data), hashlib.md5(data).digest()
                places = [(int(np.searchsorted(ends, float(k), side="right")), 0)]
                if k in before:
                    places.append((before[k], 1))
                for place, extra in places:
                    for col, v in zip(out, (place, extra, i, tie, z), strict=True):
                        col.append(v)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["range", "extra", "id", "tie", "z"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, unpack = Walker(), zstandard.ZstdDecompressor()
        types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        held: list[tuple] = []  # range, extra, id, text of rows in order; the last one waits for its successor

        def rows_of() -> pa.RecordBatch:
            of = [k for k, (now, then) in enumerate(zip(held, held[1:], strict=False)) if now[0] == then[0] and not now[1]]
            cols = edited_rows(walker, [x[2] for x in held], [x[3] for x in held], of) if of else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=NAMES)

        size = 0
        for batch in batches:
            for place, extra, i, z in zip(*(batch.column(c) for c in ("range", "extra", "id", "z")), strict=True):
                place, extra = place.as_py(), extra.as_py()
                if extra and (not held or held[-1][0] != place or held[-1][1]):
                    continue  # a repeated first row
                held.append((place, extra, i.as_py(), unpack.decompress(z.as_py()).decode("utf-8", "surrogatepass")))
                size += len(held[-1][3])
                if size > AT_ONCE and len(held) > 1:
                    yield rows_of()
                    held, size = held[-1:], len(held[-1][3])
        if held:
            yield rows_of()

    dealt = rows.mapInArrow(deal, "range int, extra int, id long, tie binary, z binary")
    sorted_ = dealt.repartition(max(1, len(firsts)), "range").sortWithinPartitions("range", "extra", F.col("id").asc_nulls_first(), "tie")
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_.mapInArrow(meet, kinds)


def summary(fingerprint: str) -> tuple[int, bytes]:
    """The samples written, and two bits of each of the last HELD of them, at its place modulo HELD: first all low bits, then all high."""
    n = len(fingerprint.rstrip("-"))
    at = np.arange(max(0, n - HELD), n)
    c = np.frombuffer(fingerprint.encode(), dtype=np.uint8)[at]
    v = np.zeros(HELD, dtype=np.uint8)
    v[at % HELD] = (c & 15) + 9 * (c >> 6)
    return n, np.packbits(np.r_[v & 1, (v >> 1) & 1], bitorder="little").tobytes()


def shorter(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The low bits of summaries, and the high ones of the last SAMPLES samples, at their places modulo SAMPLES: three words each."""
    octave = (n - 1) // SAMPLES
    mask, row = BELOW[n - SAMPLES * octave], np.arange(len(n))
    high = (words[row, 2 + (octave & 1)] & mask) | (words[row, 3 - (octave & 1)] & ~mask)
    return np.c_[words[:, :2], high]


def needed(near: float) -> float:
    """The share of weight in which prints of that likeness agree, less what rounding may take."""
    return (near / 16 * 15 + 1 / 16) * (1 - 1e-9) if near > 0 else 0.0


def may_be_near(n: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray, near: float) -> tuple[np.ndarray, ...]:
    """Of the pairs i, j (n[i] <= n[j]) those whose summaries don't rule them out, with the weight in which they differ at least."""
    gap = TOTAL[n[j]] - TOTAL[n[i]]
    for back in range(3):
        fit = gap <= (1 - needed(near)) * TOTAL[n[j]]
        i, j, gap = i[fit], j[fit], gap[fit]
        octave = (n[i] - 1) // SAMPLES - back
        start, half = SAMPLES * octave, octave & 1
        mask = BELOW[np.clip(n[i] - start, 0, SAMPLES)] & ~BELOW[np.clip(n[j] - HELD - start, 0, SAMPLES)]
        other = words[i, half] ^ words[j, half]
        if words.shape[1] == 4:
            other |= words[i, half + 2] ^ words[j, half + 2]
        else:
            other |= (words[i, 2] ^ words[j, 2]) & ~BELOW[np.clip(n[j] - SAMPLES - start, 0, SAMPLES)]
        gap = gap + np.bitwise_count(other & mask) * WEIGHT[np.maximum(start, 0)]
    fit = gap <= (1 - needed(near)) * TOTAL[n[j]]
    return i[fit], j[fit], gap[fit]


def tiles(n: np.ndarray, words: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, ...]]:
    """As may_be_near for all pairs of rows in ascending order of n, by shorter summaries: in tiles, whose work is a few operations on words
    a pair and whose memory is bounded. At first only the last two octaves are looked at."""
    least = needed(near)
    octave = (n - 1) // SAMPLES
    reach = np.searchsorted(n, np.searchsorted(least * TOTAL, TOTAL[n], side="right") - 1, side="right")
    begins = np.flatnonzero(np.r_[True, octave[1:] != octave[:-1]])
    for first, last in zip(begins.tolist(), [*begins[1:].tolist(), len(n)], strict=True):
        start = SAMPLES * int(octave[first])
        if start < 0:  # empty prints
            start = 0
        high, low = (np.ascontiguousarray(words[first:, h]) for h in ((start // SAMPLES) & 1, (start // SAMPLES + 1) & 1))
        later, both = n[first:], np.ascontiguousarray(words[first:, 2])
        unit = WEIGHT[max(start - SAMPLES, 0)] if start else 2.0
        twice = int(WEIGHT[start] / unit)
        written = BELOW[np.clip(later - start, 0, SAMPLES)]
        kept = [~BELOW[np.clip(later - HELD - x, 0, SAMPLES)] for x in (start, start - SAMPLES)]
        finer = [~BELOW[np.clip(later - SAMPLES - x, 0, SAMPLES)] for x in (start, start - SAMPLES)]
        if not start:
            kept[1][:] = 0  # no octave below the first
        spare = (TOTAL[later] / unit).astype(np.float32)
        for a in range(0, last - first, TILE[0]):
            b = min(a + TILE[0], last - first)
            end = int(reach[first + b - 1]) - first
            rows, mask = high[a:b, None], written[a:b, None]
            below, fine, most = low[a:b, None], both[a:b, None], spare[a:b, None] * np.float32(1 + 1e-5) + np.float32(1e-3)
            for c in range(a, end, TILE[1]):
                d = min(c + TILE[1], end)
                y = fine ^ both[c:d]
                x = rows ^ high[c:d]
                x |= y if int(later[d - 1]) <= start + SAMPLES else y & finer[0][c:d]
                x &= mask
                if int(later[d - 1]) > start + HELD:
                    x &= kept[0][c:d]
                differ = np.bitwise_count(x)
                if twice == 2:
                    differ += differ
                np.bitwise_xor(below, low[c:d], out=x)
                y &= finer[1][c:d]
                x |= y
                x &= kept[1][c:d]
                differ += np.bitwise_count(x)
                i, j = np.nonzero(differ + np.float32(least) * spare[c:d] <= most)
                i, j = i + (first + a), j + (first + c)
                fit = i < j
                i, j, _ = may_be_near(n, words, i[fit], j[fit], near)
                if len(i):
                    yield i, j


class Search:
    """Links of prints that share a band, over a table of id, print and entity (the print's hash).

    Equal prints are one vertex. First each print is compared with the smallest one of the large groups that share a band that it comes to
    first, so that large groups of near copies are mostly one component before any band meets. Where a band's members meet, members of one
    component aren't paired, nor are those that share the band before, too: they have met there. Of the others, shorter summaries rule out what
    can't be near; the pairs left are verified, of each band that has at most ``passed`` of them a member and isn't too large to be paired in one place. Of the
    other bands only those whose members lie in different components go on. Their
    pairs across are ruled out by the summaries in blocks of bounded size, in which the members of the largest component aren't paired
    with one another. Of a band that has at most ``passed`` pairs a row left, the pairs are verified; the others' members are sent for
    again with their prints, and compared where they meet, so that only links that join components leave a block.
    """

    def __init__(self, own: DataFrame, near: float, block: int = HOT, passed: int = PASSED) -> None:
        self.own, self.near, self.block, self.passed = own, near, block, passed
        self.kinds = cut(self.described())
        self.edges = self.labels = None
        self.gather()
        met = cut(self.shared())
        self.verify(self.possible(met.filter("sig is null").select(F.col("center").alias("a"), F.col("entity").alias("b")).distinct()))
        self.groups = met.filter("sig is not null")
        if not small(self.groups, 0):
            self.reduce()
        discard(met)

    def gather(self) -> None:
        """Links of near copies with one print of their group, a pair or less for each of a print's picks."""
        rows = self.kinds.select("entity", F.explode("picks").alias("pick"))
        centers = rows.groupBy("pick").agg(F.min("entity").alias("center"), F.count("*").alias("m")).filter(F.col("m") > GROUP).drop("m")
        centers = cut(centers)
        if not small(centers, 0):
            stars = rows.join(maybe_broadcast(centers, BROADCAST), "pick").filter("entity != center")
            self.verify(self.possible(stars.select(F.col("center").alias("a"), F.col("entity").alias("b")).distinct()))
        discard(centers)

    def reduce(self) -> None:
        """Links in the bands that have too many pairs for all to be verified."""
        pairs = cut(self.pairs(self.groups))
        self.verify(pairs.filter("a is not null").select("a", "b").distinct())
        held = cut(self.groups.join(pairs.filter("a is null").select(F.col("b").alias("sig")).distinct(), "sig", "left_semi"))
        if not small(held, 0):
            # First one band of each print, the largest, then what these leave open in the others.
            first = held.groupBy("entity").agg(F.max(F.struct("m", "sig"))["sig"].alias("sig")).select("sig").distinct()
            first = cut(first)
            for which in ("left_semi", "left_anti"):
                part = held.join(first, "sig", which)
                if which == "left_semi" or not small(part, 0):
                    self.add(self.pairs(part, whole=True))
            discard(first)
        discard(pairs, held)

    def described(self) -> DataFrame:
        """(entity, id, rows, n, bits, picks): the distinct prints, with their smallest id, rows, summaries and picks."""

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints = batch.column("print").to_pylist()
                n, bits = zip(*map(summary, prints), strict=True) if prints else ((), ())
                first = pa.array([picks(bands(p)) for p in prints], pa.list_(pa.int64()))
                cols = [batch.column("entity"), batch.column("id"), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), first]
                yield pa.RecordBatch.from_arrays(cols, names=["entity", "id", "n", "bits", "picks"])

        rows = self.own.select("entity", "id", "print").mapInArrow(describe, "entity long, id long, n long, bits binary, picks array<long>")
        return rows.groupBy("entity").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("n", "bits", "picks")])

    def shared(self) -> DataFrame:
        """(sig, m, center, entity): with sig null, the pairs center < entity of a band that the summaries don't rule out; else the m prints
        of a band that has too many of these, and the smallest of them. Pairs of one component, and those that share the band before, aren't
        counted. A member whose number of samples alone keeps it from being near any other of its band is left out."""
        total = self.kinds.agg(F.coalesce(F.sum(F.col("n") * F.col("rows")), F.lit(0))).first()[0]
        buckets, near, passed, wide = max(1, total // BAND // BUCKET), self.near, self.passed, WIDE * self.block
        least = needed(near)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sigs, entities, comps, ns, bits, held, seen = [], [], [], [], [], 0, set()

            def flush() -> pa.RecordBatch:
                sig = np.concatenate(sigs) if sigs else np.zeros(0, U64)
                before = np.r_[np.zeros(1, U64), np.maximum(sig >> U64(32), U64(1))][:-1].astype(np.uint32)
                before[np.cumsum([0, *map(len, sigs)])[:-1]] = 0
                who = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
                bucket = ((sig & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                entry = np.zeros(len(sig), dtype=MEMBER)
                entry["s"], entry["p"] = (sig[order] >> U64(32)).astype(np.uint32), before[order]
                entry["e"], entry["n"] = np.array(entities, dtype=np.int64)[who[order]], np.array(ns, dtype=np.int64)[who[order]]
                entry["c"] = np.array(comps, dtype=np.int64)[who[order]] ^ entry["e"]
                entry["w"] = shorter(np.array(ns, dtype=np.int64), np.frombuffer(b"".join(bits), dtype=U64).reshape(-1, 4))[who[order]]
                ends = np.r_[(at := _runs(bucket[order])), len(sig)]
                data = [packed(entry[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(bucket[order][at], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

            for batch in batches:
                for entity, text, comp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if entity in seen:
                        continue
                    n, both = summary(text)
                    seen.add(entity), sigs.append(bands(text)), entities.append(entity), comps.append(comp), ns.append(n), bits.append(both)
                    held += len(sigs[-1])
                    if held >= FLUSH:
                        yield flush()
                        sigs, entities, comps, ns, bits, held, seen = [], [], [], [], [], 0, set()
            yield flush()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None

            def group() -> pa.RecordBatch:
                entry = np.concatenate([unpacked(x) for x in held])
                entry = entry[np.lexsort((entry["e"], entry["n"], entry["s"]))]
                entry = entry[np.r_[True, (entry["s"][1:] != entry["s"][:-1]) | (entry["e"][1:] != entry["e"][:-1])]]
                # The next of a band in the order of samples is the likeliest to be near.
                after = (entry["s"][1:] == entry["s"][:-1]) & (TOTAL[entry["n"][:-1]] >= least * TOTAL[entry["n"][1:]])
                entry = entry[np.r_[after, False] | np.r_[False, after]] if len(entry) else entry
                runs = _runs(entry["s"])
                m = np.diff(np.r_[runs, len(entry)])
                words, comp = np.ascontiguousarray(entry["w"]), entry["c"] ^ entry["e"]
                pairs, many = tested(entry["n"].astype(np.int64), words, comp, entry["p"].astype(np.int64), runs, m)
                left = np.repeat(many, m)
                center = np.minimum.reduceat(entry["e"], runs) if len(runs) else np.zeros(0, np.int64)
                sig = ((np.int64(at) << 32) | entry["s"].astype(np.int64))[left]
                e = np.ascontiguousarray(entry["e"])
                a, b = np.minimum(*e[pairs]), np.maximum(*e[pairs])
                a, b = np.unique(np.c_[a, b], axis=0).T if len(a) else (a, b)
                none = pa.nulls(len(a), pa.int64())
                cols = (none, sig), (none, np.repeat(m, m)[left]), (a, np.repeat(center, m)[left]), (b, e[left])
                arrays = [pa.concat_arrays([x if x is none else pa.array(np.ascontiguousarray(x), pa.int64()), pa.array(y, pa.int64())]) for x, y in cols]
                return pa.RecordBatch.from_arrays(arrays, names=["sig", "m", "center", "entity"])

            def tested(n: np.ndarray, words: np.ndarray, comp: np.ndarray, before: np.ndarray, runs: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Rows (i, j) of the pairs that may be near, of the bands that don't have too many; and which bands have."""
                many, found = m > wide, [np.zeros((2, 0), np.int64)]
                reach = np.searchsorted(least * TOTAL, TOTAL[n], side="right") - 1
                band, width = np.repeat(np.arange(len(m)), m), len(TOTAL)
                ends = np.searchsorted(band * width + n, band * width + reach, side="right")
                new = lambda i, j: (comp[i] != comp[j]) & ((before[i] != before[j]) | (before[i] == 0))
                # Rows of the largest component, or of the largest part that shares the band before, need no partners of the same.
                free = _outside_largest(band, comp) if len(n) else np.zeros(0, bool)
                other = _outside_largest(band, np.where(before > 0, before, -1 - np.arange(len(n)))) if len(n) else free
                fewer = np.bincount(band[other], minlength=len(m)) < np.bincount(band[free], minlength=len(m))
                free = np.where(np.repeat(fewer, m), other, free)
                frees = np.bincount(band[free], minlength=len(m))
                tiled = (m >= TILED) & (2 * CHEAPER * frees > m)
                begins = np.searchsorted(band * width + reach, band * width + n, side="left")
                count = np.where(free & ~np.repeat(tiled | many, m), ends - begins, 0)
                upto, to = np.cumsum(count), 0
                while to < len(n):
                    begin, done = to, upto[to - 1] if to else 0
                    to = max(begin + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
                    i = np.repeat(np.arange(begin, to), count[begin:to])
                    j = np.repeat(begins[begin:to] - (upto[begin:to] - count[begin:to] - done), count[begin:to]) + np.arange(len(i))
                    fit = (~free[j] | (i < j)) & new(i, j)
                    found.append(np.stack(may_be_near(n, words, np.minimum(i, j)[fit], np.maximum(i, j)[fit], near)[:2]))
                for k in np.flatnonzero(tiled & ~many).tolist():
                    part, size, own = slice(runs[k], runs[k] + m[k]), 0, []
                    for two in tiles(n[part], words[part], near):
                        two = np.stack(two) + runs[k]
                        own.append(two[:, new(*two)])
                        size += own[-1].shape[1]
                        if size > passed * m[k]:
                            many[k] = True
                            break
                    else:
                        found += own
                pairs = np.concatenate(found, 1)
                of = band[pairs[0]]
                many |= np.bincount(of, minlength=len(m)) > passed * m
                return pairs[:, ~many[of]], many

            for batch in batches:
                for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and bucket != at:
                        yield group()
                        held = []
                    at = bucket
                    held.append(data)
            if held:
                yield group()

        own = self.own.select("entity", "print")
        comp = F.col("entity").alias("comp")
        if self.labels is not None:
            own, comp = own.join(maybe_broadcast(self.labels.withColumnRenamed("node", "entity"), BROADCAST), "entity", "left"), F.coalesce("comp", "entity").alias("comp")
        dealt = own.select("entity", "print", comp).mapInArrow(deal, "bucket int, data binary")
        spread = dealt.repartition(max(1, min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket")
        return spread.mapInArrow(meet, "sig long, m long, center long, entity long")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the summaries don't rule out."""
        near = self.near

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = np.c_[batch.column("na").to_numpy(), batch.column("nb").to_numpy()].reshape(-1)
                bits = b"".join(x for two in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True) for x in two)
                i = np.arange(0, len(n), 2)
                swap = n[i] > n[i + 1]
                words = np.frombuffer(bits, dtype=U64).reshape(-1, HELD // 32)
                lo, *_ = may_be_near(n, words, i + swap, i + 1 - swap, near)
                yield batch.select(["a", "b"]).take(pa.array(np.sort(lo // 2)))

        side = lambda x: self.kinds.select(F.col("entity").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return both.mapInArrow(prune, "a long, b long")

    def prints(self, entities: DataFrame) -> DataFrame:
        """(entity, print) of the entities, which may repeat."""
        some = cut(entities.select("entity").distinct())
        return cut(self.own.select("entity", "print").join(maybe_broadcast(some, BROADCAST), "entity", "left_semi").dropDuplicates(["entity"]))

    def pairs(self, groups: DataFrame, whole: bool = False) -> DataFrame:
        """Pairs (a, b) of a band and of different components that may be near; a null and b a band that has too many of these. whole:
        from the prints themselves, links (a, b, likeness) that join all components of a band that near pairs connect."""
        near, passed = self.near, self.passed
        kinds = self.kinds.select("entity", "n", "bits").join(self.labels.withColumnRenamed("node", "entity"), "entity", "left")
        kinds = kinds.withColumn("comp", F.coalesce("comp", "entity"))
        if whole:
            kinds = kinds.join(self.prints(groups), "entity").withColumn("print", F.unhex(F.rtrim("print", F.lit("-"))))
        part = groups.select("sig", "entity", F.ceil(F.col("m") / (self.block if whole else WIDE * self.block)).cast("int").alias("blocks"))
        part = part.withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
        part = part.join(cut(kinds).hint("merge"), "entity")  # the same plan at every size
        part = part.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        more = ["print"] * whole
        part = part.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "entity", "comp", "n", "bits", *more)
        part = part.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "n")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("sig", "p", "q", "own", "entity", "comp", "n")

            def tested(cols: list[np.ndarray], words: np.ndarray, samples: np.ndarray | None) -> pa.RecordBatch:
                sig, p, q, own, entity, comp, n = cols
                block = np.cumsum(np.r_[False, (sig[1:] != sig[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
                free = _outside_largest(block, comp)
                reach = np.searchsorted(needed(near) * TOTAL, TOTAL[n], side="right") - 1
                width = len(TOTAL)
                begins = np.searchsorted(block * width + reach, block * width + n, side="left")
                ends = np.searchsorted(block * width + n, block * width + reach, side="right")
                count = np.where(free, ends - begins, 0)
                upto, at, root = np.cumsum(count), 0, {}
                a = b = np.zeros(0, np.int64)
                like = np.zeros(0)
                while at < len(n):
                    done = upto[at - 1] if at else 0
                    to = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
                    i = np.repeat(np.arange(at, to), count[at:to])
                    j = np.repeat(begins[at:to] - (upto[at:to] - count[at:to] - done), count[at:to]) + np.arange(len(i))
                    fit = (comp[i] != comp[j]) & ((p[i] == q[i]) | (own[i] != own[j])) & (~free[j] | (i < j))
                    i, j = np.minimum(i, j)[fit], np.maximum(i, j)[fit]
                    i, j, gap = may_be_near(n, words, i, j, near)
                    if samples is not None and len(i):
                        found = np.concatenate([_likeness_of(samples, n, i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)])
                        order = np.flatnonzero(found >= near)
                        order = order[_joining(comp[i[order]].tolist(), comp[j[order]].tolist(), np.argsort(-found[order], kind="stable").tolist(), root)]
                        i, j, gap = i[order], j[order], found[order]
                        if root:  # what is joined needs no more tests
                            comp = np.array([_find(root, c) for c in comp.tolist()], dtype=np.int64)
                    a, b, like = np.r_[a, i], np.r_[b, j], np.r_[like, gap]
                    at = to
                if samples is not None:
                    return pa.RecordBatch.from_arrays([pa.array(entity[a]), pa.array(entity[b]), pa.array(like)], names=["a", "b", "likeness"])
                many = np.bincount(block[a], minlength=block[-1] + 1) > passed * np.bincount(block)
                back = np.unique(sig[many[block]])
                a, b = a[~many[block[a]]], b[~many[block[b]]]
                a, b = np.minimum(entity[a], entity[b]), np.maximum(entity[a], entity[b])
                a, b = np.unique(np.c_[a, b], axis=0).T if len(a) else (a, b)
                a = pa.concat_arrays([pa.array(np.ascontiguousarray(a)), pa.nulls(len(back), pa.int64())])
                return pa.RecordBatch.from_arrays([a, pa.array(np.r_[b, back])], names=["a", "b"])

            held: list[pa.RecordBatch] = []

            def columns() -> tuple:
                table = pa.Table.from_batches(held)
                words = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=U64).reshape(-1, HELD // 32)
                samples = _unpacked(table.column("print").to_pylist(), table.column("n").to_numpy()) if whole else None
                return [table.column(c).to_numpy().astype(np.int64) for c in names], words, samples

            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                key = [batch.column(c).to_numpy() for c in names[:3]]
                ended = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
                if len(ended):  # the last block may go on in the next batch
                    held[-1] = batch.slice(0, int(ended[-1]) + 1)
                    yield tested(*columns())
                    held = [batch.slice(int(ended[-1]) + 1)]
            if held:
                yield tested(*columns())

        return part.mapInArrow(test, "a long, b long" + ", likeness double" * whole)

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs that are near to the links."""
        near, pairs = self.near, cut(pairs)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                like = np.array([likeness(x, y) for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)], dtype=float)
                out = [batch.column("a"), batch.column("b"), pa.array(like)]
                yield pa.RecordBatch.from_arrays(out, names=["a", "b", "likeness"]).filter(pa.array(like >= near))

        prints = self.prints(pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))))
        both = pairs.join(prints.select(F.col("entity").alias("a"), F.col("print").alias("pa")), "a")
        both = both.join(prints.select(F.col("entity").alias("b"), F.col("print").alias("pb")), "b")
        self.add(both.select("a", "b", "pa", "pb").mapInArrow(compare, "a long, b long, likeness double"))

    def add(self, links: DataFrame) -> None:
        found = cut(links)
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        if self.labels is None or not small(found, 0):
            self.labels = cut(components(contracted(self.edges)))


def contracted(edges: DataFrame) -> DataFrame:
    """Links (a, b) that join what the edges (a, b) join, at most one to a node of each CONTRACTED edges or so: what they join among themselves
    needs no rounds over all of them."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top = [_find(root, a), _find(root, b)]
                for v in (a, b, *top):
                    root[v] = min(top)
        nodes = [v for v in root if _find(root, v) != v]
        cols = [pa.array([_find(root, v) for v in nodes], pa.int64()), pa.array(nodes, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["a", "b"])

    return edges.select("a", "b").coalesce(max(1, edges.count() // CONTRACTED)).mapInArrow(join, "a long, b long")


def _find(root: dict[int, int], v: int) -> int:
    while (up := root.get(v, v)) != v:
        v = up
    return v


def _unpacked(prints: list[bytes], n: np.ndarray) -> np.ndarray:
    """The samples of packed prints (two to a byte, the first of an odd number alone), a row each; 255 after the last."""
    out = np.full((len(prints), int(n.max(initial=0))), 255, dtype=np.uint8)
    for row, data, k in zip(out, prints, n.tolist(), strict=True):
        raw = np.frombuffer(data, dtype=np.uint8)
        row[:k] = np.c_[raw >> 4, raw & 15].reshape(-1)[k & 1 :]
    return out


def _likeness_of(samples: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """likeness() of the pairs i, j (n[i] <= n[j]) of unpacked prints; weights are powers of two, so the sums are exact."""
    x = samples[i]
    same = ((x == samples[j]) & (x != 255)) @ WEIGHT[: samples.shape[1]]
    share = (same / np.maximum(TOTAL[n[j]], 1e-9) - 1 / 16) / (15 / 16)
    return np.clip(share, 0.0, 1.0)


def _outside_largest(block: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which rows (in the order of blocks) aren't of their block's largest component."""
    order = np.lexsort((comp, block))
    at = np.flatnonzero(np.r_[True, (block[order][1:] != block[order][:-1]) | (comp[order][1:] != comp[order][:-1])])
    size = np.diff(np.r_[at, len(order)])
    run = np.lexsort((-size, block[order][at]))
    first = run[_runs(block[order][at][run])]  # of each block, the run of its largest component
    out = np.ones(len(block), dtype=bool)
    out[order] = ~np.repeat(np.isin(np.arange(len(at)), first), size)
    return out


def _entities(prints: DataFrame, id_col: str, print_col: str) -> DataFrame:
    own = prints.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(print_col), F.lit("")).alias("print"))
    return own.withColumn("entity", F.xxhash64("print"))


def near_links(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint", near: float = NEAR, **more) -> DataFrame:
    """(id, other, likeness) links that hold together what is near: rows are connected by them just where a chain of pairs that share a
    band and have that likeness connects them. A print's smallest id (null if it has no other) stands for its rows, which link to it.
    """
    own = cut(_entities(prints, id_col, print_col))
    search = Search(own, near, **more)
    side = lambda x, name: search.kinds.select(F.col("entity").alias(x), F.col("id").alias(name))
    out = search.edges.join(side("a", "other"), "a").join(side("b", "id"), "b").select("id", "other", "likeness")
    copies = own.join(side("entity", "other"), "entity").filter(~F.col("id").eqNullSafe(F.col("other")))
    return out.unionByName(copies.select("id", "other", F.lit(1.0).alias("likeness")))


def with_components(prints: DataFrame, id_col: str = "doc_id", print_col: str = "fingerprint", near: float = NEAR, **more) -> DataFrame:
    """prints (a table that is cheap to read again) with component_id: the smallest id reachable by near links (null ids count as
    largest), itself included.
    """
    search = Search(_entities(prints, id_col, print_col), near, **more)
    root = search.kinds.join(search.labels, search.kinds["entity"] == search.labels["node"], "left")
    root = cut(root.select("entity", "id", "rows", F.coalesce("comp", "entity").alias("root")))
    lowest = root.groupBy("root").agg(F.min("id").alias("component_id"), F.sum("rows").alias("n")).filter("n > 1").drop("n")
    of = cut(root.join(lowest, "root").select(F.col("entity").alias("__entity"), "component_id"))
    rows = prints.withColumn("__key", F.xxhash64(F.coalesce(F.col(print_col), F.lit(""))))
    out = rows.join(maybe_broadcast(of, BROADCAST), F.col("__key") == F.col("__entity"), "left")
    return out.select(*[prints[c] for c in prints.columns], F.coalesce("component_id", F.col(id_col).cast("long")).alias("component_id"))
