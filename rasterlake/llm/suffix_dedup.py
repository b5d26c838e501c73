"""Repeated-substring removal with a run-length index.

Any string of ``length`` bytes has a smallest k-gram (by hash, the leftmost of equals): its anchor. All windows of a text that share an
anchor form one stretch, and two windows can only be equal if their stretches share the anchor's k-gram. Stretches are therefore grouped
by it; equal ones are counted before they are shuffled, k-grams that occur once drop out, and of the others each distinct stretch is
fetched once, with its multiplicity. Of the groups of a partition, blocks of bounded size are indexed: their Burrows-Wheeler transform is
cut into runs, the suffix positions at run ends are sampled with the length of their match with the neighbouring suffix, and the matching
statistics of all other positions are streamed from these (a position inside a run matches one byte less than the one before it). Windows
whose statistic reaches ``length`` occur elsewhere. Groups with too many distinct stretches for a block are split by what the windows at a
quarter of the offsets have in common, again and again, which stays exact.

Equal stretches add no runs to the transform, so each goes in once, and all windows of one that occurs twice are repeated by its count
alone; a group in which each stretch occurs twice needs no index. On the test table of 1,000 documents counts alone decide 88 % of the
removed bytes and the index 12 %: what is repeated whole is found by counting, what is repeated in part by the matching statistics.

Contract of :func:`repeated_spans`
* null text counts as empty; texts shorter than ``length`` bytes keep all; offsets are bytes of the UTF-8 text;
* a window is repeated if it starts anywhere else, in the same text too (overlapping or not), whatever else is removed;
* rows with equal id and text are copies of one another; equal ids with different texts are told apart;
* texts of any length are read in windows of bounded size; an empty table stays empty;
* stretches are grouped by two 64-bit hashes (k-gram and content): exact up to hash collisions;
* only the id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, discard
from rasterlake.llm.partenum import BYTE, POWERS, RATIO, U64, _text_parts, mix

LENGTH, GRAM = 400, 16
#: Bytes of a text read at once; distinct stretches of a group that one block takes; bytes of a block; parts of a split.
PART, GROUP, BLOCK, SPLIT = 4 << 20, 4096, 128 << 10, 4
LOW32 = U64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def content_key(total: np.ndarray, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) and of a number, from prefix sums."""
    _, inverse = POWERS.upto(len(total))
    return mix((total[end] - total[start]) * inverse[start] + mix((end - start).astype(U64) * U64(RATIO) + more.astype(U64)))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    power, _ = POWERS.upto(len(data) + 1)
    return np.r_[U64(0), np.cumsum(BYTE[data] * power[: len(data)], dtype=U64)]


def stretches(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents in data that end at ends: k-gram hash, content hash, document, start in data, windows and anchor offset of each stretch."""
    n = len(data)
    if n < length:
        return (np.zeros(0, U64), np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4)
    total = prefix_sums(data)
    at = np.arange(n - gram + 1)
    _, inverse = POWERS.upto(n)
    hashes = mix((total[gram:] - total[:-gram]) * inverse[: len(at)])
    low = _sliding_min((hashes & ~LOW32) | at.astype(U64), length - gram + 1)
    anchor = (low & LOW32).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))[: len(anchor)]
    valid = at[: len(anchor)] + length <= ends[doc]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])] & valid
    start = np.flatnonzero(new)
    windows = np.add.reduceat(valid.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    offset = anchor[start] - start
    content = content_key(total, start, start + windows + length - 1, offset)
    return hashes[anchor[start]], content, doc[start], start, windows, offset


class Index:
    """Run-length index of a block of strings: run ends of the BWT, with sampled positions and match lengths."""

    WORD = 7  # symbols of nine bits in a word

    def __init__(self, strings: list[bytes]) -> None:
        # A match may run over an end mark, but one of ``length`` bytes from where as many are left can't.
        raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int64) + 1
        lengths = np.array([len(s) for s in strings])
        self.ends = np.cumsum(lengths + 1) - 1  # of the strings' end marks
        self.starts = self.ends - lengths
        raw[self.ends] = 0
        self.symbols, n = raw, len(raw)
        word, padded = np.zeros(n, dtype=np.int64), np.r_[raw, np.zeros(self.WORD, np.int64)]
        for t in range(self.WORD):
            word = (word << 9) | padded[t : t + n]
        self.word = word
        sa = self._suffixes()
        before = np.r_[-1, raw[:-1]][sa]
        #: Ranks at which a run begins, the suffixes on either side, and how far these match.
        self.runs = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.above, self.below = sa[self.runs - 1], sa[self.runs]
        self.match = self._extend(self.above, self.below)
        self.first, self.last = sa[0], sa[-1]

    def _suffixes(self) -> np.ndarray:
        """Suffix array by prefix doubling; only positions that still tie are sorted again."""
        n = len(self.word)
        active = np.argsort(self.word).astype(np.int32)
        sa, rank = active.copy(), np.zeros(n + 1, dtype=np.int32)  # ranks from 1; past the end 0
        key, slot = self.word[active], np.arange(n, dtype=np.int32)
        h = self.WORD
        while True:
            head = np.r_[True, key[1:] != key[:-1]]
            own = np.maximum.accumulate(np.where(head, slot, 0)) + np.int32(1)
            rank[active] = own
            tied = ~(head & np.r_[head[1:], True])
            if not tied.any():
                return sa
            active, own, slot = active[tied], own[tied], slot[tied]
            key = (own.astype(np.int64) << 32) | rank[np.minimum(active.astype(np.int64) + h, n)]
            order = np.argsort(key)  # groups stay in their slots: own is the high part
            key, active = key[order], active[order]
            sa[slot] = active
            h *= 2

    def _extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        n = len(self.word)
        while len(live):
            at = out[live]
            x, y = a[live] + at, b[live] + at
            wx, wy = self.word[np.minimum(x, n - 1)], self.word[np.minimum(y, n - 1)]
            diff = wx ^ wy
            bits = np.frexp(diff.astype(np.float64))[1]  # 63-bit words: the place of the highest bit, at most one too high
            same = np.where(diff == 0, self.WORD, self.WORD - 1 - (np.maximum(bits, 1) - 1) // 9)
            fix = (diff != 0) & (same < self.WORD) & ((diff >> np.maximum(0, 9 * (self.WORD - 1 - same))) == 0)
            same = np.minimum(same + fix, np.minimum(n - x, n - y))
            out[live] += same
            live = live[same == self.WORD]
        return out

    def statistics(self) -> np.ndarray:
        """For each position the longest match of what begins there with any other suffix of the block."""
        n = len(self.symbols)
        best = np.zeros(n, dtype=np.int64)
        for own, edge in ((self.below, self.first), (self.above, self.last)):
            sampled = np.full(n, -1, dtype=np.int64)
            sampled[own] = self.match
            sampled[edge] = 0
            source = np.maximum.accumulate(np.where(sampled >= 0, np.arange(n), 0))
            best = np.maximum(best, sampled[source] - (np.arange(n) - source))
        return best


def mark_block(strings: list[bytes], windows: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(string, first window, last window) of the maximal runs of windows that occur elsewhere in the block."""
    index = Index(strings)
    long = index.statistics() >= length
    for i, (start, n) in enumerate(zip(index.starts.tolist(), windows, strict=True)):
        hit = np.flatnonzero(np.diff(np.r_[0, long[start : start + n].astype(np.int8), 0]))
        yield from ((i, int(a), int(b) - 1) for a, b in zip(hit[::2], hit[1::2], strict=True))


ROW = "key long, content long, rid long, start long, windows long, anchor long"
NAMES = ["key", "content", "rid", "start", "windows", "anchor"]


def _read(docs: DataFrame, length: int, gram: int, part: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, done = batch.column(0).to_numpy(), 0
            for raw, ends in _text_parts(batch.column(1)):
                own, parts = rid[done : done + len(ends)], [(0, raw, ends)]
                done += len(ends)
                if len(raw) > part:  # a long text: its windows in parts
                    parts = _parted(raw, ends, part, length)
                for base, data, stops, *of in parts:
                    key, content, doc, start, windows, offset = stretches(data, stops, length, gram)
                    begin = np.r_[0, stops[:-1]]
                    ids = own[doc] if not of else np.full(len(doc), own[of[0]])
                    cols = (key.view(np.int64), content.view(np.int64), ids, start - begin[doc] + base, windows, offset)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=NAMES)

    return docs.select("rid", "text").mapInArrow(read, ROW)


def _parted(raw: np.ndarray, ends: np.ndarray, part: int, length: int) -> list[tuple]:
    """(offset in the document, bytes, their end, document) of the parts in which the windows of each document begin."""
    out = []
    for k, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
        for at in range(a, b, part):
            data = raw[at : min(b, at + part + length - 1)]
            out.append((at - a, data, np.array([len(data)]), k))
    return out


def _packed(own: DataFrame) -> DataFrame:
    """(id, rid, z): texts compressed, for the shuffles."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [tool.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["id", "rid", "z"])

    return own.select("id", "rid", "text").mapInArrow(squeeze, f"id {own.schema['id'].dataType.simpleString()}, rid long, z binary")


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Each stretch in SPLIT parts of its anchor's offsets, keyed by what the windows of a part share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("key", "rid", "start", "windows", "anchor", "low", "high", "data")]
            for key, rid, start, windows, anchor, low, high, data in zip(*cols, strict=True):
                total = prefix_sums(np.frombuffer(data, dtype=np.uint8))
                step = -(-(high - low + 1) // SPLIT)
                for a in range(low, high + 1, step):
                    b = min(high, a + step - 1)  # windows with the anchor at offsets a to b
                    first, last = max(0, anchor - b), min(windows - 1, anchor - a)
                    if first > last or anchor - a < 0 or anchor - b > windows - 1:
                        continue
                    core = np.array([max(0, anchor - a)]), np.array([min(len(data), anchor - b + length)])
                    k = content_key(total, *core, np.array([(key ^ a * 7919) & 0x7FFFFFFFFFFFFFFF]))
                    ends = np.array([first]), np.array([last + length])
                    c = content_key(total, *ends, np.array([anchor - first]))
                    part = data[first : last + length]
                    out.append((int(k.view(np.int64)[0]), int(c.view(np.int64)[0]), rid, start + first, last - first + 1, anchor - first, a, b, part))
            kinds = [*[pa.int64()] * 8, pa.binary()]
            cols = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[*NAMES, "low", "high", "data"])

    return rows.mapInArrow(split, f"{ROW}, low long, high long, data binary")


def _index(rows: DataFrame, length: int) -> DataFrame:
    """(rid, begin, end) of the bytes that repeated windows cover, by blocks of whole groups."""
    parts = max(8, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("key", "content", "rid", "start", "windows", "data").repartition(parts, "key").sortWithinPartitions("key", "content")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None

        def block() -> pa.RecordBatch:
            out = [(held[i][0], held[i][1] + a, held[i][1] + b + length) for i, a, b in mark_block([h[3] for h in held], [h[2] for h in held], length)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["rid", "begin", "end"])

        for batch in batches:
            names = ("key", "content", "rid", "start", "windows", "data")
            for key, content, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (key, content) == at:
                    continue  # of rows that are equal in id and text
                if at is not None and key != at[0] and size >= BLOCK:
                    yield block()
                    held, size = [], 0
                at = key, content
                held.append(row)
                size += len(row[3])
        if held:
            yield block()

    return rows.mapInArrow(index, "rid long, begin long, end long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(documents with a row key rid; rid, begin, end of byte ranges that repeated windows cover, overlaps included)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("rid", F.xxhash64("id", "text"))
    read = cut(_read(own, length, gram, part))
    own = _packed(own)
    again = cut(read.groupBy("key").agg(F.count("*").alias("total")).filter("total > 1").select("key"))
    one = F.min(F.struct("rid", "start", "windows", "anchor")).alias("one")
    equal = cut(read.join(again, "key", "left_semi").groupBy("key", "content").agg(F.count("*").alias("n"), one))
    twice = equal.filter("n > 1").select("key", "content")
    spans = read.join(twice, ["key", "content"]).select("rid", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + length - 1).alias("end"))

    # Distinct stretches of groups that have several, and one that occurs once among them, fetched from their texts.
    groups = equal.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    groups = cut(groups.select("key", (F.col("kinds") > group).alias("hot")))
    wanted = equal.join(groups, "key").select("key", "content", "one.*", "hot").groupBy("rid")
    wanted = wanted.agg(F.collect_list(F.struct("key", "content", "start", "windows", "anchor", "hot")).alias("of"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                rid, text = batch.column(0)[k].as_py(), unpack.decompress(batch.column(1)[k].as_py())
                of = batch.column(2)[k].as_py()
                cols = [[x[c] for x in of] for c in ("key", "content", "start", "windows", "anchor")]
                data = [text[a : a + w + length - 1] for a, w in zip(cols[2], cols[3], strict=True)]
                arrays = [pa.array(c, pa.int64()) for c in (cols[0], cols[1], [rid] * len(of), *cols[2:])]
                hot = pa.array([x["hot"] for x in of], pa.bool_())
                yield pa.RecordBatch.from_arrays([*arrays, hot, pa.array(data, pa.binary())], names=[*NAMES, "hot", "data"])

    rows = own.join(wanted, "rid").select("rid", "z", "of").mapInArrow(fetch, f"{ROW}, hot boolean, data binary")
    many = groups.filter("hot").limit(1).count()
    if many:
        rows = cut(rows)
    spans = spans.unionByName(_index(rows.filter("not hot"), length))
    if not many:
        out = cut(spans.distinct())
        discard(read, again, equal, groups)
        return own, out
    rows = rows.filter("hot").select(*NAMES, F.lit(0).cast("long").alias("low"), F.lit(length - gram).cast("long").alias("high"), "data")
    rows = rows.dropDuplicates(["key", "content"])
    while True:
        split = cut(_split(rows, length))
        equal = split.groupBy("key", "content").agg(F.count("*").alias("n"))
        again = split.join(equal.filter("n > 1").select("key", "content"), ["key", "content"])
        spans = spans.unionByName(again.select("rid", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + length - 1).alias("end")))
        groups = equal.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
        groups = cut(groups.select("key", (F.col("kinds") > group).alias("hot")))
        rows = cut(split.join(groups, "key").dropDuplicates(["key", "content"]))
        spans = spans.unionByName(_index(rows.filter("not hot"), length))
        if not groups.filter("hot").limit(1).count():
            return own, cut(spans.distinct())
        rows = rows.filter("hot").drop("hot")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **more) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (merged, byte offsets), kept (remaining bytes) and kept_sha256 of every document."""
    own, spans = repeated_spans(docs, id_col, text_col, length, **more)
    lists = cut(spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("of")))
    discard(spans)
    kind = docs.schema[id_col].dataType

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"]
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for z, of in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(z.as_py())
                merged: list[list[int]] = []
                for x in of.as_py() or ():
                    if merged and x["begin"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["begin"], x["end"]])
                edges = [0, *(v for m in merged for v in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                made = (len(data), len(data) - len(kept), len(merged), merged, kept, hashlib.sha256(kept).hexdigest())
                for col, v in zip(rows, made, strict=True):
                    col.append(v)
            types = [*[pa.int64()] * 3, pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], names=names)

    schema = f"id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, kept_sha256 string"
    joined = own.join(lists, "rid", "left").select("id", "z", "of")
    return joined.mapInArrow(remove, schema).withColumnRenamed("id", id_col)
