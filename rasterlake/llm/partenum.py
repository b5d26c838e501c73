"""Exact n-gram Jaccard join with PartEnum signatures.

A document's set holds the hashes of its distinct word shingles. For sets in the size band up to u (u a power of two) the hash domain is
cut into about 0.6 u partitions; what a set has in one partition is a signature of it. Sets of sizes a <= b with Jaccard J >= t differ in
at most (a + b)(1 - t)/(1 + t) elements, d for short, so in at most d partitions. Put in any order that all sets share, the first d + 1
signatures of both then have one in common; so only these are enumerated. Signatures made of frequent shingles alone come last in that
order, which keeps common passages out. A set may have partners in the next band, and is enumerated there too.

Signatures go to buckets as packed arrays. Every task first reduces the sets of a signature to links with their smallest member, and so
does each bucket: a hot group costs a row per set. These star links are tested first (a parity bitmap bounds the difference from below,
then the sets themselves are compared). Where a large group's members still lie in different components, pairs that would join these are
tested, nearest bitmaps first, and at last, in groups of any size, all pairs across that the bitmaps allow, so no link is lost. Bitmaps are
compared in blocks of bounded size.

Contract of :func:`near_duplicates`
* words are maximal runs outside space and U+0009..D, A-Z in lower case; fewer words than n make one shingle; none makes an empty set,
  which links with nothing; null text counts as empty;
* sets are compared by 64-bit hashes (of shingles and of sets): exact up to hash collisions; partitions of a band above 64 are few
  enough that a set with at most d of them has a chance below 2^-50;
* equal sets are one vertex; component_id is the smallest id reachable by links, itself included (null ids count as largest);
* ids are of any type that has an order; an empty table stays empty; repeated rows share their component; only the id and text are
  read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, discard, maybe_broadcast, row_key, small, without_rows

N_WORDS, PERCENT = 5, 75
#: Bands up to this size take each shingle for a partition; partitions per unit of a larger band's bound.
SINGLES, PARTITIONS = 64, 0.6
#: Bytes hashed at once; signatures held before they are dealt; signatures to a bucket.
CHUNK, FLUSH, BUCKET = 1 << 20, 3_000_000, 200_000
#: Rows to a batch that is returned; ranges of buckets that are dealt one after the other.
ROWS, RANGES = 1000, 8
#: A shingle is frequent from this share of the documents on; frequent shingles at most (more are ordered as rare ones).
FREQUENT, MAX_FREQUENT = 1 / 512, 400_000
#: Members of a block in which cross pairs are tested; of a group in which all are tested at once; bits of a bitmap and ids broadcast at most.
BLOCK, FOREST, MAX_BITS, BROADCAST_IDS = 1024, 32, 1 << 16, 100_000

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(97))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
PLACE = _rng.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
RATIO = 0x9E3779B97F4A7C17
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of RATIO and of its inverse, mod 2^64, grown as needed."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK)
            inverse = pow(RATIO, -1, 1 << 64)
            self.arrays = tuple(np.cumprod(np.r_[U64(1), np.full(self.n, r, dtype=U64)], dtype=U64) for r in (RATIO, inverse))
        return self.arrays


POWERS = Powers()


def _text_parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends of the documents in them) for runs of documents of about CHUNK bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at]
        at = to


def shingle_sets(column: pa.Array, n_words: int = N_WORDS) -> Iterator[np.ndarray]:
    """For each text of the column the sorted hashes of its distinct shingles."""
    for raw, ends in _text_parts(column):
        n = len(raw)
        begins = np.r_[0, ends[:-1]]
        if not n:
            yield from (np.zeros(0, U64) for _ in ends)
            continue
        data = np.frombuffer(raw.tobytes().translate(LOWER), dtype=np.uint8)
        word = ~SPACE[data]
        gap = np.r_[True, ~word[:-1]]
        gap[begins[begins < n]] = True
        first = np.flatnonzero(word & gap)
        over = np.r_[~word[1:], True]
        over[ends[ends > 0] - 1] = True
        last = np.flatnonzero(word & over) + 1
        power, inverse = POWERS.upto(n + 1)
        total = np.r_[U64(0), np.cumsum(BYTE[data] * power[:n], dtype=U64)]
        words = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(U64) * U64(RATIO))
        counts = np.diff(np.searchsorted(first, np.r_[0, ends]))
        stop = np.cumsum(counts)
        full = np.zeros(max(0, len(words) - n_words + 1), dtype=U64)
        for t in range(n_words):
            full += words[t : t + len(full)] * PLACE[t]
        full = mix(full)
        for a, k in zip((stop - counts).tolist(), counts.tolist(), strict=True):
            if k >= n_words:
                h = np.sort(full[a : a + k - n_words + 1])
                yield h[np.r_[True, h[1:] != h[:-1]]] if len(h) > 1 else h
            elif k:
                yield mix((words[a : a + k] * PLACE[:k]).sum(dtype=U64, keepdims=True) + PLACE[40:41] * np.full(1, k, U64))
            else:
                yield np.zeros(0, U64)


def set_key(h: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    s = mix(h).sum(dtype=U64, keepdims=True) + mix(h ^ U64(RATIO)).sum(dtype=U64, keepdims=True) * PLACE[41:42] + PLACE[42:43] * np.full(1, len(h), U64)
    return int(mix(s).view(np.int64)[0])


def band(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the elements' counts by hash: the bits in which two bitmaps differ are at most the elements in which the sets do."""
    bits = min(MAX_BITS, max(64, 2 * band(len(h))))
    odd = np.bincount((h % U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def most_difference(a: int, b: int, percent: int) -> int:
    return (a + b) * (100 - percent) // (100 + percent)


def signatures(h: np.ndarray, rare: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set (sorted hashes; rare: which of them aren't frequent)."""
    a, own, out = len(h), band(len(h)), []
    for u in (own, 2 * own):
        if u != own and 100 * a <= percent * own:
            break
        d = most_difference(a, min(a * 100 // percent, u), percent)
        if u <= SINGLES:
            tokens, common = mix(h + U64(u)), ~rare
        else:
            part = ((h >> U64(32)) * U64(int(u * PARTITIONS))) >> U64(32)
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            tokens = mix(np.add.reduceat(mix(h), at) + mix(part[at] + U64(u << 32)))
            common = ~np.logical_or.reduceat(rare, at)
        key = (tokens >> U64(1)) | (common.astype(U64) << U64(63))
        if d + 1 < len(key):
            key = np.partition(key, d)[: d + 1]
        out.append(key)
    return np.concatenate(out)


ENTRY = np.dtype([("s", "<u4"), ("e", "<i8")])
STAR = np.dtype([("b", "<i4"), ("s", "<u4"), ("c", "<i8"), ("e", "<i8")])


def _runs(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def _stars(sig: np.ndarray, entity: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct signatures with their smallest member; (index of signature, centre, member) of the others."""
    order = np.argsort(sig, kind="stable")
    sig, entity = sig[order], entity[order]
    at = _runs(sig)
    low = np.minimum.reduceat(entity, at) if len(at) else entity
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(sig)]))
    other = entity != low[group]
    return sig[at], low, group[other], low[group[other]], entity[other]


def _often(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of that many sets at least, and of how many. Empties the list, and sorts in place, to hold the elements once."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    sets.clear()
    flat.sort()
    ahead = flat[least - 1 :]
    hit = ahead[ahead == flat[: len(ahead)]]
    values = hit[_runs(hit)]
    return values, np.searchsorted(flat, values, "right") - np.searchsorted(flat, values, "left")


def read_sets(docs: DataFrame, n_words: int) -> DataFrame:
    """Of each row: id, key, n, entity (hash of its set), bits; with kind 1, frequent shingles of a batch and their counts there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["kind", "id", "key", "n", "entity", "bits"]

        def returned(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            kinds[1] = batch.column(0).type
            ids, keys, rows, held = batch.column(0).to_pylist(), batch.column(2).to_pylist(), [], []
            for i, k, h in zip(ids, keys, shingle_sets(batch.column(1), n_words), strict=True):
                rows.append((0, i, k, len(h), set_key(h) if len(h) else None, bitmap(h) if len(h) else None))
                held.append(h)
                if len(rows) == ROWS:
                    yield returned(rows)
                    rows = []
            values, counts = _often(held, max(4, math.ceil(len(ids) * FREQUENT * 2)))
            yield returned(rows + [(1, None, None, c, v, None) for v, c in zip(values.view(np.int64).tolist(), counts.tolist(), strict=True)])

    return docs.mapInArrow(read, f"kind int, id {docs.schema['id'].dataType.simpleString()}, key long, n long, entity long, bits binary")


def star_links(docs: DataFrame, frequent: np.ndarray, buckets: int, n_words: int, percent: int) -> DataFrame:
    """(sig, center, member): the sets of each shared signature, linked with the smallest of their task and that of all tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        entities: list[int] = []
        seen: set[int] = set()
        salt, known = 0, shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            """Deals what is held, a range of buckets at a time, so that the sorted copies are of a range only."""
            sig = np.concatenate(sigs) if sigs else np.zeros(0, U64)
            who = np.repeat(np.arange(len(sigs), dtype=np.int32), [len(s) for s in sigs])
            entity = np.array(entities, dtype=np.int64)
            sigs.clear(), entities.clear(), seen.clear()
            bucket = _bucket(sig)
            for k in range(RANGES):
                own = np.flatnonzero((bucket >= buckets * k // RANGES) & (bucket < buckets * (k + 1) // RANGES))
                if len(own):
                    yield dealt_range(sig[own], entity[who[own]])

        def _bucket(sig: np.ndarray) -> np.ndarray:
            return ((sig & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int32)

        def dealt_range(sig: np.ndarray, entity: np.ndarray) -> pa.RecordBatch:
            nonlocal salt
            rows = []
            sig, low, group, center, member = _stars(sig, entity)
            bucket, high = _bucket(sig), (sig >> U64(32)).astype(np.uint32)
            star = np.zeros(len(group), dtype=STAR)
            star["b"], star["s"], star["c"], star["e"] = bucket[group], high[group], center, member
            for k in range(0, len(star), 20_000):  # passed on: to any bucket
                salt += 1
                rows.append(((salt * 7919) % buckets, 1, star[k : k + 20_000].tobytes()))
            order = np.argsort(bucket, kind="stable")
            entry = np.zeros(len(sig), dtype=ENTRY)
            entry["s"], entry["e"] = high[order], low[order]
            ends = np.r_[(at := _runs(bucket[order])), len(sig)]
            rows += [(int(bucket[order[a]]), 0, entry[a:b].tobytes()) for a, b in zip(at.tolist(), ends[1:].tolist(), strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "data"])

        held = 0
        for batch in batches:
            for h in shingle_sets(batch.column(1), n_words):
                if not len(h) or (key := set_key(h)) in seen:
                    continue
                seen.add(key)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                s = signatures(h, known[at] != h if len(known) else np.ones(len(h), bool), percent)
                sigs.append(s), entities.append(key)
                held += len(s)
                if held >= FLUSH:
                    held = 0
                    yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, at = ["sig", "center", "member"], [], None

        def rows(b, s, c, e) -> pa.RecordBatch:
            sig = (np.asarray(b, dtype=np.int64) << 32) | s.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.ascontiguousarray(c)), pa.array(np.ascontiguousarray(e))], names=names)

        def join() -> pa.RecordBatch:
            entry = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in held])
            sig, _, group, center, member = _stars(entry["s"], entry["e"])
            return rows(np.full(len(group), at), sig[group], center, member)

        for batch in batches:
            for bucket, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind:
                    star = np.frombuffer(data, dtype=STAR)
                    yield rows(star["b"], star["s"], star["c"], star["e"])
                    continue
                if held and bucket != at:
                    yield join()
                    held = []
                at = bucket
                held.append(data)
        if held:
            yield join()

    dealt = docs.mapInArrow(deal, "bucket int, kind int, data binary")
    spread = dealt.repartition(max(1, min(buckets, 20_000)), "bucket").sortWithinPartitions("bucket", "kind")
    return spread.mapInArrow(meet, "sig long, center long, member long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b). Alternates large-star and small-star until nothing changes."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    old, last = mark(e), e
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        joined = e.join(low, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e, before = cut(e.filter("u > v").distinct()), last
        discard(before)
        last, new = e, mark(e)
        if new == old:
            break
        old = new
    return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("comp"))


class Join:
    """The steps of one join, over tables in the shared folder."""

    def __init__(self, docs: DataFrame, n_words: int, percent: int) -> None:
        self.docs, self.n_words, self.percent = docs, n_words, percent
        self.read = cut(read_sets(docs, n_words))
        self.rows = self.read.filter("kind = 0").select("id", "key", "n", "entity")
        self.sets = cut(self.read.filter("kind = 0 and n > 0").groupBy("entity").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    def stars(self) -> DataFrame:
        docs, shingles = self.rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        often = self.read.filter("kind = 1").groupBy("entity").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(4, docs * FREQUENT))
        rows = often.orderBy(F.desc("n"), "entity").limit(MAX_FREQUENT).select("entity").toPandas()
        frequent = rows["entity"].to_numpy(dtype=np.int64).view(U64)
        return cut(star_links(self.docs, frequent, max(1, int(shingles * 0.5) // BUCKET), self.n_words, self.percent))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of sets that link."""
        percent, n_words = self.percent, self.n_words
        side = lambda x: self.sets.select(F.col("entity").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"), F.col("key").alias(f"i{x}"))

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")]
                keep = [
                    100 * min(na, nb) >= percent * max(na, nb) and least_difference(sa, sb) <= most_difference(na, nb, percent)
                    for na, nb, sa, sb in zip(*cols, strict=True)
                ]
                yield batch.select(["a", "b", "ia", "ib"]).filter(pa.array(keep, pa.bool_()))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    part = batch.slice(k, 500)
                    data = [h.tobytes() for h in shingle_sets(part.column(1), n_words)]
                    keys = [set_key(np.frombuffer(x, dtype=U64)) if x else None for x in data]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["entity", "data"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column("da"), batch.column("db"), strict=True):
                    p, q = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                    at = np.searchsorted(q, p)
                    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                    keep.append(100 * common >= percent * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb", "ia", "ib")
        near = cut(near.mapInArrow(prune, "a long, b long, ia long, ib long"))
        keys = cut(near.select(F.col("ia").alias("key")).unionByName(near.select(F.col("ib").alias("key"))).distinct())
        texts = self.docs.join(maybe_broadcast(keys, BROADCAST_IDS), "key", "left_semi").select("id", "text")
        data = cut(texts.mapInArrow(sets, "entity long, data binary").filter("entity is not null").dropDuplicates(["entity"]))
        full = near.select("a", "b").join(data.select(F.col("entity").alias("a"), F.col("data").alias("da")), "a")
        full = full.join(data.select(F.col("entity").alias("b"), F.col("data").alias("db")), "b")
        out = cut(full.select("a", "b", "da", "db").mapInArrow(compare, "a long, b long"))
        discard(near, keys, data)
        return out

    def shared(self, stars: DataFrame) -> DataFrame:
        """(sig, m, entity): the members of each group of three and more sets that share a signature. Star links have been tested, so
        only these have other pairs. Of groups with the same members one is kept."""
        part = stars.select("sig", F.col("center").alias("entity")).unionByName(stars.select("sig", F.col("member").alias("entity"))).distinct()
        what = F.sum(F.xxhash64("entity").cast("decimal(38,0)")).alias("what")
        groups = part.groupBy("sig").agg(F.count("*").alias("m"), what).filter("m > 2").groupBy("m", "what").agg(F.min("sig").alias("sig"))
        return cut(part.join(groups.select("sig", "m"), "sig").select("sig", "m", "entity"))

    def cross_pairs(self, shared: DataFrame, labels: DataFrame, forest: bool) -> DataFrame:
        """Pairs of sets that share a signature but no component yet, unless their bitmaps rule them out. forest: only in groups above
        FOREST, and there of each block only pairs of sets and their nearest partners across, as many as would join its components."""
        percent = self.percent
        part = shared.filter(F.col("m") > FOREST) if forest else shared
        part = part.join(labels.select(F.col("node").alias("entity"), "comp"), "entity", "left").withColumn("comp", F.coalesce("comp", "entity"))
        groups = part.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
        part = part.join(groups.select("sig"), "sig").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        part = part.withColumn("own", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
        part = part.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        part = part.select("sig", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "entity", "comp")
        part = part.join(self.sets.select("entity", "n", "bits"), "entity").repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], None

            def block() -> pa.RecordBatch:
                held.sort(key=lambda r: r[2])
                entity, comp, n = (np.array([r[i] for r in held], dtype=np.int64) for i in range(3))
                own = np.array([r[4] for r in held])
                words = np.array([len(r[3]) // 8 for r in held])
                # Bitmaps by width, those of twice the width folded: partners are at most one band apart.
                tables = {}
                for w in np.unique(words).tolist():
                    end = int(np.searchsorted(words, 2 * w, side="right"))
                    rows = np.zeros((end, w), dtype=U64)
                    for i in range(int(np.searchsorted(words, w)), end):
                        x = np.frombuffer(held[i][3], dtype=U64)
                        rows[i] = x if len(x) == w else x[:w] ^ x[w:]
                    tables[w] = rows
                a, b, gap = [], [], []
                for i in range(len(held) - 1):
                    rows = tables[int(words[i])]
                    end = min(len(rows), int(np.searchsorted(n, n[i] * 100 // percent, side="right")))
                    j = i + 1 + np.flatnonzero(comp[i + 1 : end] != comp[i])
                    if at[1] != at[2]:
                        j = j[own[j] != own[i]]
                    if len(j):
                        least = np.bitwise_count(rows[j] ^ rows[i]).sum(1, dtype=np.int64)
                        fit = least <= most_difference(n[i], n[j], percent)
                        a.append(np.full(int(fit.sum()), i)), b.append(j[fit]), gap.append(least[fit])
                a, b, gap = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, gap))
                if forest and len(a):
                    who, pair = np.r_[a, b], np.r_[np.arange(len(a)), np.arange(len(a))]
                    order = np.lexsort((entity[np.r_[b, a]], np.r_[gap, gap], who))
                    pair = np.unique(pair[order][_runs(who[order])])
                    keep = _joining(comp[a[pair]].tolist(), comp[b[pair]].tolist(), np.lexsort((pair, gap[pair])).tolist())
                    a, b = a[pair[keep]], b[pair[keep]]
                return pa.RecordBatch.from_arrays([pa.array(entity[a]), pa.array(entity[b])], names=["a", "b"])

            for batch in batches:
                names = ("sig", "p", "q", "entity", "comp", "n", "bits", "own")
                for sig, p, q, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if held and at != (sig, p, q):
                        yield block()
                        held = []
                    at = sig, p, q
                    held.append(row)
            if held:
                yield block()

        return _ordered(part.mapInArrow(test, "a long, b long"))


def _joining(x: list[int], y: list[int], order: list[int], root: dict[int, int] | None = None) -> list[int]:
    """Of the edges x[k], y[k], tried in that order, those that join what earlier ones (and root, which takes them up) haven't."""
    root = {} if root is None else root

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    out = []
    for k in order:
        p, q = find(x[k]), find(y[k])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append(k)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rows(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int) -> DataFrame:
    """id, key (hash of id and text), n and root (an entity of its component, null of an empty set) of every row."""
    text = F.col(text_col).cast("string")
    join = Join(docs.select(F.col(id_col).alias("id"), text.alias("text"), row_key(id_col, text).alias("key")), n_words, percent)
    stars = join.stars()
    links = _ordered(stars.select(F.col("member").alias("a"), F.col("center").alias("b")))
    best = stars.groupBy("member", "center").agg(F.count("*").alias("n")).groupBy("member").agg(F.max(F.struct("n", "center")).alias("c"))
    tried = cut(_ordered(best.select(F.col("member").alias("a"), F.col("c.center").alias("b"))))
    edges = join.verify(tried)
    labels = cut(components(edges))
    # The other star links across components, then nearest partners, then all pairs across that are left.
    shared = join.shared(stars)
    comp = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    for step in ("stars", "forest", "all"):
        if step != "stars":
            pairs = join.cross_pairs(shared, labels, step == "forest")
        else:
            across = links.join(comp("a"), "a", "left").join(comp("b"), "b", "left")
            pairs = across.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        if not small(pairs, 0):
            tried, found = tried.unionByName(pairs), join.verify(pairs)
            if not small(found, 0):
                edges = edges.unionByName(found)
                labels = cut(components(edges))
    discard(stars, shared)
    rows = join.rows.join(labels, join.rows["entity"] == labels["node"], "left").withColumn("root", F.coalesce("comp", "entity"))
    return rows.select("id", "key", "n", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    rows = cut(_rows(docs, id_col, text_col, n_words, percent))
    # Of a component of one row its own id: only the others' lowest ids are joined.
    lowest = rows.filter("root is not null").groupBy("root").agg(F.min("id").alias("low"), F.count("*").alias("rows")).filter("rows > 1")
    rows = rows.join(maybe_broadcast(cut(lowest.drop("rows")), BROADCAST_IDS), "root", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT, most: int = BROADCAST_IDS) -> DataFrame:
    """docs with exactly one row of each component: of the smallest id (null ids last), then of the smallest hash of id and text, of rows
    equal in both any one. Rows with empty sets stay. Rows keep all their columns."""
    rows = _rows(docs, id_col, text_col, n_words, percent).filter("root is not null").groupBy("root", "id", "key").agg(F.count("*").alias("n"))
    rows = cut(rows)
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key")).alias("best"), F.sum("n").alias("of"))
    best = cut(best.filter("of > 1").select("root", F.col("best.key").alias("best")))
    rows = cut(rows.join(maybe_broadcast(best, BROADCAST_IDS), "root").select("id", "n", "key", (F.col("key") == F.col("best")).alias("stays")))
    pick = lambda what: rows.filter(what).select(F.col("key").alias("__key"), F.col("id").alias("__of"))
    key = row_key(id_col, F.col(text_col).cast("string"))
    return without_rows(docs, key, id_col, pick("not stays"), pick("stays and n > 1"), most)
