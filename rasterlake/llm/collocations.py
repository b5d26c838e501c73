"""Phrase collocation mining over packed word ids.

Words that occur often enough to be in a phrase get ids by descending count (joint for all languages, ``most_words`` at most: the broadcast
dictionary is bounded). Texts are tokenized again; pieces break at all other words. Pairs of neighbouring ids, then triples whose two pairs
are frequent (a bitmap of bounded size), are packed into one 64-bit key each, radix-sorted and run-length counted within a slice of rows,
dealt to ranges of keys, sorted there and run-length counted again, so a hot phrase is at most one row per slice when it is dealt.
Frequent words beyond the dictionary are kept apart by a bitmap, and n-grams that hold one are counted by their words. Scores are exact decimals.

Contract of :func:`mine`
* A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` ends a piece; words are ``[^\\x20\\x09]+``; null text counts as empty, null languages as ``und``;
* of each language the first ``top`` phrases by score, count (both descending) and phrase (by bytes); ranks have no ties;
* counts are over all rows and whole texts, repeated rows included; ids aren't read; the result has columns of its own only;
* a candidate inside a longer one of at least half its count is dropped, whether the longer one is dropped or not;
* an empty table yields no phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import byte_slices, cut, discard, maybe_broadcast, small

LEAST, TOP, SLICE = 10, 2000, 8 << 20
#: Bits of an id within a key; words of the dictionary, and bytes of the longest word in it.
ID_BITS, MOST_WORDS, LONGEST = 21, 1 << 20, 64
#: Bits of a bitmap: 16 for each key it holds, within these bounds (8 KB and 32 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Rows up to which a table of frequent phrases is broadcast to a join.
BROADCAST_ROWS = 50_000
#: Marks the end of a piece; no byte of UTF-8.
BREAK = b"\xff"
CLASSES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of non-negative 64-bit keys: a stable pass for each 16 bits that differ."""
    order = np.arange(len(keys))
    for shift in range(0, 64, 16):
        digit = (keys >> shift & 0xFFFF).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and how often they occur."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.diff(np.r_[at, len(keys)]) if counts is None else np.add.reduceat(counts, at)


def _tokens(texts: list[bytes]) -> pa.DictionaryArray:
    """Words of texts, one after another, with BREAK between pieces and texts."""
    whole = BREAK.join(texts).lower().translate(CLASSES).replace(BREAK, b" \xff ")
    return pa.array(whole.split(), pa.large_binary()).dictionary_encode()


def _by_lang(batch: pa.RecordBatch, most: int) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language in slices of a batch (columns: lang, text)."""
    for a, b in byte_slices(pc.binary_length(batch.column(1)).to_pylist(), most):
        group: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
            group.setdefault(lang, []).append(text)
        yield from group.items()


def count_words(texts: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """(lang, word, f) of all words, and f of all words together under a null word; counted within slices before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in _by_lang(batch, slice_bytes):
                coded = _tokens(own)
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                real = pc.not_equal(coded.dictionary, pa.scalar(BREAK, pa.large_binary()))
                words, n = coded.dictionary.filter(real).cast(pa.binary()), n[real.to_numpy(zero_copy_only=False)]
                words, n = pa.concat_arrays([words, pa.nulls(1, pa.binary())]), np.r_[n, n.sum()].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), words.cast(pa.string()), pa.array(n)], names=["lang", "word", "f"])

    return texts.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Dictionary:
    """Words of each language with their ids (consecutive within a language's list) and counts, all sorted by descending count."""

    def __init__(self, table: pa.Table):
        langs, words = table["lang"].to_pylist(), table["word"].cast(pa.large_binary()).combine_chunks()
        self.words, self.counts = words, table["f"].to_numpy()
        place: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            place.setdefault(lang, []).append(i)
        self.ids = {lang: np.array(at, dtype=np.int64) for lang, at in place.items()}
        self.of_lang = {lang: words.take(pa.array(at)) for lang, at in self.ids.items()}

    def look_up(self, lang: str, words: pa.Array) -> np.ndarray:
        if lang not in self.ids:
            return np.full(len(words), -1, np.int64)
        at = pc.index_in(words, value_set=self.of_lang[lang])
        found = at.is_valid().to_numpy(zero_copy_only=False)
        return np.where(found, self.ids[lang][at.fill_null(0).to_numpy(zero_copy_only=False)], -1)


def bitmap(keys: DataFrame, key: str) -> np.ndarray | None:
    """Bits at the hashes of keys, gathered word by word; its size follows the count of keys and is bounded. None: no keys."""
    n = keys.count()
    if not n:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n - 1).bit_length()))
    at = F.pmod(_mix_column(F.col(key)), F.lit(bits)).alias("h")
    words = keys.select(at).select(F.expr("h div 32768").alias("word"), (F.col("h") % 32768).alias("place")).groupBy("word").agg(F.bitmap_construct_agg("place").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in words.toLocalIterator():
        out[row.word * 4096 : (row.word + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


#: An odd factor that spreads keys over a bitmap; products stay within 64 bits.
MIX = 0x9E3779B1


def _mix_column(key):
    return F.shiftrightunsigned((key % F.lit((1 << 31) - 1)) * F.lit(MIX), 17).bitwiseXOR(key)


def _in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h = ((keys % ((1 << 31) - 1) * MIX) >> 17 ^ keys) % (8 * len(bits))
    return bits[h >> 3] >> (h & 7).astype(np.uint8) & 1 == 1


def _grams(texts: DataFrame, size: int, shared, slice_bytes: int) -> DataFrame:
    """(key, n): n-grams of dictionary words, counted within slices. Triples only where both pairs are in the bitmap."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        for batch in batches:
            for lang, own in _by_lang(batch, slice_bytes):
                coded = _tokens(own)
                ids = words.look_up(lang, coded.dictionary)[coded.indices.to_numpy()]
                keys = (ids[:-1] << ID_BITS | ids[1:])[(ids[:-1] >= 0) & (ids[1:] >= 0)] if size == 2 else _triples(ids, pairs)
                keys, n = run_lengths(keys[radix_order(keys)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return texts.mapInArrow(count, "key long, n long")


def _triples(ids: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    if pairs is None or len(ids) < 3:
        return np.zeros(0, np.int64)
    known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    known = known[_in_bitmap(pairs, ids[known] << ID_BITS | ids[known + 1])]
    at = known[:-1][known[1:] == known[:-1] + 1]
    return (ids[at] << ID_BITS | ids[at + 1]) << ID_BITS | ids[at + 2]


def _tail_grams(texts: DataFrame, shared, slice_bytes: int) -> DataFrame:
    """(lang, words, f): pairs and triples with a frequent word that the dictionary has no room for, counted by their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, maybe = shared.value
        for batch in batches:
            for lang, own in _by_lang(batch, slice_bytes):
                coded = _tokens(own)
                kinds = coded.dictionary
                ids = words.look_up(lang, kinds)
                rank = np.zeros(len(ids), np.int8)  # 0: in the dictionary, 1: may be frequent, 2: rare or the end of a piece
                other = np.flatnonzero(ids < 0)
                said = kinds.take(pa.array(other)).to_pylist()
                hashes = np.array([zlib.crc32(lang.encode() + b"\0" + w) for w in said], dtype=np.int64)
                rank[other] = np.where(_in_bitmap(maybe, hashes) & (np.array(said, dtype=object) != BREAK), 1, 2)
                code = coded.indices.to_numpy()
                kind, found = rank[code], {}
                for size in (2, 3):
                    if len(code) < size:
                        continue
                    worst = np.max([kind[k : len(kind) - size + 1 + k] for k in range(size)], axis=0)
                    for i in np.flatnonzero(worst == 1).tolist():
                        phrase = tuple(code[i : i + size].tolist())
                        found[phrase] = found.get(phrase, 0) + 1
                said = [[kinds[k].as_py().decode() for k in p] for p in found]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(said), pa.string()), pa.array(said, pa.list_(pa.string())), pa.array(list(found.values()), pa.int64())], names=["lang", "words", "f"])

    return texts.mapInArrow(count, "lang string, words array<string>, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))


def _count_ranges(grams: DataFrame, least: int) -> DataFrame:
    """(key, n) of keys that occur ``least`` times: dealt to ranges, sorted there, run-length counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0
        for batch in batches:
            keys, n = run_lengths(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if not len(keys):
                continue
            if key is not None:  # the last key of a batch may go on in the next one
                if keys[0] == key:
                    n[0] += total
                else:
                    keys, n = np.r_[key, keys], np.r_[total, n]
            key, total = keys[-1], n[-1]
            often = n[:-1] >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][often]), pa.array(n[:-1][often])], names=["key", "n"])
        if key is not None and total >= least:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([total], pa.int64())], names=["key", "n"])

    return grams.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(count, "key long, n long")


def _spell(counted: DataFrame, size: int, langs: dict[int, str], shared) -> DataFrame:
    """(lang, words, f, f1 .. fn) of packed keys: words and their counts come from the dictionary."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = shared.value[0], langs.value
        for batch in batches:
            key = batch.column(0).to_numpy()
            ids = np.stack([key >> ID_BITS * k & (1 << ID_BITS) - 1 for k in range(size - 1, -1, -1)], 1)
            said = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(key) + 1, size, dtype=np.int32)), words.words.take(pa.array(ids.ravel())).cast(pa.binary()).cast(pa.string()))
            own = pa.ListArray.from_arrays(pa.array(np.arange(0, size * len(key) + 1, size, dtype=np.int32)), pa.array(words.counts[ids.ravel()]))
            yield pa.RecordBatch.from_arrays([of.take(pa.array(ids[:, 0])), said, batch.column(1), own], names=["lang", "words", "f", "each"])

    return counted.mapInArrow(spell, "lang string, words array<string>, f long, each array<long>")


def _top(scored: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first rows of each language: first of each part of a language, then of the parts' firsts."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, slice_bytes: int = SLICE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's collocations of two and three words."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    words = cut(count_words(texts, slice_bytes).filter(F.col("word").isNull() | (F.col("f") >= least)))
    frequent = words.filter(F.col("word").isNotNull())
    held = frequent.filter(F.octet_length("word") <= LONGEST).orderBy(F.col("f").desc(), "lang", "word").limit(min(most_words, 1 << ID_BITS)).toArrow()
    dictionary = Dictionary(held)
    broadcast = spark.sparkContext.broadcast
    langs = broadcast(held["lang"].combine_chunks())
    shared = broadcast((dictionary, None))
    partial = cut(_grams(texts, 2, shared, slice_bytes))
    pairs = cut(_count_ranges(partial, least))
    discard(partial)
    with_pairs = broadcast((dictionary, bitmap(pairs, "key")))
    partial = cut(_grams(texts, 3, with_pairs, slice_bytes))
    triples = cut(_count_ranges(partial, least))
    discard(partial)
    two, three = _spell(pairs, 2, langs, shared), _spell(triples, 3, langs, shared)
    if not small(frequent, held.num_rows):  # words beyond the dictionary
        chosen = spark.createDataFrame(held.select(["lang", "word"])) if held.num_rows else frequent.select("lang", "word").limit(0)
        tail = cut(frequent.join(chosen, ["lang", "word"], "left_anti"))
        maybe = bitmap(tail.select(F.crc32(F.concat("lang", F.lit("\0"), "word")).alias("key")), "key")
        rest = cut(_tail_grams(texts, broadcast((dictionary, maybe)), slice_bytes).filter(F.col("f") >= least))
        at = rest.select("lang", "words", "f", F.posexplode("words").alias("k", "word"))
        of_word = frequent.select("lang", "word", F.col("f").alias("own"))
        each = at.join(of_word, ["lang", "word"]).groupBy("lang", "words", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: x["own"]).alias("each"))
        each = cut(each.select("lang", "words", "f", "each"))
        two, three = two.unionByName(each.filter("size(words) = 2")), three.unionByName(each.filter("size(words) = 3"))
    return _top(_score(two, three, words), top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _score(two: DataFrame, three: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one covers."""
    two = cut(two.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.col("each")[0].alias("l"), F.col("each")[1].alias("r")))
    head, tail = F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " ")
    three = cut(three.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), head.alias("head"), tail.alias("tail"), F.col("each")[0].alias("first"), F.col("each")[2].alias("last")))
    covers = three.select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = two.join(maybe_broadcast(covers, BROADCAST_ROWS), ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * a").drop("longer")
    inner = maybe_broadcast(two.select("lang", F.col("phrase").alias("inner"), F.col("a").alias("f")), BROADCAST_ROWS)
    part = lambda col, f: inner.withColumnsRenamed({"inner": col, "f": f})
    three = three.join(part("tail", "f_tail"), ["lang", "tail"]).join(part("head", "f_head"), ["lang", "head"])
    score = lambda l, r: F.expr(f"cast(1000000 as decimal(38,0)) * a * a div (cast({l} as decimal(38,0)) * {r})")
    one, other = score("first", "f_tail"), score("f_head", "last")
    low = one <= other
    three = three.select("lang", "phrase", "a", F.when(low, F.col("first")).otherwise(F.col("f_head")).alias("l"), F.when(low, F.col("f_tail")).otherwise(F.col("last")).alias("r"), F.least(one, other).cast("long").alias("score"))
    both = kept.withColumn("score", score("l", "r").cast("long")).unionByName(three)
    totals = maybe_broadcast(words.filter("word is null").select("lang", F.col("f").alias("n")), BROADCAST_ROWS)
    return both.join(totals, "lang")
