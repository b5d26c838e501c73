"""Minimum-bin-slack packing of token sequences.

Every document is cut into full windows and a remainder. Remainders meet only as a histogram of their lengths (fewer than 2,048
counts). For each window a bitset subset-sum finds the multiset of remaining lengths that comes closest to capacity, counts are
backtracked, and the pattern is used as often as the counts allow. Remainders are then numbered within their length, in buckets of
bounded size, and take their places in the patterns.

Contract of :func:`pack`
* null text counts as empty; an empty document is its end mark alone; documents of any length are packed whole;
* ids are those of the byte-level BPE vocabulary, then the end mark 1; every id is in exactly one piece;
* a sequence holds at most ``window`` ids and is padded to it, unless it holds a power of two;
* ids may repeat or be null: each row is packed for itself; rows with equal id and remainder length are numbered by their checksum;
  reruns agree up to the order of rows that are equal in all of these;
* an empty table yields no pieces; only the id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import cut

WINDOW, END = 2048, 1
#: Remainders of one length to a bucket of the numbering.
BUCKET_ROWS = 20_000


class Encoder:
    """Ids of the tokenizers file; tiktoken, three times as fast, gives the same ids from the same vocabulary's ranks."""

    def __init__(self, folder: str | None = None, name: str = "byte_bpe_50k"):
        import public_tokenizers as P
        import tiktoken

        self.file = f"{folder}/{name}.json" if folder else P.path(f"{name}.json")
        ranks_file = f"{folder}/{name}.tiktoken" if folder else P.path(f"{name}.tiktoken")
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def __call__(self, text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return self.fast.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.file)
        return self.exact.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """Full windows and remainders of every document, with their checksums. One scan, no shuffle."""
    id_type = docs.schema[id_col].dataType

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(folder)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END)
                raw, n = np.asarray(ids, dtype="<u4").tobytes(), len(ids)
                for at in range(0, n, window):
                    size = min(window, n - at)
                    for col, v in zip(rows, (key, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), n), strict=True):
                        col.append(v)
            types = [batch.column(0).type, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    schema = f"doc_id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(cut_up, schema)


def _power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def minimum_slack(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many windows it fills), until all counts are used.

    Each length's count is split into binary multiples, so a window costs one shift of a bitset per multiple. A sum that needs no
    padding (the window or a power of two) is preferred to a larger sum that does; the longest length left is always placed.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    free = [window, *sorted((1 << i for i in range(window.bit_length()) if (1 << i) < window), reverse=True)]
    while left:
        first = max(left)
        room = window - first
        steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before it
        sums, full = 1, (1 << (room + 1)) - 1
        want = 1 << room
        for length in sorted(left, reverse=True):
            most = min(left[length] - (length == first), room // length)
            k = 1
            while most > 0:
                k = min(k, most)
                steps.append((length, k, sums))
                sums |= (sums << (length * k)) & full
                most -= k
                k *= 2
            if sums & want:
                break
        best = sums.bit_length() - 1
        total = next((t for t in free if t >= first and sums >> (t - first) & 1), first + best)
        at = total - first
        pattern = {first: 1}
        for length, k, before in reversed(steps):
            if not before >> at & 1:
                pattern[length] = pattern.get(length, 0) + k
                at -= length * k
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cutup = pieces(docs, id_col, text_col, window, folder)
    salt = F.xxhash64("doc_id", "start", "ids_crc32")
    cutup = cut(cutup.withColumn("salt", salt))
    counts = {int(r.length): int(r.n) for r in cutup.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS))
    numbered = cutup.withColumn("bucket", F.pmod("salt", F.lit(buckets)))
    sizes = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    numbered = numbered.withColumn("nth", within - 1).join(sizes, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("ahead"))

    # Places: of each length, runs of numbers that a pattern takes.
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    patterns = [({window: 1}, counts[window])] if window in counts else []
    for pattern, times in patterns + minimum_slack({k: v for k, v in counts.items() if k != window}, window):
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            plan.setdefault(length, []).append((used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in plan.items()})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            seq, off = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length):
                at, runs = np.flatnonzero(length == n), shared.value[int(n)]
                run = runs[np.searchsorted(runs[:, 0], nth[at], side="right") - 1]
                within, slot = np.divmod(nth[at] - run[:, 0], run[:, 1])
                seq[at], off[at] = run[:, 2] + within, run[:, 3] + slot * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kind = cutup.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return numbered.select(*names, F.col("nth").cast("long").alias("nth")).mapInArrow(place, schema)
