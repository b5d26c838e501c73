"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary reaches across (before a word's space, around line ends), which no merge can cross; equal
units of a slice of rows are merged once. All units of a slice lie in one flat array of symbols. In a round each unit finds the best rank
of its pairs (a segmented minimum), merges all pairs of that rank from the left, without overlaps, and the array is compacted; units
without a pair leave. If a merge would bring a pair of a better rank than the round's, the unit's merges after it wait, so that the
result is that of merging one pair at a time. Units of more than ``LONG`` symbols take their pairs from a heap instead, for their rounds could be as
many as their merges.

Contract of :func:`encode`
* null text counts as empty; empty text has no ids; texts of any length are encoded whole, one row at a time if a row is above ``SLICE`` bytes;
* ids are those of the sentencepiece library for the model, without begin and end ids and without sampling; ``▁`` counts as a space;
* the model must be a BPE model with byte fallback, a dummy prefix, kept and escaped spaces and no other normalization, without user-defined
  or unused pieces; any other raises ValueError;
* bytes that aren't UTF-8 become U+FFFD; repeated and null ids, and empty tables, are rows like others;
* the result has the id and ``ids``; other columns are not read, so they can't clash.

Contract of :func:`decode`: null ids stay null; byte pieces that aren't UTF-8 become U+FFFD, one for each byte; begin and end ids vanish; ids
outside the vocabulary, and null ones among others, raise IndexError; an id column of any type is passed on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import byte_slices

MODEL = "piece_bpe_32k.model"
#: Bytes of text encoded, and of ids decoded, at once, and symbols above which a unit is merged from a heap.
SLICE, LONG = 3 << 20, 1000
#: Codes of characters that no piece holds start here; a rank that no pair has.
UNKNOWN, NONE = 1 << 26, np.iinfo(np.int32).max


class Vocabulary:
    """The tables of a model: symbols of characters, ranks and results of pairs, bytes of pieces."""

    def __init__(self, file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not plain or kinds & {4, 5}:
            raise ValueError(f"{file}: not a BPE model with byte fallback and unchanged spaces")
        own = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.size = len(model.pieces)
        code = dict(own)
        for piece in own:
            for c in piece:
                code.setdefault(c, self.size + len(code))
        best = sorted({model.pieces[i].score for i in own.values()}, reverse=True)
        place = {s: r for r, s in enumerate(best)}
        pairs = []
        for piece, i in own.items():
            for k in range(1, len(piece)):
                a, b = code.get(piece[:k]), code.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, place[model.pieces[i].score], i))
        pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.results = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32), pairs[:, 2].copy()
        self.of_char = np.arange(0x110000, dtype=np.int64) + UNKNOWN
        for c, i in code.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[32] = self.of_char[ord("▁")]
        # Whether two neighbouring bytes may belong to one piece, or do belong to one character.
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for piece in own:
            raw = np.frombuffer(piece.replace("▁", " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.joined = self.joined.ravel()
        self.byte_ids = np.zeros(256, np.int64)
        said = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            said.append({1: p.piece.replace("▁", " ").encode(), 2: " ⁇ ".encode(), 3: b""}.get(p.type) if p.type != 6 else bytes([int(p.piece[3:5], 16)]))
        self.said = pa.array(said, pa.binary())
        self.is_byte = np.array([p.type == 6 for p in model.pieces])
        self.silent = np.array([p.type == 3 for p in model.pieces])
        self.char_of = {i: c for c, i in code.items() if i >= self.size}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and result of each pair."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.results[at], 0)


@lru_cache(maxsize=4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


def _heap_merge(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """One unit, a pair at a time: the best rank first, the leftmost of equals."""
    n, out = len(sym), sym.tolist()
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    ranks, results = v.look_up(sym[:-1], sym[1:])
    todo = [(r, i, out[i], out[i + 1], z) for i, (r, z) in enumerate(zip(ranks.tolist(), results.tolist(), strict=True)) if r != NONE]
    heapq.heapify(todo)
    known: dict[tuple[int, int], tuple[int, int]] = {}
    while todo:
        _, i, a, b, z = heapq.heappop(todo)
        j = right[i]
        if not alive[i] or j < 0 or out[i] != a or out[j] != b:
            continue
        out[i], alive[j], right[i] = z, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for p in (left[i], i):
            q = right[p] if p >= 0 else -1
            if q >= 0:
                pair = (out[p], out[q])
                if pair not in known:
                    rank, result = v.look_up(np.array(pair[:1]), np.array(pair[1:]))
                    known[pair] = int(rank[0]), int(result[0])
                rank, result = known[pair]
                if rank != NONE:
                    heapq.heappush(todo, (rank, p, *pair, result))
    return np.array([s for s, live in zip(out, alive, strict=True) if live], dtype=np.int64)


def merge_rounds(v: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths of all units after their merges."""
    total = len(lengths)
    unit = np.repeat(np.arange(total), lengths)
    done_sym, done_unit = [], []
    for u in np.flatnonzero(lengths > LONG):
        merged = _heap_merge(v, sym[slice(*np.searchsorted(unit, [u, u + 1]))])
        done_sym.append(merged)
        done_unit.append(np.full(len(merged), u))
    short = lengths[unit] <= LONG
    sym, unit = sym[short], unit[short]
    rank, result = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
    dirty = np.flatnonzero(unit[:-1] == unit[1:])
    while len(sym):
        rank[dirty], result[dirty] = v.look_up(sym[dirty], sym[dirty + 1])
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(sym)])
        best = np.repeat(best, sizes)
        if (best == NONE).any():  # units without a pair leave
            gone = best == NONE
            done_sym.append(sym[gone])
            done_unit.append(unit[gone])
            stay = ~gone
            sym, unit, rank, result, best = sym[stay], unit[stay], rank[stay], result[stay], best[stay]
            if not len(sym):
                break
        at = np.flatnonzero(rank == best)
        first = np.r_[True, at[1:] != at[:-1] + 1]  # of neighbouring candidates every other one is taken
        nth = np.arange(len(at))
        take = at[(nth - np.maximum.accumulate(np.where(first, nth, 0))) % 2 == 0]
        same = unit[take[1:]] == unit[take[:-1]]
        if same.any():
            take = take[~_waits(v, sym, unit, best, result, take, same)]
        sym[take] = result[take]
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        place = np.cumsum(keep) - 1
        sym, unit, rank, result = sym[keep], unit[keep], rank[keep], result[keep]
        new = place[take]
        rank[new] = NONE  # the last symbol of a unit has no pair
        changed = np.zeros(len(sym), bool)
        changed[new] = changed[new[new > 0] - 1] = True
        dirty = np.flatnonzero(changed[:-1] & (unit[:-1] == unit[1:]))
    if not done_sym:
        return sym, np.zeros(total, np.int64)
    sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
    return sym[np.argsort(unit, kind="stable")], np.bincount(unit, minlength=total)


def _waits(v: Vocabulary, sym, unit, best, result, take, same) -> np.ndarray:
    """Of the merges of a round, those after one that brings its unit a pair better than the round's."""
    n = len(sym)
    merged = result[take]
    near = np.r_[False, same & (take[1:] == take[:-1] + 2)]  # the symbol to the left has just been merged
    before = np.where(near, np.r_[0, merged[:-1]], sym[np.maximum(take - 1, 0)])
    has_left = (take > 0) & (unit[np.maximum(take - 1, 0)] == unit[take])
    after = np.minimum(take + 2, n - 1)
    has_right = (take + 2 < n) & (unit[after] == unit[take])
    better = (v.look_up(before, merged)[0] < best[take]) & has_left | (v.look_up(merged, sym[after])[0] < best[take]) & has_right
    first = np.r_[True, ~same]
    earlier = np.cumsum(better) - better
    return earlier - np.repeat(earlier[first], np.diff(np.r_[np.flatnonzero(first), len(take)])) > 0


def encode_texts(v: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of UTF-8 texts, flat, and the number of each text's."""
    raw = [b" " + t.replace("▁".encode(), b" ") if t else b"" for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    data = b"".join(raw)
    if not data:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    buf = np.frombuffer(data, np.uint8)
    start = np.ones(len(buf), bool)
    start[1:] = ~v.joined[buf[:-1].astype(np.uint16) << 8 | buf[1:]]
    start[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(start)
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(buf)].astype(np.int64)), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    code, kinds = coded.indices.to_numpy(), coded.dictionary
    offsets = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
    kind_data = kinds.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    points = np.frombuffer(kind_data.decode().encode("utf-32-le"), np.uint32)
    is_char = (np.frombuffer(kind_data, np.uint8) & 0xC0) != 0x80
    lengths = np.add.reduceat(is_char.astype(np.int64), offsets[:-1])
    sym, lengths = merge_rounds(v, v.of_char[points], lengths)
    sym, lengths = _fall_back(v, sym, lengths)
    begins = np.cumsum(lengths) - lengths
    size = lengths[code]
    run = np.cumsum(size) - size
    ids = sym[np.repeat(begins[code] - run, size) + np.arange(size.sum())]
    first_unit = np.searchsorted(at, ends)
    filled = np.r_[run, len(ids)]
    return ids, np.diff(filled[first_unit])


def _fall_back(v: Vocabulary, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no pieces become the ids of their bytes."""
    odd = np.flatnonzero(sym >= v.size)
    if not len(odd):
        return sym, lengths
    kinds, which = np.unique(sym[odd], return_inverse=True)
    spelled = [v.byte_ids[np.frombuffer((chr(k - UNKNOWN) if k >= UNKNOWN else v.char_of[k]).encode(), np.uint8)] for k in kinds.tolist()]
    size = np.ones(len(sym), np.int64)
    size[odd] = np.array([len(s) for s in spelled])[which]
    run = np.cumsum(size) - size
    out = np.repeat(sym, size)
    for k in range(4):
        has = size[odd] > k
        out[run[odd[has]] + k] = np.array([s[k] if len(s) > k else 0 for s in spelled])[which[has]]
    unit = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(np.repeat(unit, size), minlength=len(lengths))


def _repair(ids: np.ndarray, v: Vocabulary) -> str:
    """Decoded text of a sequence whose byte pieces aren't UTF-8: a U+FFFD for each byte that begins no character."""
    out, run = [], bytearray()

    def flush() -> None:
        at = 0
        while at < len(run):
            for k in range(1, 5):
                try:
                    out.append(bytes(run[at : at + k]).decode())
                    at += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        run.clear()

    for i in ids.tolist():
        if v.is_byte[i]:
            run.extend(v.said[i].as_py())
        else:
            flush()
            out.append(v.said[i].as_py().decode())
    flush()
    return "".join(out)


def decode_ids(v: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Texts of sequences of ids, which lie one after another."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < v.size:
        raise IndexError("piece id is out of range")
    ends = np.r_[0, np.cumsum(lengths)]
    parts = v.said.take(pa.array(ids))
    data = parts.buffers()[2].to_pybytes() if len(parts) else b""
    places = np.frombuffer(parts.buffers()[1], np.int32)[: len(ids) + 1][ends] if len(parts) else ends
    out = []
    for k, (a, b) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)):
        own = ids[ends[k] : ends[k + 1]]
        try:
            text = data[a:b].decode()
        except UnicodeDecodeError:
            text = _repair(own, v)
        lead = own[~v.silent[own]][:1]
        out.append(text[1:] if len(lead) and not v.is_byte[lead[0]] and lead[0] and text[:1] == " " else text)
    return out


def _file(folder: str | None, model: str) -> str:
    import public_tokenizers as P

    return f"{folder}/{model}" if folder else P.path(model)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, model: str = MODEL, slice_bytes: int = SLICE) -> DataFrame:
    """The id and ``ids``, array<int>, of every row. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_file(folder, model))
        for batch in batches:
            for a, b in byte_slices(pc.binary_length(batch.column(1)).to_pylist(), slice_bytes):
                ids, n = encode_texts(v, batch.column(1).slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit("")).cast("binary")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text.alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(sequences: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", folder: str | None = None, model: str = MODEL, slice_bytes: int = SLICE) -> DataFrame:
    """The id, ``ids`` and their ``decoded`` text. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_file(folder, model))
        for batch in batches:
            lists = batch.column(1)
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            for a, b in byte_slices((4 * n).tolist(), slice_bytes):
                own = lists.slice(a, b - a)
                flat = own.flatten()
                if flat.null_count:
                    raise IndexError("piece id is null")
                texts = decode_ids(v, flat.to_numpy(zero_copy_only=False).astype(np.int64), n[a:b])
                texts = pa.array([t if ok else None for t, ok in zip(texts, own.is_valid().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), own, texts], names=[id_col, "ids", "decoded"])

    kind = sequences.schema[id_col].dataType.simpleString()
    return sequences.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
