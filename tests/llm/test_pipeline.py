"""The pipeline stage by stage, and queries whose results SQL can't express, against plain Python."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import chat, mixing, packing, queries

pipeline = pytest.importorskip("corpus_pipeline")
rnd = random.Random(11)
WORDS = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
prose = lambda n: " ".join(rnd.choices(WORDS, k=n))
bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    good = [prose(60) for _ in range(50)]
    bad = [" ".join(w.upper() + "!!" for w in prose(60).split()) for _ in range(30)]
    texts = [*good, *bad, good[0], good[1].replace(" ", "\n"), good[2] + " tail", None, "", prose(4000)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [(3, good[4], "en", "a", 5), (7, good[7], "en", "b", len(good[7])), (None, good[5], "en", "a", 5), (None, prose(50), "en", "c", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{top}/documents.parquet")
    labels = [(i, int(i < 50), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for n, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert n == 4 or docs.columns == columns
        seen.append(docs.collect())
    start, kept, unique, distinct, mixed, packed = seen
    upper = lambda r: bool(r.text) and r.text.isupper()
    assert [r for r in kept if not upper(r)] and not any(map(upper, kept))
    assert {bare(r.text) for r in unique} == {bare(r.text) for r in kept} and len(unique) == len({bare(r.text) for r in unique})
    assert all(r in kept for r in unique)
    # One row of each component of links, that of the smallest id.
    sets = [shingles(r.text) for r in unique]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root = [root[a] if x == root[b] else x for x in root]
    groups = {}
    for r, k, s in zip(unique, root, sets, strict=True):
        groups.setdefault(k if s else id(r), []).append(r)
    want = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in groups.values()]
    assert sorted(map(str, distinct)) == sorted(map(str, want)) and len(distinct) < len(unique)
    copies = {}
    for r in mixing.mix(spark.createDataFrame(distinct, docs_schema(spark, folder)), key=F.col("text")).collect():
        copies[r.doc_id, r.key] = r.copies
    got = {}
    for r in mixed:
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: v for k, v in copies.items() if v}
    tokens = packing.Encoder()
    assert sum(r.length for r in packed) == sum(len(tokens(r.text or "")) + 1 for r in mixed)
    whole = pipeline.run(spark, folder)
    assert sorted(map(str, whole.drop("sequence_id", "offset").collect())) == sorted(str(r) for r in spark.read.parquet(f"{tmp_path}/4").drop("sequence_id", "offset").collect())


def docs_schema(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").schema


def test_pieces_hold_the_ids_of_the_vocabulary(spark, folder):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.Encoder().file)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id > 7")
    by = {}
    for r in packing.pack(docs).collect():
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = [*exact.encode(d.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[d.doc_id], key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)


def test_repairs_cost_least():
    """All ways to repair up to four turns, written down from the rules rather than from the module's tables."""
    after = {None: "su", "s": "u", "u": "a", "a": "u"}

    def ways(state, roles):
        if not roles:
            yield {None: 0, "s": 4, "u": 2, "a": 0}[state]
            return
        role, rest = roles[0], roles[1:]
        if state and role in (state, "?"):
            yield from (1 + c for c in ways(state, rest))
        paths = [(0, r) for r in after[state]] + [(2, r) for mid in after[state] for r in after[mid]]
        for cost, new in paths:
            change = 0 if new == role else 1 if role == "?" else 3
            yield from (cost + change + c for c in ways(new, rest))

    number = {"s": chat.SYSTEM, "u": chat.USER, "a": chat.ASSISTANT, "?": None}
    for n in range(1, 5):
        for roles in itertools.product("sua?", repeat=n):
            costs, _ = chat.forward(list(chat.START), [number[r] for r in roles])
            assert min(costs[s] + chat.END[s][0] for s in range(4)) == min(ways(None, roles)), roles


def test_quality_of_rows_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op5_quality(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == v] for v in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([r.predicted == r.quality for r in rows])
    assert area > 0.85 and accuracy > len(good) / len(rows)
