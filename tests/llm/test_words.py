"""Piece encoding, collocations and word runs against the library, SQL and brute force, on odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from rasterlake.llm import collocations, periodic, queries, wordpieces

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, ids int, runs string, f long, word string, rank int"
rnd = random.Random(11)
WORDS = ["".join(rnd.choices("abcdeé日", k=rnd.randint(1, 6))) for _ in range(40)]
TEXTS = [None, "", " ", "\n\t \n", "▁ ▁a", "<s> <0x0A> \0 😀", "a" * 4000, "ab " * 3000, " ".join(rnd.choices(WORDS, k=5000)), "".join(rnd.choices("theandio", k=2500)), "the the the the the the", "x y x y x y x y, x y! The CAT. the cat"] + ["The old cat; of the old cat of"] * 12
ROWS = [(i, t, ["en", None, "de"][i % 3], 1, "r", 2, "w", 3) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, ROWS[8], (None, "a a a a a a", None, 1, "r", 2, "w", 3)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(wordpieces.MODEL))


def test_pieces(docs, empty, library):
    got = wordpieces.decode(wordpieces.encode(docs)).collect()
    want = {i: t or "" for i, t, *_ in ROWS} | {None: "a a a a a a"}
    assert len(got) == len(ROWS) + 2
    for r in got:
        assert r.ids == library.encode(want[r.doc_id]) and r.decoded == library.decode(r.ids)
    one = wordpieces.encode(docs, slice_bytes=1).collect()  # a row at a time
    assert sorted((str(r.doc_id), r.ids) for r in one) == sorted((str(r.doc_id), r.ids) for r in got)
    assert wordpieces.decode(wordpieces.encode(empty)).count() == 0


def test_pieces_of_many_strings(library):
    v = wordpieces.vocabulary(wordpieces._file(None, wordpieces.MODEL))
    texts = ["".join(rnd.choices(a, k=rnd.randint(1, 60))) for a in ("theandio n", "the", "abcdefghijklmnopqrstuvwxyzéüñ .,\n▁日😀") for _ in range(1500)]
    ids, n = wordpieces.encode_texts(v, [t.encode() for t in texts])
    ends = np.r_[0, np.cumsum(n)]
    assert all(ids[a:b].tolist() == library.encode(t) for t, a, b in zip(texts, ends, ends[1:], strict=False))
    # A unit merged from the heap gives the same as in rounds.
    sym = v.of_char[np.array([ord(c) for c in "".join(rnd.choices("theandio", k=900))])]
    assert wordpieces._heap_merge(v, sym).tolist() == wordpieces.merge_rounds(v, sym.copy(), np.array([len(sym)]))[0].tolist()
    for _ in range(2000):  # any ids, byte pieces that aren't UTF-8 among them
        own = [rnd.choice([rnd.randrange(32000), rnd.randrange(262), rnd.randrange(3, 259)]) for _ in range(rnd.randint(0, 8))]
        assert wordpieces.decode_ids(v, np.array(own, dtype=np.int64), np.array([len(own)]))[0] == library.decode(own)


def test_ids_without_text(spark, library):
    rows = spark.createDataFrame([("a", [1, 450, 2]), ("b", None), (None, [])], "doc_id string, ids array<int>")
    got = {(str(r.doc_id), r.decoded) for r in wordpieces.decode(rows).collect()}
    assert got == set([("a", library.decode([1, 450, 2])), ("b", None), ("None", "")])
    with pytest.raises(Exception, match="out of range"):
        wordpieces.decode(spark.createDataFrame([("a", [32000])], "doc_id string, ids array<int>")).collect()


def phrases(rows):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


def test_collocations(spark, docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.execute(queries.OP12).fetchall())
    assert want and phrases(collocations.mine(docs).collect()) == want
    assert collocations.mine(empty).count() == 0
    # Words beyond the dictionary, small slices, and a dictionary without words.
    for most in (3, 0):
        assert phrases(collocations.mine(docs, most_words=most, slice_bytes=2000).collect()) == want
    first = sorted(r for r in want if r[1] <= 2)
    assert phrases(collocations.mine(docs, top=2).collect()) == first


def test_collocations_of_the_documents(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(queries.OP12).fetchall())
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert phrases(collocations.mine(documents, most_words=300, slice_bytes=50_000).collect()) == want


def test_large_counts_are_exact(spark):
    big = 3_000_000_017
    two = spark.createDataFrame([("en", ["a", "b"], big, [big + 5, big + 9])], "lang string, words array<string>, f long, each array<long>")
    words = spark.createDataFrame([("en", None, 9 * big)], "lang string, word string, f long")
    assert collocations._score(two, two.limit(0), words).first().score == 10**6 * big * big // ((big + 5) * (big + 9))


def test_radix_order():
    keys = np.array([rnd.randrange(1 << 63) for _ in range(3000)] + [0, 0, 5, 1 << 40], dtype=np.int64)
    assert (keys[collocations.radix_order(keys)] == np.sort(keys)).all()
    assert [x.tolist() for x in collocations.run_lengths(np.array([1, 1, 4]))] == [[1, 4], [2, 1]]


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def test_runs_of_short_sequences():
    for _ in range(4000):
        s = [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 50))]
        assert periodic.runs_of(s) == plain_runs(s)
        k, q = rnd.randint(0, 9), rnd.randint(1, 6)
        s = s[:k] + (s[k : k + q] * 9)[: rnd.randint(0, 50)] + s[k:]
        assert periodic.runs_of(s) == plain_runs(s)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_runs(docs, empty, size):
    want = {i: t or "" for i, t, *_ in ROWS} | {None: "a a a a a a"}
    got = periodic.find_runs(docs, slice_bytes=size, slots=64).collect()
    assert len(got) == len(ROWS) + 2
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", want[r.doc_id])
        runs = plain_runs(words) if len(words) < 4000 else []
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic.find_runs(empty).count() == 0


def test_a_long_periodic_text(spark):
    rows = spark.createDataFrame([(1, "a " * 50_000 + "b " + "c d e " * 20_000)], "doc_id long, text string")
    assert [tuple(x) for x in periodic.find_runs(rows).first().runs] == [(0, 50_000, 1), (50_001, 60_000, 3)]


def test_run_query(spark, tmp_path):
    texts = {i: " ".join(rnd.choices(WORDS, k=rnd.randint(0, 300))) for i in range(400)} | {400: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    long = 0
    for r in queries.op13_word_runs(spark, str(tmp_path)).collect():
        words = (texts[r.doc_id] or "").split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        long += len(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {k for a, m, q in runs for k in range(a + q, a + m)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert tuple(r) == (r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(kept))
    assert long > 10
