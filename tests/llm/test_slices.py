"""Rows are worked on in slices of bounded memory."""

import tracemalloc

from rasterlake.llm import wordpieces


def test_pieces_are_decoded_in_slices(spark):
    texts = [None, "", "two words", "é" * 300, "snow ☃ \n\n x" * 40, "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = wordpieces.encode(rows)
    want = {r.doc_id: (r.ids, r.decoded) for r in wordpieces.decode(ids).collect()}
    got = {r.doc_id: (r.ids, r.decoded) for r in wordpieces.decode(wordpieces.encode(rows, slice_bytes=40), slice_bytes=40).collect()}
    assert got == want and {i: d for i, (_, d) in got.items()} == {i: t or "" for i, t in enumerate(texts)}


def test_a_slice_takes_bounded_memory():
    v = wordpieces.vocabulary(wordpieces._file(None, wordpieces.MODEL))
    texts = [" ".join(f"w{i * 7919 % 10007}x{i}" for i in range(k, k + 200)).encode() for k in range(0, 200 * 8000, 200)]
    a, b = next(wordpieces.byte_slices([len(t) for t in texts], wordpieces.SLICE))
    tracemalloc.start()
    wordpieces.encode_texts(v, texts[a:b])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20  # of words that hardly repeat; 567 MB at 12 MB a slice, 141 MB at 3
