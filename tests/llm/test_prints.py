"""Fingerprints of many texts at once, and the pairs that are left where a band meets."""

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F
from rasterlake.llm import fingerprints


def test_walks_together_are_walks_alone():
    r = random.Random(5)
    texts = ["".join(r.choices("abc é\U0001f600", k=k)) for k in [0, 1, 2, 5, 40, 700, 0, *range(60, 160)]] + ["x" * 3000, "", "y"]
    walker = fingerprints.Walker()
    keys, of = list(range(len(texts))), list(range(len(texts) - 1))
    alone = lambda t: walker.sample(c := fingerprints.codes_of(t), walker.walk(c))
    for k, n, sha, own, other, near, after in zip(*fingerprints.edited_rows(walker, keys, texts, of), strict=True):
        edited = texts[k][: n - n // 4] + texts[k + 1][: n // 4]
        assert (n, sha) == (len(texts[k]), hashlib.sha256(edited.encode()).hexdigest())
        assert (own, other) == (alone(texts[k]), alone(edited))
        assert (near, after) == (fingerprints.likeness(own, other), fingerprints.likeness(own, alone(texts[k + 1])))


def test_tiles_leave_out_no_pair():
    r = np.random.default_rng(3)
    for low, high in ((1, 60), (60, 70), (120, 400), (500, 520)):
        n = np.sort(r.integers(low, high, 300))
        base = r.integers(0, 16, 600)
        prints = ["".join("0123456789abcdef"[v] for v in np.where(r.random(k) < r.random() * 0.5, r.integers(0, 16, k), base[:k])).ljust(-(-k // 64) * 64, "-") for k in n.tolist()]
        whole = np.frombuffer(b"".join(fingerprints.summary(p)[1] for p in prints), dtype=np.uint64).reshape(-1, 4)
        words = fingerprints.shorter(n, whole)
        for near in (0.75, 0.4):
            i, j = np.triu_indices(len(n), 1)
            want = set(zip(*(x.tolist() for x in fingerprints.may_be_near(n, words, i, j, near)[:2]), strict=True))
            assert {p for a, b in fingerprints.tiles(n, words, near) for p in zip(a.tolist(), b.tolist(), strict=True)} == want
            assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if fingerprints.likeness(prints[a], prints[b]) >= near} <= want


def test_a_common_band_of_unlike_prints_leaves_no_rows(spark):
    """200 prints share their first bands and nothing else: none of their rows is passed on."""
    r = random.Random(8)
    rows = [(k, "0123456789abcdef" * 2 + "".join(r.choices("0123456789abcdef", k=288))) for k in range(200)]
    own = fingerprints._entities(spark.createDataFrame(rows, "doc_id long, fingerprint string"), "doc_id", "fingerprint")
    search = fingerprints.Search(own, fingerprints.NEAR)
    assert search.edges.count() == 0 and search.shared().count() == 0
    assert search.kinds.agg(F.count("*")).first()[0] == 200
