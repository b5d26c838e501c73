"""Large groups of near copies are one component before their bands meet."""

import random

from pyspark.sql import functions as F
from rasterlake.llm import fingerprints


def _near_copies(n: int) -> list[tuple]:
    r = random.Random(11)
    base, rows = r.choices("0123456789abcdef", k=320), []
    for k in range(n):
        own = base.copy()
        for place in r.sample(range(320), 6):
            own[place] = r.choice("0123456789abcdef")
        rows.append((k, "".join(own)))
    return rows


def test_bands_of_near_copies_leave_no_rows(spark):
    own = fingerprints._entities(spark.createDataFrame(_near_copies(60), "doc_id long, fingerprint string"), "doc_id", "fingerprint")
    search = fingerprints.Search(own, fingerprints.NEAR)
    assert search.labels.agg(F.countDistinct("comp")).first()[0] == 1 and search.labels.count() == 59  # all but the smallest
    assert search.shared().count() == 0  # before, each band was held back with its 60 members


def test_contracted_edges_join_the_same(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    root = {v: v for v in range(300)}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {v: min(x, y) if c in (x, y) else c for v, c in root.items()}
    found = {x.node: x.comp for x in fingerprints.components(fingerprints.contracted(table)).collect()}
    assert found == {v: c for v, c in root.items() if v != c}


def test_members_packed_and_unpacked():
    entry = fingerprints.np.zeros(5, fingerprints.MEMBER)
    for k, f in enumerate(fingerprints.MEMBER.names):
        entry[f] = fingerprints.np.arange(entry[f].size).reshape(entry[f].shape) * 1000 + k
    assert (fingerprints.unpacked(fingerprints.packed(entry)) == entry).all()
