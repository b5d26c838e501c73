"""Mixing sources to target weights by Pareto order sampling.

Targets share out all words by weight, capped at three times a source's size; the excess goes to the others by weight (water
filling, in closed form over the sorted caps). Within a source a document's expected copies fall with its size, by octave of the size to the
power ``-lean`` (so that a few very long documents don't fill a source's share), up to three, at a level at which the source's expected
words are its target. A document of e expected copies is taken floor(e) times for certain, and once more if sampled, with inclusion
probability p = e - floor(e): documents are ranked by q = (u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, and taken in that
order. The sample's fixed size is in words: those that the certain copies leave of the target. The document that would exceed it is passed
over, and what is still open is offered in rank order to those behind it. The ranking is cut by running sums over bins of u, so that no
source meets in one task.

Contract of :func:`mix`
* null text has size 0; a document of size 0 is taken no words; null source is a source of its own and comes last;
* u comes from a hash of the id and the seed: reruns agree, ties in q (repeated rows) go by id and size;
* a source of no words has target 0; an empty table gives an empty result; sources may be as many as documents;
* only id, source and text are read, so other columns can't clash.

Contract of :func:`mix_documents`: each row as often as the mix takes it; rows equal in id, source and text are one document there, and one
of them is repeated as often as the mix takes all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, maybe_broadcast, row_key, small

#: Weights repeat over the sources in code-point order (fixed values of the contract).
WEIGHTS = (5, 2, 1)
CAP = 3
#: By what power of its size a document's expected copies fall.
LEAN = 0.25
#: Rows of one source to a bin of the ranking.
BIN_ROWS = 2_000
#: Times that the words a cut leaves open are offered to the smaller documents that remain.
REFILLS = 3
#: Tables of at most this many rows (sources, and octaves of size in them) are broadcast.
BROADCAST_ROWS = 100_000
SIZE = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size, n_docs) with target: one row per source, so the windows are over a small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("long"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    full = (F.lit(cap) * F.col("source_size")).alias("full")
    s = s.select("*", full)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("done", F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("left", F.sum("weight").over(after))
    level = (F.col("total") - F.col("done")) / F.col("left")
    s = s.withColumn("level", level).withColumn("capped", F.col("full") <= F.col("level") * F.col("weight"))
    # Below the first source that stays under its cap, all share its level.
    at = F.min(F.when(~F.col("capped"), F.struct(F.col("full") / F.col("weight"), "level"))).over(Window.partitionBy())
    s = s.withColumn("rest", at["level"])
    target = F.when(F.col("rest").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("rest") * F.col("weight")))
    return s.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def _uniform(id_col, seed: int):
    """In (0, 1), from 52 bits of an md5 that other engines can compute too."""
    text = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def expected_copies(octaves: DataFrame, sums: DataFrame, lean: float, cap: int = CAP) -> DataFrame:
    """Of octaves (source, octave, words) with words: the expected copies e of their documents, at most cap, so that the sums of
    e * words are the sources' targets. Octaves of small sizes, which have most copies, reach the cap first."""
    o = octaves.filter("words > 0").join(sums.select(F.col("source").alias("__s"), "target"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    o = o.withColumn("weight", F.pow(F.lit(2.0), -lean * F.col("octave")))
    by = Window.partitionBy("source").orderBy("octave")
    capped = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("weight")).over(by.rowsBetween(0, Window.unboundedFollowing))
    o = o.withColumn("level", (F.col("target") - cap * capped) / rest)
    # The first octave that stays below the cap at the level for it and all behind it sets the level.
    o = o.withColumn("at", F.min(F.when(F.col("level") * F.col("weight") < cap, F.struct("octave", "level"))).over(Window.partitionBy("source")))
    e = F.when(F.col("at").isNull() | (F.col("octave") < F.col("at.octave")), F.lit(float(cap))).otherwise(F.col("at.level") * F.col("weight"))
    return o.select("source", "octave", F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), e)).alias("e"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, lean: float = LEAN, bin_rows: int = BIN_ROWS, broadcast_rows: int = BROADCAST_ROWS, **more) -> DataFrame:
    """id, source, size, source_size, target, copies, taken (copies * size) and the columns of more (computed from docs) of every row."""
    rows = docs.select(
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(SIZE)), F.lit(0)).cast("long").alias("size"),
        *[c.alias(f"__x_{k}") for k, c in more.items()],
    )
    octave = F.length(F.regexp_replace(F.bin("size"), "^0", "")).alias("octave")  # 0 of no words, else floor(log2) + 1
    rows = cut(rows.select("*", _uniform(F.col("__id"), seed).alias("u"), octave))
    octaves = cut(rows.groupBy("source", "octave").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sums = cut(targets(octaves.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))))
    copies = cut(expected_copies(octaves, sums, lean).withColumn("whole", F.floor("e")))
    of = copies.select(F.col("source").alias("__s"), F.col("octave").alias("__o"), "e", "whole")
    spent = octaves.join(of, F.col("source").eqNullSafe(F.col("__s")) & (F.col("octave") == F.col("__o")))
    mean = F.sum((F.col("e") - F.col("whole")) * F.col("n")) / F.sum("n")
    mean = F.greatest(F.lit(0.01), F.least(F.lit(0.99), mean))
    spent = spent.groupBy("source").agg(F.sum(F.col("whole") * F.col("words")).alias("spent"), (mean / (1 - mean)).alias("odds"))
    side = sums.join(spent.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left")
    side = side.select(F.col("source").alias("__s"), "source_size", "target", "n_docs", (F.col("target") - F.coalesce("spent", F.lit(0))).alias("quota"), F.coalesce("odds", F.lit(1.0)).alias("odds"))
    at = rows.join(maybe_broadcast(cut(side), broadcast_rows), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    at = at.join(maybe_broadcast(of, broadcast_rows), F.col("source").eqNullSafe(F.col("__s")) & (F.col("octave") == F.col("__o")), "left")
    at = at.withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("p", F.coalesce(F.col("e") - F.col("whole"), F.lit(0.0)))
    q = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    bins = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bin_rows))
    # Bins in the order of q, at the place that it would have were all p the source's mean; rows out of the ranking go to any bin.
    place = F.coalesce(q * F.col("odds") / (1 + q * F.col("odds")), F.col("u"))
    extra = [c for c in at.columns if c.startswith("__x_")]
    at = at.select("__id", "source", "size", "source_size", "target", "whole", "quota", q.alias("q"), F.floor(place * bins).alias("bin"), *extra)
    at = at.withColumn("extra", F.lit(False))
    for k in range(1 + REFILLS):
        at = _fill(at, broadcast_rows, last=k == REFILLS)
    copies = (F.col("whole") + F.col("extra").cast("long")).cast("long")
    return at.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *[F.col(f"__x_{k}").alias(k) for k in more])


def _fill(at: DataFrame, broadcast_rows: int, last: bool) -> DataFrame:
    """Take, in rank order, the documents whose running words stay within what their source still wants."""
    got = at.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got")).withColumnRenamed("source", "__s")
    at = at.join(maybe_broadcast(cut(got), broadcast_rows), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    open_ = F.col("quota") - F.col("got")
    fits = (~F.col("extra")) & F.col("q").isNotNull() & (F.col("size") > 0) & (F.col("size") <= open_)
    at = at.withColumn("__w", F.when(fits, F.col("size")).otherwise(F.lit(0))).withColumn("open", open_)
    per_bin = at.groupBy("source", "bin").agg(F.sum("__w").alias("w"))
    ahead = F.sum("w").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    per_bin = per_bin.select(F.col("source").alias("__s"), F.col("bin").alias("__b"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    at = at.join(per_bin, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__b")), "left").drop("__s", "__b")
    rank = Window.partitionBy("source", "bin").orderBy("q", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = F.col("ahead") + F.sum("__w").over(rank)
    at = at.withColumn("extra", F.col("extra") | ((F.col("__w") > 0) & (run <= F.col("open"))))
    at = at.drop("__w", "open", "ahead", "got")
    return at if last else cut(at)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **more) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 3 times)."""
    key = row_key(id_col, source_col, text_col)
    taken = mix(docs, id_col, source_col, text_col, key=key, **more).filter("copies > 0").select(F.col(id_col).alias("__of"), F.col("key").alias("__key"), "copies")
    taken = cut(taken.groupBy("__key", "__of").agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows")))
    match = (F.col("__k") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__of"))
    out = docs.withColumn("__k", key).join(taken, match)
    if not small(taken.filter("__rows > 1"), 0):
        out = out.filter("__rows = 1").unionByName(out.filter("__rows > 1").dropDuplicates(["__key", "__of"]))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
