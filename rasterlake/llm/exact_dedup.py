"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical without white space. A first scan yields only (length, prefix hash) groups, which are
combined before they are shuffled; lengths and then prefixes that occur once drop out, and the others become a bitmap of bounded size.
The second scan hashes whole texts only where the bitmap has their group; texts themselves are never shuffled. All of it is JVM-side.

Contract of :func:`duplicate_ledger` (one row per input row)
* null text counts as empty, so all null, empty and blank texts are one group;
* of a group, the row with the most code points stays, then the smallest id (of any type that has an order; a null id comes last);
* rows that repeat an id with equal text are one document: they share keep_id and kept, and count in group_size each;
* an empty table gives an empty ledger; only the id, text and named columns are read, so other columns can't clash.

Contract of :func:`exact_dedup` (rows keep all their columns)
* exactly one row of each group of equal texts stays, whatever ids repeat or are null: the ledger's choice, of rows equal in code points
  and id the one with the smallest hash of its text, of rows equal in id and text any one; no text is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import cut, maybe_broadcast, no_spaces, row_key, small, with_maybe, without_rows

#: Tables of at most this many groups, or rows to drop, are broadcast; beyond it the join shuffles hashes.
BROADCAST_ROWS = 200_000
GROUP = ("__len", "__prefix", "__sha")


def _hashed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, **more: Column) -> DataFrame:
    """__id, __points, __len, __prefix and, where the group may repeat, __sha of every row (else null); and more, as __x_name."""
    norm = no_spaces(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("__id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("__points"),
        norm.alias("__norm"),
        *[c.alias(f"__x_{k}") for k, c in more.items()],
    ).select("*", F.length("__norm").alias("__len"), F.xxhash64(F.substring("__norm", 1, prefix_chars)).alias("__prefix"))
    groups = keyed.groupBy("__len", "__prefix").agg(F.count("*").alias("__n"))
    lengths = groups.groupBy("__len").agg(F.sum("__n").alias("__of_len")).filter("__of_len > 1")
    again = groups.join(lengths, "__len", "left_semi").filter("__n > 1")
    out = with_maybe(keyed, again, "__len", "__prefix")
    return out.withColumn("__sha", F.when(F.col("__maybe"), F.sha2(F.col("__norm"), 256))).drop("__norm", "__maybe")


def _choice() -> Column:
    """The order in which rows of a group are kept: the smallest first."""
    return F.struct((-F.col("__points")).alias("p"), F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), *([F.col("__x_key").alias("key")]))


def duplicate_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_rows: int = BROADCAST_ROWS, **more: Column) -> DataFrame:
    """id, keep_id, group_size and kept of every row, and the columns of more (computed from docs)."""
    rows = _hashed(docs, id_col, text_col, prefix_chars, key=F.lit(0), **more)
    keep = rows.filter("__sha is not null").groupBy(*GROUP).agg(F.min(_choice()).alias("__best"), F.count("*").alias("__size")).filter("__size > 1")
    keep = cut(keep.select(*GROUP, F.col("__best.id").alias("__keep"), "__size", F.lit(True).alias("__hit")))
    if small(keep, broadcast_rows):
        out = rows.join(F.broadcast(keep), list(GROUP), "left")
    else:  # rows that can't repeat don't meet under their null hash
        none = [F.lit(None).cast(keep.schema[c].dataType).alias(c) for c in ("__keep", "__size", "__hit")]
        out = rows.filter("__sha is not null").join(keep, list(GROUP), "left").unionByName(rows.filter("__sha is null").select("*", *none))
    keep_id = F.when(F.col("__hit"), F.col("__keep")).otherwise(F.col("__id"))
    return out.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("__id")).alias("kept"),
        *[F.col(f"__x_{k}").alias(k) for k in more],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows that an equal text replaces; rows keep all their columns."""
    key = row_key(id_col, text_col)
    rows = _hashed(docs, id_col, text_col, prefix_chars, key=key).filter("__sha is not null")
    rows = cut(rows.groupBy(*GROUP, "__points", "__id", "__x_key").agg(F.count("*").alias("__n")))
    best = cut(rows.groupBy(*GROUP).agg(F.min(_choice()).alias("__best"), F.sum("__n").alias("__size")).filter("__size > 1"))
    rows = cut(rows.join(maybe_broadcast(best, broadcast_rows), list(GROUP)).select("__id", "__x_key", "__n", (F.col("__best.key") == F.col("__x_key")).alias("__stays")))
    pick = lambda what: rows.filter(what).select(F.col("__x_key").alias("__key"), F.col("__id").alias("__of"))
    return without_rows(docs, key, id_col, pick("not __stays"), pick("__stays and __n > 1"), broadcast_rows)
