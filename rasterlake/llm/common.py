"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", own) or own)
    return sc.getCheckpointDir()


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that its lineage ends there.

    Tables that a result still reads stay until the caller has written the result and calls :func:`sweep`; operators discard the others.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`cut` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if df is not None and getattr(df, "_cut_at", None):
            _delete(df.sparkSession, df._cut_at)


def sweep(spark: SparkSession) -> None:
    """Delete all tables of :func:`cut` in the session's shared folder: for callers whose results are written."""
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    for found in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, "cut-*")) or ():
        _delete(spark, found.getPath().toString())


def no_spaces(text: Column) -> Column:
    """text (null: empty) without the characters of SPACES."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most that many rows: the check before a broadcast."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if small(df, most) else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (matched as Spark does, whatever the case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


#: Bits of a bitmap of keys: 8 MB to broadcast, whatever the data; a word of it holds 32,768.
BITMAP_BITS, WORD_BITS = 1 << 26, 1 << 15


def with_maybe(df: DataFrame, keys: DataFrame, *cols: str, bits: int = BITMAP_BITS) -> DataFrame:
    """df with __maybe: false only where no row of keys has the row's values in cols. The broadcast is of bounded size."""
    at = F.pmod(F.xxhash64(*cols), F.lit(bits))
    place = keys.select(at.alias("h")).select(F.expr(f"h div {WORD_BITS}").alias("__word"), (F.col("h") % WORD_BITS).alias("place"))
    words = cut(place.groupBy("__word").agg(F.bitmap_construct_agg("place").alias("__bits")))
    out = df.withColumn("__at", at).withColumn("__word", F.expr(f"__at div {WORD_BITS}")).withColumn("__at", F.col("__at") % WORD_BITS)
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    hit = F.expr("__at % 8").cast("int")
    out = out.join(F.broadcast(words), "__word", "left").withColumn("__maybe", F.coalesce(F.getbit(byte, hit) == 1, F.lit(False)))
    return out.drop("__word", "__at", "__bits")


def row_key(*cols: str | Column) -> Column:
    return F.xxhash64(*cols)


def without_rows(docs: DataFrame, key: Column, id_col: str, gone: DataFrame, once: DataFrame, most: int) -> DataFrame:
    """docs without the rows whose (key, id) is in gone, and with one row of those whose (key, id) is in once (gone and once: __key, __of).

    Tables of at most ``most`` rows are broadcast; beyond it a bitmap of bounded size keeps all other rows out of the shuffles.
    """
    mark = gone.select("__key", "__of", F.lit(True).alias("__gone")).unionByName(once.select("__key", "__of", F.lit(False).alias("__gone")))
    rows = docs.withColumn("__k", key)
    match = (F.col("__k") == F.col("__key")) & F.col(id_col).eqNullSafe(F.col("__of"))
    if small(mark, most):
        rows, free = rows.join(F.broadcast(mark), match, "left"), None
    else:
        rows = with_maybe(rows, mark.withColumnRenamed("__key", "__k"), "__k")
        free, rows = rows.filter(~F.col("__maybe")), rows.filter("__maybe").join(mark, match, "left")
    names = [docs[c] for c in docs.columns]
    out = rows.filter("__gone is null").select(*names)
    if free is not None:
        out = out.unionByName(free.select(*names))
    if not small(once, 0):  # rows that repeat in full
        again = rows.filter("not __gone").dropDuplicates(["__key", "__of"])
        out = out.unionByName(again.select(*names))
    return out


def byte_slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have at most ``most`` bytes together, or of one row."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)
