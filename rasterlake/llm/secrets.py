"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. JVM-side throughout.

Two models give P(next character | character): one of random strings, one of ordinary identifiers. The labelled samples of the first are
drawn here, ``random_rows`` of each of four alphabets; those of the second are all runs of token characters in all documents that are
letters (with ``_`` and ``-``) or digits alone. Neither label comes from the patterns. A run of token characters is a secret if the sum of
log ratios over its character pairs reaches a bound, and their mean another.

Contract of :func:`scan_secrets`
* null text counts as empty: no spans; offsets are code points, ends are exclusive; whole texts of any length are scanned, in time that
  is linear but for the number of overlap tests between model spans and base spans of one text;
* base spans are leftmost and non-overlapping per kind, failing matches are dropped after they have matched; spans of different
  kinds may overlap; the model adds spans that overlap no base span, and removes none;
* the models depend on counts over all documents only, so reruns agree; an empty table yields an empty result;
* ties in start are ordered by kind; repeated rows are scanned alike; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import without

#: Patterns of the base kinds, in their order (fixed values of the contract). A run shorter than the bound can't be part of a longer
#: match in "access" and "hex", so the bound is in the pattern; for "assign" it is applied to group 2 afterwards.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
#: What a text in lower case must hold to match the first two patterns.
HINTS = ("passw", "secret", "token", "apikey", "api_key")
#: Characters of the models; pairs with any other character tell nothing.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z_-]{4,}+|[0-9]{2,}+)(?![A-Za-z0-9+/_=-])"
#: Random strings of each alphabet; the uniform part of either model; pairs that a character's own counts must outweigh the distribution
#: of all next characters by; bounds on the log-likelihood ratio, in all and per pair, and on
#: the number of different characters.
RANDOM_ROWS = 1000
UNIFORM, BACKOFF = 0.01, 30.0
MIN_LLR, MIN_MEAN, MIN_KINDS = 15.0, 0.6, 8
#: Spans that are gathered before they are put aside.
CHUNK = 256

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def find_spans(text: Column, hits: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Spans of a pattern's matches, from the lengths of the matches (hits) and of what stands between them. keep: of (hit, start, end)."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end")))
        grown = F.concat(acc["spans"], span)
        if keep is not None:
            grown = F.when(keep(x["hit"], start, end), grown).otherwise(acc["spans"])
        full = F.size(acc["spans"]) >= CHUNK  # so that a text of many matches isn't copied once a match
        return F.struct(
            end.alias("at"), F.when(full, F.concat(acc["done"], F.array(acc["spans"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.when(keep(x["hit"], start, end), span).otherwise(_empty(SPAN)) if keep is not None else span).otherwise(grown).alias("spans"),
        )

    pairs = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), _empty(f"array<{SPAN}>").alias("done"), _empty(SPAN).alias("spans"))
    found = F.aggregate(pairs, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["spans"]))
    return F.when(F.size(hits) > 0, found).otherwise(_empty(SPAN))


def _hits(text: Column, pattern: str, worth: Column) -> Column:
    return F.when(worth, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_empty("array<string>"))


def base_hits(text: Column, tokens: Column) -> tuple[Column, Column, Column]:
    """Matches of the base patterns; tokens, the long runs of token characters, tell which texts are worth the passes."""
    low = F.lower(text)
    hint = low.contains(HINTS[0])
    for h in HINTS[1:]:
        hint = hint | low.contains(h)
    some = F.size(tokens) > 0
    return _hits(text, ASSIGN, hint), _hits(text, ACCESS, some & text.contains("AKIA")), _hits(text, HEX, some & text.rlike(HEX))


def base_spans(text: Column, assign: Column, access: Column, hexes: Column) -> Column:
    long_enough = lambda hit, *_: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_VALUE
    return F.array_sort(F.concat(
        find_spans(text, assign, ASSIGN, "assign", 0, long_enough), find_spans(text, access, ACCESS, "access", 1), find_spans(text, hexes, HEX, "hex", 2)
    ))


def _class(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def _pairs(samples: DataFrame) -> dict[tuple[int, int], float]:
    """Counts of character-class pairs in samples (s, n): at most 65 * 65 rows."""
    chars = samples.filter("length(s) > 1").select("n", F.split("s", "").alias("c")).withColumn("k", F.size("c") - 1)
    pair = chars.select("n", F.explode(F.arrays_zip(F.expr("slice(c, 1, k)").alias("x"), F.expr("slice(c, 2, k)").alias("y"))).alias("p"))
    rows = pair.groupBy(_class(F.col("p")["x"]).alias("a"), _class(F.col("p")["y"]).alias("b")).agg(F.sum("n").alias("n")).collect()
    return {(r.a, r.b): float(r.n) for r in rows}


def random_strings(docs: DataFrame, rows: int) -> DataFrame:
    """(s, n): strings over the base-64 alphabet, capitals and digits, small letters and digits, and hexadecimal digits."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256))
    plain = F.regexp_replace(F.base64(digest), "[=\\r\\n]", "")
    each = F.array(plain, F.regexp_replace(F.upper(plain), "[+/]", ""), F.regexp_replace(F.lower(plain), "[+/]", ""), F.lower(F.hex(digest)))
    return spark.range(rows).select(F.explode(each).alias("s"), F.lit(1).alias("n"))


def ordinary_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(s, n): the words and numbers of all documents, counted where they are read before they are shuffled."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("s"))
    return words.groupBy("s").agg(F.count("*").alias("n"))


def train_models(docs: DataFrame, text_col: str = "text", random_rows: int = RANDOM_ROWS) -> list[int]:
    """Log ratios of all class pairs in thousandths of a nat, row by row."""
    k = range(1, len(ALPHABET) + 1)
    models = []
    for counts in (_pairs(random_strings(docs, random_rows)), _pairs(ordinary_words(docs, text_col))):
        total = {x: sum(counts.get((x, y), 0.0) for y in k) for x in k}
        every = sum(total.values())
        next_ = {y: sum(counts.get((x, y), 0.0) for x in k) / every if every else 1 / len(k) for y in k}
        part = lambda x, y: (counts.get((x, y), 0.0) + BACKOFF * next_[y]) / (total[x] + BACKOFF)  # noqa: B023, E731
        models.append({(x, y): (1 - UNIFORM) * part(x, y) + UNIFORM / len(k) for x in k for y in k})
    return [round(1000 * math.log(models[0][x, y] / models[1][x, y])) for x in k for y in k]


def log_ratio(token: Column, weights: list[int]) -> Column:
    """Struct of sum (log-likelihood ratio in nats, of the pairs of letters and digits) and n (how many such pairs)."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    k = len(ALPHABET)

    def step(acc: Column, c: Column) -> Column:
        now = _class(c)
        pair = (acc["last"] > 0) & (now > 0)
        gain = F.when(pair, F.element_at(table, F.greatest((acc["last"] - 1) * k + now, F.lit(1)))).otherwise(F.lit(0))
        return F.struct(now.alias("last"), (acc["sum"] + gain).alias("sum"), (acc["n"] + pair.cast("int")).alias("n"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(F.split(token, ""), start, step, lambda acc: F.struct((acc["sum"] / 1000.0).alias("sum"), acc["n"].alias("n")))


def scan_secrets(docs: DataFrame, text_col: str = "text", weights: list[int] | None = None) -> DataFrame:
    """docs with base (spans of the patterns) and spans (with those of the models), each sorted. One scan, no shuffle."""
    weights = train_models(docs, text_col) if weights is None else weights
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = without(docs, "base", "spans", "__tokens", "__assign", "__access", "__hex", "__model")
    out = out.withColumn("__tokens", F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    out = out.withColumns(dict(zip(("__assign", "__access", "__hex"), base_hits(text, F.col("__tokens")), strict=True)))
    out = out.withColumn("base", base_spans(text, F.col("__assign"), F.col("__access"), F.col("__hex")))

    def secret(token: Column, start: Column, end: Column) -> Column:
        score = log_ratio(token, weights)
        return (score["sum"] >= F.greatest(F.lit(MIN_LLR), MIN_MEAN * score["n"])) & (F.size(F.array_distinct(F.split(token, ""))) >= MIN_KINDS)

    out = out.withColumn("__model", find_spans(text, F.col("__tokens"), TOKEN, "markov", 3, secret))
    clear = F.filter("__model", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    out = out.withColumn("spans", F.when(F.size("__model") > 0, F.array_sort(F.concat("base", clear))).otherwise(F.col("base")))
    return out.drop("__tokens", "__assign", "__access", "__hex", "__model")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
