"""The operators' queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import chat, collocations, exact_dedup, fingerprints, mixing, packing, partenum, periodic, quality, secrets, suffix_dedup, urls, wordpieces
from rasterlake.llm.common import cut, no_spaces, table


def op1_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.make_valid_utf8(F.col("kept").cast("string"))  # a character that removal has cut becomes U+FFFD
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), kept.alias("kept"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.duplicate_ledger(docs, text_sha256=F.sha2(no_spaces(F.col("text")), 256))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    out = quality.score_quality(docs, quality.train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints.fingerprint_documents(table(spark, sf_dir, "documents")), "zstd")
    return fingerprints.with_components(prints)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_duplicates(table(spark, sf_dir, "documents"))


def op11_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wordpieces.decode(wordpieces.encode(table(spark, sf_dir, "documents")))
    n, ids = F.size("ids").cast("long").alias("n_tokens"), F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", n, F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """docs where a tenth of the texts, by their ids' checksums, repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g, n = F.expr("__h div 10"), F.size("__words").cast("long")
    out = docs.withColumn("__h", h).withColumn("__words", F.when(F.col("__h") % 10 == 0, words))
    out = out.withColumn("__a", F.when(n > 0, g % n)).withColumn("__p", 1 + F.expr("(size(__words) - __a) div (3 + (__h div 10) % 8)"))
    at = F.sequence(F.lit(0).cast("long"), n - 1)
    word = F.transform(at, lambda i: F.get("__words", F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p")).cast("int")))
    return out.withColumn("text", F.when(F.col("__a").isNull(), F.col("text")).otherwise(F.array_join(word, " "))).drop("__h", "__words", "__a", "__p")


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    out = out.withColumn("best", F.array_max(rank))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_run_length_dedup, op2_exact_dedup, op3_packing, op4_secret_scan, op5_quality, op6_chat_repair, op7_edit_fingerprints, op8_mixing, op9_url_filter, op10_partenum_join, op11_piece_encoding, op12_collocations, op13_word_runs)}


OP2 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""

OP9 = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
                                    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
      FROM c JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN m ON c.page_id = m.page_id
"""


OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM p),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS f FROM t, range(1, 4) AS s(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM g WHERE len(g) > 1),
s AS (SELECT c.lang, c.g, c.k, c.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN g x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN g y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM g WHERE len(g) = 3),
m AS (SELECT lang, g, max(f) AS longer FROM h GROUP BY ALL),
q AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM q JOIN n ON n.lang = q.lang QUALIFY rank <= 2000
"""


def oracle_sql() -> dict:
    return {"op12_collocations": OP12, "op2_exact_dedup": OP2, "op9_url_filter": OP9}
