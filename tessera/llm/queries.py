"""The operators' queries over the fixture tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, langid, licenses, line_dedup, ngram_join, packing, pii, quality, toxicity

SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS dropped
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=3, similarity="9/10")


SQL["op3_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s GROUP BY x, y),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reached AS (
  SELECT doc_id AS node, doc_id AS start FROM sizes
  UNION
  SELECT y, start FROM reached JOIN links ON x = node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT node, min(start) AS component FROM reached GROUP BY node) r ON r.node = d.doc_id
"""


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def _path() -> Column:
    """Documents have no paths, so ids make a tree: 64 to a directory, 8 of these to the one above.

    The first document of each directory takes the place of its license file.
    """
    inner, outer = F.expr("doc_id div 64"), F.expr("doc_id div 512")
    name = F.when(F.col("doc_id") % 512 == 0, F.concat(outer, F.lit("/LICENSE"))).when(F.col("doc_id") % 64 == 0, F.concat_ws("/", outer, inner, F.lit("LICENSE")))
    return F.coalesce(name, F.concat(outer, F.lit("/"), inner, F.lit("/"), F.col("doc_id"), F.lit(".txt")))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fingerprints' query: lengths and edited texts."""
    return op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


SQL["fingerprint_edits"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
following AS (SELECT doc_id, t, lead(t, 1, (SELECT arg_max(t, doc_id) FROM texts)) OVER (ORDER BY doc_id DESC) AS f FROM texts)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(f, length(t) // 3)) AS edited_sha256 FROM following
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("key"), _path().alias("path"), "text")
    return licenses.inherit(licenses.scan(files)).withColumnRenamed("key", "doc_id")


def _held_out(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus == rest


def _graded(docs: DataFrame, labels: DataFrame, operator, label: str, modulus: int, rest: int) -> DataFrame:
    """Scores by ``operator`` (a module with train and score) learned outside the held-out fold."""
    model = operator.train(docs, labels.where(~_held_out(modulus, rest)), label)
    scored = operator.score(docs, model)
    return scored.select("doc_id", F.coalesce(_held_out(modulus, rest), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), quality, "quality", 5, 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxicity, "toxic", 4, 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.where(~_held_out(4, 2))))
    return found.select("doc_id", F.coalesce(_held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_line_dedup": op2_line_dedup,
        "op3_ngram_join": op3_ngram_join,
        "op4_fingerprints": op4_fingerprints,
        "op5_license_scan": op5_license_scan,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_pii": op8_pii,
        "op9_decontamination": op9_decontamination,
        "op10_language_id": op10_language_id,
        "fingerprint_edits": fingerprint_edits,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
