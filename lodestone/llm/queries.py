"""The operators of this package applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arc_to_warc, compression_rules, html_tree, jaccard_join, kneser_ney, pareto_mix, secret_scan, sstable, suffix_decontam, zstd_langid
from .tokens import TOKEN_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return zstd_langid.identify(docs, zstd_langid.fit(docs))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_to_warc.convert(arc_to_warc.pages_to_arc(_table(spark, sf_dir, "pages")))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.tables(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents"))


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.sample(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.decisions(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_language_id, op3_quality_classifier, op4_arc_to_warc, op5_sstable, op6_decontamination, op7_jaccard_join, op8_source_mixture,
        op9_quality_rules, op10_secret_scan,
    )
}

SQL: dict[str, str] = {
    "op8_source_mixture": """
WITH d AS (
  SELECT doc_id, source, CAST(floor(1000 * sqrt(1.0 + greatest(coalesce(n_chars, 0), 0))) AS BIGINT) AS x,
    (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(source, '') || ':' || greatest(coalesce(n_chars, 0), 0))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(x) AS sx, CASE source WHEN 'src0' THEN 3.0 WHEN 'src1' THEN 4.0 WHEN 'src2' THEN 0.5 WHEN 'src3' THEN 0.5 WHEN 'src4' THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
p AS (SELECT source, sx, floor(0.75::DOUBLE * (SELECT count(*) FROM d) * w / (SELECT sum(w) FROM s) + 0.5) AS quota FROM s),
e AS (SELECT doc_id, d.source, u, quota, quota * x::DOUBLE / sx::DOUBLE AS e FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, floor(e) AS sure, e - floor(e) AS f FROM e),
k AS (
  SELECT *, row_number() OVER (PARTITION BY source, f > 0 ORDER BY CASE WHEN f > 0 THEN u * (1 - f) / ((1 - u) * f) END, CAST(doc_id AS VARCHAR)) AS place,
    quota - sum(sure) OVER (PARTITION BY source) AS places_left
  FROM r)
SELECT doc_id, source, CAST(sure AS BIGINT) + CASE WHEN f > 0 AND place <= places_left THEN 1 ELSE 0 END AS copies
FROM k WHERE CAST(sure AS BIGINT) + CASE WHEN f > 0 AND place <= places_left THEN 1 ELSE 0 END > 0""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_SQL}') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
      ELSE [array_to_string(w, ' ')] END) AS g
  FROM toks WHERE len(w) > 0),
sets AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
near AS (SELECT p, q FROM shared JOIN sets a ON a.doc_id = p JOIN sets b ON b.doc_id = q WHERE n / (a.size + b.size - n) >= 0.5),
reach AS (SELECT doc_id, doc_id AS other FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, n.q FROM reach r JOIN near n ON n.p = r.other),
links AS (SELECT p, count(*) AS links FROM near GROUP BY p)
SELECT doc_id, min(other) AS class_id, coalesce(any_value(links), 0) AS links FROM reach LEFT JOIN links ON p = doc_id GROUP BY doc_id""",

}
