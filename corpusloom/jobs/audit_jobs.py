"""Audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources.tables import table

IGNORES = ["# comment", "*1", "!*11", "/b*/", "**/page?", "c/**"]


def ignored_pages(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/?", "").alias("path"))
    return pages.select("page_id", A.ignored(F.col("path"), IGNORES).alias("ignored"))


def missing_languages(spark, d) -> DataFrame:
    """Languages that a source has no document in of a length: of as many digits as its number of characters has."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit(":"), F.length(F.col("n_chars").cast("string")).cast("string")).alias("source"), "lang")
    return A.missing_siblings(docs, "source", "lang", ["en", "fr", "de", "es", "it"])


def missing_languages_all(spark, d) -> DataFrame:
    """Languages that a source has no document in at all."""
    return A.missing_siblings(table(spark, d, "documents"), "source", "lang", ["en", "fr", "de", "es", "it"])


def manifest_drift(spark, d) -> DataFrame:
    """Labelled documents as the manifest of good ones' first words, against documents as they are."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("lang").alias("digest"))
    manifest = table(spark, d, "labels").select(F.when(F.col("quality") == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.md5(F.when(F.col("toxic") == 1, "xx").otherwise("en")).alias("digest"))
    return A.drift(manifest, docs, "doc_id", "digest")


def feature_sizes(spark, d) -> DataFrame:
    """Each customer's reach: their orders as files, urgent ones as routes."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("files"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("routes"))
    both = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return both.select("c_custkey", A.feature_size(F.col("files"), F.col("routes")).alias("size"))


def text_complexity(spark, d) -> DataFrame:
    """Branch words and signs of each page's source."""
    return table(spark, d, "pages").select("page_id", A.complexity(F.col("html")).alias("complexity"))


QUERIES = {
    "ignored_pages": ignored_pages,
    "missing_languages": missing_languages,
    "missing_languages_all": missing_languages_all,
    "manifest_drift": manifest_drift,
    "feature_sizes": feature_sizes,
    "text_complexity": text_complexity,
}
ORACLES = {
    "ignored_pages": r"""
WITH paths AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^c/') THEN true WHEN regexp_matches(path, '(^|.*/)page[^/](/|$)') THEN true WHEN regexp_matches(path, '^b[^/]*/') THEN true
  WHEN regexp_matches(path, '(^|/)[^/]*11(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*1(/|$)') THEN true ELSE false END AS ignored FROM paths""",
    "missing_languages": """
WITH docs AS (SELECT source || ':' || length(CAST(n_chars AS VARCHAR)) AS source, lang FROM documents)
SELECT source, w.lang FROM (SELECT DISTINCT source FROM docs) AS s, (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) AS w(lang)
WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.source IS NOT DISTINCT FROM s.source AND x.lang = w.lang)""",
    "missing_languages_all": """
SELECT source, w.lang FROM (SELECT DISTINCT source FROM documents) AS s, (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) AS w(lang)
WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source IS NOT DISTINCT FROM s.source AND x.lang = w.lang)""",
    "manifest_drift": """
WITH m AS (SELECT CASE WHEN quality = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS lang FROM labels)
SELECT coalesce(m.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unmanaged' ELSE 'modified' END AS state
FROM m FULL JOIN documents d ON d.doc_id = m.doc_id WHERE m.doc_id IS NULL OR d.doc_id IS NULL OR m.lang <> d.lang""",
    "feature_sizes": """
SELECT c_custkey, CASE WHEN files IS NULL THEN 'medium' WHEN files >= 25 OR routes >= 5 THEN 'large' WHEN files >= 6 OR routes >= 2 THEN 'medium' ELSE 'small' END AS size
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS files, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS routes FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "text_complexity": r"""
SELECT page_id, CAST(1 + len(regexp_extract_all(html, '\b(if|for|while|case|catch)\b')) + len(regexp_extract_all(html, '\?')) + len(regexp_extract_all(html, '&&'))
  + len(regexp_extract_all(html, '\|\|')) AS INT) AS complexity FROM pages""",
}
