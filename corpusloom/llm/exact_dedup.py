"""Exact dedup by skew-safe combining, comparing whole texts at every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text equals an empty one. The row with the largest
    doc_id of each group stays.

    Stage 1: each map task combines its own equal texts (partial aggregation keyed by the text itself).
    Stage 2: digest groups merge under a salt that is constant in a task, so that no reducer
    gets more than a few rows of a group, whatever its size. Stage 3: the salts' winners merge.
    Each stage groups by digest and text, so that a digest shared by unequal texts joins nothing.
    Documents then find their group by digest; where one digest has several texts, by digest and text.

    Cases: null doc_id counts in its group but never wins unless no other row is there (keep_id
    is then null, and the row with a null id stays); repeated rows are members of one group and each counts,
    and every row with the winning id is kept; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    local = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))
    winners = salted.groupBy("digest", "text").agg(F.max("winner").alias("winner"), F.sum("size").alias("size"))
    groups = written(
        winners.groupBy("digest").agg(F.count("*").alias("variants"), F.max("winner").alias("keep_id"), F.max("size").alias("group_size")),
        "exact-groups",
    )
    single = keyed.select("doc_id", "digest").join(groups.where("variants = 1").drop("variants"), "digest")
    shared = groups.where("variants > 1").select("digest")
    if not shared.isEmpty():
        several = winners.join(shared, "digest", "left_semi").select("digest", "text", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"))
        single = single.unionByName(keyed.join(several, ["digest", "text"]).drop("text"))
    return single.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
