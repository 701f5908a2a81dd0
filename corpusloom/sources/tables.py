"""The Parquet tables that registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts_as_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as entities: id, name, path, host, usage_count (order lines) and recency (their last shipping date)."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("usage_count"), F.max("l_shipdate").alias("recency"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_brand").alias("host"))
    return parts.join(lines, "id", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))


def events_as_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as findings: the event type is the rule, and gives the severity; users are files."""
    severity = F.expr("CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END")
    return table(spark, folder, "events").select(
        F.upper("event_type").alias("rule"), severity.alias("severity"), F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), (F.col("value") < 50).alias("heuristic")
    )
