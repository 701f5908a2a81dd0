"""Heartbeats and changed files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed_values import LEASE_MINUTES
from ..operators.incremental import reuse
from ..sources.builds import BUCKETS, bucket_of, folder_of
from ..sources.storage import discarded, new_path, written


def lease_sessions(beats: DataFrame, holder: str, at: str, late: str = "1 hour", minutes: int = LEASE_MINUTES) -> DataFrame:
    """holder, started, expires, beats: leases as session windows, which end `minutes` after their last heartbeat.

    Works on streams and tables. On a stream, heartbeats more than `late` behind the latest are dropped by the watermark, and a
    lease comes out when the watermark has passed its end; a heartbeat exactly `minutes` after another begins a new lease.
    """
    time = F.col(at).cast("timestamp")
    marked = beats.withColumn("_at", time)
    if beats.isStreaming:
        marked = marked.withWatermark("_at", late)
    grouped = marked.groupBy(holder, F.session_window("_at", f"{minutes} minutes").alias("_window")).agg(F.count("*").alias("beats"))
    return grouped.select(holder, F.col("_window.start").alias("started"), F.col("_window.end").alias("expires"), "beats")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all input that is there now, as a table; its checkpoint and output are in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, f"{name}-out")
    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def index_changes(stream: DataFrame, table: str, keys: list[str], parse, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the Parquet table at `table` up to date with a stream of files: each micro-batch parses only rows whose keys the table lacks.

    The table is in folders by batch and bucket of the first key, and a batch reads only the keys of the buckets that its own rows fall in; parse keeps the keys. A batch that runs again
    writes over what it wrote before and takes no notice of it, so that a batch lost halfway leaves nothing twice. Rows with
    a null first key are of bucket -1.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.coalesce(bucket_of(F.col(keys[0]), buckets), F.lit(-1))
        rows = written(batch.dropDuplicates(keys).withColumn("_bucket", bucket), "stream-batch")
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # a number for each bucket at most
        schema = rows.select(*keys, F.col("_bucket"), F.lit(0).alias("_batch")).schema
        where, store = folder_of(spark, table)
        there = spark.read.schema(schema).parquet(table) if store.exists(where) else spark.createDataFrame([], schema)
        known = there.where(F.col("_bucket").isin(touched) & (F.col("_batch") != number)).select(*keys)
        _, fresh, _ = reuse(rows, known, keys)
        parsed = parse(fresh.drop("_bucket")).withColumn("_bucket", bucket)
        parsed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/_batch={number}")
        discarded(rows)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{table}-state").trigger(availableNow=True).start()
