"""An index that is rebuilt bucket by bucket: versions of buckets, and manifests that say which version of each counts.

root/data/v=N/bucket=K holds rows; root/manifest/v=N has a row for each bucket that isn't empty: bucket, version, n_rows. The last complete manifest
is the index; a build writes its data first and its manifest last, so that readers see a build whole or not at all, and a
build that was lost halfway is written over by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discarded, written

BUCKETS = 64
MANIFEST = "bucket int, version int, n_rows long"


@dataclass
class Build:
    """What a build did: its version (that before, where nothing changed), the buckets that it wrote anew, and how many rows it parsed, took over in these buckets, and dropped."""

    version: int
    rewritten: list[int]
    parsed: int
    reused: int
    gone: int


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(path.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def folder_of(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def last_version(spark: SparkSession, root: str) -> int:
    """0 where there is no complete build."""
    where, store = folder_of(spark, f"{root}/manifest")
    if not store.exists(where):
        return 0
    names = [x.getPath().getName() for x in store.listStatus(where)]
    done = [int(n.removeprefix("v=")) for n in names if n.startswith("v=") and store.exists(folder_of(spark, f"{root}/manifest/{n}/_SUCCESS")[0])]
    return max(done, default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    version = last_version(spark, root) if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v={version}") if version else spark.createDataFrame([], MANIFEST)


def read_build(spark: SparkSession, root: str, schema: str, only: list[int] | None = None, version: int | None = None) -> DataFrame:
    """The index's rows, or those of some buckets; a row of the manifest for each bucket is all that the driver reads."""
    rows = manifest(spark, root, version).collect()
    paths = [f"{root}/data/v={r.version}/bucket={r.bucket}" for r in rows if only is None or r.bucket in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def build(files: DataFrame, root: str, context: str, parse: Callable[[DataFrame], DataFrame], schema: str, buckets: int = BUCKETS) -> Build:
    """Bring the index at root up to date with files (path, digest, ...).

    parse makes rows of `schema`, a row or several for each file, with its path and digest; a row keeps the context that it was parsed in, such as the settings that its findings
    depend on, so that a file is parsed again if its digest or the context is another. Only buckets with a file that is new, changed or gone are
    written; of these, rows of unchanged files are taken over. schema must have path and digest; files' paths must be distinct.
    """
    spark = files.sparkSession
    before = last_version(spark, root)
    stored = f"{schema}, context string"
    keys = written(files.select("path", "digest", bucket_of(F.col("path"), buckets).alias("bucket")), "build-keys")
    prior = read_build(spark, root, stored, version=before).select("path", F.col("digest").alias("old"), "context").distinct()
    both = keys.join(prior, "path", "full_outer")
    state = F.when(F.col("digest").isNull() & F.col("bucket").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("digest")) & F.col("context").eqNullSafe(F.lit(context)), "same").otherwise("new")
    states = written(both.select("path", F.coalesce("bucket", bucket_of(F.col("path"), buckets)).alias("bucket"), state.alias("state")), "build-states")
    counts = states.groupBy("bucket").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("gone", "same", "new")]).collect()  # a row for each bucket
    changed = sorted(r.bucket for r in counts if r.gone or r.new)
    done = Build(before, changed, sum(r.new for r in counts), sum(r.same for r in counts if r.gone or r.new), sum(r.gone for r in counts))
    if changed:
        done.version = before + 1
        # Whole texts travel only where some of their files stay: none do in a first build or another context, and none of other buckets.
        new = files.where("path is not null")
        if any(r.same for r in counts):
            new = new.where(bucket_of(F.col("path"), buckets).isin(changed)).join(states.where("state = 'new'").select("path"), "path", "left_semi")
        fresh = parse(new).withColumn("context", F.lit(context))
        kept = read_build(spark, root, stored, only=changed, version=before).join(states.where("state = 'same'").select("path"), "path", "left_semi")
        columns = [*[f.name for f in spark.createDataFrame([], stored).schema.fields]]
        rows = fresh.select(columns).unionByName(kept.select(columns)).withColumn("bucket", bucket_of(F.col("path"), buckets))
        data = f"{root}/data/v={done.version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        where, store = folder_of(spark, data)
        there = spark.read.parquet(data).groupBy("bucket").agg(F.count("*").alias("n_rows")) if any(x.isDirectory() for x in store.listStatus(where)) else None
        rest = manifest(spark, root, before).where(~F.col("bucket").isin(changed))
        written_now = there.select("bucket", F.lit(done.version).alias("version"), "n_rows") if there is not None else spark.createDataFrame([], MANIFEST)
        rest.unionByName(written_now).coalesce(1).write.parquet(f"{root}/manifest/v={done.version}")
    discarded(keys)
    discarded(states)
    return done


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete buckets that none of the last `keep` builds reads, and older manifests; returns the folders that went."""
    last = last_version(spark, root)
    used = {(r.version, r.bucket) for v in range(max(1, last - keep + 1), last + 1) for r in manifest(spark, root, v).collect()}
    gone = []
    for v in range(1, last + 1):
        where, store = folder_of(spark, f"{root}/data/v={v}")
        for x in store.listStatus(where) if store.exists(where) else []:
            name = x.getPath().getName()
            if name.startswith("bucket=") and (v, int(name.removeprefix("bucket="))) not in used:
                store.delete(x.getPath(), True)
                gone.append(f"v={v}/{name}")
        if v <= last - keep:
            store.delete(folder_of(spark, f"{root}/manifest/v={v}")[0], True)
    return gone
