"""Builds bucket by bucket: what is parsed, taken over and written, versions and what is left after a lost build."""

from pyspark.sql import functions as F

from corpusloom.sources import builds
from corpusloom.sources.storage import new_path

SCHEMA = "path string, digest string, word string"


def files(spark, texts):
    return spark.createDataFrame([*texts.items()], "path string, text string").withColumn("digest", F.sha1("text"))


def test_builds_touch_only_changed_buckets(spark):
    root, parsed = new_path(spark, "build"), []

    def parse(rows):
        parsed.append(sorted(r.path for r in rows.collect()))
        return rows.select("path", "digest", F.explode(F.split("text", " ")).alias("word"))

    def index():
        return {(r.path, r.word, r.context) for r in builds.read_build(spark, root, f"{SCHEMA}, context string").collect()}

    texts = {f"f{k}": f"a b{k}" for k in range(40)}
    bucket = {r.path: r.b for r in files(spark, texts).select("path", builds.bucket_of(F.col("path"), 8).alias("b")).collect()}
    want = lambda context: {(p, w, context) for p, t in texts.items() for w in t.split()}
    assert index() == set() and builds.last_version(spark, root) == 0
    first = builds.build(files(spark, texts), root, "c1", parse, SCHEMA, 8)
    assert (first.version, first.parsed, first.reused, first.gone) == (1, 40, 0, 0) and index() == want("c1")

    texts |= {"f3": "changed", "new": "x y"}
    del texts["f5"]
    second = builds.build(files(spark, texts), root, "c1", parse, SCHEMA, 8)
    touched = {bucket["f3"], bucket["f5"], files(spark, {"new": ""}).select(builds.bucket_of(F.col("path"), 8)).first()[0]}
    assert (second.version, second.parsed, second.gone) == (2, 2, 1) and set(second.rewritten) == touched and parsed[-1] == ["f3", "new"]
    assert second.reused == sum(bucket[p] in touched for p in texts if p not in ("f3", "new")) and index() == want("c1")
    assert {r.bucket: r.version for r in builds.manifest(spark, root).collect()} == {b: 2 if b in touched else 1 for b in range(8)}

    third = builds.build(files(spark, texts), root, "c1", parse, SCHEMA, 8)
    assert (third.version, third.rewritten, len(parsed)) == (2, [], 2)

    # A build that was lost before its manifest leaves data that no one reads; the next one writes over it.
    spark.createDataFrame([("lost", "d", "w", "c", 0)], f"{SCHEMA}, context string, bucket int").write.partitionBy("bucket").parquet(f"{root}/data/v=3")
    assert index() == want("c1")
    fourth = builds.build(files(spark, texts), root, "c2", parse, SCHEMA, 8)
    assert (fourth.version, fourth.parsed, fourth.reused) == (3, len(texts), 0) and index() == want("c2")
    assert len(builds.vacuum(spark, root)) == 8 + len(touched) and index() == want("c2") and builds.vacuum(spark, root) == []

    fifth = builds.build(files(spark, texts).limit(0), root, "c2", parse, SCHEMA, 8)
    assert fifth.gone == len(texts) and index() == set() and builds.manifest(spark, root).count() == 0
