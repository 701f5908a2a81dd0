"""Sources and streams."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.sources.storage import new_path
from corpusloom.streaming.leases import index_changes, lease_sessions, run_once


def test_scan_and_decode(spark, tmp_path):
    tree = {"src/app/page.tsx": b"\xef\xbb\xbfa\r\nb", "src/x.test.ts": b"one", "node_modules/m/i.js": b"x", "readme.md": b"# x", "src/bad.ts": b"ok \xff"}
    for name, data in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found, skipped = files.scan_tree(spark, f"file://{tmp_path}")
    assert {(r.path, r.reason) for r in skipped.collect()} == {("node_modules/m/i.js", "ignored folder"), ("readme.md", "other kind")}
    got = {r.path: r for r in files.decode(found.where(F.col("path") != "src/bad.ts")).collect()}
    page = got["src/app/page.tsx"]
    assert (page.text, page.eol, page.bom, page.lines, page.file_class, page.bytes) == ("a\nb", "crlf", True, 2, "route", 7)
    assert got["src/x.test.ts"].file_class == "test"


def test_front_matter_and_tokens(spark):
    rows = [("---\nname: 'x y'\ntier: 2\nname: z\n---\nbody",), ("no block",), (None,)]
    got = [r.fields for r in files.front_matter(spark.createDataFrame(rows, "text string")).collect()]
    assert got == [{"name": "z", "tier": "2"}, {}, {}]
    styles = spark.createDataFrame([(":root { --brand: #AABBCC; --gap: 4px } a { color: #aabbcc }",), (None,)], "text string")
    assert {(r.token, r.kind) for r in files.design_tokens(styles).collect()} == {("--brand", "property"), ("--gap", "property"), ("#aabbcc", "colour")}


def test_lease_stream_equals_its_batch(spark):
    start = datetime(2024, 1, 1)
    beats = [("u", start + timedelta(minutes=m)) for m in (0, 10, 24, 40, 60, 61)] + [("v", start), ("w", start + timedelta(hours=9))]
    folder = new_path(spark, "beats")
    table = spark.createDataFrame(beats, "h string, at timestamp")
    table.write.parquet(folder)
    batch = {tuple(r) for r in lease_sessions(table, "h", "at").collect()}
    stream = spark.readStream.schema(table.schema).parquet(folder)
    ended = {tuple(r) for r in run_once(lease_sessions(stream, "h", "at", "0 seconds"), "leases").collect()}
    assert {(h, n) for h, _, _, n in batch if h == "u"} == {("u", 3), ("u", 1), ("u", 2)}
    assert ended == {x for x in batch if x[0] != "w"}


def test_lease_stream_gives_all_that_ended_by_the_latest_event(spark, tmp_path):
    from corpusloom.jobs import stream_jobs

    start = datetime(2024, 1, 1)
    events = [(1, start), (2, start + timedelta(minutes=40)), (3, start + timedelta(minutes=46)), (4, start + timedelta(minutes=60))]
    spark.createDataFrame(events, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.user_id for r in stream_jobs.lease_stream(spark, str(tmp_path)).collect()) == [1, 2]


def test_index_changes_parses_only_what_is_new(spark):
    folder, table, parsed = new_path(spark, "in"), new_path(spark, "table"), []
    schema = "path string, sha1 string"

    def parse(rows):
        parsed.append(rows.count())
        return rows

    for more in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("b", "3")]):
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        index_changes(stream, table, ["path", "sha1"], parse).awaitTermination()
    assert parsed == [2, 1]
    assert {tuple(r) for r in spark.read.parquet(table).select("path", "sha1").collect()} == {("a", "1"), ("b", "2"), ("b", "3")}


def test_index_changes_writes_a_lost_batch_again(spark):
    """Rows that a batch left before it was lost are written over, not kept beside those of its next run; a batch without new rows adds none."""
    folder, table = new_path(spark, "in"), new_path(spark, "table")
    schema = "path string, sha1 string"
    spark.createDataFrame([("half", "0")], schema).withColumn("_bucket", F.lit(5)).write.partitionBy("_bucket").parquet(f"{table}/_batch=0")
    for more in ([("a", "1"), (None, "2")], [("a", "1")], [("c", "1")]):
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(folder)
        index_changes(spark.readStream.schema(schema).parquet(folder), table, ["path", "sha1"], lambda rows: rows, buckets=8).awaitTermination()
    got = spark.read.schema(f"{schema}, _batch int, _bucket int").parquet(table)
    assert sorted((r.path or "", r.sha1, r["_batch"]) for r in got.collect()) == [("", "2", 0), ("a", "1", 0), ("c", "1", 2)]
    assert {r["_bucket"] for r in got.collect() if r.path is None} == {-1}


def test_settings_of_projects(spark, tmp_path):
    """Packages, frameworks, aliases and ignored folders; broken files give nothing."""
    from corpusloom.sources import settings

    packages = [("a", '{"dependencies": {"next": "14.2.3", "react": "18", "x": "1"}, "devDependencies": {"x": "2"}, "peerDependencies": null}'), ("b", '{"dependencies": {"vue": "3", "react-router-dom": "6"}}'), ("c", "{broken"), ("d", None)]
    needed = settings.dependencies(spark.createDataFrame(packages, "root string, text string"))
    assert sorted(map(tuple, needed.collect())) == [("a", "next", "14.2.3"), ("a", "react", "18"), ("a", "x", "2"), ("b", "react-router-dom", "6"), ("b", "vue", "3")]
    folders = spark.createDataFrame([("a", "src/app"), ("a", "lib"), ("b", "pages")], "root string, path string")
    assert sorted(map(tuple, settings.frameworks(needed, folders).collect())) == [("a", "next", True, "app"), ("b", "vue", False, "react-router 6")]
    tsconfig = '{ // base\n "compilerOptions": { /* x\n */ "baseUrl": "./src", "paths": { "@/*": ["./*", "lib/*",], "u": ["https://x/y"], }, } }'
    got = sorted(map(tuple, settings.compiler_aliases(spark.createDataFrame([("a", tsconfig), ("b", "no")], "root string, text string")).collect()))
    assert got == [("a", "@/*", 0, "src/*"), ("a", "@/*", 1, "src/lib/*"), ("a", "u", 0, "src/https://x/y")]
    vite = "resolve: { alias: { '@': path.resolve(__dirname, './src'), \"~lib\": './lib', 'plain': './no' } }"
    assert sorted(map(tuple, settings.bundler_aliases(spark.createDataFrame([("a", vite)], "root string, text string")).collect())) == [("a", "@/*", 0, "src/*"), ("a", "~lib/*", 0, "lib/*")]
    ignores = "# c\n/dist/\nbuild\n!keep\n*.log\na/b\n.env\n\ndist"
    assert sorted(r.name for r in settings.ignored_folders(spark.createDataFrame([("a", ignores)], "root string, text string")).collect()) == ["build", "dist"]
    paths = spark.createDataFrame([("a.tsx",), ("a.d.ts",), ("b.mts",), ("c.css",)], "p string")
    assert [r.p for r in paths.where(settings.is_source_file(paths.p)).collect()] == ["a.tsx", "b.mts"]
    (tmp_path / "cache.jsonl").write_text('{"k": 1, "v": "a"}\nbroken\n{"k": 2, "v": "b"}\n')
    assert sorted(map(tuple, settings.read_records(spark, f"file://{tmp_path}/cache.jsonl", "k long, v string").collect())) == [(1, "a"), (2, "b")]
