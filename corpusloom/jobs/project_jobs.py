"""Queries on projects: module resolution, components of imports, ignore files, and members of types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import components as K
from ..operators import ignore as I
from ..operators import resolve as R
from ..operators import types as T
from ..sources.tables import table

PRIORITIES = {"1-URGENT": ".tsx", "2-HIGH": ".ts", "3-MEDIUM": ".jsx", "4-NOT SPECIFIED": ".mjs", "5-LOW": "/index.js"}
#: place, pattern, target_place, target
ALIASES = [
    (0, "@/*", 0, "gen/*"), (0, "@/*", 1, "src/*"), (1, "~*.view", 0, "src/c*"), (2, "@/c1/1995", 0, "src/never"), (3, "home", 0, "src/c1/1995"), (4, "@/c2*", 0, "src/c1*"),
]


def year_files(spark, d) -> DataFrame:
    """Orders as files: one for each customer, year and priority, in the customer's folder; several share all of a path but the extension."""
    ext = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    year = F.date_format("o_orderdate", "yyyy")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", year.alias("year"), F.concat(F.lit("src/c"), "o_custkey", F.lit("/"), year, ext[F.col("o_orderpriority")]).alias("path"))


def resolved_files(spark, d) -> DataFrame:
    """What each order's file refers to, by ways of all kinds, and the file that this means."""
    orders = year_files(spark, d)
    aliases = spark.createDataFrame(ALIASES, "place int, pattern string, target_place int, target string")
    # Files are told apart before their specifiers are made: a few small rows go over the network instead of ten long ones for each order.
    files = orders.groupBy("path", "o_custkey", "year").agg(F.collect_set(F.coalesce(F.col("o_orderkey") % 3, F.lit(2))).alias("thirds"))
    c, n, y = F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string"), F.col("year")
    up = lambda third: F.when(third == 0, "..").when(third == 1, "../x/..").otherwise("../../src")
    ups = F.transform("thirds", lambda third: F.concat(up(third), F.lit("/c"), n, F.lit("/"), y, F.lit(".js")))
    specs = [
        F.concat(F.lit("./"), y), F.concat(F.lit("@/c"), n, F.lit("/"), y), F.concat(F.lit("~"), n, F.lit("/"), y, F.lit(".view")),
        F.concat(F.lit("src/c"), n, F.lit("/"), y, F.lit(".mjs")), F.concat(F.lit("./"), y, F.lit("/")), F.concat(F.lit("./"), y, F.lit(".tsx")), F.lit("home"), F.lit("@scope/lib/x"), F.concat(F.lit("../../../c"), c, F.lit("/"), y),
    ]
    told = lambda rows: rows.select("path", F.explode(F.array_distinct(F.concat(F.array(*specs), ups))).alias("source"))
    # A path tells its customer and year, so that only what has none can come twice.
    refs = told(files.where("path is not null")).unionByName(told(files.where("path is null")).distinct())
    return R.resolve_modules(refs, orders.select("path"), aliases)


def follower_edges(spark, d) -> DataFrame:
    """From each part to the parts that follow it in the first and the last order that has one."""
    lines = table(spark, d, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    follows = lines.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "dst")
    both = follows.groupBy("src").agg(F.array(F.min_by("dst", order), F.max_by("dst", order)).alias("ends"))
    return both.select("src", F.explode("ends").alias("dst"))


def import_components(spark, d) -> DataFrame:
    """For each part the cycle of followers, of any length, that it is on: its least part and its size."""
    found = K.strongly_connected(follower_edges(spark, d))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes.hint("merge"), "component").select(F.col("node").alias("part"), "component", "size")


#: Rules of the root, of folders of the first level and of those of the second.
IGNORES = {0: "# all\n*1.ts\n!*11.ts\r\n/standard/**/p?.ts\nsmall/\n\n!/promo/", 1: "brand_1?/\n!brand_1*/*9*\nbrand_[2]\n/*/p8*.ts\n", 2: "/*7.ts\n!*77.ts\n**/p2*.ts"}


def typed_paths(spark, d) -> DataFrame:
    """Parts as files in folders of their type and brand."""
    return table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/p"), "p_partkey", F.lit(".ts")).alias("path"))


def ignored_nested(spark, d) -> DataFrame:
    """Which parts' files the ignore files of the root and of the two levels below ignore."""
    paths = typed_paths(spark, d)
    folder = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")
    ignores = None
    for level, text in IGNORES.items():
        rows = paths.select(folder(level).alias("folder")).distinct().withColumn("text", F.lit(text))
        ignores = rows if ignores is None else ignores.unionByName(rows)
    return I.ignored_paths(paths, I.ignore_rules(ignores))


def order_types(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, members, refs): customers as files and their orders as types, whose members are their lines' parts by brand; the nth order extends the one
    at half its place, odd ones name the one before too, the first the last, and those not yet fulfilled a type of another file."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), F.count("*").over(Window.partitionBy("o_custkey")).alias("last"))
    file, name = F.concat(F.lit("c"), "o_custkey").alias("file"), lambda n: F.concat(F.lit("T"), n.cast("int").cast("string"))
    types = orders.select(file, name(F.col("n")).alias("type"))
    lines = orders.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    members = lines.select(file, name(F.col("n")).alias("type"), F.col("l_linenumber").alias("place"), F.lower(F.replace("p_brand", F.lit("Brand#"), F.lit("m"))).alias("member"))
    parents = F.array(
        F.when(F.col("n") > 1, F.struct(F.lit(0).alias("place"), F.concat(name(F.floor(F.col("n") / 2)), F.lit("<Row>")).alias("parent"))),
        F.when((F.col("n") > 1) & (F.col("n") % 2 == 1), F.struct(F.lit(1).alias("place"), name(F.col("n") - 1).alias("parent"))),
        F.when((F.col("n") == 1) & (F.col("last") > 1), F.struct(F.lit(2).alias("place"), name(F.col("last")).alias("parent"))),
        F.when(F.col("o_orderstatus") != "F", F.struct(F.lit(3).alias("place"), F.concat(F.lit("Open"), "o_orderstatus").alias("parent"))),
    )
    refs = orders.select(file, name(F.col("n")).alias("type"), F.inline(F.filter(parents, lambda x: x.isNotNull())))
    return types, members, refs


def type_members(spark, d) -> DataFrame:
    """The members of each type and where they are declared, with the names that its file doesn't declare."""
    return T.walked_members(*order_types(spark, d)).drop("found")


FOUND_IN = """
CASE WHEN ext = '/index.js' THEN 'src/c' || c || '/' || y || '/' ELSE 'src/c' || c || '/' END"""
QUERIES = {"resolved_files": resolved_files, "import_components": import_components, "ignored_nested": ignored_nested, "type_members": type_members}
ORACLES = {
    "resolved_files": f"""
WITH files AS (
  SELECT o_custkey AS c, o_orderkey AS k, strftime(o_orderdate, '%Y') AS y,
    CASE o_orderpriority {" ".join(f"WHEN '{p}' THEN '{e}'" for p, e in PRIORITIES.items())} END AS ext FROM orders),
paths AS (SELECT *, 'src/c' || c || '/' || y || ext AS path, {FOUND_IN} AS folder, ext = '/index.js' AS deep FROM files),
meant AS (
  SELECT path, './' || y AS source, 0 AS nth, folder || y AS base, false AS index_only FROM paths
  UNION SELECT path, CASE k % 3 WHEN 0 THEN '..' WHEN 1 THEN '../x/..' ELSE '../../src' END || '/c' || (c + 1) || '/' || y || '.js', 0,
    CASE WHEN NOT deep THEN 'src/' WHEN k % 3 = 2 THEN 'src/src/' ELSE 'src/c' || c || '/' END || 'c' || (c + 1) || '/' || y || '.js', false FROM paths
  UNION SELECT path, '@/c' || (c + 1) || '/' || y, 1, 'src/c' || (c + 1) || '/' || y, false FROM paths
  UNION SELECT path, '@/c' || (c + 1) || '/' || y, 4, 'src/c1' || substring((c + 1)::VARCHAR, 2) || '/' || y, false FROM paths WHERE starts_with((c + 1)::VARCHAR, '2')
  UNION SELECT path, '~' || (c + 1) || '/' || y || '.view', 0, 'src/c' || (c + 1) || '/' || y, false FROM paths
  UNION SELECT path, 'src/c' || (c + 1) || '/' || y || '.mjs', 0, 'src/c' || (c + 1) || '/' || y || '.mjs', false FROM paths
  UNION SELECT path, './' || y || '/', 0, folder || y, true FROM paths
  UNION SELECT path, './' || y || '.tsx', 0, folder || y || '.tsx', false FROM paths
  UNION SELECT path, 'home', 0, 'src/c1/1995', false FROM paths
  UNION SELECT path, '@scope/lib/x', 0, '@scope/lib/x', false FROM paths
  UNION SELECT path, '../../../c' || c || '/' || y, 0, 'out of the tree', false FROM paths),
exts AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(R.EXTENSIONS))}) AS t(i, e)),
tries AS (
  SELECT path, source, nth * 100 AS rank, base AS file FROM meant WHERE NOT index_only AND regexp_matches(base, '(^|/)[^/]+[.][^/]*$')
  UNION ALL SELECT path, source, nth * 100 + 10 + i, base || e FROM meant, exts WHERE NOT index_only
  UNION ALL SELECT path, source, nth * 100 + 20 + i, regexp_replace(base, '[.](js|jsx|mjs)$', '') || e FROM meant, exts WHERE NOT index_only AND regexp_matches(base, '[.](js|jsx|mjs)$')
  UNION ALL SELECT path, source, nth * 100 + 30 + i, base || '/index' || e FROM meant, exts),
found AS (SELECT t.path, source, arg_min(file, rank) AS resolved FROM tries t WHERE file IN (SELECT path FROM paths) GROUP BY ALL)
SELECT DISTINCT m.path, m.source, resolved FROM meant m LEFT JOIN found f ON f.path = m.path AND f.source = m.source""",
    "import_components": """
WITH RECURSIVE follows AS (
  SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
placed AS (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY o, n, s, dst) AS up, row_number() OVER (PARTITION BY src ORDER BY o DESC, n DESC, s DESC, dst DESC) AS down
  FROM follows WHERE dst IS NOT NULL),
edges AS (SELECT DISTINCT src, dst FROM placed WHERE up = 1 OR down = 1),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b),
cyclic AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
found AS (SELECT n.node, coalesce(least, n.node) AS component FROM nodes n LEFT JOIN cyclic c ON n.node = c.node)
SELECT node AS part, component, count(*) OVER (PARTITION BY component) AS size FROM found""",
    "ignored_nested": r"""
WITH paths AS (SELECT p_partkey, lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '/p' || p_partkey || '.ts' AS path FROM part),
below AS (
  SELECT path, 0 AS depth, path AS rest FROM paths
  UNION ALL SELECT path, 1, regexp_replace(path, '^[^/]*/', '') FROM paths
  UNION ALL SELECT path, 2, regexp_replace(path, '^[^/]*/[^/]*/', '') FROM paths),
rules AS (SELECT * FROM (VALUES
  (0, 1, true, '(^|/)[^/]*1\.ts(/|$)'), (0, 2, false, '(^|/)[^/]*11\.ts(/|$)'), (0, 3, true, '^standard/.*p[^/]\.ts(/|$)'), (0, 4, true, '(^|/)small(/|$)'), (0, 6, false, '^promo(/|$)'),
  (1, 0, true, '(^|/)brand_1[^/](/|$)'), (1, 1, false, '^brand_1[^/]*/[^/]*9[^/]*(/|$)'), (1, 2, true, '(^|/)brand_\[2\](/|$)'), (1, 3, true, '^[^/]*/p8[^/]*\.ts(/|$)'),
  (2, 0, true, '^[^/]*7\.ts(/|$)'), (2, 1, false, '(^|/)[^/]*77\.ts(/|$)'), (2, 2, true, '^.*p2[^/]*\.ts(/|$)')) AS t(depth, line, ignores, regex)),
judged AS (SELECT path, arg_max(ignores, b.depth * 100 + line) AS ignored FROM below b JOIN rules r ON b.depth = r.depth WHERE regexp_matches(rest, regex) GROUP BY path)
SELECT p_partkey, p.path, coalesce(ignored, false) AS ignored FROM paths p LEFT JOIN judged j ON p.path = j.path""",
    "type_members": """
WITH RECURSIVE o AS (
  SELECT 'c' || o_custkey AS file, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS last FROM orders),
members AS (SELECT file, 'T' || n AS type, lower(replace(p_brand, 'Brand#', 'm')) AS member, min(l_linenumber) AS place FROM o JOIN lineitem ON k = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
refs AS (
  SELECT file, 'T' || n AS type, 0 AS place, 'T' || (n // 2) AS parent FROM o WHERE n > 1
  UNION ALL SELECT file, 'T' || n, 1, 'T' || (n - 1) FROM o WHERE n > 1 AND n % 2 = 1
  UNION ALL SELECT file, 'T1', 2, 'T' || last FROM o WHERE n = 1 AND last > 1
  UNION ALL SELECT file, 'T' || n, 3, 'Open' || s FROM o WHERE s <> 'F'),
ways AS (
  SELECT file, 'T' || n AS type, 'T' || n AS reached, CAST([] AS INTEGER[]) AS way, ['T' || n] AS seen FROM o
  UNION ALL SELECT w.file, w.type, parent, list_append(way, place), list_append(seen, parent) FROM ways w JOIN refs r ON r.file = w.file AND r.type = reached WHERE NOT list_contains(seen, parent)),
ordered AS (SELECT file, type, reached, row_number() OVER (PARTITION BY file, type, reached ORDER BY way) AS nth, way FROM ways),
least AS (SELECT file, type, reached, way FROM ordered WHERE nth = 1),
had AS (
  SELECT l.file, l.type, member, reached, row_number() OVER (PARTITION BY l.file, l.type, member ORDER BY way, place) AS nth
  FROM least l JOIN members m ON m.file = l.file AND m.type = reached)
SELECT file, type, member, reached AS declared_in FROM had WHERE nth = 1
UNION ALL SELECT file, type, reached, NULL FROM least WHERE starts_with(reached, 'Open')""",
}
