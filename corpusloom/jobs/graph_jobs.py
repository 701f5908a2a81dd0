"""Graph, cluster and resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, name_tokens, package_of
from ..operators import cluster as C
from ..operators import graph as G
from ..operators import resolve as R
from ..sources.storage import written
from ..sources.tables import table


def tree_edges(spark, d) -> DataFrame:
    """Who depends on whom in the star schema: nations on regions, customers and suppliers on nations, orders on customers."""
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda t, a, b: table(spark, d, t).select(a.alias("src"), b.alias("dst"))
    return (
        edge("nation", name("nation", "n_nationkey"), name("region", "n_regionkey"))
        .union(edge("customer", name("customer", "c_custkey"), name("nation", "c_nationkey")))
        .union(edge("supplier", name("supplier", "s_suppkey"), name("nation", "s_nationkey")))
        .union(edge("orders", name("orders", "o_orderkey"), name("customer", "o_custkey")))
    )


def impact_layers(spark, d) -> DataFrame:
    seeds = table(spark, d, "region").where("r_regionkey = 0").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.impact_layers(tree_edges(spark, d), seeds)


def impact_counts(spark, d) -> DataFrame:
    return impact_layers(spark, d).groupBy("layer").agg(F.count("*").alias("nodes"))


def part_edges(spark, d) -> DataFrame:
    """From each part to the next one in its order."""
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    edges = lines.select(F.col("l_partkey").alias("src"), after.alias("dst"))
    return edges.where("src <> dst").distinct()


def import_edges(spark, d) -> DataFrame:
    """Distinct edges between parts that follow each other in an order, over the whole table: number out of and into each."""
    edges = part_edges(spark, d)
    out, into = edges.groupBy(F.col("src").alias("part")).agg(F.count("*").alias("out")), edges.groupBy(F.col("dst").alias("part")).agg(F.count("*").alias("into"))
    return out.join(into, "part", "full_outer").na.fill(0, ["out", "into"])


def cycles(spark, d) -> DataFrame:
    """Simple cycles of up to three parts that follow each other in orders."""
    found = G.simple_cycles(part_edges(spark, d), 3)
    return found.select("size", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def drill_chains(spark, d) -> DataFrame:
    """Chains of what depends on what, from every edge to the end."""
    found = G.pass_chains(tree_edges(spark, d), 6)
    return found.select("depth", F.array_join("path", ">").alias("path"))


def near_dup_pairs(spark, d) -> DataFrame:
    """All pairs of near-duplicate texts, copies too, and how alike they are."""
    members, pairs = C.near_pairs(table(spark, d, "documents"), "doc_id", "text")
    return C.listed_pairs(members, C.same_and_near(members, pairs)).withColumn("similarity", jaccard(F.col("common"), F.col("union")))


def near_dup_clusters(spark, d) -> DataFrame:
    return C.near_clusters(table(spark, d, "documents"), "doc_id", "text")


def dropped_blocks(spark, d) -> DataFrame:
    """Blocks of parts by name token, and which are too large for a comparison of all their pairs."""
    parts = table(spark, d, "part").select(name_tokens(F.col("p_name")).alias("tokens"))
    return C.block_sizes(parts, F.col("tokens"), 250)


def delivered(spark, d) -> DataFrame:
    """Suppliers with the brands, types and sizes of what they deliver."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    sets = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"), F.collect_set("p_type").alias("types"), F.collect_set("p_size").alias("sizes"))
    return sets.join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey")


DELIVERED = [("brands", 50), ("types", 30), ("sizes", 20)]


def contract_similarity(spark, d) -> DataFrame:
    """The stated query set, each twentieth supplier, against all suppliers: those that are .55 or more alike by brands, types and sizes of what they deliver."""
    found = C.weighted_pairs(delivered(spark, d), "s_suppkey", DELIVERED, asked=F.col("s_suppkey") % 20 == 0)
    sides = found.select(F.inline(F.array(F.struct(F.col("a").alias("asked"), F.col("b").alias("other"), "similarity"), F.struct(F.col("b").alias("asked"), F.col("a").alias("other"), "similarity"))))
    return sides.where("asked % 20 = 0")


def supplier_pairs(spark, d) -> DataFrame:
    """All pairs of suppliers that are .55 or more alike by brands, types and sizes of what they deliver, and the cluster that they are in."""
    sets = written(delivered(spark, d), "delivered")
    clusters = C.weighted_clusters(sets, "s_suppkey", DELIVERED)
    return C.weighted_pairs(sets.join(clusters, "s_suppkey", "left"), "s_suppkey", DELIVERED, carry="cluster")


def module_resolution(spark, d) -> DataFrame:
    """Orders as files in folders of their customers; each refers to the customer's folder and to its next order."""
    orders = table(spark, d, "orders").select(F.concat(F.lit("src/c"), "o_custkey", F.lit("/o"), "o_orderkey", F.lit(".ts")).alias("path"), "o_custkey", "o_orderkey")
    refs = orders.select("path", F.explode(F.array(F.concat(F.lit("../c"), "o_custkey", F.lit("/./o"), F.col("o_orderkey") + 1), F.concat(F.lit("@/c"), "o_custkey", F.lit("/o"), "o_orderkey"), F.lit("@scope/lib/x"))).alias("source"))
    return R.resolve_modules(refs, orders.select("path"), {"@/": "src/"}).groupBy(F.coalesce(package_of(F.col("source")), F.lit("relative")).alias("kind")).agg(F.count("*").alias("refs"), F.count("resolved").alias("resolved"), F.count_if(F.col("resolved") == F.col("path")).alias("own"))


def package_extract(spark, d) -> DataFrame:
    specs = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("spec"))
    return specs.select(package_of(F.col("spec")).alias("package")).groupBy("package").agg(F.count("*").alias("n"))


def owner_spans(spark, d) -> DataFrame:
    """For each event the last session of its user that holds it; sessions begin at signups and errors and last a thousand events."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    spans = events.where(F.col("event_type").isin("signup", "error")).select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + 1000).alias("last"), F.col("event_id").alias("session"))
    return R.owners(events.select("user_id", "event_id"), spans, "user_id", "event_id", "first", "last", "session")


def last_bindings(spark, d) -> DataFrame:
    """The binding of each user and event type: later events replace earlier ones, purchases all others."""
    events = table(spark, d, "events").select("user_id", F.substring("event_type", 1, 1).alias("name"), "event_id")
    kinds = table(spark, d, "events")
    local = events.where("name <> 'p'")
    imported = kinds.where("event_type = 'purchase'").select("user_id", F.lit("s").alias("name"), "event_id")
    return R.last_binding(local, imported, ["user_id", "name"], "event_id")


def reexports(spark, d) -> DataFrame:
    """Names of regions, forwarded to their nations and on to customers' segments."""
    own = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("file"), F.col("r_name").alias("name"), F.concat(F.lit("region:"), "r_regionkey").alias("target"))
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("file"), F.col("n_nationkey").alias("place"), F.concat(F.lit("r"), "n_regionkey").alias("source_file"))
    segments = table(spark, d, "customer").groupBy(F.concat(F.lit("s"), "c_mktsegment").alias("file"), F.col("c_nationkey").alias("place")).agg(F.first(F.concat(F.lit("n"), "c_nationkey")).alias("source_file"))
    return R.follow_reexports(own, nations.unionByName(segments))


TREE = """
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders),
reached AS (
  SELECT 'region:0' AS node, 0 AS layer UNION SELECT src, layer + 1 FROM reached JOIN edges ON dst = node WHERE layer < 12),
layers AS (SELECT node, min(layer) AS layer FROM reached GROUP BY node HAVING min(layer) > 0)"""
PARTS = """
follows AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)"""


SHINGLED = r"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS same FROM shingles GROUP BY doc_id)"""
SHINGLES = f"""{SHINGLED},
members AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS class FROM sizes),
own AS (SELECT s.doc_id, s FROM shingles s JOIN members m ON s.doc_id = m.class AND m.doc_id = m.class),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM own x JOIN own y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (
  SELECT a, b, common, p.n + q.n - common AS "union" FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE common * 100 >= (p.n + q.n - common) * 75)"""
SIMILAR = """
sets AS (
  SELECT s_suppkey, any_value(s_nationkey) AS nation, list(DISTINCT p_brand) AS brands, list(DISTINCT p_type) AS types, list(DISTINCT p_size) AS sizes
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey)"""


def share(c: str, weight: int) -> str:
    common = f"len(list_intersect(x.{c}, y.{c}))"
    return f"CAST(floor({common} * {weight * 10} / (len(x.{c}) + len(y.{c}) - {common}) + 0.5) AS BIGINT)"


QUERIES = {
    "impact_layers": impact_layers,
    "impact_counts": impact_counts,
    "import_edges": import_edges,
    "cycles": cycles,
    "drill_chains": drill_chains,
    "near_dup_pairs": near_dup_pairs,
    "near_dup_clusters": near_dup_clusters,
    "dropped_blocks": dropped_blocks,
    "contract_similarity": contract_similarity,
    "supplier_pairs": supplier_pairs,
    "module_resolution": module_resolution,
    "package_extract": package_extract,
    "owner_spans": owner_spans,
    "last_bindings": last_bindings,
    "reexports": reexports,
}
ORACLES = {
    "impact_layers": f"WITH RECURSIVE {TREE} SELECT node, layer FROM layers",
    "impact_counts": f"WITH RECURSIVE {TREE} SELECT layer, count(*) AS nodes FROM layers GROUP BY layer",
    "import_edges": f"""WITH {PARTS}, edges AS (SELECT DISTINCT src, dst FROM follows WHERE src <> dst),
o AS (SELECT src AS part, count(*) AS "out" FROM edges GROUP BY 1), i AS (SELECT dst AS part, count(*) AS "into" FROM edges GROUP BY 1)
SELECT part, coalesce("out", 0) AS "out", coalesce("into", 0) AS "into" FROM o FULL JOIN i USING (part)""",
    "cycles": f"""WITH RECURSIVE {PARTS}, edges AS (SELECT DISTINCT src, dst FROM follows WHERE src <> dst),
paths AS (
  SELECT [src, dst] AS path, dst AS last FROM edges WHERE dst > src
  UNION ALL SELECT list_append(path, dst), dst FROM paths JOIN edges ON src = last WHERE dst > path[1] AND NOT list_contains(path, dst) AND len(path) < 3)
SELECT CAST(len(path) AS INT) AS size, array_to_string(path, '>') AS path FROM paths JOIN edges ON src = last AND dst = path[1]""",
    "drill_chains": f"""WITH RECURSIVE {TREE},
paths AS (
  SELECT [src, dst] AS path, dst AS last FROM edges
  UNION ALL SELECT list_append(path, dst), dst FROM paths JOIN edges ON src = last WHERE NOT list_contains(path, dst))
SELECT CAST(len(path) AS INT) AS depth, array_to_string(path, '>') AS path FROM paths p
WHERE len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = p.last)""",
    "near_dup_pairs": f"""WITH {SHINGLED},
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS (
  SELECT a, b, common, p.n + q.n - common AS "union" FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE common * 100 >= (p.n + q.n - common) * 75)
SELECT a, b, CAST(common AS INT) AS common, CAST("union" AS INT) AS "union", CAST(floor(common * 1000 / "union" + 0.5) AS BIGINT) AS similarity FROM pairs""",
    "near_dup_clusters": f"""WITH RECURSIVE {SHINGLES},
linked AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
closed AS (SELECT class AS node, class AS other FROM members UNION SELECT node, b FROM closed JOIN linked ON a = other),
labels AS (SELECT node, min(other) AS cluster FROM closed GROUP BY node),
named AS (SELECT doc_id AS key, cluster FROM members JOIN labels ON node = class)
SELECT key, cluster, size FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM named) WHERE size > 1""",
    "dropped_blocks": """
SELECT token AS block, count(*) AS size, count(*) > 250 AS dropped
FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part)
WHERE token NOT IN ('', 'component', 'container', 'wrapper', 'view', 'page', 'screen', 'item', 'list', 'new', 'base', 'common', 'shared', 'ui', 'index', 'default')
GROUP BY token""",
    "contract_similarity": f"""WITH {SIMILAR}
SELECT * FROM (
  SELECT x.s_suppkey AS asked, y.s_suppkey AS other, {share("brands", 50)} + {share("types", 30)} + {share("sizes", 20)} AS similarity
  FROM sets x JOIN sets y ON x.s_suppkey <> y.s_suppkey WHERE x.s_suppkey % 20 = 0)
WHERE similarity >= 550""",
    "supplier_pairs": f"""WITH RECURSIVE {SIMILAR},
pairs AS (
  SELECT x.s_suppkey AS a, y.s_suppkey AS b, {share("brands", 50)} + {share("types", 30)} + {share("sizes", 20)} AS similarity
  FROM sets x JOIN sets y ON x.s_suppkey < y.s_suppkey),
near AS (SELECT * FROM pairs WHERE similarity >= 550),
linked AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
closed AS (SELECT a AS node, a AS other FROM linked UNION SELECT node, b FROM closed JOIN linked ON a = other),
labels AS (SELECT node, min(other) AS cluster FROM closed GROUP BY node)
SELECT a, b, similarity, cluster FROM near JOIN labels ON node = a""",
    "module_resolution": """
WITH files AS (SELECT o_custkey AS c, o_orderkey AS o FROM orders),
refs AS (
  SELECT 'relative' AS kind, EXISTS (SELECT 1 FROM files g WHERE g.c = f.c AND g.o = f.o + 1) AS hit, false AS own FROM files f
  UNION ALL SELECT '@/c' || c, true, true FROM files
  UNION ALL SELECT '@scope/lib', false, false FROM files)
SELECT CASE WHEN starts_with(kind, '@/c') THEN 'relative' ELSE kind END AS kind, count(*) AS refs, count(*) FILTER (WHERE hit) AS resolved, count(*) FILTER (WHERE own) AS own
FROM refs GROUP BY ALL""",
    "package_extract": r"SELECT regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/@][^/]*)', 1) AS package, count(*) AS n FROM pages GROUP BY 1",
    "owner_spans": """
SELECT e.user_id, e.event_id, max(s.event_id) AS session FROM events e
JOIN events s ON s.user_id = e.user_id AND s.event_type IN ('signup', 'error') AND e.event_id BETWEEN s.event_id AND s.event_id + 1000
GROUP BY ALL""",
    "last_bindings": """
SELECT user_id, name, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY rank DESC, event_id DESC) AS place FROM (
    SELECT user_id, substring(event_type, 1, 1) AS name, event_id, 0 AS rank FROM events WHERE event_type <> 'purchase'
    UNION ALL SELECT user_id, 's', event_id, 1 FROM events WHERE event_type = 'purchase'))
WHERE place = 1""",
    "reexports": """
WITH own AS (SELECT 'r' || r_regionkey AS file, r_name AS name, 'region:' || r_regionkey AS target, 0 AS hops FROM region),
one AS (SELECT 'n' || n_nationkey AS file, name, target, 1 AS hops FROM nation JOIN own ON own.file = 'r' || n_regionkey),
two AS (
  SELECT 's' || c_mktsegment AS file, name, arg_min(target, c_nationkey) AS target, 2 AS hops
  FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer) JOIN one ON one.file = 'n' || c_nationkey GROUP BY 1, 2)
SELECT * FROM own UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two""",
}
