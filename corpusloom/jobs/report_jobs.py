"""Whole reports: the gate with citations and what a diff lands in, builds by bucket, briefs by role, totals, limits and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import brief as B
from ..operators import cluster as C
from ..operators import components as K
from ..operators import gate as G
from ..operators import graph as H
from ..operators import search as S
from ..operators import totals as T
from ..sources import builds
from ..sources.derived import code_lines
from ..sources.storage import new_path, written
from ..sources.tables import parts_as_entities, table
from .code_jobs import CODE, changes, contracts, entities, gate_checks
from .code_jobs import ORACLES as CODE_ORACLES
from .graph_jobs import PARTS, TREE, part_edges, tree_edges
from .search_jobs import REQUEST, SCORED

SYMBOLS = ["useState", "run", "img", "import", "href"]


def bad_citations(spark, d) -> DataFrame:
    """Citations of modified orders' files that don't hold: each names the file of its customer's order before, a line and a word that should stand there."""
    lines = code_lines(spark, d)
    before = F.lag("file").over(Window.partitionBy("change").orderBy("order_key"))
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), F.pmod("order_key", F.lit(len(SYMBOLS))).cast("int") + 1)
    cited = changes(spark, d).withColumn("before", before).where("status = 'M'")
    cites = cited.select(F.struct("change", "order_key").alias("cite"), F.col("before").alias("file"), (F.pmod("order_key", F.lit(6)) + 1).cast("int").alias("line"), symbol.alias("symbol"))
    return G.check_citations(cites, lines.select("file", "line", "text")).where("verdict <> 'RESOLVES'").select("cite.change", "cite.order_key", "verdict")


def like_orders(spark, d) -> DataFrame:
    """Orders that took the same part from the same supplier to the same end, each with the next of them."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_orderkey").alias("src")).distinct()
    after = F.lead("src").over(Window.partitionBy("l_partkey", "l_suppkey", "l_returnflag").orderBy("src"))
    return lines.select("src", after.alias("dst")).where("dst is not null").distinct()


def diff_members(spark, d) -> DataFrame:
    """Clusters of like orders once the added ones have come to those that were there: node, component, and whether its cluster is another than before."""
    added = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_key"))
    edges = written(like_orders(spark, d), "like-orders")
    mark = added.withColumn("is_new", F.lit(True))
    both = edges.join(mark.withColumnsRenamed({"order_key": "src", "is_new": "a"}), "src", "left").join(mark.withColumnsRenamed({"order_key": "dst", "is_new": "b"}), "dst", "left")
    fresh = F.coalesce("a", "b", F.lit(False))
    return K.grown_components(written(K.connected_components(both.where(~fresh)), "like-clusters"), both.where(fresh))


def diff_clusters(spark, d) -> DataFrame:
    """The clusters of like orders that added orders land in: size, how many of the members are added, and how many have another cluster for it."""
    members = written(diff_members(spark, d), "diff-members")
    added = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node"))
    moved = members.groupBy("component").agg(F.count_if("moved").alias("moved"))
    return G.landed_clusters(members, added).join(moved, "component")


def gate_full(spark, d) -> DataFrame:
    """Each change set's problems by check, citations among them, and its verdict; with what it lands in: clusters of like orders, orders that nothing is
    still open for, parts that no line passes on, and the share of comment in its files."""
    changed = changes(spark, d)
    checks = gate_checks(spark, d) | {"citations": bad_citations(spark, d)}
    verdicts = G.rollup(checks, changed, "change")
    there = written(changed.where("status <> 'D'").select("change", "order_key", "file"), "changed")
    members = diff_members(spark, d)
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    clustered = members.join(sizes, "component").select(F.col("node").alias("order_key"), "component")
    landed = there.join(clustered, "order_key").groupBy("change").agg(F.count_distinct("component").alias("clusters"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_partkey", "l_quantity", "l_linestatus")
    unused = there.join(lines.where("l_linestatus = 'O'"), "order_key", "left_anti").groupBy("change").agg(F.count("*").alias("orphans"))
    parts = there.join(lines, "order_key").groupBy("change", "order_key", "l_partkey").agg(F.max("l_quantity").alias("most"))
    dead = parts.groupBy("change").agg(F.count_if(F.col("most") < 25).alias("dead_props"))
    density = G.comment_density(there.select("order_key").join(code_lines(spark, d), "order_key").select("file", "line", "text"))
    comments = there.join(density, "file").groupBy("change").agg(F.sum("comment_lines").alias("comment_lines"), F.sum("filled_lines").alias("filled_lines"))
    out = verdicts
    for part in (landed, unused, dead, comments):
        out = out.join(part, "change", "left")
    return out.na.fill(0, ["clusters", "orphans", "dead_props", "comment_lines", "filled_lines"])


def states_of_documents(spark, d) -> list[tuple[DataFrame, str]]:
    """Documents as files at four moments: as they are; toxic ones changed and poor ones gone; the same again; and in another context."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), "doc_id", "text")
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    both = docs.join(labels, "doc_id", "left")
    later = both.where("quality is null or quality > 0").withColumn("text", F.when(F.col("toxic") > 0, F.concat(F.lit("changed\n"), "text")).otherwise(F.col("text")))
    named = lambda df: df.select("path", F.sha2("text", 256).alias("digest"), "text")
    later = written(named(later), "later-documents")  # three builds read it, each twice: their texts are joined with the labels once
    return [(named(docs), "a"), (later, "a"), (later, "a"), (later, "b")]


def incremental_build(spark, d) -> DataFrame:
    """The index after each of four builds: for each bucket the build that wrote it, its files and their lines."""
    root, schema, out = new_path(spark, "documents-index"), "path string, digest string, lines long", None
    parse = lambda files: files.select("path", "digest", F.size(F.split("text", "\n")).cast("long").alias("lines"))
    for k, (files, context) in enumerate(states_of_documents(spark, d)):
        done = builds.build(files, root, context, parse, schema)
        index = builds.read_build(spark, root, schema).withColumn("bucket", builds.bucket_of(F.col("path")))
        rows = index.groupBy("bucket").agg(F.count("*").alias("n_files"), F.sum("lines").alias("n_lines")).join(builds.manifest(spark, root, done.version).select("bucket", "version"), "bucket")
        rows = rows.withColumn("build", F.lit(k + 1)).select("build", "bucket", "version", "n_files", "n_lines")
        out = rows if out is None else out.unionByName(rows)
    return out


BRIEF_BUDGET = 300


def brief_facts(spark, d) -> DataFrame:
    """Nations as features, and what the tables know of each as facts in shards: feature, shard, first, second (their order), text."""
    nation, customer, supplier, orders = (table(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("c_nationkey", "feature")
    lines = table(spark, d, "lineitem")
    used = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")).join(supplier, "s_suppkey")
    brands = lines.select("l_suppkey", "l_partkey").join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("s_nationkey", "p_brand").agg(F.count("*").alias("n"))
    by = lambda key: bought.groupBy("feature", key).agg(F.count("*").alias("n"))
    fact = lambda df, feature, shard, first, second, *text: df.select(F.col(feature).cast("int").alias("feature"), F.lit(shard).alias("shard"), first.cast("double").alias("first"), second.cast("string").alias("second"), F.concat(*text).alias("text"))
    none, c, s = F.lit(0), F.col, lambda x: F.col(x).cast("string")
    parts = [
        fact(nation, "n_nationkey", "00-DIGEST.md", none, F.lit("a"), F.lit("nation "), c("n_name")),
        fact(customer.groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey", "00-DIGEST.md", none, F.lit("b"), F.lit("customers "), s("n")),
        fact(used, "s_nationkey", "10-precedents.md", -c("n"), c("s_name"), c("s_name"), F.lit(" used by "), s("n")),
        fact(by("o_orderpriority"), "feature", "20-conventions.md", -c("n"), c("o_orderpriority"), c("o_orderpriority"), F.lit(": "), s("n")),
        fact(by("o_orderstatus"), "feature", "30-state.md", -c("n"), c("o_orderstatus"), F.lit("status "), c("o_orderstatus"), F.lit(": "), s("n")),
        fact(bought.where("o_orderpriority = '1-URGENT'"), "feature", "40-routes.md", -c("o_totalprice"), c("o_orderkey"), F.lit("route to order "), s("o_orderkey")),
        fact(brands, "s_nationkey", "50-design-tokens.md", -c("n"), c("p_brand"), F.lit("--"), F.lower("p_brand"), F.lit(": "), s("n")),
        fact(customer.where("c_acctbal < 0"), "c_nationkey", "70-risk.md", c("c_acctbal"), c("c_custkey"), c("c_name"), F.lit(" owes")),
        fact(bought.where("o_orderstatus = 'P'"), "feature", "90-open-questions.md", -c("o_totalprice"), c("o_orderkey"), F.lit("is order "), s("o_orderkey"), F.lit(" to be closed?")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def brief_shards(spark, d) -> DataFrame:
    return B.shards(brief_facts(spark, d), ["feature"], [F.col("first"), F.col("second")], BRIEF_BUDGET)


def brief_routes(spark, d) -> DataFrame:
    """For each nation as a feature and each role, the shards of its brief that the role reads."""
    return B.routed(brief_shards(spark, d))


def brief_costs(spark, d) -> DataFrame:
    """What the steps of a run of each size cost with each nation's brief."""
    return B.run_costs(brief_shards(spark, d), ["feature"])


def meta_totals(spark, d) -> DataFrame:
    """Documents and characters by source and language, by either and in all, and whether the sketch of distinct texts comes within a tenth of their number."""
    docs = table(spark, d, "documents")
    sketched = T.totals(docs, ["source", "lang"], {"chars": F.col("n_chars")}, {"texts": F.col("text")})
    exact = docs.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")], [F.col("lang")], []], "source", "lang").agg(F.grouping_id().cast("int").alias("level"), F.count_distinct("text").alias("exact"))
    same = (sketched["level"] == exact["level"]) & sketched["source"].eqNullSafe(exact["source"]) & sketched["lang"].eqNullSafe(exact["lang"])
    close = F.abs(F.col("texts") - F.col("exact")) * 10 <= F.col("exact")
    return sketched.join(exact, same).select(sketched["source"], sketched["lang"], sketched["level"], "n", "chars", "exact", close.alias("close"))


def ordered_sets(spark, d) -> DataFrame:
    """Each order's brands in the order in which its lines first name them."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    found = T.ordered_distinct(lines, ["l_orderkey"], "p_brand", ["l_linenumber", "l_partkey", "l_suppkey"], "brands")
    return found.select("l_orderkey", F.array_join("brands", ",").alias("brands"))


def kept_entities(spark, d) -> DataFrame:
    """What an index keeps of the parts as entities."""
    return T.kept_entities(entities(spark, d).withColumn("source", F.lit("text"))).select("id", "kind", "exported")


def bounded_reports(spark, d) -> DataFrame:
    """The cycles, chains and orphans that reports show, and how many each leaves out: cycles of parts by size, chains by depth, parts by use."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ">")
    cycles = written(H.simple_cycles(part_edges(spark, d), 3), "cycles")
    chains = written(H.pass_chains(tree_edges(spark, d), 6), "chains")
    used = table(spark, d, "lineitem").where("l_returnflag = 'A' and l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    alone = table(spark, d, "part").join(used, "p_partkey", "left_anti")
    return (
        T.bounded(cycles, "cycles", text(F.col("path")), [F.col("size"), F.col("path")], 50)
        .unionByName(T.bounded(chains, "chains", text(F.col("path")), [-F.col("depth"), text(F.col("path"))], 25))
        .unionByName(T.bounded(alone, "orphans", F.col("p_partkey"), [F.col("p_partkey")], 60))
    )


def search_reasons(spark, d) -> DataFrame:
    """Every part that the request finds, with the reasons for its score."""
    host = F.array(F.lower("host"))
    found = S.search(parts_as_entities(spark, d), REQUEST, None, ordered=False)
    why = S.reasons(REQUEST, F.col("name"), F.col("usage_count"), F.col("deprecated"), F.col("path"), host)
    return found.select("id", "score", F.array_join(why, " ").alias("why"))


def like_parts(spark, d) -> DataFrame:
    """Clusters of parts that share a name and a brand; parts without another like them have none."""
    same = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("cluster"), F.count("*").alias("n")).where("n > 1")
    return table(spark, d, "part").join(same, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("id"), "cluster")


def precedent_clusters(spark, d) -> DataFrame:
    """The best parts for the request, and of how many clusters they are."""
    ranked = S.precedents(parts_as_entities(spark, d), REQUEST, 20)
    return S.precedent_report(ranked, like_parts(spark, d)).select("rank", "id", "usage_count", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "clusters")


def duplicates_report(spark, d) -> DataFrame:
    """The forty largest clusters of suppliers with like contracts, with the best of each."""
    return C.duplicates(C.contract_members(contracts(spark, d)))


CLUSTERS = """
shared AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_orderkey AS src FROM lineitem),
edges AS (SELECT DISTINCT src, dst FROM (SELECT src, lead(src) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY src) AS dst FROM shared) WHERE dst IS NOT NULL),
fresh AS (SELECT src, dst FROM edges WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') OR dst IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')),
old AS (SELECT src, dst FROM edges EXCEPT SELECT src, dst FROM fresh),
linked AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
old_linked AS (SELECT src, dst FROM old UNION SELECT dst, src FROM old),
closed AS (SELECT src AS node, src AS other FROM linked UNION SELECT node, dst FROM closed JOIN linked ON src = other),
old_closed AS (SELECT src AS node, src AS other FROM old_linked UNION SELECT node, dst FROM old_closed JOIN old_linked ON src = other),
members AS (SELECT node, min(other) AS component FROM closed GROUP BY node),
before AS (SELECT node, min(other) AS component FROM old_closed GROUP BY node)"""

QUERIES = {
    "diff_clusters": diff_clusters, "gate_full": gate_full, "incremental_build": incremental_build,
    "brief_routes": brief_routes, "brief_costs": brief_costs, "meta_totals": meta_totals, "ordered_sets": ordered_sets, "kept_entities": kept_entities, "bounded_reports": bounded_reports,
    "search_reasons": search_reasons, "precedent_clusters": precedent_clusters, "duplicates_report": duplicates_report,
}
BRIEF = f"""
bought AS (SELECT o.*, c_nationkey AS feature FROM orders o JOIN customer ON o_custkey = c_custkey),
facts AS (
  SELECT n_nationkey AS feature, '00-DIGEST.md' AS shard, 0.0 AS first, 'a' AS second, 'nation ' || n_name AS text FROM nation
  UNION ALL SELECT c_nationkey, '00-DIGEST.md', 0, 'b', 'customers ' || count(*) FROM customer GROUP BY 1
  UNION ALL SELECT s_nationkey, '10-precedents.md', -n, s_name, s_name || ' used by ' || n FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
  UNION ALL SELECT feature, '20-conventions.md', -count(*), o_orderpriority, o_orderpriority || ': ' || count(*) FROM bought GROUP BY feature, o_orderpriority
  UNION ALL SELECT feature, '30-state.md', -count(*), o_orderstatus, 'status ' || o_orderstatus || ': ' || count(*) FROM bought GROUP BY feature, o_orderstatus
  UNION ALL SELECT feature, '40-routes.md', -o_totalprice, o_orderkey::VARCHAR, 'route to order ' || o_orderkey FROM bought WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT s_nationkey, '50-design-tokens.md', -count(*), p_brand, '--' || lower(p_brand) || ': ' || count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY s_nationkey, p_brand
  UNION ALL SELECT c_nationkey, '70-risk.md', c_acctbal, c_custkey::VARCHAR, c_name || ' owes' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT feature, '90-open-questions.md', -o_totalprice, o_orderkey::VARCHAR, 'is order ' || o_orderkey || ' to be closed?' FROM bought WHERE o_orderstatus = 'P'),
summed AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY feature, shard ORDER BY first, second ROWS UNBOUNDED PRECEDING) - 1 AS chars FROM facts),
told AS (SELECT feature, shard, CAST(floor(chars / 4 + 0.5) AS BIGINT) AS t FROM summed),
shards AS (
  SELECT feature, shard, count(*) FILTER (WHERE t <= {BRIEF_BUDGET}) AS lines, coalesce(max(t) FILTER (WHERE t <= {BRIEF_BUDGET}), 0) AS tokens, count(*) FILTER (WHERE t > {BRIEF_BUDGET}) AS suppressed FROM told GROUP BY ALL),
roles AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{p}')" for r, own in V.ROLE_ROUTING.items() for p in own)}) AS t(role, prefix))"""


def brief_costs_sql() -> str:
    rows = []
    for size, r in V.SIZES.items():
        second = max(2, -(-r["experts"] * 3 // 10)) if r["rounds"] >= 2 else 0
        plain, skilled = V.AGENT_PROMPT, V.AGENT_PROMPT + V.SKILL
        rows += [
            (size, "preflight", 1, f"{plain + 1200}"), (size, "intake", 2, f"digest + {plain + 1200}"), (size, "explore", r["explorers"], f"digest + floor(every / 5 + 0.5) + {skilled + 1200}"),
            (size, "synthesize", min(1, r["explorers"]), f"digest + {plain + 1500}"), (size, "spec", 1, f"spec + {skilled + 3500}"), (size, "design round 1", r["experts"], f"expert + {skilled + V.PLAN + 1200}"),
            (size, "design round 2", second, f"expert + {plain + V.PLAN + 1200}"), (size, "plan-attack", 1, f"attack + {plain + V.PLAN + 1500}"), (size, "build", r["implementers"] + 1, f"floor(every / 4 + 0.5) + {skilled + V.PLAN + 2500}"),
            (size, "verify", r["verifiers"], f"{skilled + V.DIFF + -(-V.SPEC // 2) + 1800}"), (size, "integrate", 2, f"{plain + V.DIFF + V.SPEC + 1500}"), (size, "release", 4, f"{plain + 1200}"), (size, "supervision", 3, f"{plain + 2000}"),
        ]
    steps = " UNION ALL ".join(f"SELECT feature, '{size}' AS size, '{step}' AS step, {n} AS agents, CAST({each} AS BIGINT) AS per_agent FROM known" for size, step, n, each in rows)
    return f"""WITH {BRIEF},
read AS (SELECT feature, role, sum(tokens) AS cost FROM shards JOIN roles ON starts_with(shard, prefix) GROUP BY ALL),
costs AS (
  SELECT feature, max(cost) FILTER (WHERE role = 'fe-spec-writer') AS spec, max(cost) FILTER (WHERE role = 'fe-red-team') AS attack,
    floor(avg(cost) FILTER (WHERE ends_with(role, '-expert') OR role IN ('fe-ux-analyst', 'fe-devils-advocate')) + 0.5) AS expert FROM read GROUP BY 1),
sums AS (SELECT feature, sum(CASE WHEN shard IN ('00-DIGEST.md', '90-open-questions.md') THEN tokens ELSE 0 END) AS digest, sum(tokens) AS every FROM shards GROUP BY 1),
known AS (SELECT * FROM sums JOIN costs USING (feature)),
steps AS ({steps})
SELECT *, agents * per_agent AS tokens FROM steps"""


ORACLES = {
    "brief_routes": f"WITH {BRIEF} SELECT DISTINCT feature, shard, lines, tokens, suppressed, role FROM shards JOIN roles ON starts_with(shard, prefix)",
    "brief_costs": brief_costs_sql(),
    "meta_totals": """
SELECT source, lang, CAST(grouping(source, lang) AS INTEGER) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS exact, true AS close
FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""",
    "ordered_sets": """
WITH placed AS (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
first AS (SELECT l_orderkey, p_brand, min(n) AS n FROM placed GROUP BY ALL)
SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY n) AS brands FROM first GROUP BY 1""",
    "search_reasons": f"""{SCORED},
told AS (
  SELECT *, {" || ".join(f"CASE WHEN list_contains(names, '{t}') THEN 'name:{t} ' WHEN len([x FOR x IN names IF starts_with(x, '{t}') OR starts_with('{t}', x)]) > 0 THEN 'name~{t} ' ELSE '' END || CASE WHEN list_contains(paths, '{t}') THEN 'path:{t} ' ELSE '' END || CASE WHEN lower(host) = '{t}' THEN 'host:{t} ' ELSE '' END" for t in ("red", "widget"))} AS found
  FROM scored WHERE score > 0)
SELECT id, score, trim(found || CASE WHEN usage_count > 0 THEN 'usage:' || usage_count || ' ' ELSE '' END || CASE WHEN deprecated THEN 'deprecated' ELSE '' END) AS why FROM told""",
    "precedent_clusters": f"""{SCORED},
best AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, usage_count DESC, id LIMIT 20),
like_parts AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS c, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part)
SELECT CAST(row_number() OVER (ORDER BY deprecated, usage_count DESC, recency DESC, id) AS INT) AS rank, id, usage_count, coalesce(c, -1) AS cluster,
  CAST(greatest((SELECT count(DISTINCT c) FROM best JOIN like_parts ON p_partkey = id WHERE n > 1), 1) AS INT) AS clusters
FROM best LEFT JOIN like_parts ON p_partkey = id AND n > 1""",
    "duplicates_report": f"""
WITH members AS ({CODE_ORACLES["duplicates"]})
SELECT cluster, size, total_usage, id AS best FROM members WHERE rank = 1 ORDER BY size DESC, total_usage DESC, cluster LIMIT 40""",
    "kept_entities": """
SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'component' WHEN 1 THEN 'hook' ELSE 'util' END AS kind, p_retailprice > 1000 AS exported FROM part WHERE p_size % 3 < 2 OR p_retailprice > 1000""",
    "bounded_reports": f"""
WITH RECURSIVE {PARTS}, pairs AS (SELECT DISTINCT src, dst FROM follows WHERE src <> dst),
rings AS (
  SELECT [src, dst] AS path, dst AS last FROM pairs WHERE dst > src
  UNION ALL SELECT list_append(path, dst), dst FROM rings JOIN pairs ON src = last WHERE dst > path[1] AND NOT list_contains(path, dst) AND len(path) < 3),
cycles AS (SELECT path, row_number() OVER (ORDER BY len(path), path) AS n FROM rings JOIN pairs ON src = last AND dst = path[1]),
{TREE},
ways AS (
  SELECT [src, dst] AS path, dst AS last FROM edges
  UNION ALL SELECT list_append(path, dst), dst FROM ways JOIN edges ON src = last WHERE NOT list_contains(path, dst)),
ended AS (SELECT array_to_string(path, '>') AS path, len(path) AS depth FROM ways w WHERE len(path) >= 3 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = w.last)),
chains AS (SELECT path, row_number() OVER (ORDER BY depth DESC, path) AS n FROM ended),
alone AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 45)),
found AS (
  SELECT 'cycles' AS what, n, array_to_string(path, '>') AS item, 50 AS most FROM cycles UNION ALL SELECT 'chains', n, path, 25 FROM chains UNION ALL SELECT 'orphans', n, p_partkey::VARCHAR, 60 FROM alone)
SELECT what, CAST(n AS INTEGER) AS place, item FROM found WHERE n <= most
UNION ALL SELECT what, 0, 'suppressed: ' || (count(*) - any_value(most)) FROM found GROUP BY what HAVING count(*) > any_value(most)""",
    "diff_clusters": f"""
WITH RECURSIVE {CLUSTERS}
SELECT m.component, count(*) AS size, count(*) FILTER (WHERE o_orderstatus = 'O') AS landed, count(*) FILTER (WHERE b.component IS DISTINCT FROM m.component) AS moved
FROM members m LEFT JOIN before b ON b.node = m.node LEFT JOIN orders ON o_orderkey = m.node GROUP BY m.component
HAVING count(*) > 1 AND count(*) FILTER (WHERE o_orderstatus = 'O') > 0""",
    "gate_full": f"""
WITH RECURSIVE verdicts AS ({CODE_ORACLES["gate_rollup"]}),
{CODE},
{CLUSTERS},
changed AS (
  SELECT o_custkey AS change, o_orderkey AS order_key, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_key FROM orders),
cites AS (SELECT change, order_key, before_key, order_key % 6 + 1 AS l, {SYMBOLS}[order_key % {len(SYMBOLS)} + 1] AS symbol FROM changed WHERE s = 'F'),
last_lines AS (SELECT order_key AS k, max(line) AS last_line FROM code GROUP BY 1),
good AS (SELECT DISTINCT c.order_key FROM cites c JOIN code x ON x.order_key = before_key AND x.line BETWEEN l - 2 AND l + 2 WHERE regexp_matches(x.text, '(^|[^A-Za-z0-9_])' || symbol || '([^A-Za-z0-9_]|$)')),
bad AS (
  SELECT change, count(*) AS citations FROM cites LEFT JOIN last_lines ON k = before_key
  WHERE before_key IS NULL OR last_line IS NULL OR l > last_line OR order_key NOT IN (SELECT order_key FROM good) GROUP BY 1),
there AS (SELECT change, order_key FROM changed WHERE s IN ('O', 'F')),
sized AS (SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM members),
landed AS (SELECT change, count(DISTINCT component) AS clusters FROM there JOIN sized ON node = order_key WHERE size > 1 GROUP BY 1),
unused AS (SELECT change, count(*) AS orphans FROM there WHERE order_key NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1),
parts AS (SELECT change, order_key, l_partkey, max(l_quantity) AS most FROM there JOIN lineitem ON l_orderkey = order_key GROUP BY ALL),
dead AS (SELECT change, count(*) FILTER (WHERE most < 25) AS dead_props FROM parts GROUP BY 1),
comments AS (SELECT change, count(*) FILTER (WHERE starts_with(text, '//')) AS comment_lines, count(*) AS filled_lines FROM there JOIN code USING (order_key) GROUP BY 1)
SELECT v.* EXCLUDE (verdict), coalesce(citations, 0) AS citations, CASE WHEN verdict = 'BLOCK' OR citations > 0 THEN 'BLOCK' ELSE 'PASS' END AS verdict,
  coalesce(clusters, 0) AS clusters, coalesce(orphans, 0) AS orphans, coalesce(dead_props, 0) AS dead_props, coalesce(comment_lines, 0) AS comment_lines, coalesce(filled_lines, 0) AS filled_lines
FROM verdicts v LEFT JOIN bad USING (change) LEFT JOIN landed USING (change) LEFT JOIN unused USING (change) LEFT JOIN dead USING (change) LEFT JOIN comments USING (change)""",
    "incremental_build": """
WITH files AS (
  SELECT CAST(CAST('0x' || substring(md5('d' || d.doc_id), 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket, len(string_split(text, chr(10))) AS lines,
    coalesce(quality > 0, true) AS stays, coalesce(toxic > 0, false) AND text IS NOT NULL AS changes
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
first AS (SELECT bucket, 1 AS version, count(*) AS n_files, CAST(sum(lines) AS BIGINT) AS n_lines FROM files GROUP BY bucket),
later AS (
  SELECT bucket, CASE WHEN bool_or(changes OR NOT stays) THEN 2 ELSE 1 END AS version, count(*) FILTER (WHERE stays) AS n_files,
    CAST(sum(CASE WHEN stays THEN lines + CASE WHEN changes THEN 1 ELSE 0 END END) AS BIGINT) AS n_lines FROM files GROUP BY bucket HAVING bool_or(stays))
SELECT 1 AS build, * FROM first UNION ALL SELECT 2, * FROM later UNION ALL SELECT 3, * FROM later UNION ALL SELECT 4, bucket, 3, n_files, n_lines FROM later""",
}
