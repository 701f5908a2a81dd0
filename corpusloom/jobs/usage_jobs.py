"""Usage, convention and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import SECRETS
from ..operators import conventions as C
from ..operators import rules as R
from ..operators import usage as U
from ..sources.tables import events_as_findings, table
from .search_jobs import FINDINGS


def usage_count(spark, d) -> DataFrame:
    return U.usage_counts(table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "lineitem"), "p_partkey", "l_partkey")


def call_site_sample(spark, d) -> DataFrame:
    """The first five lines of each part, and how many more it has."""
    sites = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return U.site_sample(sites, "l_partkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"], 5)


def passed_priorities(spark, d) -> DataFrame:
    """Order priorities as attributes that nations pass."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority", (F.col("o_totalprice") > 250000).alias("spread"))


def prop_usage(spark, d) -> DataFrame:
    return U.attribute_usage(passed_priorities(spark, d), "c_nationkey", "o_orderpriority")


def declared_priorities(spark, d) -> DataFrame:
    """What customers' nations declare: the priorities of cheap orders."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    cheap = table(spark, d, "orders").where("o_totalprice < 3000").select("o_custkey", "o_orderpriority")
    return cheap.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderpriority")


def dear_priorities(spark, d) -> DataFrame:
    return passed_priorities(spark, d).where("spread")


def prop_stats(spark, d) -> DataFrame:
    stats = U.attribute_stats(declared_priorities(spark, d), passed_priorities(spark, d), "c_nationkey", "o_orderpriority", "spread")
    return stats.withColumn("never_passed", F.concat_ws("|", "never_passed")).withColumn("undeclared", F.concat_ws("|", "undeclared"))


def unused_props(spark, d) -> DataFrame:
    usage = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("usage_count"))
    stats = U.attribute_stats(declared_priorities(spark, d), dear_priorities(spark, d), "c_nationkey", "o_orderpriority")
    return U.unused_attributes(stats, usage, "c_nationkey").select("c_nationkey", "declared", "passed_somewhere", "waste", "usage_count")


def external_usage(spark, d) -> DataFrame:
    return U.external_usage((table(spark, d, "customer"), "c_mktsegment"), (table(spark, d, "lineitem"), "l_returnflag"), (table(spark, d, "events"), "event_type"))


def orphans(spark, d) -> DataFrame:
    """Documents without a label, but those of the first source."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return U.orphans(docs, table(spark, d, "labels"), "doc_id", "doc_id", F.col("source") == "src0")


def barrels(spark, d) -> DataFrame:
    return U.barrels(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R", F.col("l_returnflag") == "R")


def rule_histogram(spark, d) -> DataFrame:
    return R.rule_histogram(events_as_findings(spark, d))


def severity_pivot(spark, d) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return events_as_findings(spark, d).groupBy("file").agg(*counts)


def convention_verdict(spark, d) -> DataFrame:
    """The dominant language of each source."""
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("hits"))
    return C.verdicts(counts, "source", "lang")


def tag_scan(spark, d) -> DataFrame:
    found = R.elements(table(spark, d, "pages"), "page_id", "html")
    return found.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.size("attrs")).alias("attributes"))


def tag_missing_attr(spark, d) -> DataFrame:
    found = R.elements(table(spark, d, "pages"), "page_id", "html")
    return R.element_findings(found, "page_id").groupBy("rule", "severity", "heuristic").agg(F.count("*").alias("findings"), F.countDistinct("page_id").alias("pages"))


def heading_skip(spark, d) -> DataFrame:
    """Events of a user whose value class is more than one above the event's before."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") / 50).alias("level"))
    return R.heading_skips(rows, "user_id", ["ts", "event_id"], "level").select("user_id", "event_id", "level", "level_before")


def line_explode(spark, d) -> DataFrame:
    rows = R.lines(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.max("line").alias("lines"), F.count_if(F.trim("text") == "").alias("blank"), F.sum(F.length("text")).alias("chars"))


def secret_scan(spark, d) -> DataFrame:
    return R.secrets(R.lines(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


STATS = """
passed AS (SELECT c_nationkey, o_orderpriority, o_totalprice > 250000 AS spread FROM orders JOIN customer ON o_custkey = c_custkey),
declared AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice < 3000)"""


def stats_sql(passed: str, spread: str) -> str:
    return f"""
stats AS (
  SELECT coalesce(d.c_nationkey, p.c_nationkey) AS c_nationkey, count(d.o_orderpriority) AS declared,
         count(*) FILTER (WHERE d.o_orderpriority IS NOT NULL AND p.o_orderpriority IS NOT NULL) AS passed_somewhere,
         coalesce(string_agg(d.o_orderpriority, '|' ORDER BY d.o_orderpriority) FILTER (WHERE p.o_orderpriority IS NULL), '') AS never_passed,
         coalesce(string_agg(p.o_orderpriority, '|' ORDER BY p.o_orderpriority) FILTER (WHERE d.o_orderpriority IS NULL), '') AS undeclared,
         count(*) FILTER (WHERE (d.o_orderpriority IS NULL) <> (p.o_orderpriority IS NULL)) AS waste{spread}
  FROM declared d FULL JOIN ({passed}) p
    ON d.c_nationkey = p.c_nationkey AND d.o_orderpriority = p.o_orderpriority GROUP BY 1)"""


def verdict_sql(counts: str, category: str, option: str) -> str:
    return f"""
WITH counts AS ({counts}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {category} ORDER BY hits DESC, {option}) AS place FROM counts),
best AS (
  SELECT {category}, max(CASE WHEN place = 1 AND hits > 0 THEN {option} END) AS winner, max(CASE WHEN place = 1 THEN hits END) AS hits,
         coalesce(max(CASE WHEN place = 2 THEN hits END), 0) AS runner_up_hits
  FROM ranked GROUP BY {category})
SELECT *, CASE WHEN hits <= 0 THEN 'NONE-FOUND' WHEN hits >= 3 * runner_up_hits THEN 'DOMINANT' ELSE 'COMPETING' END AS verdict FROM best"""


TAGS = r"""
raws AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z-]+\s*=\s*"[^"]*")*\s*/?>')) AS raw FROM pages),
found AS (
  SELECT page_id, raw, lower(regexp_extract(raw, '^<([a-zA-Z0-9]+)', 1)) AS tag,
         list_transform(regexp_extract_all(raw, '([a-zA-Z-]+)\s*=\s*"[^"]*"', 1), lambda x: lower(x)) AS attrs FROM raws)"""


def rules_sql() -> str:
    quote = lambda p: p.replace("'", "''").replace("(?i)", "")
    cases = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, '{s}' AS severity, doc_id, line FROM placed WHERE regexp_matches(text, '{quote(p)}'{', ' + repr('i') if p.startswith('(?i)') else ''})" for n, s, p in SECRETS
    )
    return f"""
WITH placed AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT rule, severity, doc_id, CAST(line AS INT) AS line FROM ({cases})"""


QUERIES = {
    "usage_count": usage_count,
    "call_site_sample": call_site_sample,
    "prop_usage": prop_usage,
    "prop_stats": prop_stats,
    "unused_props": unused_props,
    "external_usage": external_usage,
    "orphans": orphans,
    "barrels": barrels,
    "rule_histogram": rule_histogram,
    "severity_pivot": severity_pivot,
    "convention_verdict": convention_verdict,
    "tag_scan": tag_scan,
    "tag_missing_attr": tag_missing_attr,
    "heading_skip": heading_skip,
    "line_explode": line_explode,
    "secret_scan": secret_scan,
}
ORACLES = {
    "usage_count": "SELECT p_partkey, p_brand, count(l_partkey) AS usage_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL",
    "call_site_sample": """
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, place, greatest(n - 5, 0) AS truncated FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS INT) AS place,
         count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
WHERE place <= 5""",
    "prop_usage": "SELECT c_nationkey, o_orderpriority, count(*) AS passed FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "prop_stats": f"WITH {STATS}, {stats_sql('SELECT c_nationkey, o_orderpriority, count(*) FILTER (WHERE spread) AS n FROM passed GROUP BY ALL', ', CAST(coalesce(sum(p.n), 0) AS BIGINT) AS spread_sites')} SELECT c_nationkey, declared, passed_somewhere, never_passed, undeclared, spread_sites FROM stats",
    "unused_props": f"""WITH {STATS}, {stats_sql("SELECT DISTINCT c_nationkey, o_orderpriority FROM passed WHERE spread", "")}
SELECT c_nationkey, declared, passed_somewhere, CAST(waste AS INT) AS waste, usage_count
FROM stats JOIN (SELECT c_nationkey, count(*) AS usage_count FROM customer GROUP BY 1) USING (c_nationkey)
WHERE usage_count >= 2 AND waste > 0 ORDER BY waste DESC, c_nationkey LIMIT 40""",
    "external_usage": """
SELECT package, count(*) AS uses FROM (SELECT c_mktsegment AS package FROM customer UNION ALL SELECT l_returnflag FROM lineitem UNION ALL SELECT event_type FROM events) GROUP BY package""",
    "orphans": "SELECT doc_id, source, lang FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "barrels": "SELECT l_orderkey, count(*) AS reexports FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (WHERE l_returnflag = 'R') = 0",
    "rule_histogram": f"WITH {FINDINGS} SELECT rule, count(*) AS findings FROM findings GROUP BY rule",
    "severity_pivot": f"""WITH {FINDINGS}
SELECT file, count(*) FILTER (WHERE level = 4) AS critical, count(*) FILTER (WHERE level = 3) AS high,
       count(*) FILTER (WHERE level = 2) AS medium, count(*) FILTER (WHERE level = 1) AS low FROM findings GROUP BY file""",
    "convention_verdict": verdict_sql("SELECT source, lang, count(*) AS hits FROM documents GROUP BY ALL", "source", "lang"),
    "tag_scan": f"WITH {TAGS} SELECT tag, count(*) AS n, CAST(sum(len(attrs)) AS BIGINT) AS attributes FROM found GROUP BY tag",
    "tag_missing_attr": rf"""WITH {TAGS},
hits AS (
  SELECT page_id, unnest(list_filter([
    CASE WHEN tag = 'html' AND NOT list_contains(attrs, 'lang') THEN {{'rule': 'SEO-HTML-NO-LANG', 'severity': 'medium', 'heuristic': false}} END,
    CASE WHEN tag = 'a' AND NOT list_contains(attrs, 'class') THEN {{'rule': 'A11Y-ANCHOR-NO-CLASS', 'severity': 'low', 'heuristic': true}} END,
    CASE WHEN starts_with(regexp_extract(raw, '\shref\s*=\s*"([^"]*)"', 1), 'http:') THEN {{'rule': 'SEC-HREF-HTTP', 'severity': 'medium', 'heuristic': false}} END,
    CASE WHEN tag = 'a' AND list_contains(attrs, 'onclick') AND NOT list_contains(attrs, 'href') THEN {{'rule': 'A11Y-ANCHOR-NO-HREF', 'severity': 'high', 'heuristic': false}} END
  ], lambda x: x IS NOT NULL)) AS h FROM found)
SELECT h.rule AS rule, h.severity AS severity, h.heuristic AS heuristic, count(*) AS findings, count(DISTINCT page_id) AS pages FROM hits GROUP BY ALL""",
    "heading_skip": """
SELECT user_id, event_id, level, level_before FROM (
  SELECT user_id, event_id, CAST(floor(value / 50) AS BIGINT) AS level,
         lag(CAST(floor(value / 50) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS level_before FROM events)
WHERE level > level_before + 1""",
    "line_explode": """
SELECT doc_id, CAST(count(*) AS INT) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, CAST(sum(length(line)) AS BIGINT) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
    "secret_scan": rules_sql(),
}
