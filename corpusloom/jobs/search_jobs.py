"""Search, precedent and finding queries over parts, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import CATEGORIES, NAME_STOP_TOKENS, QUERY_STOP_WORDS
from ..functions.text import deprecated_name, estimated_tokens, name_tokens, query_tokens
from ..operators import search as S
from ..sources.derived import LINES, PATHS, code_lines
from ..sources.tables import events_as_findings, parts_as_entities, table

REQUEST = "add a red widget"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: The derived code base, as a common table expression.
CODE = f"""
code AS (
  SELECT l_orderkey AS order_key, replace({sql_list(PATHS)}[l_orderkey % {len(PATHS)} + 1], '@', CAST(l_orderkey AS VARCHAR)) AS file, CAST(l_linenumber AS INT) AS line,
         replace({sql_list(LINES)}[(l_partkey * 7 + l_suppkey * 3 + l_linenumber * 5) % {len(LINES)} + 1], '@', CAST(l_suppkey AS VARCHAR)) AS text, l_suppkey AS widget
  FROM lineitem)"""

ENTITIES = """
entities AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS path, p_brand AS host, coalesce(n, 0) AS usage_count, recency
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS recency FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""

SCORED = f"""
WITH {ENTITIES},
tokens AS (
  SELECT *, list_filter(string_split(lower(name), ' '), lambda t: t <> '' AND NOT list_contains({sql_list(NAME_STOP_TOKENS)}, t)) AS names,
         list_filter(regexp_split_to_array(lower(path), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(QUERY_STOP_WORDS)}, t)) AS paths
  FROM entities),
hit AS (
  SELECT *, CAST((SELECT sum(
      CASE WHEN list_contains(names, t) THEN 3000
           WHEN len(list_filter(names, lambda x: starts_with(x, t) OR starts_with(t, x))) > 0 THEN 1600 ELSE 0 END
      + CASE WHEN list_contains(paths, t) THEN 1400 ELSE 0 END
      + CASE WHEN lower(host) = t THEN 800 ELSE 0 END) FROM (VALUES ('red'), ('widget')) AS q(t)) AS BIGINT) AS hits,
    regexp_matches(lower(name), '\\b(legacy|deprecated|old|v1|obsolete)\\b') AS deprecated
  FROM tokens),
scored AS (
  SELECT *, CASE WHEN hits > 0 THEN CAST(hits + floor(900 * log10(usage_count + 1.0) + 0.5) - CASE WHEN deprecated THEN 2500 ELSE 0 END AS BIGINT)
            ELSE 0 END AS score
  FROM hit)"""


def search_score(spark, d) -> DataFrame:
    """Every part's points for the request, without a limit."""
    return S.search(parts_as_entities(spark, d), REQUEST, None, ordered=False).select("id", "name", "hits", "deprecated", "score", "usage_count")


def search_filtered(spark, d) -> DataFrame:
    """Hits among parts of a size, a brand and a price, used often enough: filters reach the scan."""
    parts = table(spark, d, "part").where((F.col("p_size") >= 10) & F.lower("p_type").contains("a") & (F.col("p_retailprice") > 900)).select(F.col("p_partkey").alias("id"))
    entities = parts_as_entities(spark, d).join(parts, "id", "left_semi").where("usage_count >= 25")
    return S.search(entities, REQUEST, 20).select("id", "name", "hits", "score", "usage_count")


def precedent_rank(spark, d) -> DataFrame:
    ranked = S.precedents(parts_as_entities(spark, d), REQUEST, 8)
    return ranked.select("rank", "id", F.concat_ws(":", "path", "name").alias("location"), "hits", F.date_format("recency", "yyyy-MM-dd").alias("last_modified"), "deprecated", "usage_count")


def find_by_name(spark, d) -> DataFrame:
    """Customers by a market segment's name in another case."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"))
    return S.find_by_name(customers, "Building")


def findings_filtered(spark, d) -> DataFrame:
    """Findings of some rules, high or worse, in files with a 7, no guesses among them."""
    return S.signals(events_as_findings(spark, d), "err,pur", "high", "7", heuristic=False, limit=None, ordered=False)


def findings_top(spark, d) -> DataFrame:
    return S.signals(events_as_findings(spark, d), limit=100).select("rule", "severity", "file", "line")


def props_all(spark, d) -> DataFrame:
    """Orders whose lines have all of two return flags."""
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return flags.where(S.has_all(["A", "R"], F.col("flags"))).select("l_orderkey", F.concat_ws(",", "flags").alias("flags"))


def name_token_counts(spark, d) -> DataFrame:
    tokens = table(spark, d, "part").select(F.explode(name_tokens(F.col("p_name"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def query_token_counts(spark, d) -> DataFrame:
    tokens = table(spark, d, "conversations").select(F.explode(query_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def token_estimates(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


def deprecated_parts(spark, d) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", deprecated_name(F.col("p_name")).alias("deprecated"))
    return rows.groupBy("p_brand", "deprecated").agg(F.count("*").alias("n"))


def category_infer(spark, d) -> DataFrame:
    """For each turn of a conversation, its categories by number of cues, the first eight."""
    return categories(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])


def category_lines(spark, d) -> DataFrame:
    """For each different line of the derived code base, its categories by number of cues, the first eight."""
    return categories(code_lines(spark, d).select(F.md5("text").alias("digest"), "text").distinct(), ["digest"])


def categories(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, category, cues and place for texts (keys, text): the first eight categories that a text has cues of."""
    turns = texts.select(*keys, F.lower("text").alias("lower"), query_tokens(F.col("text")).alias("tokens"))
    hits = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(c).alias("category"), cue_count(cues).alias("cues")) for k, (c, cues) in enumerate(CATEGORIES)])
    rows = turns.select(*keys, F.inline(F.filter(hits, lambda h: h["cues"] > 0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cues"), "at"))
    return rows.withColumn("place", place).where("place <= 8").select(*keys, "category", "cues", "place")


def cue_count(cues: list[str]):
    """Phrases count where the text has them, single words where they are one of its tokens."""
    total = F.lit(0)
    for cue in cues:
        met = F.col("lower").contains(cue) if " " in cue else F.array_contains("tokens", cue)
        total = total + met.cast("int")
    return total


def category_sql(texts: str, keys: str) -> str:
    count = lambda cues: " + ".join(f"CAST({'contains(low, ' + repr(c) + ')' if ' ' in c else 'list_contains(tokens, ' + repr(c) + ')'} AS INT)" for c in cues)
    items = ", ".join(f"{{'at': {k}, 'category': '{c}', 'cues': {count(cues)}}}" for k, (c, cues) in enumerate(CATEGORIES))
    return f"""
turns AS (
  SELECT {keys}, lower(text) AS low,
         list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({sql_list(QUERY_STOP_WORDS)}, t)) AS tokens
  FROM {texts}),
hits AS (SELECT {keys}, unnest([{items}]) AS h FROM turns),
ranked AS (
  SELECT {keys}, h.category AS category, h.cues AS cues,
         row_number() OVER (PARTITION BY {keys} ORDER BY h.cues DESC, h.at) AS place
  FROM hits WHERE h.cues > 0)
SELECT * FROM ranked WHERE place <= 8"""


FINDINGS = """
findings AS (
  SELECT upper(event_type) AS rule, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity,
         CAST(user_id AS VARCHAR) AS file, event_id AS line, value < 50 AS heuristic,
         CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS level
  FROM events)"""

QUERIES = {
    "search_score": search_score,
    "search_filtered": search_filtered,
    "precedent_rank": precedent_rank,
    "find_by_name": find_by_name,
    "findings_filtered": findings_filtered,
    "findings_top": findings_top,
    "props_all": props_all,
    "name_token_counts": name_token_counts,
    "query_token_counts": query_token_counts,
    "token_estimates": token_estimates,
    "deprecated_parts": deprecated_parts,
    "category_infer": category_infer,
    "category_lines": category_lines,
}
ORACLES = {
    "search_score": f"{SCORED} SELECT id, name, hits, deprecated, score, usage_count FROM scored WHERE score > 0",
    "search_filtered": f"""{SCORED}
SELECT s.id, name, hits, score, usage_count FROM scored s JOIN part ON p_partkey = s.id
WHERE p_size >= 10 AND contains(lower(p_type), 'a') AND p_retailprice > 900 AND usage_count >= 25 AND score > 0
ORDER BY score DESC, usage_count DESC, s.id LIMIT 20""",
    "precedent_rank": f"""{SCORED},
best AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, usage_count DESC, id LIMIT 8)
SELECT CAST(row_number() OVER (ORDER BY deprecated, usage_count DESC, recency DESC, id) AS INT) AS rank, id, path || ':' || name AS location, hits,
       strftime(recency, '%Y-%m-%d') AS last_modified, deprecated, usage_count FROM best""",
    "find_by_name": """
SELECT c_custkey AS id, c_mktsegment AS name FROM customer
WHERE c_mktsegment = 'Building' OR (lower(c_mktsegment) = 'building' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'Building'))""",
    "findings_filtered": f"""WITH {FINDINGS}
SELECT rule, severity, file, line, heuristic FROM findings
WHERE (starts_with(rule, 'ERR') OR starts_with(rule, 'PUR')) AND level >= 3 AND contains(file, '7') AND NOT heuristic""",
    "findings_top": f"WITH {FINDINGS} SELECT rule, severity, file, line FROM findings ORDER BY level DESC, file, line, rule LIMIT 100",
    "props_all": """
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey
HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')""",
    "name_token_counts": f"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS token FROM part)
WHERE token <> '' AND NOT list_contains({sql_list(NAME_STOP_TOKENS)}, token) GROUP BY token""",
    "query_token_counts": f"""
SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM conversations)
WHERE length(token) > 1 AND NOT list_contains({sql_list(QUERY_STOP_WORDS)}, token) GROUP BY token""",
    "token_estimates": "SELECT source, CAST(sum(floor(length(text) / 4.0 + 0.5)) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY source",
    "deprecated_parts": r"""
SELECT p_brand, regexp_matches(lower(p_name), '\b(legacy|deprecated|old|v1|obsolete)\b') AS deprecated, count(*) AS n FROM part GROUP BY ALL""",
    "category_infer": f"WITH {category_sql('conversations', 'conv_id, turn')}",
    "category_lines": f"WITH {CODE}, texts AS (SELECT DISTINCT md5(text) AS digest, text FROM code), {category_sql('texts', 'digest')}",
}
