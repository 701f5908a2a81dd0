"""Gate, incremental, session and cost queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..operators import gate as G
from ..operators import sessions as S
from ..operators.incremental import reuse
from ..sources.tables import events_as_findings, table
from .search_jobs import FINDINGS


def hashed_documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("context"))


def incremental_reuse(spark, d) -> DataFrame:
    """Documents against an earlier state, in which every seventh text and every eleventh language was another and every thirteenth was not there."""
    current = hashed_documents(spark, d)
    prior = current.where("path % 13 <> 0").select(
        "path", F.when(F.col("path") % 7 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("path") % 11 == 0, "xx").otherwise(F.col("context")).alias("context")
    )
    reused, to_do, gone = reuse(current, prior, ["path", "sha256", "context"])
    kind = lambda df, name: df.select("path", F.lit(name).alias("kind"))
    return kind(reused, "reused").union(kind(to_do, "to do")).union(kind(gone, "gone"))


def ownership(spark, d) -> DataFrame:
    """Labelled documents as changes, sources as owners: each owns its documents, and src1 those of src2 as well."""
    changed = table(spark, d, "labels").select(F.col("doc_id").alias("path"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "source")
    owned = docs.where("source <> 'src3'").select("path", F.col("source").alias("owner"))
    extra = docs.where("source = 'src2'").select("path", F.lit("src1").alias("owner"))
    return G.ownership(changed, owned.union(extra))


def footprint(spark, d) -> DataFrame:
    """Pages as files added, HTML files as backups; the plan names those that are reached without encryption."""
    pages = table(spark, d, "pages").select(F.regexp_replace("url", r"\.html$", ".bak").alias("path"), F.col("url").startswith("http:").alias("planned"))
    return G.footprint(pages.select("path"), pages.where("planned").select("path"))


def baseline_diff(spark, d) -> DataFrame:
    """Findings of users with a purchase in the later half of events that the first half doesn't have."""
    found = events_as_findings(spark, d).select("rule", "severity", "file", (F.col("line") % 100).alias("line"), F.col("line").alias("event"))
    half = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    changed = table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("event_id") > half)).select(F.col("user_id").cast("string").alias("file"))
    return G.new_findings(found.where(F.col("event") > half), changed, found.where(F.col("event") <= half), "file", ["rule", "file", "line"]).select("rule", "severity", "file", "line", "event")


def baseline_diff_all(spark, d) -> DataFrame:
    """Findings of users with events in the later half that the first half of events doesn't have."""
    found = events_as_findings(spark, d).select("rule", "severity", "file", (F.col("line") % 100).alias("line"), F.col("line").alias("event"))
    half = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    later = found.where(F.col("event") > half)
    return G.new_findings(later, later.select("file"), found.where(F.col("event") <= half), "file", ["rule", "file", "line"]).select("rule", "severity", "file", "line", "event")


def citation_check(spark, d) -> DataFrame:
    """Citations of labelled documents' second word, at lines that may not be there."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = docs.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    cited = table(spark, d, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("cite"),
        F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("doc_id")).cast("long").alias("file"),
        F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("doc_id") % 8).cast("int").alias("line"),
        F.nullif(F.regexp_extract("text", r"^\S+ ([a-z]+)[ .,]", 1), F.lit("")).alias("symbol"),
    )
    return G.check_citations(cited, lines).select("cite", "verdict")


def gate_verdict(spark, d) -> DataFrame:
    found = events_as_findings(spark, d)
    return G.verdict(found, F.col("severity").isin("critical", "high") & ~F.col("heuristic"), ["file"])


def added_lines(spark, d) -> DataFrame:
    """Diffs made of documents: each adds its lines from line 11 on."""
    header = F.format_string("+++ b/doc\n@@ -10,0 +11,%d @@\n+", F.size(F.split("text", "\n")))
    text = F.concat(header, F.regexp_replace("text", "\n", "\n+"))
    return G.added_lines(table(spark, d, "documents").select("doc_id", text.alias("diff")), "doc_id", "diff")


def lease_expiry(spark, d) -> DataFrame:
    return S.lease_gaps(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "gap_seconds", "expired")


def claim_conflict(spark, d) -> DataFrame:
    """Orders claim parts; suppliers hold them."""
    claims = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    found = S.claim_conflicts(claims, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"])
    return found.groupBy("l_partkey", "held_by").agg(F.count("*").alias("refused"))


def rounds(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 200).alias("found"), F.md5("event_type").alias("signature"))


def terminator_dry(spark, d) -> DataFrame:
    return S.dry_rounds(rounds(spark, d), "user_id", ["ts", "event_id"], "found").select("user_id", "event_id")


def signature_repeat(spark, d) -> DataFrame:
    return S.repeated_signatures(rounds(spark, d), "user_id", ["ts", "event_id"], "signature").select("user_id", "event_id", "signature")


def split_work(spark, d) -> DataFrame:
    dealt = S.deal(table(spark, d, "conversations").select("conv_id").distinct(), "conv_id", 4)
    return dealt.groupBy("session").agg(F.count("*").alias("pieces"), F.min("conv_id").alias("first"))


def cost_forecast(spark, d) -> DataFrame:
    """What a feature of each size costs, with as many tokens of context as a source's documents have."""
    digest = table(spark, d, "documents").groupBy("source").agg(F.floor(F.sum(F.length("text")) / 4 / 100).alias("digest"))
    waves = []
    for size, r in V.SIZES.items():
        second = max(2, -(-r["experts"] * 3 // 10)) if r["rounds"] >= 2 else 0
        for wave, agents, base, share in (
            ("intake", 2, V.AGENT_PROMPT + 1200, 1),
            ("explore", r["explorers"], V.AGENT_PROMPT + V.SKILL + 1200, 1),
            ("spec", 1, V.AGENT_PROMPT + V.SKILL + 3500, 0),
            ("design", r["experts"], V.AGENT_PROMPT + V.SKILL + V.PLAN + 1200, 0),
            ("design again", second, V.AGENT_PROMPT + V.PLAN + 1200, 0),
            ("build", r["implementers"] + 1, V.AGENT_PROMPT + V.SKILL + V.PLAN + 2500, 1),
            ("verify", r["verifiers"], V.AGENT_PROMPT + V.SKILL + V.DIFF + V.SPEC // 2 + 1800, 0),
        ):
            waves.append(F.struct(F.lit(size).alias("size"), F.lit(wave).alias("wave"), F.lit(agents).alias("agents"), F.lit(base).alias("base"), F.lit(share).alias("share")))
    rows = digest.select("source", "digest", F.inline(F.array(*waves)))
    cost = F.col("agents") * (F.col("base") + F.col("share") * F.col("digest"))
    total = rows.groupBy("source", "size").agg(F.sum(cost).alias("subtotal"))
    overhead = F.floor(F.col("subtotal") * V.OVERHEAD_PERCENT / 100 + 0.5)
    out = total.withColumn("total", F.col("subtotal") + overhead)
    return out.withColumn("headroom", F.lit(V.BUDGET) - F.col("total")).withColumn("fits", F.col("total") <= V.BUDGET)


def cost_sql() -> str:
    parts = []
    for size, r in V.SIZES.items():
        second = max(2, -(-r["experts"] * 3 // 10)) if r["rounds"] >= 2 else 0
        fixed = 2 * 2400 + r["explorers"] * 3800 + 6100 + r["experts"] * 6800 + second * 5400 + (r["implementers"] + 1) * 8100 + r["verifiers"] * 11400
        parts.append(f"('{size}', {fixed}, {2 + r['explorers'] + r['implementers'] + 1})")
    return f"""
WITH digest AS (SELECT source, CAST(floor(sum(length(text)) / 4.0 / 100) AS BIGINT) AS digest FROM documents GROUP BY source),
total AS (SELECT source, size, fixed + times * digest AS subtotal FROM digest, (VALUES {", ".join(parts)}) AS s(size, fixed, times)),
summed AS (SELECT *, CAST(subtotal + floor(subtotal * 12 / 100.0 + 0.5) AS BIGINT) AS total FROM total)
SELECT *, 400000 - total AS headroom, total <= 400000 AS fits FROM summed"""


QUERIES = {
    "incremental_reuse": incremental_reuse,
    "ownership": ownership,
    "footprint": footprint,
    "baseline_diff": baseline_diff,
    "baseline_diff_all": baseline_diff_all,
    "citation_check": citation_check,
    "gate_verdict": gate_verdict,
    "added_lines": added_lines,
    "lease_expiry": lease_expiry,
    "claim_conflict": claim_conflict,
    "terminator_dry": terminator_dry,
    "signature_repeat": signature_repeat,
    "split_work": split_work,
    "cost_forecast": cost_forecast,
}
ORACLES = {
    "incremental_reuse": """
WITH state AS (SELECT doc_id AS path, doc_id % 13 = 0 AS absent, doc_id % 7 = 0 OR doc_id % 11 = 0 AS changed FROM documents)
SELECT path, CASE WHEN absent OR changed THEN 'to do' ELSE 'reused' END AS kind FROM state
UNION ALL SELECT path, 'gone' FROM state WHERE NOT absent AND changed""",
    "ownership": """
WITH owned AS (SELECT doc_id, source FROM documents WHERE source <> 'src3' UNION SELECT doc_id, 'src1' FROM documents WHERE source = 'src2')
SELECT path, owners, CASE WHEN owners = 0 THEN 'unowned' ELSE 'double-owned' END AS problem FROM (
  SELECT l.doc_id AS path, count(o.source) AS owners FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN owned o USING (doc_id) GROUP BY 1)
WHERE owners <> 1""",
    "footprint": rf"""
WITH files AS (SELECT regexp_replace(url, '[.]html$', '.bak') AS path, starts_with(url, 'http:') AS planned FROM pages)
SELECT DISTINCT path, regexp_matches(path, '{V.SCRATCH}') AS scratch FROM files f WHERE NOT EXISTS (SELECT 1 FROM files p WHERE p.path = f.path AND p.planned)""",
    "baseline_diff": f"""WITH {FINDINGS}, half AS (SELECT max(event_id) // 2 AS middle FROM events)
SELECT rule, severity, file, line % 100 AS line, line AS event FROM findings f
WHERE line > (SELECT middle FROM half) AND CAST(file AS BIGINT) IN (SELECT user_id FROM events, half WHERE event_type = 'purchase' AND event_id > middle) AND NOT EXISTS (
  SELECT 1 FROM findings g WHERE g.line <= (SELECT middle FROM half) AND g.rule = f.rule AND g.file = f.file AND g.line % 100 = f.line % 100)""",
    "baseline_diff_all": f"""WITH {FINDINGS}, half AS (SELECT max(event_id) // 2 AS middle FROM events)
SELECT rule, severity, file, line % 100 AS line, line AS event FROM findings f
WHERE line > (SELECT middle FROM half) AND NOT EXISTS (
  SELECT 1 FROM findings g WHERE g.line <= (SELECT middle FROM half) AND g.rule = f.rule AND g.file = f.file AND g.line % 100 = f.line % 100)""",
    "citation_check": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
counts AS (SELECT doc_id, max(line) AS n FROM lines GROUP BY 1),
cited AS (
  SELECT doc_id AS cite, CASE WHEN doc_id % 10 = 0 THEN -1 ELSE doc_id END AS file, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 8 END AS line,
         nullif(regexp_extract(text, '^\S+ ([a-z]+)[ .,]', 1), '') AS symbol
  FROM labels JOIN documents USING (doc_id)),
found AS (
  SELECT c.*, counts.n, EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = c.file AND l.line BETWEEN c.line - 2 AND c.line + 2
                                AND (c.symbol IS NULL OR regexp_matches(l.text, '(^|[^A-Za-z0-9_])' || c.symbol || '([^A-Za-z0-9_]|$)'))) AS hit
  FROM cited c LEFT JOIN counts ON counts.doc_id = c.file)
SELECT cite, CASE WHEN line IS NULL THEN 'MALFORMED' WHEN n IS NULL THEN 'MISSING-FILE' WHEN line < 1 OR line > n THEN 'OUT-OF-RANGE'
             WHEN hit OR symbol IS NULL THEN 'RESOLVES' ELSE 'SYMBOL-NOT-AT-LINE' END AS verdict FROM found""",
    "gate_verdict": f"""WITH {FINDINGS}
SELECT file, count(*) FILTER (WHERE level >= 3 AND NOT heuristic) AS blocking,
       CASE WHEN bool_or(level >= 3 AND NOT heuristic) THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM findings GROUP BY file""",
    "added_lines": """
SELECT doc_id, 'doc' AS file, CAST(10 + generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line, unnest(string_split(text, chr(10))) AS text FROM documents""",
    "lease_expiry": """
SELECT user_id, event_id, CAST(floor(gap / 1000000.0) AS BIGINT) AS gap_seconds, gap >= 900000000 AS expired FROM (
  SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
WHERE gap IS NOT NULL""",
    "claim_conflict": """
SELECT l_partkey, held_by, count(*) AS refused FROM (
  SELECT l_partkey, l_suppkey, first(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS held_by FROM lineitem)
WHERE held_by <> l_suppkey GROUP BY ALL""",
    "terminator_dry": """
SELECT user_id, event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE floor(value / 200) = 0 AND floor(before / 200) = 0""",
    "signature_repeat": """
SELECT user_id, event_id, md5(event_type) AS signature FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE event_type = before""",
    "split_work": """
SELECT CAST(CAST('0x' || substring(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 AS INT) AS session, count(*) AS pieces, min(conv_id) AS first
FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1""",
    "cost_forecast": cost_sql(),
}
