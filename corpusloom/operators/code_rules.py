"""Rules over source lines, their imports, their elements and whole files; all give rule, severity, file, line, heuristic and hits.

Lines are a table (file, line, text). No rule here needs a parser: what holds for a component in a parsed tree holds for its file here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources.storage import written
from .audit import complexity
from .rules import COMPONENT_RULES, ELEMENT_RULES, NEXT_RULES, Rule, elements

FINDING = ["rule", "severity", "file", "line", "heuristic", "hits"]
STORED_SECRET = rf"\b(?:localStorage|sessionStorage)\s*\.\s*setItem\s*\(\s*['\"][^'\"]*(?i:{V.SECRET_WORDS})[^'\"]*['\"]"
PUBLIC_SECRET = rf"\b{V.PUBLIC_PREFIX}[A-Z0-9_]*(?i:{V.SECRET_WORDS})"
IMPORT = r"^\s*import\s+(type\s+)?(?:(?:\*\s+as\s+([A-Za-z_$][\w$]*)|([A-Za-z_$][\w$]*))\s*,?\s*)?(?:\{([^}]*)\}\s*)?(?:from\s*)?['\"]([^'\"]+)['\"]"
DIRECTIVE = r"^\s*['\"](use client|use server|use strict)['\"]\s*;?\s*$"
SKIPPED = r"^\s*$|^\s*//|^\s*/\*"
#: Directives stand in so many first lines of a file.
DIRECTIVE_LINES = 6


def finding(rule: str, severity: str, hits: Column, heuristic: bool = False) -> Column:
    """A finding where there are hits, else null."""
    fields = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(heuristic).alias("heuristic"), hits.cast("long").alias("hits"))
    return F.when(hits > 0, fields)


def found(rows: DataFrame, findings: list[Column]) -> DataFrame:
    return rows.select("file", "line", F.inline(F.array_compact(F.array(*findings)))).select(FINDING)


def directives(lines: DataFrame) -> DataFrame:
    """file, directive: those at the start of a file, before any line but blank ones and comments."""
    head = lines.where(F.col("line") <= DIRECTIVE_LINES)
    name = F.nullif(F.regexp_extract("text", DIRECTIVE, 1), F.lit(""))
    before = Window.partitionBy("file").orderBy("line", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = head.withColumn("directive", name)
    rows = rows.withColumn("first", F.every(F.col("directive").isNotNull() | F.col("text").rlike(SKIPPED)).over(before))
    return rows.where("first and directive is not null").select("file", "directive").distinct()


def imports(lines: DataFrame) -> DataFrame:
    """file, line, source, namespace, default_name, named, type_only: the import statements of one line each."""
    part = lambda k: F.regexp_extract("text", IMPORT, k)
    names = F.filter(F.split(part(4), r"\s*,\s*"), lambda n: F.trim(n) != "")
    rows = lines.where(F.col("text").rlike(IMPORT))
    return rows.select(
        "file", "line", part(5).alias("source"), F.nullif(part(2), F.lit("")).alias("namespace"), F.nullif(part(3), F.lit("")).alias("default_name"), F.transform(names, lambda n: F.trim(n)).alias("named"), (part(1) != "").alias("type_only")
    )


def line_findings(lines: DataFrame, tailwind: bool = False) -> DataFrame:
    rules = [finding(name, severity, F.regexp_count("text", F.lit(pattern))) for name, severity, pattern in V.LINE_SINKS]
    rules += [finding("SEC-PUBLIC-ENV-SECRET", "critical", F.regexp_count("text", F.lit(PUBLIC_SECRET))), finding("SEC-TOKEN-IN-STORAGE", "high", F.regexp_count("text", F.lit(STORED_SECRET)))]
    if tailwind:
        rules.append(finding("STYLE-ARBITRARY-VALUE", "low", F.regexp_count("text", F.lit(V.ARBITRARY_VALUE))))
    return found(lines, rules)


def colour_findings(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The first colour of a line, unless tokens (token, in lower case) has it."""
    rows = lines.withColumn("token", F.lower(F.regexp_extract("text", V.COLOUR, 0))).where("token <> ''")
    if tokens is not None:
        rows = rows.join(tokens.select("token"), "token", "left_anti")
    return found(rows, [finding("STYLE-HARDCODED-COLOR", "low", F.lit(1))])


def import_findings(lines: DataFrame) -> DataFrame:
    whole = F.col("namespace").isNotNull() | F.col("default_name").isNotNull()
    return found(imports(lines), [finding("PERF-HEAVY-IMPORT", "medium", (F.col("source").isin(V.HEAVY_PACKAGES) & whole).cast("int"))])


def server_imports(lines: DataFrame) -> DataFrame:
    """Imports of modules that only a server has: findings where their file is a client's."""
    return found(imports(lines).where(F.col("source").rlike(V.SERVER_MODULE)), [finding("NEXT-SERVER-MODULE-IN-CLIENT", "critical", F.lit(1))])


#: What file_findings() sums up over a file's lines.
COUNTED = {"leaks": V.LEAKS, "teardowns": V.TEARDOWN, "suppressed": V.DEPS_SUPPRESSED, "client": V.CLIENT_ONLY, "handlers": r"<[^<>]*\son[A-Z]"}


def file_findings(lines: DataFrame, texts: DataFrame, client_files: DataFrame, is_next: bool = False) -> DataFrame:
    """Findings on line 1 of a file, from sums over its lines; texts (text) are the distinct ones, each counted in once."""
    counts = texts.select("text", *[F.regexp_count("text", F.lit(p)).alias(name) for name, p in COUNTED.items()])
    counts = written(counts.where(sum((F.col(name) for name in COUNTED), F.lit(0)) > 0), "text-counts")
    sums = lines.join(counts, "text").groupBy("file").agg(*[F.sum(name).alias(name) for name in COUNTED])
    rows = sums.join(client_files.withColumn("is_client", F.lit(True)), "file", "full_outer").na.fill(0, [*COUNTED]).withColumn("line", F.lit(1))
    is_client = F.col("is_client").isNotNull()
    rules = [
        finding("LEAK-NO-TEARDOWN", "high", F.when(F.col("teardowns") == 0, F.col("leaks")).otherwise(0)),
        finding("REACT-DEPS-SUPPRESSED", "high", F.col("suppressed")),
    ]
    if is_next:
        app = F.col("file").rlike("(^|/)(app)/")
        rules.append(finding("NEXT-MISSING-USE-CLIENT", "critical", F.when(~is_client & app, F.col("client") + F.col("handlers")).otherwise(0)))
        rules.append(finding("NEXT-CLIENT-BOUNDARY-TOO-HIGH", "medium", (is_client & F.col("file").rlike(V.BOUNDARY)).cast("int")))
    return found(rows, rules)


def file_counts(lines: DataFrame) -> DataFrame:
    """file, lines, state, effects, contexts (how many kinds of such hooks it calls), fetches, and complexity, from sums over its lines."""
    has = lambda p: F.bool_or(F.coalesce(F.col("text").rlike(p), F.lit(False)))
    kinds = lambda *names: sum((has(rf"\b{n}\s*\(").cast("int") for n in names), F.lit(0))
    return lines.groupBy("file").agg(
        F.count("*").alias("lines"), *[kinds(*names).alias(kind) for kind, names in V.HOOK_KINDS.items()],
        has(V.FETCHES).alias("fetches"), (F.sum(complexity(F.coalesce("text", F.lit(""))) - 1) + 1).alias("complexity"),
    )


def neighbourhood(hits: DataFrame, findings: DataFrame, file: str = "file") -> DataFrame:
    """Findings in the files that hits (the few of a report) stand in, counted by file and severity."""
    near = findings.join(hits.select(file).distinct(), file, "left_semi")
    return near.groupBy(file).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITIES])


def jsx_elements(lines: DataFrame) -> DataFrame:
    """file, line, place, tag, attrs, raw of elements that stand on one line; names keep their case."""
    return elements(lines.withColumn("at", F.struct("file", "line", "text")), "at", "text", fold=False).select("at.file", "at.line", "place", "tag", "attrs", "raw")


def elements_by_text(lines: DataFrame) -> DataFrame:
    """The same as jsx_elements(), each distinct text being searched once and joined to the lines that have it."""
    texts = lines.where("text is not null").select("text").distinct()
    found = written(jsx_elements(texts.select(F.col("text").alias("file"), F.lit(0).alias("line"), "text")).withColumnRenamed("file", "text").drop("line"), "text-elements")
    return lines.select("file", "line", "text").join(found, "text").select("file", "line", "place", "tag", "attrs", "raw")


def jsx_findings(lines: DataFrame, is_next: bool = False) -> DataFrame:
    rules: list[Rule] = [*ELEMENT_RULES[:10], *COMPONENT_RULES, *(NEXT_RULES if is_next else [])]
    rows = jsx_elements(lines).withColumn("attrs", F.transform("attrs", F.lower))
    return found(rows, [finding(r.name, r.severity, r.where().cast("int"), r.heuristic) for r in rules])


def code_findings(lines: DataFrame, tokens: DataFrame | None = None, is_next: bool = False, tailwind: bool = False) -> DataFrame:
    """All of these rules over source lines. What a text breaks is found once for each distinct one and joined to the lines that have it."""
    texts = written(lines.where("text is not null").select("text").distinct(), "distinct-texts")
    one = texts.select(F.col("text").alias("file"), F.lit(0).alias("line"), "text")
    parts = [line_findings(one, tailwind), colour_findings(one, tokens), import_findings(one), jsx_findings(one, is_next), *([server_imports(one)] if is_next else [])]
    by_text = parts[0]
    for p in parts[1:]:
        by_text = by_text.unionByName(p)
    by_text = written(by_text.withColumnRenamed("file", "text").drop("line"), "text-findings")
    client_files = written(directives(lines).where("directive = 'use client'").select("file"), "client-files")
    broken = lines.select("file", "line", "text").join(by_text, "text").select(FINDING)
    server = F.col("rule") == "NEXT-SERVER-MODULE-IN-CLIENT"
    out = broken.where(~server).unionByName(broken.where(server).join(client_files, "file", "left_semi").select(FINDING))
    return out.unionByName(file_findings(lines, texts, client_files, is_next))
