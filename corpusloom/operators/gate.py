"""Gating a change set: ownership, footprint, citations, new findings, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import FORBIDDEN_REFERENCE, SCRATCH


def status_rows(output: DataFrame, column: str = "value") -> DataFrame:
    """status, path of `git diff --name-status` or `git status --porcelain` lines; a rename gives the new path."""
    line = F.col(column)
    path = F.regexp_extract(line, r"^\s*\S+\s+(?:\"?[^\t]*?\"?(?:\t| -> ))?(.+?)\s*$", 1)
    return output.where(line.rlike(r"^\s*[AMDRTU?]")).select(F.regexp_extract(line, r"^\s*([AMDRTU?])", 1).alias("status"), path.alias("path"))


def added_lines(diffs: DataFrame, key: str, diff: str) -> DataFrame:
    """key, file, line, text: the lines that a diff without context adds, with their numbers in the new file.

    What a hunk's header announces is what it has, so that an added line may begin with anything.
    """
    rows = diffs.select(key, F.posexplode(F.split(diff, "\n")).alias("at", "raw")).where(~F.col("raw").startswith("\\"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("at")))  # a missing line feed is noted as a line
    by_place = Window.partitionBy(key).orderBy("at")
    part = lambda k: F.regexp_extract("raw", r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", k)
    number = lambda k: F.when(part(2) != "", F.coalesce(F.nullif(part(k), F.lit("")), F.lit("1")).cast("int"))
    # A hunk has `gone` lines of the old file, then `come` of the new one; a header inside these is one of the lines.
    header = F.struct("at", number(1).alias("gone"), number(2).alias("first"), number(3).alias("come"))
    rows = rows.withColumn("header", F.last(F.when(part(2) != "", header), ignorenulls=True).over(by_place))
    nth = F.col("at") - F.col("header.at") - F.col("header.gone")
    inside = F.coalesce((nth >= 1 - F.col("header.gone")) & (nth <= F.col("header.come")), F.lit(False))
    named = F.when(~inside, F.nullif(F.regexp_extract("raw", r"^\+\+\+ b/(.*)$", 1), F.lit("")))
    rows = rows.withColumn("nth", nth).withColumn("inside", inside).withColumn("file", F.last(named, ignorenulls=True).over(by_place))
    plus = rows.where(F.col("inside") & (F.col("nth") >= 1) & F.col("raw").startswith("+"))
    return plus.select(key, "file", (F.col("header.first") + F.col("nth") - 1).alias("line"), F.substring("raw", 2, 1 << 30).alias("text"))


def with_untracked(added: DataFrame, untracked: DataFrame, key: str, text: str) -> DataFrame:
    """added with all lines of files (key, file, text) that no diff knows, numbered from 1."""
    rows = untracked.select(key, "file", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return added.unionByName(rows.select(added.columns))


def forbidden_references(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that name a plan or one of its numbered items."""
    return lines.where(F.col(text).rlike(FORBIDDEN_REFERENCE))


def rollup(checks: dict[str, DataFrame], groups: DataFrame, by: str) -> DataFrame:
    """For each group: how many problems each check found (tables with the column `by`, one row a problem), and the verdict: BLOCK with any, else PASS."""
    out = groups.select(by).distinct()
    for name, problems in checks.items():
        out = out.join(problems.groupBy(by).agg(F.count("*").alias(name)), by, "left")
    out = out.na.fill(0, list(checks))
    total = sum((F.col(name) for name in checks), F.lit(0))
    return out.withColumn("verdict", F.when(total > 0, "BLOCK").otherwise("PASS"))


def ownership(changed: DataFrame, owners: DataFrame, path: str = "path", owner: str = "owner") -> DataFrame:
    """Changed paths with another number of owners than one: owners (their number) and problem, unowned or double-owned."""
    counts = owners.select(path, owner).distinct().groupBy(path).agg(F.count("*").alias("_n"))
    out = changed.select(path).distinct().join(counts, path, "left").select(path, F.coalesce("_n", F.lit(0)).alias("owners"))
    return out.where("owners <> 1").withColumn("problem", F.when(F.col("owners") == 0, "unowned").otherwise("double-owned"))


def footprint(added: DataFrame, planned: DataFrame, path: str = "path", scratch: str = SCRATCH) -> DataFrame:
    """Added paths that no plan names, and whether they look like scratch files."""
    rows = added.select(path).distinct().join(planned.select(path), path, "left_anti")
    return rows.withColumn("scratch", F.col(path).rlike(scratch))


def new_findings(findings: DataFrame, changed: DataFrame, baseline: DataFrame, file: str, keys: list[str]) -> DataFrame:
    """Findings in changed files that the baseline doesn't have."""
    return findings.join(changed.select(file).distinct(), file, "left_semi").join(baseline.select(*keys), keys, "left_anti")


def check_citations(citations: DataFrame, lines: DataFrame, reach: int = 2) -> DataFrame:
    """citations (cite, file, line, symbol) with the verdict over lines (file, line, text).

    MALFORMED without file or line, MISSING-FILE, OUT-OF-RANGE, RESOLVES where the symbol stands as a word within
    `reach` lines (or none is asked for), else SYMBOL-NOT-AT-LINE. The interval join is an equi-join on the few
    lines that a citation may mean.
    """
    wide = citations.withColumn("near", F.explode_outer(F.when(F.col("line").isNotNull(), F.sequence(F.col("line") - reach, F.col("line") + reach))))
    files = lines.groupBy("file").agg(F.max("line").alias("last_line"))
    text = lines.select("file", F.col("line").alias("near"), F.col("text").alias("near_text"))
    both = wide.join(text, ["file", "near"], "left")
    pattern = F.concat(F.lit("(^|[^A-Za-z0-9_])"), F.regexp_replace("symbol", r"([^A-Za-z0-9_])", r"\\$1"), F.lit("([^A-Za-z0-9_]|$)"))
    found = F.coalesce(F.bool_or(F.col("symbol").isNull() | F.rlike("near_text", pattern)), F.lit(False))
    judged = both.groupBy("cite", "file", "line", "symbol").agg(found.alias("found")).join(files, "file", "left")
    verdict = (
        F.when(F.col("file").isNull() | F.col("line").isNull(), "MALFORMED")
        .when(F.col("last_line").isNull(), "MISSING-FILE")
        .when((F.col("line") < 1) | (F.col("line") > F.col("last_line")), "OUT-OF-RANGE")
        .when(F.col("found"), "RESOLVES")
        .otherwise("SYMBOL-NOT-AT-LINE")
    )
    return judged.select("cite", "file", "line", "symbol", verdict.alias("verdict"))


def verdict(problems: DataFrame, blocking: Column, by: list[str]) -> DataFrame:
    """PASS or BLOCK for each group, with the number of blocking rows."""
    out = problems.groupBy(*by).agg(F.count_if(blocking).alias("blocking"))
    return out.withColumn("verdict", F.when(F.col("blocking") > 0, "BLOCK").otherwise("PASS"))


def landed_clusters(members: DataFrame, changed: DataFrame, node: str = "node", cluster: str = "component") -> DataFrame:
    """cluster, size, landed: clusters of two or more that a changed member stands in, and how many do."""
    marked = members.join(changed.select(node).distinct().withColumn("_changed", F.lit(1)), node, "left")
    sizes = marked.groupBy(cluster).agg(F.count("*").alias("size"), F.count("_changed").alias("landed"))
    return sizes.where("size > 1 and landed > 0")


def comment_density(lines: DataFrame) -> DataFrame:
    """file, comment_lines, filled_lines, density (of the filled lines, to four places) of source lines (file, line, text).

    A line is one of comment if a comment begins on it, outside quotes, or goes on there from a line above. A file's lines meet in one window; files are bounded by the scan.
    """
    bare = F.regexp_replace("text", r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`\\]|\\.)*`", "''")
    # What is open after a line: the last mark on it says so, else the last one on a line above.
    marks = F.regexp_extract_all(bare, F.lit(r"(/\*|\*/|//.*)"), F.lit(1))
    blocks = F.filter(marks, lambda m: ~F.startswith(m, F.lit("//")))
    above = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.select("file", "line", "text", F.size(marks).alias("marks"), F.try_element_at(blocks, F.lit(-1)).alias("mark"))
    inside = F.coalesce(F.last("mark", ignorenulls=True).over(above) == "/*", F.lit(False))
    judged = rows.select("file", (inside | (F.col("marks") > 0)).alias("comment"), (F.trim(F.regexp_replace("text", r"\s", " ")) != "").alias("filled"))
    sums = judged.groupBy("file").agg(F.count_if("comment").alias("comment_lines"), F.count_if("filled").alias("filled_lines"))
    return sums.withColumn("density", F.when(F.col("filled_lines") > 0, F.round(F.col("comment_lines") / F.col("filled_lines"), 4)).otherwise(0.0))
