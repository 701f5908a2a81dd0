"""Audits: ignored paths, missing siblings, drift against a manifest, feature size, and complexity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import BOOLEAN_NAME


def glob_regex(pattern: str) -> str:
    """The regular expression of an ignore pattern: `*` and `?` stay within a segment, `**` spans several, a leading slash anchors."""
    anchored, p = "/" in pattern.rstrip("/"), pattern.strip("/")
    out = ""
    for token in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?)", p):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token, re.escape(token))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it; `!` takes back. Blank lines and comments count for nothing."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            negate = p.startswith("!")
            out = F.when(path.rlike(glob_regex(p.lstrip("!").strip())), F.lit(not negate)).otherwise(out)
    return out


def missing_siblings(files: DataFrame, segment: str, kind: str, wanted: list[str]) -> DataFrame:
    """segment, kind: of the wanted kinds, those that a segment has no file of."""
    have = files.groupBy(segment).agg(F.collect_set(kind).alias("_have"))
    return have.select(segment, F.explode(F.array_except(F.array(*map(F.lit, wanted)), F.col("_have"))).alias(kind))


def drift(manifest: DataFrame, disk: DataFrame, path: str, digest: str) -> DataFrame:
    """path, state: missing or modified for managed files, unmanaged for others on disk; files as the manifest has them don't appear."""
    m, d = manifest.select(path, F.col(digest).alias("_m")), disk.select(path, F.col(digest).alias("_d"))
    both = m.withColumn("_in_m", F.lit(True)).join(d.withColumn("_in_d", F.lit(True)), path, "full_outer")
    state = F.when(F.col("_in_d").isNull(), "missing").when(F.col("_in_m").isNull(), "unmanaged").when(~F.col("_m").eqNullSafe(F.col("_d")), "modified")
    return both.select(path, state.alias("state")).where("state is not null")


def feature_size(files: Column, routes: Column) -> Column:
    """large, medium or small by how many files and routes a change reaches; medium where nothing is known."""
    return F.when(files.isNull(), "medium").when((files >= 25) | (routes >= 5), "large").when((files >= 6) | (routes >= 2), "medium").otherwise("small")


def complexity(source: Column) -> Column:
    """One more than the branches of a source text: if, for, while, case, catch, `?` and the logical operators."""
    count = lambda p: F.regexp_count(source, F.lit(p))
    return F.lit(1) + count(r"\b(if|for|while|case|catch)\b") + count(r"\?") + count(r"&&") + count(r"\|\|")


def boolean_traps(members: Column) -> Column:
    """How many members (structs of name and type) of an array read as yes or no by their name or type."""
    return F.size(F.filter(members, lambda m: m["name"].rlike(BOOLEAN_NAME) | F.coalesce(m["type"].contains("boolean"), F.lit(False))))


def registry_check(present: DataFrame, registered: DataFrame, name: str = "name", file: str | None = None) -> DataFrame:
    """name, problem: unregistered, missing, duplicate, bad-name (not lower-case words joined by hyphens), and, with a file column, misnamed."""
    rows = present.select(F.col(name).alias("name"), *([F.col(file).alias("file")] if file else []))
    known = registered.select(F.col(name).alias("name")).distinct()
    problem = lambda df, what: df.select("name", F.lit(what).alias("problem")).distinct()
    out = problem(rows.join(known, "name", "left_anti"), "unregistered").unionByName(problem(known.join(rows, "name", "left_anti"), "missing"))
    out = out.unionByName(problem(rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "duplicate"))
    out = out.unionByName(problem(rows.where(~F.col("name").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")), "bad-name"))
    if file:
        stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
        out = out.unionByName(problem(rows.where(stem != F.col("name")), "misnamed"))
    return out


def prune_plan(prior: DataFrame, fresh: DataFrame, disk: DataFrame, path: str, digest: str, scope: list[str] = ()) -> DataFrame:
    """path, action for what an earlier manifest had and a fresh one has not, in the same scope (columns): delete where the disk still has it as it was
    written, keep where it was changed since, gone where it is there no more."""
    keys = [path, *scope]
    scoped = prior.join(fresh.select(*scope).distinct(), list(scope), "left_semi") if scope else prior
    left = scoped.join(fresh.select(*keys), keys, "left_anti").select(path, F.col(digest).alias("_was"))
    both = left.join(disk.select(path, F.col(digest).alias("_is")), path, "left")
    action = F.when(F.col("_is").isNull(), "gone").when(F.col("_is") == F.col("_was"), "delete").otherwise("keep")
    return both.select(path, action.alias("action"))
