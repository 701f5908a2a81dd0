"""Ignore files of any folder as data: patterns by folder, joined with the paths below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: longer patterns count for nothing.
LONGEST_PATTERN = 512


def pattern_regex(pattern: Column, anchored: Column) -> Column:
    """The regular expression of a pattern, for paths relative to its folder: `?` and `*` stay within a segment, `**` spans any, with a slash after it or without.

    A match ends at a segment's end, so that what lies below a matched folder is matched too.
    """
    plain = F.regexp_replace(pattern, r"([\\.+^$|()\[\]{}])", r"\\$1")
    # A star that stays one is marked first, so that those of ** and those put in don't meet.
    spanned = F.regexp_replace(plain, r"\*\*/?", "\u0001")
    body = F.replace(F.regexp_replace(F.regexp_replace(spanned, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("\u0001"), F.lit(".*"))
    return F.concat(F.lit("(?s)"), F.when(anchored, "^").otherwise("(?:^|/)"), body, F.lit("(?:/|$)"))


def ignore_rules(ignores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """folder, depth, line, negate, regex of each rule of ignore files (folder, text); folder is `` for the root.

    Blank lines, comments and patterns over LONGEST_PATTERN characters are no rules. A slash at a pattern's start or inside it ties it to its folder.
    """
    rows = ignores.select(*by, "folder", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    rows = rows.where((F.col("raw") != "") & ~F.startswith("raw", F.lit("#"))).withColumn("negate", F.startswith("raw", F.lit("!")))
    pattern = F.replace(F.when(F.col("negate"), F.expr("substring(raw, 2)")).otherwise(F.col("raw")), F.lit("\\ "), F.lit(" "))
    rows = rows.withColumn("pattern", F.regexp_replace(pattern, "/$", "")).where(F.length(F.regexp_replace("pattern", "^/", "")) <= LONGEST_PATTERN)
    regex = pattern_regex(F.regexp_replace("pattern", "^/", ""), F.instr("pattern", "/") > 0)
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return rows.select(*by, "folder", depth.alias("depth"), "line", "negate", regex.alias("regex"))


def ignored_paths(paths: DataFrame, rules: DataFrame, by: tuple[str, ...] = (), path: str = "path") -> DataFrame:
    """paths with ignored: whether the last rule that matches says so, rules of deeper folders coming after those above, and lines in their order.

    A path meets the rules of its own ancestors alone, by their names; where no rule matches it isn't ignored. Paths that repeat are judged each once; null paths aren't ignored.
    """
    distinct = paths.select(*by, path).where(F.col(path).isNotNull()).distinct()
    segments = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    each = distinct.withColumn("folder", F.explode(above))
    inside = F.when(F.col("folder") == "", F.col(path)).otherwise(F.expr(f"substring(`{path}`, length(folder) + 2)"))
    met = each.join(rules, [*by, "folder"]).where(F.rlike(inside, F.col("regex")))
    last = met.groupBy(*by, path).agg(F.max_by(~F.col("negate"), F.struct("depth", "line")).alias("ignored"))
    return paths.join(last, [*by, path], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
