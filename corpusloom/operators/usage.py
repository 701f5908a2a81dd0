"""Usage counting, declared against used attributes, and what nothing uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_counts(entities: DataFrame, sites: DataFrame, key: str, target: str) -> DataFrame:
    """entities with usage_count, the sites that name them; 0 where none does. Sites are counted before they are joined."""
    counts = sites.groupBy(F.col(target).alias("_target")).agg(F.count("*").alias("usage_count"))
    out = entities.join(counts, F.col(key) == F.col("_target"), "left").drop("_target")
    return out.withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))


def site_sample(sites: DataFrame, target: str, order: list[str], limit: int = 60) -> DataFrame:
    """The first `limit` sites of each target in this order, with place, and how many more there are (truncated).

    The sample is the report's; the count is of all sites. A rank filter lets each task keep its own first ones.
    """
    place = F.row_number().over(Window.partitionBy(target).orderBy(*order))
    first = sites.withColumn("place", place).where(F.col("place") <= limit)
    counts = sites.groupBy(target).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("truncated"))
    return first.join(counts, target)


def attribute_usage(sites: DataFrame, target: str, attribute: str) -> DataFrame:
    """How often each attribute is passed to each target."""
    return sites.groupBy(target, attribute).agg(F.count("*").alias("passed"))


def attribute_stats(declared: DataFrame, passed: DataFrame, target: str, attribute: str, spread: str | None = None) -> DataFrame:
    """Per target: declared, passed_somewhere, never_passed and undeclared (sorted arrays) from (target, attribute) rows.

    Targets of either side appear; with `spread`, a boolean column of passed, spread_sites counts the sites that pass one.
    """
    d = declared.select(target, attribute).distinct().withColumn("_d", F.lit(1))
    more = [F.count_if(F.col(spread)).alias("spread_sites")] if spread else []
    p = passed.groupBy(target, attribute).agg(F.lit(1).alias("_p"), *more)
    both = d.join(p, [target, attribute], "full_outer")
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(attribute))))
    has_d, has_p = F.col("_d").isNotNull(), F.col("_p").isNotNull()
    return both.groupBy(target).agg(
        F.count("_d").alias("declared"),
        F.count_if(has_d & has_p).alias("passed_somewhere"),
        named(has_d & ~has_p).alias("never_passed"),
        named(~has_d & has_p).alias("undeclared"),
        *([F.sum(F.coalesce("spread_sites", F.lit(0))).alias("spread_sites")] if spread else []),
    )


def unused_attributes(stats: DataFrame, usage: DataFrame, target: str, min_usage: int = 2, limit: int = 40) -> DataFrame:
    """Targets used at least min_usage times, by how many attributes are never passed or undeclared; those without any go."""
    waste = F.size("never_passed") + F.size("undeclared")
    out = stats.join(usage, target).where((F.col("usage_count") >= min_usage) & (waste > 0))
    return out.withColumn("waste", waste).orderBy(F.desc("waste"), target).limit(limit)


def external_usage(*sources: tuple[DataFrame, str]) -> DataFrame:
    """Uses of each package over several tables, each with the column that names the package."""
    out = None
    for df, column in sources:
        part = df.groupBy(F.col(column).alias("package")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("package").agg(F.sum("n").alias("uses"))


def orphans(exported: DataFrame, used: DataFrame, key: str, target: str, entry: Column | None = None) -> DataFrame:
    """Exported rows that nothing uses and that are no entry point."""
    rows = exported if entry is None else exported.where(~entry)
    return rows.join(used.select(F.col(target).alias(key)), key, "left_anti")


def barrels(files: DataFrame, key: str, reexport: Column, own: Column, least: int = 3) -> DataFrame:
    """Files with at least `least` re-exports and nothing of their own."""
    counts = files.groupBy(key).agg(F.count_if(reexport).alias("reexports"), F.count_if(own).alias("own"))
    return counts.where((F.col("reexports") >= least) & (F.col("own") == 0)).drop("own")
