"""Totals over several groupings at once, sets in first-seen order, and which entities an index keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch's size as a power of two; its standard error is 1.04 / sqrt(2^12), under 2%.
SKETCH_BITS = 12


def totals(rows: DataFrame, by: list[str], sums: dict[str, Column], distinct: dict[str, Column]) -> DataFrame:
    """by, level, n, sums, and about how many distinct values: for each group, each single column of `by` and the whole, in one pass over the rows.

    Rows are first summed by the whole group, with a mergeable sketch of each distinct value; only these few rows are then expanded to the grouping sets, where sketches
    merge. level is 0 for whole groups and greater the more is left out; a column that is left out is null, as a null value is.
    """
    sketch = lambda c: F.hll_sketch_agg(F.xxhash64(c), SKETCH_BITS)
    fine = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()], *[sketch(c).alias(k) for k, c in distinct.items()])
    sets = [[F.col(c) for c in by], *[[F.col(c)] for c in by if len(by) > 1], []]
    merged = fine.groupingSets(sets, *by).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums], *[F.hll_sketch_estimate(F.hll_union_agg(k)).alias(k) for k in distinct]
    )
    return merged.select(*by, "level", "n", *sums, *distinct)


def ordered_distinct(rows: DataFrame, by: list[str], value: str, order: list[str], name: str = "items") -> DataFrame:
    """by and the array of each group's distinct values, in the order in which they are first seen. Repeats meet before a group's values come together."""
    first = rows.groupBy(*by, value).agg(F.min(F.struct(*order)).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(*by).agg(F.transform(ordered, lambda x: x[value]).alias(name))


def kept_entities(entities: DataFrame, kind: str = "kind", exported: str = "exported") -> DataFrame:
    """Components, all hooks, and what else is exported; without the columns that only the build needs."""
    shown = F.col(kind).isin("component", "hook") | (F.col(kind).isin("util", "class") & F.col(exported))
    return entities.where(shown).drop("source", "body_start", "body_end")


def bounded(rows: DataFrame, what: str, item: Column, order: list[Column], limit: int) -> DataFrame:
    """what, place, item: the first `limit` rows of a report; and a row at place 0 that tells how many were suppressed, if any were."""
    best = rows.select(item.alias("item"), F.struct(*order).alias("_order")).orderBy("_order").limit(limit)
    report = best.agg(F.array_sort(F.collect_list(F.struct("_order", "item"))).alias("all")).select(F.posexplode("all").alias("place", "x"))
    report = report.select(F.lit(what).alias("what"), (F.col("place") + 1).alias("place"), F.col("x.item").cast("string").alias("item"))
    left = rows.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n")).where("n > 0")
    return report.unionByName(left.select(F.lit(what).alias("what"), F.lit(0).alias("place"), F.concat(F.lit("suppressed: "), "n").alias("item")))
