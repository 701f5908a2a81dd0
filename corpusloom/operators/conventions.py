"""Counting conventions, and which of several is the dominant one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pattern_counts(texts: DataFrame, text: str, counters: dict[str, str], repeated: bool = False) -> DataFrame:
    """category, option, hits: matches of each counter `category.option` over all texts, in one pass.

    With repeated, as for lines of source, equal texts meet first, where each task has them, and are matched once.
    """
    rows, times = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")), F.lit(1)
    if repeated:
        rows, times = rows.groupBy("text").agg(F.count("*").alias("times")), F.col("times")
    sums = rows.select(*[(F.regexp_count("text", F.lit(p)) * times).alias(f"c{k}") for k, p in enumerate(counters.values())]).agg(
        *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(counters))]
    )
    rows = [F.struct(F.lit(name.split(".", 1)[0]).alias("category"), F.lit(name.split(".", 1)[1]).alias("option"), F.col(f"c{k}").alias("hits")) for k, name in enumerate(counters)]
    return sums.select(F.inline(F.array(*rows)))


def verdicts(counts: DataFrame, category: str = "category", option: str = "option", hits: str = "hits", factor: int = 3) -> DataFrame:
    """For each category: winner, hits, runner_up_hits and the verdict.

    DOMINANT where no second option has hits or the first has at least factor times its hits, COMPETING otherwise,
    NONE-FOUND without hits. Ties go to the lesser name.
    """
    order = Window.partitionBy(category).orderBy(F.desc(hits), option)
    ranked = counts.withColumn("_place", F.row_number().over(order)).where("_place <= 2")
    first, second = F.col("_place") == 1, F.col("_place") == 2
    best = ranked.groupBy(category).agg(
        F.max(F.when(first & (F.col(hits) > 0), F.col(option))).alias("winner"),
        F.max(F.when(first, F.col(hits))).alias("hits"),
        F.coalesce(F.max(F.when(second, F.col(hits))), F.lit(0)).alias("runner_up_hits"),
    )
    verdict = F.when(F.col("hits") <= 0, "NONE-FOUND").when(F.col("hits") >= factor * F.col("runner_up_hits"), "DOMINANT").otherwise("COMPETING")
    return best.withColumn("verdict", verdict)


def summary(counts: DataFrame, decisions: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """For each category of `decisions` (name, prefix of the counters, labels of its options): winner, hits, runner_up_hits and verdict, over
    counts (category, option, hits) of pattern_counts(). Categories without a hit are NONE-FOUND."""
    options = [F.struct(F.lit(name).alias("convention"), F.lit(prefix).alias("category"), F.lit(o).alias("option"), F.lit(label).alias("label")) for name, prefix, labels in decisions for o, label in labels.items()]
    known = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "category", "option"), "hits"))).alias("hits"))
    rows = known.select("hits", F.inline(F.array(*options)))
    hits = F.coalesce(F.try_element_at("hits", F.concat_ws(".", "category", "option")), F.lit(0))
    return verdicts(rows.select("convention", F.col("label").alias("option"), hits.alias("hits")), "convention", "option")
