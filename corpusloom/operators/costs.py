"""What the steps of a run cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def wave_table() -> list[tuple[str, str, int, int, int, float]]:
    """size, wave, agents, fixed tokens, and the shares of digest and shards, for each size and step."""
    return [(size, wave, agents(r) if callable(agents) else agents, fixed, digest, shards) for size, r in V.SIZES.items() for wave, agents, fixed, digest, shards in V.WAVES]


def wave_costs(briefs: DataFrame) -> DataFrame:
    """briefs (digest, shards: tokens) with size, wave, agents, per_agent and tokens, one row for each size and step."""
    waves = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("size", "wave", "agents", "_fixed", "_digest", "_shards"), w, strict=True)]) for w in wave_table()])
    rows = briefs.select("*", F.inline(waves))
    each = F.col("_fixed") + F.col("_digest") * F.col("digest") + F.floor(F.col("_shards") * F.col("shards") + 0.5)
    return rows.withColumn("per_agent", each.cast("long")).withColumn("tokens", F.col("agents") * F.col("per_agent")).drop("_fixed", "_digest", "_shards")


def forecast(waves: DataFrame, by: list[str], budget: int = V.BUDGET) -> DataFrame:
    """For each group: subtotal, total with the overhead, headroom and whether it fits the budget."""
    total = waves.groupBy(*by).agg(F.sum("tokens").alias("subtotal"))
    total = total.withColumn("total", F.col("subtotal") + F.floor(F.col("subtotal") * V.OVERHEAD_PERCENT / 100 + 0.5))
    return total.withColumn("headroom", F.lit(budget) - F.col("total")).withColumn("fits", F.col("total") <= budget)
