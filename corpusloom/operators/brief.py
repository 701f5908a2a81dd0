"""Briefs: facts in shards of bounded size, which shards each role reads, and what a run with them costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def tokens_of(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("long")


def shards(facts: DataFrame, by: list[str], order: list[Column], budget: int) -> DataFrame:
    """by, shard, lines, tokens, suppressed of facts (by, shard, text): each shard takes its first facts, a line each, as long as they stay within the budget of tokens.

    Only as many rows of a shard as could ever fit are ordered in one task, whatever its number of facts; suppressed tells how many were left out.
    """
    keys = [*by, "shard"]
    first = facts.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= 4 * budget + 2)
    chars = F.sum(F.length("text") + 1).over(Window.partitionBy(*keys).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)) - 1
    kept = first.withColumn("_chars", chars).where(tokens_of(F.col("_chars")) <= budget)
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("lines"), tokens_of(F.max("_chars")).alias("tokens"))
    every = facts.groupBy(*keys).agg(F.count("*").alias("_all"))
    out = every.join(sizes, keys, "left").na.fill(0, ["lines", "tokens"])
    return out.select(*keys, "lines", "tokens", (F.col("_all") - F.col("lines")).alias("suppressed"))


def routed(shard_rows: DataFrame, routing: dict[str, list[str]] | None = None) -> DataFrame:
    """shard_rows once for each role that reads them: shards whose names begin with one of the role's prefixes.

    A prefix join: names are cut to each length that prefixes have and meet these as equals, so that no name is compared with all prefixes.
    """
    routing = routing or V.ROLE_ROUTING
    pairs = [(role, p) for role, prefixes in routing.items() for p in prefixes]
    lengths = sorted({len(p) for _, p in pairs})
    table = shard_rows.sparkSession.createDataFrame(pairs, "role string, prefix string")
    cut = F.array(*[F.when(F.length("shard") >= n, F.substring("shard", 1, n)) for n in lengths])
    rows = shard_rows.withColumn("prefix", F.explode(cut)).join(table, "prefix")
    return rows.drop("prefix").distinct()


def run_costs(shard_rows: DataFrame, by: list[str]) -> DataFrame:
    """by, size, step, agents, per_agent, tokens: what each step of a run of each size costs with a feature's brief, every role reading its own shards alone."""
    name, tokens = F.col("shard"), F.col("tokens")
    sums = shard_rows.groupBy(*by).agg(F.sum(F.when(name.isin(V.DIGEST_SHARDS), tokens).otherwise(0)).alias("digest"), F.sum(tokens).alias("every"))
    roles = routed(shard_rows.select(*by, "shard", "tokens")).groupBy(*by, "role").agg(F.sum("tokens").alias("cost"))
    of = lambda role: F.max(F.when(F.col("role") == role, F.col("cost")))
    read = roles.groupBy(*by).agg(of("fe-spec-writer").alias("spec"), of("fe-red-team").alias("attack"), F.sum(F.when(F.col("role").rlike(V.EXPERT), F.col("cost"))).alias("experts"))
    n_experts = sum(1 for r in V.ROLE_ROUTING if r.endswith("-expert") or r in ("fe-ux-analyst", "fe-devils-advocate"))
    half_up = lambda c: F.floor(c + 0.5)
    digest, every, spec, attack = (F.coalesce(c, F.lit(0)) for c in ("digest", "every", "spec", "attack"))
    expert = half_up(F.coalesce("experts", F.lit(0)) / n_experts)
    steps = []
    for size, r in V.SIZES.items():
        second = max(2, -(-r["experts"] * 3 // 10)) if r["rounds"] >= 2 else 0
        for step, agents, each in (
            ("preflight", 1, F.lit(V.AGENT_PROMPT + 1200)),
            ("intake", 2, V.AGENT_PROMPT + digest + 1200),
            ("explore", r["explorers"], V.AGENT_PROMPT + V.SKILL + digest + half_up(every / 5) + 1200),
            ("synthesize", min(1, r["explorers"]), V.AGENT_PROMPT + digest + 1500),
            ("spec", 1, V.AGENT_PROMPT + V.SKILL + spec + 3500),
            ("design round 1", r["experts"], V.AGENT_PROMPT + V.SKILL + expert + V.PLAN + 1200),
            ("design round 2", second, V.AGENT_PROMPT + expert + V.PLAN + 1200),
            ("plan-attack", 1, V.AGENT_PROMPT + V.PLAN + attack + 1500),
            ("build", r["implementers"] + 1, V.AGENT_PROMPT + V.SKILL + V.PLAN + half_up(every / 4) + 2500),
            ("verify", r["verifiers"], F.lit(V.AGENT_PROMPT + V.SKILL + V.DIFF + -(-V.SPEC // 2) + 1800)),
            ("integrate", 2, F.lit(V.AGENT_PROMPT + V.DIFF + V.SPEC + 1500)),
            ("release", 4, F.lit(V.AGENT_PROMPT + 1200)),
            ("supervision", 3, F.lit(V.AGENT_PROMPT + 2000)),
        ):
            steps.append(F.struct(F.lit(size).alias("size"), F.lit(step).alias("step"), F.lit(agents).alias("agents"), each.cast("long").alias("per_agent")))
    rows = sums.join(read, by, "left").select(*by, F.inline(F.array(*steps)))
    return rows.withColumn("tokens", F.col("agents") * F.col("per_agent"))
