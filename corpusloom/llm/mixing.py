"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one task sorts at most, near enough; the number of parts follows from the table's size.
PART_ROWS = 8_192


def source_targets(sized: DataFrame, weights: tuple[int, ...], budget_percent: int, max_passes: int) -> DataFrame:
    """source, rank, source_size, n_docs, target: the budget shared by weight, no share above max_passes x source_size.

    Water filling in closed form: ordered by capacity over weight, a source is full when its capacity is
    within its share of what the fuller ones before it leave. All comparisons are between integers. The windows
    run over one row per source.
    """
    scale = 1
    for w in set(weights):
        scale *= w
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    # In hundredths of a word, so that the budget is an integer.
    ranked = ranked.withColumn("cap", F.col("source_size") * (100 * max_passes)).withColumn("budget", F.sum("source_size").over(everything) * budget_percent)
    order = Window.orderBy((F.col("source_size") * scale / F.col("weight")).cast("long"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        ranked.withColumn("cap_before", F.sum("cap").over(upto) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
        .withColumn("full", F.col("cap") * F.col("weight_from") <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
    )
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("weight") * left).cast("double") / (100 * open_weight).cast("double")
    target = F.when(F.col("full"), (F.col("source_size") * max_passes).cast("double")).otherwise(share)
    return filled.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    budget_percent: int = 150,
    max_passes: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Words that the mix takes of each document in each pass: row_id, doc_id, source, size, source_size, target, pass, taken.

    Sources ordered by code point (null last) get the weights in turn and share budget_percent of all words; a
    target stops at max_passes times its source's words. Each source's documents are shuffled by a hash of their
    ids; a document's virtual finish time is its source's cumulative words, passes included, over the target.
    Documents are ranged by finish time over all sources, and taken until the total budget is used up; the one at the limit
    is taken in part.

    Sums along both orders go by parts (a document's place in its part plus the sums of the parts before), so that
    neither a hot source nor the global order meets in one task; parts are equal ranges of the hash and of the finish time.

    Cases: null text or one without words has size 0 and is taken with 0; null source is a source of its own; rows that
    repeat are documents of their own; no rows or no words give targets of 0; other columns are ignored.
    """
    sized = docs.select(
        "doc_id",
        "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    sized = written(sized.withColumn("row_id", F.monotonically_increasing_id()), "mix-sized")  # so that row_id stays the same
    targets = written(source_targets(sized, weights, budget_percent, max_passes), "mix-targets")
    rows, words = sized.agg(F.count("*"), F.sum("size")).first()
    budget = (words or 0) * budget_percent // 100

    parts = F.ceil(F.col("n_docs") / PART_ROWS)
    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("part", F.shiftright(hashed * parts, 32))
    by_part = placed.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("rank", "part", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("words_before"))
    shuffled = Window.partitionBy("rank", "part").orderBy("key", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.join(before, ["rank", "part"]).withColumn("cumulative", F.col("words_before") + F.sum("size").over(shuffled))

    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))
    # Rows without words change no sum and take nothing: they don't queue, however many there are.
    idle = placed.where("size = 0").withColumn("pass", passes)
    queued = placed.where("size > 0").withColumn("pass", passes)
    finish = (F.col("pass") * F.col("source_size") + F.col("cumulative")).cast("double") / F.col("target")
    queued = queued.withColumn("finish", finish)
    queued = queued.withColumn("part", F.floor(F.col("finish") * spread(rows * max_passes, PART_ROWS))).select(
        "row_id", "doc_id", "source", "size", "source_size", "target", "rank", "key", "pass", "finish", "part"
    )
    by_part = queued.groupBy("part").agg(F.sum("size").alias("words"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("words_before"))
    ranged = Window.partitionBy("part").orderBy("finish", "rank", "key", "pass", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("words_before") + F.sum("size").over(ranged) - F.col("size")
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.lit(budget).cast("long") - start))
    names = ["row_id", "doc_id", "source", "size", "source_size", "target", "pass", "taken"]
    return queued.join(before, "part").withColumn("taken", taken).select(names).unionByName(idle.withColumn("taken", F.lit(0).cast("long")).select(names))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    taken = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    per_row = taken.groupBy("row_id", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return per_row.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighted AS (
  SELECT *, [3, 1, 2][CAST((rank - 1) % 3 + 1 AS BIGINT)] AS weight, source_size * 200 AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * 150 AS budget
  FROM ranked),
filled AS (
  SELECT *, cap * (sum(weight) OVER () - sum(weight) OVER o + weight) <= weight * (budget - (sum(cap) OVER o - cap)) AS is_full
  FROM weighted
  WINDOW o AS (ORDER BY source_size * 6 // weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, rank, source_size,
         CASE WHEN is_full THEN CAST(source_size * 2 AS DOUBLE)
              ELSE CAST(weight * (budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
                   / CAST(100 * sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, s.key, t.rank, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queued AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(pass * source_size + cumulative AS DOUBLE) / target ELSE 0 END AS finish
  FROM placed, (VALUES (0), (1)) AS p(pass)),
started AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, key, pass, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM queued)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(greatest(0, least(size, (SELECT CAST(sum(size) AS BIGINT) * 150 // 100 FROM sized) - start))) AS BIGINT) AS taken
FROM started GROUP BY doc_id, size, source_size, target
"""
