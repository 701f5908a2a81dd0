"""Quality rules with thresholds that adapt to each language and source."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, text_slices, written

MEASURED = "row_id long, doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Ratios, as integers in ten thousandths (mean word length in hundredths), and which end is cut off.
RULES = {
    "symbols": ("n_symbols * 10000 div greatest(word_chars, 1)", "high"),
    "repeats": ("n_repeat_words * 10000 div greatest(n_words, 1)", "high"),
    "dup_lines": ("n_dup_lines * 10000 div greatest(n_words, 1)", "high"),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", "both"),
}
#: Least distance of a fence from its quartile, in the rule's unit: in a group whose values are nearly all equal the quartiles coincide, and
#: fences on them would reject every other value, however ordinary.
SLACK = {"symbols": 300, "repeats": 1000, "dup_lines": 300, "word_length": 150}


def repeated_words(index: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text, its words in 3-word windows that it has twice or more. Exact: windows are compared by word numbers."""
    n = len(index) - 2
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    inside = owner[:n] == owner[2:]
    at = np.flatnonzero(inside)
    pairs = np.unique(index[at] * (index.max() + 1) + index[at + 1], return_inverse=True)[1]
    triples = np.unique(pairs * (index.max() + 1) + index[at + 2], return_inverse=True)[1]
    keys = triples * n_texts + owner[at]
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    starts = at[counts[which] >= 2]
    covered = np.zeros(len(index), bool)
    for k in range(3):
        covered[starts + k] = True
    return np.bincount(owner[covered], minlength=n_texts)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, symbols = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
    for part in text_slices(batches):
        texts = pc.fill_null(part["text"], "")
        words = Words(texts)
        raw = texts.cast(pa.binary()).to_pylist()
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        blanks = np.fromiter((len(x) - len(x.translate(None, space)) for x in raw), np.int64, len(raw))
        yield pa.RecordBatch.from_arrays(
            [
                part["row_id"],
                part["doc_id"].cast(pa.int64()),
                part["lang"].cast(pa.string()),
                part["source"].cast(pa.string()),
                pa.array(np.diff(words.bounds)),
                pa.array(chars - blanks),
                pa.array(np.fromiter((len(x) - len(x.translate(None, symbols)) for x in raw), np.int64, len(raw))),
                pa.array(np.fromiter(map(duplicate_lines, raw), np.int64, len(raw))),
                pa.array(repeated_words(words.index, words.owner, len(raw))),
            ],
            names=[x.split()[0] for x in MEASURED.split(", ")],
        )


def sketch_bucket(value):
    """The bucket of a non-negative integer: exact below 64, then 32 buckets for each doubling (error at most 1/32)."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def bucket_floor(bucket):
    """The least value of a bucket."""
    shift = F.greatest(F.floor(bucket / 32) - 1, F.lit(0))
    return ((bucket - shift * 32) * F.pow(F.lit(2.0), shift)).cast("long")


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, rule, n, q1, q3: of sketches (by, rule, bucket, n), whose counts add up where groups merge."""
    merged = sketches.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.select(*by, "rule", "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("n"))
    quantile = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("n") * quarter, bucket_floor(F.col("bucket"))))
    return ranked.groupBy(*by, "rule").agg(F.max("n").alias("n"), quantile(1).alias("q1"), quantile(3).alias("q3"))


def thresholds(measured: DataFrame, min_group: int, least: dict[str, int] = SLACK) -> DataFrame:
    """lang, source, rule, low, high for each language and source that measured has.

    A sketch counts a group's values by bucket; sketches of a language merge by adding. A group with fewer than
    min_group documents takes the thresholds of its language, and a small language those of all.
    """
    values = F.array(*[F.struct(F.lit(rule).alias("rule"), F.expr(e).alias("value")) for rule, (e, _) in RULES.items()])
    passed = measured.where("not base_failed").select("lang", "source", F.inline(values))
    sketches = passed.groupBy("lang", "source", "rule", sketch_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    named = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") if c in ("n", "q1", "q3") else F.col(c).alias(f"{p}{c}") for c in df.columns])
    own = named(fences(sketches, ["lang", "source"]), "a")
    language = named(fences(sketches, ["lang"]), "b")
    whole = named(fences(sketches, []), "c")
    groups = measured.select("lang", "source").distinct().withColumn("rule", F.explode(F.array(*map(F.lit, RULES))))
    both = (
        groups.join(own, F.col("lang").eqNullSafe(F.col("alang")) & F.col("source").eqNullSafe(F.col("asource")) & (F.col("rule") == F.col("arule")), "left")
        .join(language, F.col("lang").eqNullSafe(F.col("blang")) & (F.col("rule") == F.col("brule")), "left")
        .join(whole, F.col("rule") == F.col("crule"), "left")
    )
    pick = lambda q: F.when(F.col("a_n") >= min_group, F.col(f"a_{q}")).when(F.col("b_n") >= min_group, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    slack = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(least[r])), RULES, F)
    reach = F.greatest(3 * (pick("q3") - pick("q1")), slack)
    high = pick("q3") + reach
    low = F.when(F.col("rule").isin([r for r, (_, end) in RULES.items() if end == "both"]), pick("q1") - reach)
    return both.select("lang", "source", "rule", low.alias("low"), high.alias("high"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_group: int = 200, slack: dict[str, int] = SLACK) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in 3-word windows that the text
    has twice. Others are kept unless a ratio (symbols, repeats, duplicate lines, word length) lies beyond its group's
    fences, which are the quartiles of the group's sketch plus three times their distance (slack at least).

    Cases: null and empty texts have no words and fail; null languages and sources are groups of their own; rows that
    repeat are judged each for itself; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", "lang", "source")
    measured = slim.mapInArrow(measure, MEASURED).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    measured = written(measured, "quality-measured")
    limits = (
        thresholds(measured, min_group, slack)
        .groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"))
        .agg(*[F.max(F.when(F.col("rule") == r, F.col(e))).alias(f"{r}_{e}") for r in RULES for e in ("low", "high")])
    )
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    beyond = F.lit(False)
    for rule, (e, _) in RULES.items():
        value = F.expr(e)
        beyond = beyond | F.coalesce(value > F.col(f"{rule}_high"), F.lit(False)) | F.coalesce(value < F.col(f"{rule}_low"), F.lit(False))
    kept = ~F.col("base_failed") & ~beyond
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH listed AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM listed),
windows AS (
  SELECT doc_id, place, word, lead(word, 1) OVER d AS second, lead(word, 2) OVER d AS third FROM placed
  WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
counted AS (
  SELECT doc_id, place, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) >= 2 AS twice FROM windows),
covered AS (
  SELECT doc_id, twice OR coalesce(lag(twice, 1) OVER d, false) OR coalesce(lag(twice, 2) OVER d, false) AS hit FROM counted
  WINDOW d AS (PARTITION BY doc_id ORDER BY place)),
repeats AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM listed)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT l.doc_id, lang, source, len(words) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM listed l LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [n_symbols * 10000 // greatest(word_chars, 1), n_repeat_words * 10000 // greatest(n_words, 1),
          n_dup_lines * 10000 // greatest(n_words, 1), word_chars * 100 // greatest(n_words, 1)] AS ratios
  FROM measured),
valued AS (
  SELECT lang, source, generate_subscripts(ratios, 1) AS rule, unnest(ratios) AS value FROM judged WHERE NOT base_failed),
bucketed AS (
  SELECT lang, source, rule, greatest(length(bin(value)) - 6, 0) AS shift, value FROM valued),
floored AS (SELECT lang, source, rule, (value // CAST(pow(2, shift) AS BIGINT)) * CAST(pow(2, shift) AS BIGINT) AS low_edge FROM bucketed),
own AS (
  SELECT lang, source, rule, count(*) AS n, quantile_disc(low_edge, 0.25) AS q1, quantile_disc(low_edge, 0.75) AS q3
  FROM floored GROUP BY ALL),
language AS (
  SELECT lang, rule, count(*) AS n, quantile_disc(low_edge, 0.25) AS q1, quantile_disc(low_edge, 0.75) AS q3
  FROM floored GROUP BY ALL),
whole AS (
  SELECT rule, quantile_disc(low_edge, 0.25) AS q1, quantile_disc(low_edge, 0.75) AS q3 FROM floored GROUP BY ALL),
picked AS (
  SELECT g.lang, g.source, w.rule,
         CASE WHEN o.n >= 200 THEN o.q1 WHEN l.n >= 200 THEN l.q1 ELSE w.q1 END AS q1,
         CASE WHEN o.n >= 200 THEN o.q3 WHEN l.n >= 200 THEN l.q3 ELSE w.q3 END AS q3
  FROM (SELECT DISTINCT lang, source FROM judged) g CROSS JOIN whole w
  LEFT JOIN own o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.rule = w.rule
  LEFT JOIN language l ON l.lang IS NOT DISTINCT FROM g.lang AND l.rule = w.rule),
fenced AS (
  SELECT lang, source, rule, q3 + greatest(3 * (q3 - q1), [300, 1000, 300, 150][rule]) AS high,
         CASE WHEN rule = 4 THEN q1 - greatest(3 * (q3 - q1), [300, 1000, 300, 150][rule]) END AS low
  FROM picked),
beyond AS (
  SELECT j.doc_id, bool_or(ratios[f.rule] > f.high OR coalesce(ratios[f.rule] < f.low, false)) AS hit
  FROM judged j JOIN fenced f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source GROUP BY j.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(hit, false) AS kept
FROM judged LEFT JOIN beyond USING (doc_id)
"""
