"""A corpus pipeline: language identification, exact and near dedup, mixing, packing.

Each stage takes what the one before kept, written and read again, and all but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.llm.exact_dedup import exact_dedup
from corpusloom.llm.jaccard_join import jaccard_classes
from corpusloom.llm.language_id import fit_dictionaries, identify
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.packing import pack

#: No SQL states language identification or packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def whole_row(docs: DataFrame) -> Column:
    """All columns of a document as one, beside which no other name can clash."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those whose best two languages compress the text almost equally well, go.

    Rows that repeat go or stay alike; without a labelled text, or in an empty table, nothing is left.
    """
    dictionaries = fit_dictionaries(docs.select("text", "lang"))
    return identify(docs.select(whole_row(docs), "text"), dictionaries).where("not rejected").select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays; rows that repeat both are one document."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256").distinct()
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    stays = F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("sha256") == F.col("text_sha256"))
    return rows.join(kept, stays, "left_semi").dropDuplicates(["key", "sha256"]).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least doc_id stays (a null one last; of equal ones, that with the least hash of its text).

    Documents are told apart by doc_id and text, so that repeated and null ids do no harm; rows that repeat both are one document.
    Texts without words are near copies of nothing.
    """
    row_key = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row_key")
    classes = jaccard_classes(docs.select(row_key.alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component")
    ids = docs.select(F.col("doc_id").alias("key"), row_key).distinct()
    order = F.struct(F.col("key").isNull().alias("unknown"), "key", "row_key")
    named = ids.join(classes.distinct(), "row_key")
    best = named.where("component is not null").groupBy("component").agg(F.min(order).alias("best")).select("best.key", "best.row_key")
    kept = best.union(named.where("component is null").select("key", "row_key")).toDF("kept_id", "kept_key")
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("key"), row_key)
    stays = F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key"))
    return rows.join(kept, stays, "left_semi").dropDuplicates(["key", "row_key"]).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it whole; one without words once.

    Documents are told apart by doc_id and text; rows that repeat both are weighed each and come as often in all as they are taken.
    A null source is one of its own; ties in the queue go by a hash of the id.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(F.col("doc_id"), text_key.alias("text_key")).alias("doc_id"), "text", "source")
    taken = mix_sources(named).where("taken = size and (size > 0 or pass = 0)")
    copies = taken.groupBy(F.col("doc_id.doc_id").alias("kept_id"), F.col("doc_id.text_key").alias("kept_key")).agg(F.count("*").alias("copies"))
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("key"), text_key.alias("text_key")).dropDuplicates(["key", "text_key"])
    both = rows.join(copies, F.col("key").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents, packed into sequences of 2048 tokens. Null texts are empty; rows that repeat are packed each."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
