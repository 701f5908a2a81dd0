"""Sessions of work: leases, claims, loops, and work dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import LEASE_MINUTES


def lease_gaps(beats: DataFrame, holder: str, at: str, key: str, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Each heartbeat but a holder's first, with gap_seconds since the one before and whether the lease had expired."""
    before = F.lag(at).over(Window.partitionBy(holder).orderBy(at, key))
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(at)) / 1_000_000
    rows = beats.withColumn("_before", before).where("_before is not null")
    return rows.withColumn("gap_seconds", F.floor(gap)).withColumn("expired", gap >= minutes * 60).drop("_before")


def claim_conflicts(claims: DataFrame, file: str, holder: str, order: list[str]) -> DataFrame:
    """Claims of a file that another holder claimed first, with that holder."""
    first = Window.partitionBy(file).orderBy(*order)
    rows = claims.withColumn("held_by", F.first(holder).over(first))
    return rows.where(F.col("held_by") != F.col(holder))


def dry_rounds(rounds: DataFrame, loop: str, order: list[str], found: str) -> DataFrame:
    """Rounds that end a loop: the second of two consecutive ones that found nothing new."""
    before = F.lag(found).over(Window.partitionBy(loop).orderBy(*order))
    return rounds.withColumn("_before", before).where((F.col(found) == 0) & (F.col("_before") == 0)).drop("_before")


def repeated_signatures(rounds: DataFrame, loop: str, order: list[str], signature: str) -> DataFrame:
    """Rounds whose failure signature is that of the round before."""
    before = F.lag(signature).over(Window.partitionBy(loop).orderBy(*order))
    return rounds.withColumn("_before", before).where(F.col(signature) == F.col("_before")).drop("_before")


def deal(work: DataFrame, key: str, sessions: int) -> DataFrame:
    """Each piece of work with one session from 0 to sessions - 1, by a hash of its key: balanced, and the same in every run."""
    return work.withColumn("session", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % sessions).cast("int"))
