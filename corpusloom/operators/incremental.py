"""Incremental work: what can be reused by content, and what must be done anew."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reuse(current: DataFrame, prior: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reused, to_do, gone): current rows whose keys (path, content hash, context) the prior table has or lacks, and prior rows
    whose keys are no longer current."""
    return (
        current.join(prior.select(*keys), keys, "left_semi"),
        current.join(prior.select(*keys), keys, "left_anti"),
        prior.join(current.select(*keys), keys, "left_anti"),
    )
