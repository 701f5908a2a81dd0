"""Call sites: elements joined to what their tags mean, and what follows from these joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import META_ATTRIBUTES
from ..sources.storage import written
from .audit import boolean_traps
from .resolve import owners
from .usage import attribute_stats, site_sample

#: `attribute={name}`: a value handed on under another name or its own.
PASSED = r"\b([A-Za-z_$][\w$-]*)\s*=\s*\{\s*([A-Za-z_$][\w$]*)\s*\}"


def contract_attributes(attributes: Column) -> Column:
    """Attributes that a contract may know: no data-* and aria-* ones, and none that all elements have."""
    return F.filter(attributes, lambda a: ~(a.startswith("data-") | a.startswith("aria-") | a.isin(META_ATTRIBUTES)))


def call_sites(elements: DataFrame, bindings: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """file, line, place, target, attrs, spread, raw of elements whose tag (its part before a dot) a binding of the file names; host tags go.

    elements have file, line, place, tag, attrs and raw; bindings file, name and target; with spans (file, first, last, owner), the owner is the
    one that holds the line and starts last, null where none does.
    """
    base = F.regexp_extract("tag", r"^([^.]+)", 1)
    named = elements.where(~F.col("tag").rlike("^[a-z]")).withColumn("name", base)
    sites = named.join(bindings.select("file", "name", "target"), ["file", "name"])
    sites = sites.select("file", "line", "place", "target", contract_attributes(F.col("attrs")).alias("attrs"), F.col("raw").contains("{...").alias("spread"), "raw")
    if spans is None:
        return sites
    sites = written(sites, "call-sites")  # they are read again where their owners are joined
    held = owners(sites.select("file", "line").distinct(), spans, "file", "line", "first", "last", "owner")
    return sites.join(held, ["file", "line"], "left")


def render_edges(sites: DataFrame) -> DataFrame:
    """owner, target: who renders what, once each."""
    return sites.where("owner is not null").select("owner", "target").distinct()


def pass_edges(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """src, dst, prop, via, file, line: where an owner hands one of its own attributes (declared: target, attribute) on to what it renders."""
    pairs = F.arrays_zip(F.regexp_extract_all("raw", F.lit(PASSED), F.lit(1)).alias("prop"), F.regexp_extract_all("raw", F.lit(PASSED), F.lit(2)).alias("via"))
    rows = sites.where("owner is not null").select(F.col("owner").alias("src"), F.col("target").alias("dst"), "file", "line", F.inline(pairs))
    own = declared.select(F.col("target").alias("src"), F.col("attribute").alias("via")).distinct()
    return rows.join(own, ["src", "via"], "left_semi").select("src", "dst", "prop", "via", "file", "line")


def who_uses(sites: DataFrame, limit: int = 60) -> DataFrame:
    """The first sites of each target by file and line, with their place, how many more there are (truncated), and usage_count."""
    first = site_sample(sites.select("target", "file", "line", "place"), "target", ["file", "line", "place"], limit)
    return first.withColumnRenamed("place", "nth").withColumn("usage_count", F.col("truncated") + F.count("*").over(Window.partitionBy("target")))


def prop_report(declared: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per target that declares attributes (declared: target, attribute, type, required): props, by how often they are passed, with their type, whether they are
    required and dead; never_passed, undeclared, required_count, spread_sites and boolean_traps."""
    passed = sites.select("target", F.explode("attrs").alias("attribute"))
    counts = passed.groupBy("target", "attribute").agg(F.count("*").alias("passed_at"))
    own = declared.groupBy("target", "attribute").agg(F.min("type").alias("type"), F.bool_or("required").alias("required"))
    rows = own.join(counts, ["target", "attribute"], "left").na.fill(0, ["passed_at"])
    prop = F.struct((-F.col("passed_at")).alias("_order"), F.col("attribute").alias("name"), "type", "required", "passed_at", (F.col("passed_at") == 0).alias("dead"))
    props = rows.groupBy("target").agg(F.array_sort(F.collect_list(prop)).alias("props"), F.count_if("required").alias("required_count"))
    props = props.withColumn("boolean_traps", boolean_traps(F.col("props"))).withColumn("props", F.transform("props", lambda p: p.dropFields("_order")))
    stats = attribute_stats(own, passed, "target", "attribute").select("target", "never_passed", "undeclared")
    # A site that spreads counts once, however many attributes it names besides.
    spread = sites.groupBy("target").agg(F.count_if("spread").alias("spread_sites"))
    return props.join(stats, "target").join(spread, "target", "left").na.fill(0, ["spread_sites"])
