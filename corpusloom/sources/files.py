"""Source trees as tables: files, decoded texts, front matter, design tokens, and the path list that a scan skips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_class

# Folders that hold no source of the project's own.
IGNORED = [
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", "coverage",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", ".parcel-cache", ".vercel",
    "vendor", "__snapshots__", ".yarn", ".pnpm-store", "storybook-static", ".astro",
    ".claude", ".codex", ".cursor",
]
SUFFIX = r"\.(tsx|jsx|ts|js|mjs|cjs|mts|cts)$"
MAX_BYTES = 4 << 20


def scan_tree(spark: SparkSession, root: str, ignored: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) under root: files have path, modified, content; skipped has path and reason. ignored are more folders to skip.

    Reads by Spark's binaryFile source, so that root may be on any store. Nothing is left out without a row in skipped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{base}/", "")
    rows = raw.select(path.alias("path"), F.col("modificationTime").alias("modified"), "length", "content")
    segments = F.split("path", "/")
    reason = (
        F.when(F.arrays_overlap(segments, F.array(*map(F.lit, [*IGNORED, *ignored]))), "ignored folder")
        .when(~F.lower("path").rlike(SUFFIX), "other kind")
        .when(F.col("length") > MAX_BYTES, "too large")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason", "length"), rows.where("reason is not null").select("path", "reason")


def decode(files: DataFrame) -> DataFrame:
    """files (path, content) with text (no byte order mark, line feeds alone), eol, bom, bytes, sha1 of the raw bytes, lines and file_class."""
    raw = F.decode(F.col("content"), "UTF-8")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    out = files.withColumn("bom", bom).withColumn("sha1", F.sha1("content")).withColumn("bytes", F.length("content"))
    out = out.withColumn("eol", F.when(raw.contains("\r\n"), "crlf").otherwise("lf"))
    text = F.regexp_replace(F.when(F.col("bom"), F.substring(raw, 2, 1 << 30)).otherwise(raw), "\r\n", "\n")
    return out.withColumn("text", text).withColumn("lines", F.size(F.split("text", "\n"))).withColumn("file_class", file_class(F.col("path"))).drop("content")


def front_matter(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with fields, the map of the `---` block at the start; an empty map without one. Quotes around values go."""
    block = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*\s*:"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), r"^[\"'](.*)[\"']$", "$1").alias("v"))
    found = F.transform(pairs, entry)
    # The last of equal keys counts.
    last = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["k"] == x["k"]))
    return texts.withColumn("fields", F.map_from_entries(last))


def design_tokens(styles: DataFrame, text: str = "text") -> DataFrame:
    """token, kind: distinct custom properties and hexadecimal colours of style texts."""
    body = F.coalesce(text, F.lit(""))
    names = styles.select(F.explode(F.regexp_extract_all(body, F.lit(r"(--[A-Za-z0-9-]+)\s*:"), F.lit(1))).alias("token"), F.lit("property").alias("kind"))
    colours = styles.select(F.explode(F.regexp_extract_all(body, F.lit(r"#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3,4})\b"), F.lit(0))).alias("token"), F.lit("colour").alias("kind"))
    return names.union(colours.withColumn("token", F.lower("token"))).distinct()
