"""Text functions over columns. All are built-in expressions; null gives null unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import DEPRECATED_NAME, FILE_CLASSES, KEYWORDS, NAME_STOP_TOKENS, QUERY_STOP_WORDS


def query_tokens_of(text: str | None) -> list[str]:
    """The same as query_tokens, for a request given as a Python string."""
    return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if len(t) > 1 and t not in QUERY_STOP_WORDS]


def query_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, longer than one character, without stop words; repeats stay."""
    stops = F.array(*map(F.lit, QUERY_STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stops, t))


def name_tokens(name: Column) -> Column:
    """An entity name's words: camel case, underscores and hyphens cut, lower case, without stop tokens."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")
    stops = F.array(*map(F.lit, NAME_STOP_TOKENS))
    return F.filter(F.split(F.lower(cut), r"\s+"), lambda t: (t != "") & ~F.array_contains(stops, t))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded half up."""
    return F.floor(F.length(text) / 4 + 0.5)


def deprecated_name(name: Column) -> Column:
    return F.lower(name).rlike(DEPRECATED_NAME)


def file_class(path: Column) -> Column:
    """test, story, route, config or source; the first that matches."""
    out = F.lit("source")
    for kind, pattern in reversed(FILE_CLASSES):
        out = F.when(F.lower(path).rlike(pattern), kind).otherwise(out)
    return out


def package_of(spec: Column) -> Column:
    """The package of an import: @scope/name or the first segment; null for relative and absolute paths."""
    scoped = F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)
    plain = F.regexp_extract(spec, r"^([^/@][^/]*)", 1)
    return F.when(spec.rlike(r"^[./]"), None).otherwise(F.coalesce(F.nullif(scoped, F.lit("")), F.nullif(plain, F.lit(""))))


def jaccard(common: Column, union: Column, scale: int = 1000) -> Column:
    """common / union as an integer in thousandths (or another scale), rounded half up; 0 for two empty sets."""
    return F.when(union > 0, F.floor(common * scale / union + 0.5)).otherwise(0).cast("long")


def normalized_tokens(source: Column) -> Column:
    """A body's tokens with every name as #, every number as 0 and every quote as one kind, so that a renamed copy has the same ones.

    Words of the language and punctuation stay; texts inside quotes are taken for code, as no lexer runs here.
    """
    token = r"[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|[\"'`]|[{}()\[\];,.:?!<>=+\-*/%&|^~]"
    words = F.array(*map(F.lit, KEYWORDS))
    one = lambda t: F.when(F.array_contains(words, t), t).when(t.rlike(r"^[A-Za-z_$]"), "#").when(t.rlike(r"^\d"), "0").when(t.rlike("^[\"'`]"), '"').otherwise(t)
    return F.transform(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(token), F.lit(0)), one)
