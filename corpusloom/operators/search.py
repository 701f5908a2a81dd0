"""Explainable token search and precedent ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import deprecated_name, name_tokens, query_tokens, query_tokens_of


def begins_with(t: Column):
    return lambda x: x.startswith(t) | t.startswith(x)


def hit_points(query: str, name: Column, path: Column | None = None, host: Column | None = None, props: Column | None = None) -> Column:
    """Points of the query's tokens in thousandths: each token counts once for the name (whole or prefix), and for props, path and host.

    A token that the query repeats counts again. A query without tokens gives 0.
    """
    total = F.lit(0)
    names = name_tokens(name)
    for token in query_tokens_of(query):
        t = F.lit(token)
        prefix = F.exists(names, begins_with(t))
        total = total + F.when(F.array_contains(names, t), V.NAME_EXACT).when(prefix, V.NAME_PREFIX).otherwise(0)
        if props is not None:
            total = total + F.when(F.array_contains(props, t), V.PROP_HIT).otherwise(0)
        if path is not None:
            total = total + F.when(F.array_contains(query_tokens(path), t), V.PATH_HIT).otherwise(0)
        if host is not None:
            total = total + F.when(F.array_contains(F.array(F.lower(host)), t), V.HOST_HIT).otherwise(0)
    return F.coalesce(total, F.lit(0)).cast("long")


def score(hits: Column, usage: Column, deprecated: Column) -> Column:
    """Hits plus a share of log10(1 + usage), less the cost of deprecation; 0 without hits."""
    bonus = F.floor(V.USAGE_FACTOR * F.log10(usage + F.lit(1.0)) + 0.5)
    return F.when(hits > 0, hits + bonus - F.when(deprecated, V.DEPRECATED_COST).otherwise(0)).otherwise(0).cast("long")


def reasons(query: str, name: Column, usage: Column, deprecated: Column, path: Column | None = None, hosts: Column | None = None, props: Column | None = None, file_class: Column | None = None, exported: Column | None = None) -> Column:
    """Why a row scores as it does, as an array: for each token of the query where it was found, then what the score gains by use and loses; empty without a hit."""
    names, parts = name_tokens(name), []
    for token in query_tokens_of(query):
        t = F.lit(token)
        parts.append(F.when(F.array_contains(names, t), f"name:{token}").when(F.exists(names, begins_with(t)), f"name~{token}"))
        for kind, where in (("prop", props), ("path", None if path is None else query_tokens(path)), ("host", hosts)):
            if where is not None:
                parts.append(F.when(F.array_contains(where, t), f"{kind}:{token}"))
    more = [F.when(usage > 0, F.concat(F.lit("usage:"), usage.cast("string"))), F.when(deprecated, "deprecated")]
    if file_class is not None:
        more.append(F.when(file_class.isin("test", "story"), F.concat(F.lit("class:"), file_class)))
    if exported is not None:
        more.append(F.when(~exported, "not-exported"))
    found = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, F.concat(found, F.array_compact(F.array(*more)))).otherwise(F.array().cast("array<string>"))


def search(entities: DataFrame, query: str, limit: int | None = 20, name="name", path="path", host="host", usage="usage_count", key="id", ordered: bool = True) -> DataFrame:
    """entities with hits, deprecated and score, best first, ties by usage, then key; those at 0 or less go where the query has tokens.

    Without a limit, ordered=False spares the sort of all rows.
    """
    hits = hit_points(query, F.col(name), F.col(path), F.col(host))
    out = entities.withColumn("hits", hits).withColumn("deprecated", deprecated_name(F.col(name)))
    out = out.withColumn("score", score(F.col("hits"), F.col(usage), F.col("deprecated")))
    if query_tokens_of(query):
        out = out.where("score > 0")
    if ordered or limit is not None:
        out = out.orderBy(F.desc("score"), F.desc(usage), key)
    return out.limit(limit) if limit is not None else out


def precedents(entities: DataFrame, query: str, limit: int = 8, recency: str = "recency", usage="usage_count", key="id", **columns: str) -> DataFrame:
    """The best hits, ranked again: deprecated ones last, then the most used, then the latest.

    The limit is the report's; the window runs over those rows alone.
    """
    best = search(entities, query, limit, usage=usage, key=key, **columns)
    order = Window.orderBy("deprecated", F.desc(usage), F.desc(recency), key)
    return best.withColumn("rank", F.row_number().over(order))


def precedent_report(ranked: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """ranked, the few rows of precedents(), with cluster (from members: key, cluster; null where it has none) and clusters, of how many clusters all of them are: 1 where none has one."""
    named = ranked.join(members.select(key, "cluster").join(F.broadcast(ranked.select(key)), key, "left_semi"), key, "left")
    return named.withColumn("clusters", F.greatest(F.size(F.collect_set("cluster").over(Window.partitionBy())), F.lit(1)))


def find_by_name(entities: DataFrame, wanted: str, name: str = "name", key: str = "id") -> DataFrame:
    """Rows with this key or name; only where there is none, those whose name is equal in another case."""
    exact = (F.col(name) == wanted) | (F.col(key).cast("string") == wanted)
    n_exact = entities.where(exact).agg(F.count("*")).scalar()
    return entities.where(exact | ((F.lower(name) == wanted.lower()) & (n_exact == 0)))


def filtered(
    entities: DataFrame,
    kind: str | None = None,
    file_part: str | None = None,
    exported: bool = False,
    min_usage: int = 0,
    with_tests: bool = False,
    props: list[str] = (),
    hook: str | None = None,
    renders: str | None = None,
) -> DataFrame:
    """entities (kind, file, exported, usage_count, file_class, and arrays props, hooks, renders) that meet all conditions asked for.

    file_part is looked for in any case; without with_tests, files of class test go (stories stay); props must all be there.
    """
    out = entities
    if kind:
        out = out.where(F.col("kind") == kind)
    if file_part:
        out = out.where(F.lower("file").contains(file_part.lower()))
    if exported:
        out = out.where("exported")
    if min_usage:
        out = out.where(F.coalesce("usage_count", F.lit(0)) >= min_usage)
    if not with_tests:
        out = out.where("file_class <> 'test'")
    if props:
        out = out.where(has_all(list(props), F.col("props")))
    if hook:
        out = out.where(F.array_contains("hooks", hook))
    if renders:
        out = out.where(F.array_contains("renders", renders))
    return out


def full_search(entities: DataFrame, query: str, limit: int | None = 20, with_tests: bool = False, **conditions) -> DataFrame:
    """The entities that filtered() leaves, with hits and score, best first; without a token in the query, the most used first.

    The score is that of search(), with props and host tags among the hits, less the costs of tests and stories and of what isn't
    exported. The limit is the report's.
    """
    rows = filtered(entities, with_tests=with_tests, **conditions)
    hosts, props = F.transform("hosts", F.lower), F.transform("props", F.lower)
    hits = hit_points(query, F.col("name"), F.col("file"), None, props)
    for token in query_tokens_of(query):
        hits = hits + F.when(F.array_contains(hosts, token), V.HOST_HIT).otherwise(0)
    cost = F.when(F.col("file_class").isin("test", "story"), V.TEST_COST).otherwise(0) + F.when(F.col("exported"), 0).otherwise(V.PRIVATE_COST)
    out = rows.withColumn("hits", hits.cast("long")).withColumn("deprecated", deprecated_name(F.col("name")))
    points = score(F.col("hits"), F.coalesce("usage_count", F.lit(0)), F.col("deprecated"))
    out = out.withColumn("score", F.when(F.col("hits") > 0, points - cost).otherwise(0).cast("long"))
    if query_tokens_of(query):
        out = out.where("score > 0").orderBy(F.desc("score"), F.desc("usage_count"), "id")
    else:
        out = out.orderBy(F.desc("usage_count"), "id")
    return out.limit(limit) if limit is not None else out


def has_all(wanted: list[str], have: Column) -> Column:
    """Whether an array column holds all of these."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) == 0


def severity_rank(severity: Column) -> Column:
    """critical 4, high 3, medium 2, anything else 1."""
    out = F.lit(1)
    for k, s in enumerate(reversed(V.SEVERITIES[:-1])):
        out = F.when(severity == s, k + 2).otherwise(out)
    return out


def signals(findings: DataFrame, rules: str | None = None, at_least: str | None = None, file_part: str | None = None, heuristic: bool = True, limit: int | None = 100, ordered: bool = True) -> DataFrame:
    """Findings (rule, severity, file, line, heuristic) by severity and file; rules is a comma list of prefixes in any case. Without a limit, ordered=False spares the sort."""
    out = findings
    if rules:
        match = F.lit(False)
        for r in rules.upper().split(","):
            match = match | F.col("rule").startswith(r.strip())
        out = out.where(match)
    if at_least:
        floor = {s: 4 - k for k, s in enumerate(V.SEVERITIES)}.get(at_least, 1)
        out = out.where(severity_rank(F.col("severity")) >= floor)
    if file_part:
        out = out.where(F.col("file").contains(file_part))
    if not heuristic:
        out = out.where(~F.col("heuristic"))
    if ordered or limit is not None:
        out = out.orderBy(severity_rank(F.col("severity")).desc(), "file", "line", "rule")
    return out.limit(limit) if limit is not None else out
