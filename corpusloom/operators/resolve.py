"""Resolving references: module paths, bindings, re-exports, and the owner of a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

# The extensions that a path without one may have, in the order in which they are tried.
EXTENSIONS = [".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs", ".mts", ".cts"]
# Fixed value: extensions that may stand for one of those above.
SWAPPED = r"\.(js|jsx|mjs)$"
#: How a path answers, in the order in which these are tried: as it is, with an extension, or as a folder's index; after a swap it is tried with an extension, before an index.
FILE, STEM, SWAPPED_RANK, INDEX = range(4)
#: Which answers a specifier takes.
ANY, INDEX_ALONE, SWAPPED_STEM = range(3)
#: After all aliases.
LAST = 1 << 30


def normal_path(path):
    """A path without `.` and `..` segments, but for leading `..` ones, which lead out of the tree."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
    step = lambda done, p: F.when((p == "..") & up(done), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def alias_rows(spark, aliases: dict[str, str]) -> DataFrame:
    """Alias rows of `prefix -> folder` pairs, in their order."""
    rows = [(k, f"{prefix}*", 0, f"{folder}*") for k, (prefix, folder) in enumerate(aliases.items())]
    return spark.createDataFrame(rows, "place int, pattern string, target_place int, target string")


def possible_bases(specs: DataFrame, aliases: DataFrame | None, by: list[str]) -> DataFrame:
    """specs (by, source) with base, a path that the specifier may mean, and alias_place, target_place, its order among these.

    A specifier's beginnings are joined with the text before the star of each pattern, so that no specifier meets an alias that it doesn't begin with;
    a pattern without a star must be the whole specifier.
    """
    as_written = specs.select(*by, "source", F.col("source").alias("base"), F.lit(LAST).alias("alias_place"), F.lit(0).alias("target_place"))
    if aliases is None:
        return as_written
    star = F.instr("pattern", "*")
    known = aliases.select(
        *by, F.col("place").alias("alias_place"), "target_place", "target", (star > 0).alias("open"),
        F.when(star > 0, F.expr("substring(pattern, 1, instr(pattern, '*') - 1)")).otherwise(F.col("pattern")).alias("prefix"),
        F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise("").alias("suffix"),
    )
    begins = specs.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("source")), lambda n: F.substring("source", F.lit(1), n))))
    fits = F.when(F.col("open"), F.endswith("source", "suffix")).otherwise(F.col("source") == F.col("prefix"))
    # One project's aliases go to the specifiers; those of many projects meet theirs by key. The specifiers, many more once they are cut, go to all tasks in neither case.
    both = (begins.hint("merge").join(known, [*by, "prefix"]) if by else begins.join(F.broadcast(known), "prefix")).where(fits)
    middle = F.expr("substring(source, length(prefix) + 1, greatest(length(source) - length(prefix) - length(suffix), 0))")
    at = F.instr("target", "*")
    filled = F.when(F.col("open") & (at > 0), F.concat(F.expr("substring(target, 1, instr(target, '*') - 1)"), middle, F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.col("target"))
    below = both.select(*by, "source", filled.alias("base"), "alias_place", "target_place").where(~F.startswith("base", F.lit("/")))
    return as_written.unionByName(below)


def resolve_modules(imports: DataFrame, files: DataFrame, aliases: DataFrame | dict[str, str] | None = None, bases: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """imports (path, source) with resolved, the file a specifier means, null where it is external.

    Relative specifiers start from the importing file's folder. Others go through all aliases that fit, in their order and that of their
    targets, then the base folder, until a file is found. aliases has place, pattern (with a star or without), target_place and target, under the
    base folder as it is; a dict maps prefixes to folders. bases has base, one row; without it the root is the base. With `by`, such as a project's root, all tables have
    these columns and only rows that agree in them meet.

    Of a path, these are tried: as it is written, if it has an extension; with each of EXTENSIONS; without .js, .jsx or .mjs and with each of them; as a folder
    with an index file. Files are known under the paths that they answer to, and how, so that a specifier is a row for each path that it may mean, and one more without .js, .jsx or .mjs, not one for each try.
    A path that leads out of the tree, or ends in a slash without a folder's index, is external.
    """
    keys = list(by)
    if isinstance(aliases, dict):
        aliases = alias_rows(imports.sparkSession, aliases)
    relative_source, folder = F.startswith("source", F.lit(".")), F.regexp_replace("path", r"[^/]*$", "")
    relative = imports.where(relative_source).select(*keys, "source", folder.alias("folder")).distinct()
    relative = relative.select(*keys, "source", "folder", F.concat("folder", "source").alias("base"), F.lit(0).alias("alias_place"), F.lit(0).alias("target_place"))
    others = possible_bases(imports.where(~relative_source).select(*keys, "source").distinct(), aliases, keys)
    if bases is not None:
        below = bases.select(*keys, F.col("base").alias("root_folder"))
        others = others.join(below, keys, "left") if keys else others.join(below, F.lit(True), "left")
        others = others.withColumn("base", F.when(F.col("alias_place") == LAST, F.concat_ws("/", F.nullif("root_folder", F.lit("")), "base")).otherwise(F.col("base"))).drop("root_folder")
    outside = F.startswith("source", F.lit("/"))
    # Only relative specifiers begin with a dot, so that others are told from them without a null folder: all meet by plain equality, and what is found is not shuffled again for it.
    rows = relative.unionByName(others.where(~outside).withColumn("folder", F.lit("")))
    slash, whole = F.col("base").rlike("(^|/)$"), normal_path(F.col("base"))
    rows = rows.withColumn("open", slash & relative_source).withColumn("base", whole)
    swapped = F.regexp_replace("base", SWAPPED, "")
    ask = lambda key, way: F.struct(key.alias("key"), way.alias("way"))
    other = F.when(~F.col("open") & (swapped != F.col("base")), ask(swapped, F.lit(SWAPPED_STEM)))
    asks = F.filter(F.array(ask(F.col("base"), F.when(F.col("open"), INDEX_ALONE).otherwise(ANY)), other), lambda x: x.isNotNull())
    asked = rows.select(*keys, "source", "folder", "alias_place", "target_place", F.inline(asks))
    place = F.create_map(*[F.lit(x) for k, e in enumerate(EXTENSIONS) for x in (e, k)])
    extension = F.regexp_extract("file", r"(\.[a-z]+)$", 1)
    stem, nth = F.expr("substring(file, 1, length(file) - length(regexp_extract(file, '([.][a-z]+)$', 1)))"), F.try_element_at(place, extension)
    answer = lambda key, rank, n: F.struct(key.alias("key"), F.lit(rank).alias("rank"), n.alias("nth"))
    answers = F.filter(
        F.array(
            F.when(F.col("file").rlike(r"(^|/)[^/]+\.[^/]*$"), answer(F.col("file"), FILE, F.lit(0))),
            F.when(nth.isNotNull(), answer(stem, STEM, nth)),
            F.when(nth.isNotNull() & stem.rlike("(^|/)index$"), answer(F.regexp_replace(stem, "/?index$", ""), INDEX, nth)),
        ), lambda x: x.isNotNull(),
    )
    known = files.select(*keys, F.col("path").alias("file")).distinct().select(*keys, "file", F.inline(answers))
    # Both sides grow with the files. Their size is guessed from the table's bytes, before each row becomes several paths, so that one could be sent to all tasks.
    way, rank = F.col("way"), F.col("rank")
    hits = asked.join(known.hint("merge"), [*keys, "key"]).where((way == ANY) | ((way == INDEX_ALONE) & (rank == INDEX)) | ((way == SWAPPED_STEM) & (rank == STEM)))
    first = F.struct("alias_place", "target_place", F.when(way == SWAPPED_STEM, SWAPPED_RANK).otherwise(rank), "nth")
    best = hits.groupBy(*keys, "source", "folder").agg(F.min_by("file", first).alias("resolved"))
    # A path goes as its folder and the rest of it, as it meets its relative specifiers by folder.
    own = imports.withColumn("_folder", F.when(relative_source, folder).otherwise(F.lit(""))).withColumn("path", F.expr("substring(path, length(_folder) + 1)"))
    found = best.select(*[F.col(k).alias(f"_by_{k}") for k in keys], F.col("source").alias("_source"), F.col("folder").alias("_of"), "resolved")
    meets = (F.col("source") == F.col("_source")) & (F.col("_folder") == F.col("_of"))
    for k in keys:
        meets = meets & (F.col(k) == F.col(f"_by_{k}"))
    whole = own.join(found.hint("merge"), meets, "left").withColumn("path", F.concat("_folder", "path"))
    return whole.select(*imports.columns, "resolved")


def last_binding(local: DataFrame, imported: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One binding for each name of a file: imports replace local ones, later ones replace earlier ones."""
    both = local.withColumn("_rank", F.lit(0)).unionByName(imported.withColumn("_rank", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_rank"), F.desc(order)))
    return both.withColumn("_last", last).where("_last = 1").drop("_rank", "_last")


def follow_reexports(exports: DataFrame, reexports: DataFrame, hops: int = 6) -> DataFrame:
    """file, name, target, hops: what each exported name means through up to `hops` re-exports.

    exports (file, name, target) are a file's own; reexports (file, place, source_file) forward all names. A file's own
    name comes first, then the re-export with the least place.
    """
    known = exports.select("file", "name", "target", F.lit(0).alias("hops"))
    frontier = known
    for k in range(1, hops + 1):
        step = reexports.join(frontier.withColumnRenamed("file", "source_file"), "source_file")
        first = step.groupBy("file", "name").agg(F.min_by("target", F.struct("place", "target")).alias("target"))
        frontier = first.join(known, ["file", "name"], "left_anti").select("file", "name", "target", F.lit(k).alias("hops"))
        frontier = written(frontier, "reexports")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def owners(places: DataFrame, spans: DataFrame, file: str, place: str, start: str, end: str, owner: str, bin_width: int = 512) -> DataFrame:
    """places with the span of the same file that holds them, the one that starts last; places outside all spans go.

    Both sides meet by file and bin of bin_width places, so that a place meets only spans near it, however many its file has; a
    span is sent to each bin that it overlaps. Places that repeat come once.
    """
    at = lambda c: F.floor(F.col(c) / bin_width)
    s = spans.where(F.col(start) <= F.col(end)).select(F.col(file).alias("_file"), F.col(start).alias("_start"), F.col(end).alias("_end"), owner, F.explode(F.sequence(at(start), at(end))).alias("_bin"))
    both = places.join(s, (F.col(file) == F.col("_file")) & (at(place) == F.col("_bin")) & F.col(place).between(F.col("_start"), F.col("_end")))
    return both.groupBy(*places.columns).agg(F.max_by(owner, F.struct("_start", owner)).alias(owner))


def export_table(entities: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """file, name, target: what a file exports under which name; an entity (id, file, name, exported, is_default) also as `default`.

    defaults (file, name) are files' default exports by name; these come before is_default, and of several the greatest id counts.
    """
    named = entities.where("exported").select("file", "name", F.col("id").alias("target"), F.lit(0).alias("rank"))
    own = entities.where("is_default").select("file", F.lit("default").alias("name"), F.col("id").alias("target"), F.lit(0).alias("rank"))
    out = named.unionByName(own)
    if defaults is not None:
        by_name = defaults.join(entities.select("file", "name", "id"), ["file", "name"])
        out = out.unionByName(by_name.select("file", F.lit("default").alias("name"), F.col("id").alias("target"), F.lit(1).alias("rank")))
    return out.groupBy("file", "name").agg(F.max_by("target", F.struct("rank", "target")).alias("target"))
