"""Members of declared types, those of the types that they extend or name included."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..sources.storage import written

#: Types of a file that one task walks from; a larger file's are dealt to several, each with all its references and members.
STARTS = 4096
#: What a row of a file is: a type, a reference or a member.
TYPE, REF, MEMBER = 0, 1, 2


def bare_name(name):
    """A type's name without its arguments."""
    return F.trim(F.regexp_replace(name, r"(?s)<.*$", ""))


def reached_from(start: str | None, steps: dict[str, list[str]]) -> list[str]:
    """What a type leads to through steps, itself first, each name once, in the order of a depth-first walk."""
    order, seen, todo = [], set(), [start]
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            order.append(name)
            todo += reversed(steps.get(name, ()))
    return order


def walked_file(kinds: list[int], types: list[str], names: list[str], mine: list[bool], at: int, end: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(row of a type, rows of its members, rows of references to names not declared) for the types that are `mine` among rows at to end of one file, which stand by kind and place."""
    steps, own, starts, first = {}, {}, {}, {}
    declared = set()
    for k in range(at, end):
        if kinds[k] == TYPE:
            declared.add(types[k])
            if mine[k]:
                starts.setdefault(types[k], k)
        elif types[k] is not None and kinds[k] == REF:
            steps.setdefault(types[k], {}).setdefault(names[k], k)
            first.setdefault(names[k], k)
        elif types[k] is not None:
            own.setdefault(types[k], {}).setdefault(names[k], k)
    for start, row in starts.items():
        order, found = reached_from(start, steps), {}
        for name in reversed(order):  # what comes first in the walk counts, so it comes last here
            found.update(own.get(name, ()))
        yield row, [*found.values()], [first[name] for name in order if name in first and (name is None or name not in declared)]


def walked_members(types: DataFrame, members: DataFrame, refs: DataFrame, starts: int = STARTS) -> DataFrame:
    """What resolved_members() gives as one table: file, type, member, declared_in, the members' other columns and found; where found is false, member is an
    unresolved name and the rest is null.

    A file's rows meet in one task, sorted, and stream through it: its members once, however many types lead to them. A file with more than `starts` types
    goes to a task for each so many of them. Rows without a file or types without a name have none.
    """
    rest = [c for c in members.columns if c not in ("file", "type", "place", "member")]
    other = F.struct(*rest) if rest else F.lit(None).cast("boolean")
    place = F.col("place").cast("long").alias("place")
    kind = lambda k: F.lit(k).cast("byte").alias("kind")
    rows = members.select("file", kind(MEMBER), "type", place, F.col("member").alias("name"), other.alias("other"))
    none = F.lit(None).cast(rows.schema["other"].dataType).alias("other")
    rows = rows.unionByName(refs.select("file", kind(REF), "type", place, bare_name(F.col("parent")).alias("name"), none))
    rows = rows.unionByName(types.where("type is not null").select("file", kind(TYPE), "type", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("name"), none))
    # Few files are that large: one for each so many types at most.
    large = types.groupBy("file").agg(F.ceil(F.count("*") / starts).cast("int").alias("parts")).where("parts > 1")
    rows = rows.where("file is not null").join(F.broadcast(large), "file", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    mine = F.pmod(F.xxhash64("type"), F.coalesce("parts", F.lit(1))) == F.col("part")
    rows = rows.select("file", "part", "kind", "type", "place", "name", mine.alias("mine"), "other").repartition("file", "part").sortWithinPartitions("file", "part", "kind", "place", "name")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if batch.num_rows:
                keys = list(zip(batch["file"].to_pylist(), batch["part"].to_pylist()))
                if held and (keys[0] != last or keys[-1] != last):
                    # The file that is under way ends in this batch; what follows but for the last file is whole as well.
                    cut = keys.index(keys[-1])
                    yield from out_of([*held, batch.slice(0, cut)])
                    held = []
                    batch = batch.slice(cut)
                held.append(batch)
                last = keys[-1]
        if held:
            yield from out_of(held)

    def out_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        files, parts, kinds, names, owners, mine = (table[c].to_pylist() for c in ("file", "part", "kind", "name", "type", "mine"))
        start, row, found, at = [], [], [], 0
        for k in range(1, len(files) + 1):
            if k == len(files) or files[k] != files[at] or parts[k] != parts[at]:
                for s, had, gone in walked_file(kinds, owners, names, mine, at, k):
                    start += [s] * (len(had) + len(gone))
                    row += had + gone
                    found += [True] * len(had) + [False] * len(gone)
                    if len(row) >= 1 << 16:
                        yield taken(table, start, row, found)
                        start, row, found = [], [], []
                at = k
        if row:
            yield taken(table, start, row, found)

    def taken(table: pa.Table, start: list[int], row: list[int], found: list[bool]) -> pa.RecordBatch:
        is_member = pa.array(found, pa.bool_())
        picked = pa.array(row, pa.int64())
        known = pa.compute.if_else(is_member, picked, None)
        from_start = table.select(["file", "type"]).take(pa.array(start, pa.int64()))
        columns = [from_start["file"], from_start["type"], table["name"].take(picked), table["type"].take(known), table["other"].take(known), is_member]
        out = pa.table(columns, names=["file", "type", "member", "declared_in", "other", "found"])
        return out.combine_chunks().to_batches()[0]

    schema = StructType([*[StructField(c, StringType()) for c in ("file", "type", "member", "declared_in")], StructField("other", rows.schema["other"].dataType), StructField("found", BooleanType())])
    out = rows.mapInArrow(walked, schema)
    return out.select("file", "type", "member", "declared_in", *[f"other.{c}" for c in rest], "found")


def resolved_members(types: DataFrame, members: DataFrame, refs: DataFrame, starts: int = STARTS) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) for types (file, type), members (file, type, place, member, ...) and refs (file, type, place, parent).

    resolved has file, type and the members' columns, with declared_in: of members with one name the first counts, a type's own before those of
    what it extends or names, in a depth-first walk. unresolved has file, type and name: names on the way that the file declares no type by.
    Types that name each other end where they meet again.
    """
    found = written(walked_members(types, members, refs, starts), "walked-members")
    return found.where("found").drop("found"), found.where("not found").select("file", "type", F.col("member").alias("name"))
