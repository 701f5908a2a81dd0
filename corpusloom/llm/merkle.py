"""A Merkle manifest of a dataset: a tree of hashes for each source, under one root, in which places are found by bitmap ranks."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import packed, rows_of, unpacked
from .common import written

#: Children of a node, levels that one task reduces at once, and the leaves of such a group.
FAN, LEVELS = 3, 7
GROUP = FAN**LEVELS
#: Ids of a bitmap, as a power of two, and bitmaps that one window of the directory orders. Null ids stand in a chunk of their own before all others.
CHUNK_BITS, SUPER_BITS, NULL_CHUNK = 12, 10, -(1 << 62)
#: Rows from which a task makes its part of the bitmaps at a time.
FLUSH_ROWS = 1 << 20
PLACED = "tree string, pos long, slot int, n_nodes long, doc_id long, leaf binary, now binary"
LEAVES = "tree string, pos long, n_nodes long, doc_ids binary, valid binary, leaves binary, changed binary, now binary, node binary"
NODES = "tree string, pos long, n_nodes long, first long, members binary, node binary"
PATH = "path array<struct<slot: int, siblings: string>>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A column as it goes into a leaf: `-` for null, else its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def n_levels(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a group, and those of each of `levels` levels above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def path_in(levels: list[list[str]], place: int) -> list[tuple[int, str]]:
    """From a node upwards within its group: its place in the run, and the run's others, left to right."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % FAN
        out.append((place % FAN, "".join(nodes[first:place] + nodes[place + 1 : first + FAN])))
        place //= FAN
    return out


def folded(node: str, path: list[tuple[int, str]]) -> str:
    for slot, siblings in path:
        node = hashed(siblings[: 64 * slot], node, siblings[64 * slot :])
    return node


def bitmaps(ids: DataFrame) -> DataFrame:
    """tree, chunk, bits, lows, counts: for each tree and range of ids a bitmap of those there are, and how often those are there that repeat.

    Each task makes compressed bitmaps of what it reads, which are merged by tree and range; a repeated id is a number in them, not a row.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FLUSH_ROWS:
                yield from split(held)
                held, n = [], 0
        if n:
            yield from split(held)

    def split(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        tree = table["tree"].combine_chunks().dictionary_encode()
        number, doc_id = tree.indices.to_numpy(), table["doc_id"].to_numpy()
        order = np.lexsort((doc_id, number))
        number, doc_id = number[order], doc_id[order]
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(doc_id >> CHUNK_BITS) != 0)) + 1
        rows = [(tree.dictionary[int(t[0])].as_py(), int(d[0] >> CHUNK_BITS), *coded(np.bincount(d & ((1 << CHUNK_BITS) - 1), minlength=1 << CHUNK_BITS))) for t, d in zip(np.split(number, cuts), np.split(doc_id, cuts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), *[pa.binary()] * 3], strict=True)], names=["tree", "chunk", "bits", "lows", "counts"])

    def coded(counts: np.ndarray) -> list[bytes]:
        lows = np.flatnonzero(counts > 1)
        return [packed(np.packbits(counts > 0, bitorder="little")), packed(lows.astype(np.uint16)), packed(counts[lows])]

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << CHUNK_BITS, np.int64)
        for row in table.to_pylist():
            counts += np.unpackbits(unpacked(row["bits"]), bitorder="little")
            counts[unpacked(row["lows"])] += unpacked(row["counts"]) - 1
        n_repeated = int((counts > 1).sum())
        columns = [table["tree"][:1], table["chunk"][:1], pa.array([int(counts.sum())]), pa.array([n_repeated]), *(pa.array([x], pa.binary()) for x in coded(counts))]
        return pa.Table.from_arrays(columns, names=["tree", "chunk", "n", "n_repeated", "bits", "lows", "counts"])

    parts = ids.select("tree", "doc_id").mapInArrow(part, "tree string, chunk long, bits binary, lows binary, counts binary")
    return parts.groupBy("tree", "chunk").applyInArrow(merge, "tree string, chunk long, n long, n_repeated long, bits binary, lows binary, counts binary")


class Ranks:
    """A bitmap with its popcount directory: how many leaves stand below an id."""

    def __init__(self, bits: bytes, lows: bytes, counts: bytes):
        self.words = unpacked(bits).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int64)
        self.lows, extra = unpacked(lows).astype(np.int64), unpacked(counts) - 1
        self.extra = np.concatenate(([0], np.cumsum(extra)))

    def below(self, low: np.ndarray) -> np.ndarray:
        word, bit = low >> 6, (low & 63).astype(np.uint64)
        inside = np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.before[word] + inside + self.extra[np.searchsorted(self.lows, low)]


def with_starts(index: DataFrame, nulls: DataFrame) -> DataFrame:
    """index with start (leaves of the tree in lower ranges; nulls, with tree and n, come first) and n_tree. Ranges are summed in two steps, so that no window holds a whole tree."""
    sizes = index.select("tree", "chunk", "n").unionByName(nulls.select("tree", F.lit(NULL_CHUNK).cast("long").alias("chunk"), "n"))
    upper = F.shiftright("chunk", SUPER_BITS).alias("upper")
    uppers = sizes.groupBy("tree", upper).agg(F.sum("n").alias("n"))
    over = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    uppers = uppers.withColumn("before", over(Window.partitionBy("tree").orderBy("upper"))).withColumn("n_tree", F.sum("n").over(Window.partitionBy("tree"))).drop("n")
    inner = sizes.select("tree", "chunk", "n", upper).withColumn("inside", over(Window.partitionBy("tree", "upper").orderBy("chunk")))
    starts = inner.join(uppers, ["tree", "upper"]).select("tree", "chunk", (F.col("before") + F.col("inside")).alias("start"), "n_tree")
    return starts.join(index, ["tree", "chunk"], "left")


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, their number from 0 in this order over all partitions; the columns named must tell rows apart. The rows must come out the same each time they are read."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))), "in-order")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return ranged.join(counts.select("part", before.alias("before")), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """PLACED rows of leaves (tree, doc_id, leaf, now, row): the group of each leaf and its slot there, by the rank of its id in its tree.

    Bitmaps answer for ids that stand once. Rows of a repeated or null id share its rank and are told apart by leaf, in a range sort over all tasks.
    """
    chunk = F.coalesce(F.shiftright("doc_id", CHUNK_BITS), F.lit(NULL_CHUNK)).alias("chunk")
    nulls = leaves.where("doc_id is null").groupBy("tree").agg(F.count("*").alias("n"))
    index = written(with_starts(written(bitmaps(leaves.where("doc_id is not null")), "bitmaps"), nulls), "bitmap-index")

    def rank(key: tuple, own: pa.Table, bitmap: pa.Table) -> pa.Table:
        if own.num_rows and bitmap.num_rows:
            row = bitmap.to_pylist()[0]
            low = own["doc_id"].to_numpy() & ((1 << CHUNK_BITS) - 1)
            at = row["start"] + Ranks(row["bits"], row["lows"], row["counts"]).below(low)
            n_tree = np.full(len(at), row["n_tree"])
        else:
            own, at, n_tree = own.slice(0, 0), np.empty(0, np.int64), np.empty(0, np.int64)
        columns = [own["tree"], pa.array(at // GROUP), pa.array((at % GROUP).astype(np.int32)), pa.array(n_tree), own["doc_id"], own["leaf"], own["now"]]
        return pa.Table.from_arrays(columns, names=names(PLACED))

    def repeated_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            if row["bits"] is None:  # the null ids
                ids, at = pa.array([None], pa.int64()), np.array([row["start"]])
            else:
                low = unpacked(row["lows"]).astype(np.int64)
                ids, at = pa.array((row["chunk"] << CHUNK_BITS) + low), row["start"] + Ranks(row["bits"], row["lows"], row["counts"]).below(low)
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(at)), ids, pa.array(at), pa.array([row["n_tree"]] * len(at))], names=["tree", "doc_id", "base", "n_tree"])

    single = leaves.where("doc_id is not null")
    again = index.where("bits is null or n_repeated > 0")
    some = not again.isEmpty()
    if some:
        repeated = written(again.mapInArrow(repeated_ids, "tree string, doc_id long, base long, n_tree long"), "repeated-ids")
        single = single.join(repeated.where("doc_id is not null").select("tree", "doc_id"), ["tree", "doc_id"], "left_anti")
    by_chunk = single.select("tree", chunk, "doc_id", "leaf", "now").groupBy("tree", "chunk")
    placed = by_chunk.cogroup(index.where("bits is not null").groupBy("tree", "chunk")).applyInArrow(rank, PLACED)
    if some:
        same = (F.col("tree") == F.col("other_tree")) & F.col("doc_id").eqNullSafe(F.col("other_id"))
        other = lambda df: df.withColumnsRenamed({"tree": "other_tree", "doc_id": "other_id"})
        ordered = positions(leaves.join(other(repeated), same).drop("other_tree", "other_id"), "tree", "doc_id", "leaf", "row")
        first = ordered.groupBy("tree", "doc_id").agg(F.min("place").alias("first"))
        at = F.col("base") + F.col("place") - F.col("first")
        rest = ordered.join(other(first), same).select("tree", F.floor(at / GROUP).alias("pos"), (at % GROUP).cast("int").alias("slot"), F.col("n_tree").alias("n_nodes"), "doc_id", "leaf", "now")
        placed = placed.unionByName(rest)
    return placed


def leaf_groups(placed: DataFrame) -> DataFrame:
    """LEAVES rows: the leaves of a group as arrays by slot, and the node that their lower levels end in."""

    def fill(table: pa.Table) -> pa.Table:
        order = np.argsort(table["slot"].to_numpy())
        table = table.take(pa.array(order))
        leaves, now = table["leaf"].to_pylist(), table["now"].to_pylist()
        node = reduced([x.hex() for x in leaves], min(LEVELS, n_levels(table["n_nodes"][0].as_py())))[-1][0]
        ids = table["doc_id"]
        columns = [
            packed(ids.fill_null(0).to_numpy()), packed(ids.combine_chunks().is_valid().to_numpy(zero_copy_only=False).view(np.uint8)), b"".join(leaves),
            packed(np.array([x is not None for x in now], np.uint8)), b"".join(x for x in now if x is not None), bytes.fromhex(node),
        ]
        return pa.Table.from_arrays([table["tree"][:1], table["pos"][:1], table["n_nodes"][:1], *(pa.array([c], pa.binary()) for c in columns)], names=names(LEAVES))

    return placed.groupBy("tree", "pos").applyInArrow(fill, LEAVES)


def fewer(n: Column) -> Column:
    """How many nodes of n are left LEVELS levels above."""
    return F.ceil(n / F.lit(GROUP)).cast("long")


def climbed(nodes: DataFrame) -> DataFrame:
    """tree, pos, top, path: for each node of nodes (tree, pos, n_nodes, node) its tree's top and its path to it.

    Slot arrays keyed by tree and group are reduced LEVELS levels at a time, until every tree has one node; then paths go down the same groups.
    """

    def fill(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["pos"].to_numpy())))
        own = table["node"].to_pylist()
        node = reduced([x.hex() for x in own], min(LEVELS, n_levels(table["n_nodes"][0].as_py())))[-1][0]
        first = table["pos"][0].as_py()
        values = [[first // GROUP], [table["n_nodes"][0].as_py()], [first], [b"".join(own)], [bytes.fromhex(node)]]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        return pa.Table.from_arrays([table["tree"][:1], *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=names(NODES))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            own = hexes(row["members"])
            levels, above = reduced(own, min(LEVELS, n_levels(row["n_nodes"]))), [(x["slot"], x["siblings"]) for x in row["path"]]
            paths = [[{"slot": s, "siblings": x} for s, x in path_in(levels, i) + above] for i in range(len(own))]
            columns = [pa.array([row["tree"]] * len(own)), pa.array(row["first"] + np.arange(len(own))), pa.array([row["top"]] * len(own)), pa.array(paths, pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.string())])))]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "pos", "top", "path"])

    rounds = []
    while True:
        groups = written(nodes.withColumn("group", F.floor(F.col("pos") / GROUP)).groupBy("tree", "group").applyInArrow(fill, NODES), "nodes")
        rounds.append(groups)
        if not groups.agg(F.max("pos")).first()[0]:
            break
        nodes = groups.select("tree", "pos", fewer(F.col("n_nodes")).alias("n_nodes"), "node")
    paths = groups.select("tree", "pos", F.lower(F.hex("node")).alias("top"), F.array().cast(PATH.split(" ", 1)[1]).alias("path"))
    for groups in reversed(rounds):
        paths = groups.join(paths, ["tree", "pos"]).mapInArrow(spread_out, f"tree string, pos long, top string, {PATH}")
    return paths


def hexes(data: bytes) -> list[str]:
    return [data[i : i + 32].hex() for i in range(0, len(data), 32)]


def merkle_manifest(docs: DataFrame, text_now: Column | None = None) -> DataFrame:
    """RESULT for docs (doc_id, source, lang, n_chars, text); text_now is the text as it is found now, which the proofs are held against.

    A leaf is the hash of a row's five fields. Each source has a tree over its leaves by doc_id, and the sources' tops, null first, have one over them; a run
    of three nodes, at the end fewer, is a node of the next level. A document's proof are the runs' others on its way to the root.

    Cases: null fields are `-`; null ids come first in their source, and rows that share an id are ordered by leaf, so that any order of the input gives the same
    tree; a source with one row has that leaf as its top, one source alone has its top as root, and a proof without siblings is the hash of nothing; an empty table
    gives an empty result; other columns are ignored.
    """
    now = docs["text"] if text_now is None else text_now
    own = [docs["doc_id"].cast("long"), docs["source"], docs["lang"], docs["n_chars"].cast("long")]
    leaf = lambda text: F.unhex(F.sha2(F.concat(*map(field, own), field(text)), 256))
    tree = F.coalesce(F.concat(F.lit("1"), docs["source"].cast("string")), F.lit("0"))
    changed = F.when(~now.eqNullSafe(docs["text"]), leaf(now))
    leaves = written(docs.select(tree.alias("tree"), own[0].alias("doc_id"), leaf(docs["text"]).alias("leaf"), changed.alias("now"), F.monotonically_increasing_id().alias("row")), "leaves")
    groups = written(leaf_groups(placed_leaves(leaves)), "leaf-groups")
    subtrees = written(climbed(groups.select("tree", "pos", fewer(F.col("n_nodes")).alias("n_nodes"), "node")), "subtrees")
    tops = positions(subtrees.where("pos = 0").select("tree", "top"), "tree")
    n_tops = tops.count()
    roots = climbed(tops.select(F.lit("").alias("tree"), F.col("place").alias("pos"), F.lit(n_tops).cast("long").alias("n_nodes"), F.unhex("top").alias("node")))
    above = tops.join(roots.select(F.col("pos").alias("place"), F.col("top").alias("root"), F.col("path").alias("last")), "place").select("tree", "root", "last")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            leaves, found = hexes(row["leaves"]), hexes(row["now"])
            changed = unpacked(row["changed"]).astype(bool)
            at = np.cumsum(changed) - 1
            levels = reduced(leaves, min(LEVELS, n_levels(row["n_nodes"])))
            upper = [(x["slot"], x["siblings"]) for x in [*row["path"], *row["last"]]]
            tail, rows = "".join(x for _, x in upper), []
            for i, leaf in enumerate(leaves):
                path = path_in(levels, i)
                root = folded(found[at[i]] if changed[i] else leaf, path + upper)
                rows.append((leaf, row["top"], row["root"], hashed(*(x for _, x in path), tail), root, root == row["root"]))
            ids = pa.array(unpacked(row["doc_ids"]), mask=~unpacked(row["valid"]).astype(bool))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in zip(*rows, strict=True))], names=names(RESULT))

    return groups.join(subtrees, ["tree", "pos"]).join(above, "tree").mapInArrow(prove, RESULT)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.lit(False))
    return merkle_manifest(docs, F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"]))
