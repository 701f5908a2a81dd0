"""Weighted similarity of sets, all with all in blocks: how much two sets share comes from products of matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..sources.storage import written

#: Keys of equal sets in one row.
KEYS = 256
#: Tasks that groups of two blocks are dealt to, at most.
TASKS = 10_000
#: Members of sets that stand in one matrix, and pairs that are scored or listed at once.
SLICE, TILE = 512, 1 << 18


class Sets:
    """Rows of a block: keys[starts[r]:starts[r + 1]] have row r's sets, one for each part as hashes of its members and the rows that these are of."""

    def __init__(self, rows: pa.Table, n_parts: int):
        keys = rows["keys"].combine_chunks()
        self.n, self.keys, self.carried = len(rows), keys.flatten(), rows["carried"].combine_chunks()
        self.counts = keys.value_lengths().to_numpy(zero_copy_only=False)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        self.asked, self.several = (rows[c].to_numpy().astype(bool) for c in ("asked", "several"))
        lists = [rows[f"p{k}"].combine_chunks() for k in range(n_parts)]
        self.sizes = [x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
        self.values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        self.owners = [np.repeat(np.arange(self.n), s) for s in self.sizes]

    def distinct(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each different set of a part, and which of these sets each row has; sets are known by sums of hashes."""
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[part].view(np.uint64))))
        ends = np.cumsum(self.sizes[part])
        _, first, which = np.unique(sums[ends] - sums[ends - self.sizes[part]], return_index=True, return_inverse=True)
        return first, which

    def only(self, part: int, rows: np.ndarray) -> Sets:
        """Some rows, of one part alone, without their keys."""
        out = object.__new__(Sets)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        has = place[self.owners[part]] >= 0
        out.n, out.values, out.owners = len(rows), [self.values[part][has]], [place[self.owners[part][has]]]
        return out

    def matrix(self, part: int, members: np.ndarray) -> np.ndarray:
        """Which of the members, sorted, each row's set has."""
        at = np.minimum(np.searchsorted(members, self.values[part]), len(members) - 1)
        has = members[at] == self.values[part]
        out = np.zeros((self.n, len(members)), np.float32)
        out[self.owners[part][has], at[has]] = 1
        return out


def common(x: Sets, y: Sets, part: int) -> np.ndarray:
    """How many members of a part each row of x shares with each of y."""
    shared = np.intersect1d(x.values[part], y.values[part])
    out = np.zeros((x.n, y.n), np.float32)
    for k in range(0, len(shared), SLICE):
        members = shared[k : k + SLICE]
        out += x.matrix(part, members) @ y.matrix(part, members).T
    return out


def tiles(n: int, m: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, m))
    return (slice(k, k + step) for k in range(0, n, step))


def shares(shared: np.ndarray, sizes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities, times scale and rounded, of sets that share so many members and have so many in all, and whether they are alike enough for boost."""
    union = sizes - shared
    rounded = np.floor(shared * float(scale) / np.maximum(union, 1) + 0.5).astype(np.int32)
    return rounded, shared * 100 >= union * V.ALIKE_PROPS_PERCENT


def part_scores(both: np.ndarray, n: np.ndarray, m: np.ndarray, scale: int, boost: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """shares() for sets of n and m members: from a table of what sizes there are, if it is small."""
    wide, high = int(min(n.max(), m.max())) + 1, int(n.max() + m.max()) + 1
    table = shares(*np.meshgrid(np.arange(wide), np.arange(high)), scale) if wide * high <= TILE // 4 else None
    out, alike = np.empty(both.shape, np.int32), np.zeros(both.shape, bool) if boost else None
    for t in tiles(*both.shape):
        shared, sizes = both[t].astype(np.int32), (n[t, None] + m[None, :]).astype(np.int32)
        if table:
            at = sizes * wide + shared
            out[t] = table[0].ravel()[at]
            similar = table[1].ravel()[at] if boost else None
        else:
            out[t], similar = shares(shared, sizes, scale)
        if boost:
            alike[t] = similar & (n[t, None] >= V.ALIKE_PROPS_LEAST) & (m[None, :] >= V.ALIKE_PROPS_LEAST)
    return out, alike


def scores(x: Sets, y: Sets, weights: list[int], boost: bool) -> np.ndarray:
    """cluster.weighted_similarity() of each row of x with each of y, after cluster.contract_boost() with boost. Of a part that has few different sets, these are compared."""
    total, alike = None, None
    for part, weight in enumerate(weights):
        (few, of_x), (fewer, of_y) = x.distinct(part), y.distinct(part)
        whole = 2 * len(few) * len(fewer) > x.n * y.n
        both = common(x if whole else x.only(part, few), y if whole else y.only(part, fewer), part if whole else 0)
        n, m = (x.sizes[part], y.sizes[part]) if whole else (x.sizes[part][few], y.sizes[part][fewer])
        own, like = part_scores(both, n, m, weight * 10, boost and part == 0)
        total = np.zeros((x.n, y.n), np.int32) if total is None else total
        alike = (like if whole else like[of_x][:, of_y]) if like is not None else alike
        for t in tiles(x.n, y.n):
            total[t] += own[t] if whole else own[of_x[t]][:, of_y]
    if alike is not None:
        np.maximum(total, V.ALIKE_SIMILARITY, out=total, where=alike)
    return total


def linked(x: Sets, y: Sets, total: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in x and y of rows that are `least` alike and of which one is asked; in a block with itself (x is y) each two once, and a row with itself where several have its sets."""
    for t in tiles(x.n, y.n):
        hit = (total[t] >= least) & (x.asked[t, None] | y.asked[None, :])
        if x is y:
            at = np.arange(x.n)
            hit &= (at[t, None] < at[None, :]) | ((at[t, None] == at[None, :]) & x.several[t, None])
        left, right = np.nonzero(hit)
        if len(left):
            yield left + t.start, right


def listed(x: Sets, y: Sets, total: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """a, b, similarity, carried: all pairs of keys of linked rows."""
    for left, right in linked(x, y, total, least):
        n = x.counts[left].astype(np.int64) * y.counts[right]
        ends = np.cumsum(n)
        for piece in np.split(np.arange(len(n)), np.searchsorted(ends, np.arange(4 * TILE, ends[-1], 4 * TILE))):
            which = np.repeat(piece, n[piece])
            within = np.arange(len(which)) - np.repeat(np.cumsum(n[piece]) - n[piece], n[piece])
            width = y.counts[right[which]]
            a, b = x.starts[left[which]] + within // width, y.starts[right[which]] + within % width
            if x is y:
                once = (left[which] != right[which]) | (a < b)
                which, a, b = which[once], a[once], b[once]
            columns = [x.keys.take(pa.array(a)), y.keys.take(pa.array(b)), pa.array(total[left[which], right[which]].astype(np.int64)), x.carried.take(pa.array(left[which]))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity", "carried"])


def joined(x: Sets, y: Sets, total: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """a, b: the first keys of linked rows, of which only those links come out that join what those before leave apart, and rows linked with themselves."""
    offset = 0 if x is y else x.n
    label = np.arange(offset + y.n)
    found: list[tuple[int, int]] = []
    for left, right in linked(x, y, total, least):
        if x is y:
            found += [(r, r) for r in left[left == right].tolist()]
        apart = label[left] != label[offset + right]
        rows, first = np.unique(left[apart], return_index=True)
        for row, others in zip(rows.tolist(), np.split(right[apart], first[1:]) if len(rows) else [], strict=True):
            labels = label[offset + others]
            new, at = np.unique(labels, return_index=True)
            found += [(row, int(others[k])) for c, k in zip(new.tolist(), at.tolist(), strict=True) if c != label[row]]
            label[np.isin(label, new)] = label[row]
    if found:
        a, b = np.array(found).T
        yield pa.RecordBatch.from_arrays([x.keys.take(pa.array(x.starts[a])), y.keys.take(pa.array(y.starts[b]))], names=["a", "b"])


def in_blocks(rows: DataFrame, weights: list[int], least: int, boost: bool, share: int, n: int, links: bool) -> DataFrame:
    """What listed() gives, or joined() with links, for rows (keys, several, asked, carried, p0, p1, ...) with n keys in all.

    Rows are dealt to blocks that have some `share` keys each by a hash, and each two blocks, and each with itself, meet in a group: a task holds two blocks, whatever the sets are.
    """
    k = max(1, -(-n // share))
    parts = [f"p{p}" for p in range(len(weights))]
    columns = ["keys", "several", "asked", "carried", *parts]
    own = F.pmod(F.xxhash64("keys"), F.lit(k)).cast("int")
    met = rows.select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other"))
    met = met.select(*columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        i, j, block = group["i"][0].as_py(), group["j"][0].as_py(), group["own"].to_numpy()
        x = Sets(group.filter(pa.array(block == i)), len(weights))
        y = x if i == j else Sets(group.filter(pa.array(block == j)), len(weights))
        if x.n and y.n and (x.asked.any() or y.asked.any()):
            yield from (joined if links else listed)(x, y, scores(x, y, weights, boost), least)

    key, carried = rows.schema["keys"].dataType.elementType.simpleString(), rows.schema["carried"].dataType.simpleString()
    # By their bytes groups would be put together into a few tasks, but they are long for their bytes.
    dealt = met.repartition(min(k * (k + 1) // 2, TASKS), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(compare, f"a {key}, b {key}" if links else f"a {key}, b {key}, similarity bigint, carried {carried}")


def hashed_parts(columns: list[str]) -> list:
    """Columns p0, p1, ... with the sorted hashes of the distinct members of array columns."""
    return [F.array_sort(F.transform(F.array_distinct(c), lambda v: F.xxhash64(v))).alias(f"p{k}") for k, c in enumerate(columns)]


def packed_sets(sets: DataFrame, columns: list[str], carry: str | None = None) -> DataFrame:
    """Rows as in_blocks() takes them of sets (key, asked, array columns), written: keys of equal sets, both asked or not, are of one row, up to some KEYS of them."""
    parts = [f"p{k}" for k in range(len(columns))]
    hashed = sets.select("key", "asked", (F.col(carry) if carry else F.lit(True)).alias("carried"), *hashed_parts(columns))
    hashed = written(hashed.withColumn("same", F.sha2(F.to_json(F.struct(*parts)), 256)), "hashed-sets")
    sizes = hashed.groupBy("same").agg(F.ceil(F.count("*") / KEYS).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("key"), F.col("k")).alias("part")
    rows = hashed.join(sizes, "same").groupBy("same", "asked", part).agg(F.sort_array(F.collect_set("key")).alias("keys"), *[F.first(c).alias(c) for c in ("carried", *parts)])
    return written(rows.select("keys", (F.size("keys") > 1).alias("several"), "asked", "carried", *parts), "packed-sets")


def class_links(classes: DataFrame, columns: list[str], weights: list[int], least: int, boost: bool, share: int) -> DataFrame:
    """a, b: links that join all classes (class, _size, array columns) that links lead between, far fewer than there are pairs, and a = b for one of several entities that is linked with itself."""
    rows = classes.select(F.array("class").alias("keys"), (F.col("_size") > 1).alias("several"), F.lit(True).alias("asked"), F.lit(True).alias("carried"), *hashed_parts(columns))
    return in_blocks(rows, weights, least, boost, share, classes.count(), True)
