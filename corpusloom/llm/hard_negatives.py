"""Hard negatives by exact integer scores, of which several come out of one multiplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import packed, rows_of, unpacked
from .common import spread, written

#: Rows of a block of candidates, anchors of a tile, anchors scored at once, and blocks that meet a tile in one task, about.
BLOCK_ROWS, TILE_ANCHORS, AT_ONCE, STRIPE_BLOCKS = 8192, 1024, 128, 16
#: A double holds integers of so many bits.
WORD_BITS = 53
#: Fields of a wide integer where one score alone needs more bits than a double has.
WIDE_FIELDS = 8
MATRIX = "n int, rows binary, ids binary, valid binary, labels binary, kind string, width int, vectors binary"
BLOCK = f"block long, stripe int, {MATRIX}"
TILE = f"tile long, {MATRIX}, limits binary, positives binary, positives_valid binary"
FOUND = "anchor_row long, anchor_id long, nth int, positive_id long, positive_score long, other_row long, other_id long, score long"


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component, a row for each vector; shorter ones end in zeros. Exact, as doubles."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False))
    return out


def stored(matrix: np.ndarray) -> tuple[str, bytes]:
    top = np.abs(matrix).max(initial=0)
    kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "f8"
    return kind, packed(matrix.astype(kind).view(f"u{np.dtype(kind).itemsize}").reshape(-1))


class Matrix:
    """Vectors with what is known of them, from a row with the columns of MATRIX."""

    def __init__(self, row: dict):
        self.rows, self.ids, self.labels = (unpacked(row[c]) for c in ("rows", "ids", "labels"))
        self.valid = unpacked(row["valid"]).astype(bool)
        self.vectors = unpacked(row["vectors"]).view(row["kind"]).reshape(row["n"], row["width"]).astype(np.float64)


def matrix_columns(batch: pa.RecordBatch) -> list[pa.Array]:
    """MATRIX for rows (row, vec_id, label, embedding): by label, then id, null ids last, so that a place is an order among equal scores."""
    ids, labels, rows = batch["vec_id"], batch["label"].to_numpy(), batch["row"].to_numpy()
    valid, known = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    order = np.lexsort((rows, known, ~valid, labels))
    matrix = quantised(batch["embedding"])[order]
    kind, data = stored(matrix)
    values = [len(order), packed(rows[order]), packed(known[order]), packed(valid[order].view(np.uint8)), packed(labels[order].astype(np.int64)), kind, matrix.shape[1], data]
    kinds = [pa.int32(), *[pa.binary()] * 4, pa.string(), pa.int32(), pa.binary()]
    return [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]


def exact_scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of two integer matrices, a row for each anchor.

    Both sides are made non-negative by a bias, so that a product needs a known number of bits. Several candidates' components then stand in
    separated fields of one integer, which each anchor component multiplies once; a field's sum is one candidate's score with the
    biases' share, which is known. Words of up to 53 bits travel as doubles, all of whose sums stay exact; wider ones as Python's integers.
    """
    width = max(anchors.shape[1], candidates.shape[1], 1)
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (anchors, candidates))
    low_a, low_c = (int(-min(0.0, x.min(initial=0))) for x in (a, c))
    bits = max(1, (width * (int(a.max(initial=0)) + low_a) * (int(c.max(initial=0)) + low_c)).bit_length())
    kind = np.float64 if bits <= WORD_BITS else object
    fields = WORD_BITS // bits if kind is np.float64 else WIDE_FIELDS
    if kind is object:
        a, c = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, c))
    words = -(-len(c) // fields)
    biased = np.concatenate((c + low_c, np.zeros((words * fields - len(c), width), kind))).reshape(fields, words, width)
    word = biased[0].astype(kind)
    for f in range(1, fields):
        word = word + biased[f] * kind(1 << bits * f) if kind is np.float64 else word + biased[f] * (1 << bits * f)
    products = (a + low_a) @ word.T
    if kind is np.float64:
        products, whole = products.astype(np.int64), np.int64
    else:
        whole = object
    out = np.concatenate([(products >> bits * f) & ((1 << bits) - 1) for f in range(fields)], axis=1)[:, : len(c)]
    return out - (low_c * a.sum(axis=1).astype(whole))[:, None] - (low_a * c.sum(axis=1).astype(whole))[None, :] - width * low_a * low_c


def as_long(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as 64-bit integers, and which of them these can hold."""
    if scores.dtype != object:
        return scores, np.ones(scores.shape, bool)
    fits = np.array([-(1 << 63) < v < 1 << 63 for v in scores.reshape(-1)], bool).reshape(scores.shape)
    return np.where(fits, scores, 0).astype(np.int64), fits


class Best:
    """The first k candidates of each slot, by score downwards, then id (null last), then row."""

    def __init__(self, k: int):
        self.k, self.kept = k, np.empty((5, 0), np.int64)

    def add(self, slots: np.ndarray, scores: np.ndarray, block: Matrix, at: np.ndarray) -> None:
        new = np.stack([slots, scores, ~block.valid[at], block.ids[at], block.rows[at]]).astype(np.int64)
        both = np.concatenate((self.kept, new), axis=1)
        both = both[:, np.lexsort((both[4], both[3], both[2], ~both[1], both[0]))]
        first = np.concatenate(([True], both[0][1:] != both[0][:-1]))
        place = np.arange(both.shape[1]) - np.maximum.accumulate(np.where(first, np.arange(both.shape[1]), 0))
        self.kept = both[:, place < self.k]


def positives_in(tile: Matrix, block: Matrix, best: Best) -> None:
    """Each anchor's best other rows of its own label in a block."""
    for label in np.unique(tile.labels):
        own = np.flatnonzero(tile.labels == label)
        same = slice(*np.searchsorted(block.labels, [label, label + 1]))
        for part in np.split(own, range(AT_ONCE, len(own), AT_ONCE)):
            scores, fits = as_long(exact_scores(tile.vectors[part], block.vectors[same]))
            fits &= tile.rows[part][:, None] != block.rows[same][None, :]
            order = np.argsort(np.where(fits, ~scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, : best.k]
            ok = np.take_along_axis(fits, order, 1)
            best.add(np.repeat(part, ok.sum(axis=1)), np.take_along_axis(scores, order, 1)[ok], block, order[ok] + same.start)


def negatives_in(tile: Matrix, limits: np.ndarray, block: Matrix, best: Best) -> None:
    """For each anchor and positive (limits: lowest and highest score, lowest above highest where there is none), the best rows of other labels."""
    n_slots = limits.shape[1]
    low = np.where(limits[:, :, 0] <= limits[:, :, 1], limits[:, :, 0], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
    high = np.where(limits[:, :, 0] <= limits[:, :, 1], limits[:, :, 1], np.iinfo(np.int64).min).max(axis=1, initial=np.iinfo(np.int64).min)
    for part in np.split(np.arange(len(low)), range(AT_ONCE, len(low), AT_ONCE)):
        scores, fits = as_long(exact_scores(tile.vectors[part], block.vectors))
        fits &= (scores >= low[part][:, None]) & (scores <= high[part][:, None]) & (tile.labels[part][:, None] != block.labels[None, :])
        at, candidate = np.nonzero(fits)
        score, anchor = scores[at, candidate], part[at]
        for k in range(n_slots):
            inside = (score >= limits[anchor, k, 0]) & (score <= limits[anchor, k, 1])
            best.add(anchor[inside] * n_slots + k, score[inside], block, candidate[inside])


def blocks_of(rows: DataFrame, stripes: int) -> DataFrame:
    """BLOCK rows of rows (row, vec_id, label, embedding)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                number += 1
                columns = [pa.array([number]), pa.array([(number + (number >> 32)) % stripes], pa.int32()), *matrix_columns(batch.slice(i, BLOCK_ROWS))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCK.split(", ")])

    return rows.mapInArrow(pack, BLOCK)


def tiles_of(anchors: DataFrame, tiles: int, per_anchor: int) -> DataFrame:
    """TILE rows of anchors (row, vec_id, label, embedding, positives: array<struct<positive_id, score>>)."""

    def pack(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        columns = matrix_columns(batch)
        at = {r: i for i, r in enumerate(batch["row"].to_pylist())}
        ids, valid, limits = np.zeros((batch.num_rows, per_anchor), np.int64), np.zeros((batch.num_rows, per_anchor), np.uint8), np.zeros((batch.num_rows, per_anchor, 2), np.int64)
        given = batch["positives"].to_pylist()
        limits[:, :, 1] = -1
        scores = np.zeros((batch.num_rows, per_anchor), np.int64)
        for i, row in enumerate(unpacked(columns[1][0].as_py())):
            for k, p in enumerate(given[at[row]] or []):
                s = p["score"]
                ids[i, k], valid[i, k], scores[i, k] = p["positive_id"] or 0, p["positive_id"] is not None, s
                limits[i, k] = -(-s // 2), 95 * s // 100
        tail = [np.concatenate((limits, scores[:, :, None]), axis=2).reshape(-1), ids.reshape(-1), valid.reshape(-1)]
        columns = [pa.array([batch["tile"][0].as_py()], pa.int64()), *columns, *(pa.array([packed(x)], pa.binary()) for x in tail)]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in TILE.split(", ")])

    return anchors.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles))).groupBy("tile").applyInArrow(pack, TILE)


def searched(tiles: DataFrame, blocks: DataFrame, stripes: int, per_anchor: int, k: int, negatives: bool) -> DataFrame:
    """FOUND rows: the best of each task's blocks for each anchor (and positive), a few for each stripe.

    A tile meets every block: it is sent to each stripe of blocks. Blocks that follow each other with the same tile are merged before they leave the task.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tile, best, limits, row = None, None, None, None, None

        def result() -> pa.RecordBatch:
            slots, score, null, ids, rows = best.kept
            anchor, nth = (slots // per_anchor, slots % per_anchor) if negatives else (slots, np.zeros(len(slots), np.int64))
            positive = unpacked(row["positives"]).reshape(-1, per_anchor)[anchor, nth]
            known = unpacked(row["positives_valid"]).reshape(-1, per_anchor)[anchor, nth].astype(bool)
            columns = [
                pa.array(tile.rows[anchor]), pa.array(tile.ids[anchor], mask=~tile.valid[anchor]), pa.array(nth.astype(np.int32)), pa.array(positive, mask=~known),
                pa.array(limits[anchor, nth, 2]), pa.array(rows), pa.array(ids, mask=null.astype(bool)), pa.array(score),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

        for new in rows_of(batches):
            if new["tile"] != number:
                if best is not None:
                    yield result()
                row, number, best = new, new["tile"], Best(k)
                tile, limits = Matrix(row), unpacked(row["limits"]).reshape(row["n"], per_anchor, 3)
            block = Matrix({c.removeprefix("b_"): v for c, v in new.items() if c.startswith("b_")})
            if negatives:
                negatives_in(tile, limits[:, :, :2], block, best)
            else:
                positives_in(tile, block, best)
        if best is not None:
            yield result()

    everywhere = tiles.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    renamed = blocks.select("stripe", *[F.col(c.split()[0]).alias(f"b_{c.split()[0]}") for c in MATRIX.split(", ")])
    return everywhere.join(renamed, "stripe").mapInArrow(search, FOUND)


def first_of(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of each group over all tasks, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, embedding).

    A score is the inner product of floor(256 * x) components. An anchor's positives are its best other rows of the same label; each
    takes the best `negatives` rows of other labels that score between 50% and 95% of it. Higher scores come first, ties by the lesser id.

    The anchors are the stated query set: tiles of them meet all rows in blocks, once for the positives (same labels only) and once for the
    negatives. Only the best few of each anchor leave a task, and these are merged by anchor, so that a label
    with a third of all rows is no group anywhere.

    Cases: rows with a null label, a null vector or a null or non-finite component (also once multiplied by 256) take no part; shorter vectors
    end in zeros, an empty one scores 0 with all; a null id comes last among equal scores; rows that repeat are rows of their own; pairs whose score 64 bits can't hold
    take no part; an anchor without positives or fitting negatives gives no row; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x * 256) < F.lit(float("inf"))))
    wanted = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("anchor")
    ).where("label is not null and embedding is not null")
    rows = written(wanted.where(finite).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    n_blocks = spread(n_rows, BLOCK_ROWS)
    stripes = max(spread(n_blocks, STRIPE_BLOCKS), min(n_blocks, spark.sparkContext.defaultParallelism))
    blocks = written(blocks_of(rows.drop("anchor"), stripes), "vector-blocks")
    anchors, tiles = rows.where("anchor").drop("anchor"), spread(n_anchors, TILE_ANCHORS)
    none = F.lit(None).cast("array<struct<positive_id: bigint, score: bigint>>")
    seeking = written(tiles_of(anchors.withColumn("positives", none), tiles, positives), "anchor-tiles")
    best = first_of(searched(seeking, blocks, stripes, positives, positives, negatives=False), positives, "anchor_row")
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.col("other_id").alias("positive_id"), "score")))
    grouped = best.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(by_rank, lambda p: F.struct(p.positive_id.alias("positive_id"), p.score.alias("score"))).alias("positives"))
    paired = written(tiles_of(anchors.join(grouped, "row"), tiles, positives), "anchor-tiles")
    found = first_of(searched(paired, blocks, stripes, positives, negatives, negatives=True), negatives, "anchor_row", "nth")
    return found.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    anchor = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), anchor)


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a, usable b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth
    FROM scored WHERE anchor_label = other_label) WHERE nth <= 5
), found AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS place
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
  WHERE s.anchor_label <> s.other_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE place <= 3
"""
