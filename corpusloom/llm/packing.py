"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices, written
from .tokens import SLICE, coder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
#: Pieces that are packed together; a group leaves at most one bin or so less full than it could.
GROUP_PIECES = 8_192


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int) -> DataFrame:
    """PIECES of every whole text: its ids with end_id, cut every `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for part in text_slices(batches, limit=SLICE):
            ids = coder(tokenizer_path).encode(part["text"])
            rows = []
            for doc_id, a, b in zip(part["doc_id"].to_pylist(), ids.bounds, ids.bounds[1:], strict=False):
                own = np.concatenate((ids.values[a:b], tail)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    piece = own[start : start + capacity]
                    rows.append((doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class Bins:
    """Items in bins, with what the local search asks about them."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.bin_of = self.best_fit()
        self.fill = np.bincount(self.bin_of, weights=self.lengths).astype(np.int64)
        self.items = [[] for _ in self.fill]
        for i, b in enumerate(self.bin_of):
            self.items[b].append(i)

    def best_fit(self) -> np.ndarray:
        """Longest first, each into the fullest bin that has room."""
        out, room, rooms, n = np.empty(len(self.lengths), np.int64), [[] for _ in range(self.capacity + 1)], 0, 0
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            size = int(self.lengths[i])
            fitting = rooms >> size
            if fitting:
                r = size + (fitting & -fitting).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    rooms ^= 1 << r
                r -= size
            else:
                b, r, n = n, self.capacity - size, n + 1
            out[i] = b
            room[r].append(b)
            rooms |= 1 << r
        return out

    def move(self, item: int, to: int) -> None:
        frm = int(self.bin_of[item])
        self.items[frm].remove(item)
        self.items[to].append(item)
        self.bin_of[item] = to
        self.fill[frm] -= self.lengths[item]
        self.fill[to] += self.lengths[item]

    def step(self, low: int) -> bool:
        """One exchange that takes most words from bin `low` into a fuller bin, or False when none does.

        Moving an item, giving one for a shorter one, or two for a shorter one, each make the fuller bin fuller by what
        `low` loses, so that the sum of squared fills grows with every step.
        """
        others = self.fill >= self.fill[low]
        others[low] = False
        space = np.where(others, self.capacity - self.fill, -1)
        own = sorted(self.items[low], key=lambda i: -self.lengths[i])
        for i in own:
            at = np.where(space >= self.lengths[i], space, self.capacity + 1)
            if len(at) and at[b := int(at.argmin())] <= self.capacity:
                self.move(i, b)
                return True
        gain, best = 0, None
        give = [(i,) for i in own] + [(i, j) for k, i in enumerate(own) for j in own[k + 1 :]]
        item_space = space[self.bin_of]
        for group in give:
            more = sum(int(self.lengths[i]) for i in group) - self.lengths
            more = np.where((more <= item_space) & (more > 0), more, 0)
            if (g := int(more.max(initial=0))) > gain:
                gain, best = g, (group, int(more.argmax()))
        if best is None:
            return False
        group, back = best
        to = int(self.bin_of[back])
        self.move(back, low)
        for i in group:
            self.move(i, to)
        return True

    def search(self) -> None:
        """Empty bins, least full first, until their number is the least possible or a round empties none."""
        least = -(-int(self.lengths.sum()) // self.capacity)
        emptied = True
        while emptied and (self.fill > 0).sum() > least:
            emptied = False
            for low in np.argsort(self.fill, kind="stable").tolist():
                if not 0 < self.fill[low] < self.capacity:
                    continue
                if (self.fill > 0).sum() <= least:
                    break
                while self.fill[low] and self.step(low):
                    pass
                emptied |= not self.fill[low]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Each item's bin, numbered from 0 without gaps, and its offset there."""
        number = np.cumsum(self.fill > 0) - 1
        offset = np.zeros(len(self.lengths), np.int64)
        for own in self.items:
            at = 0
            for i in sorted(own):
                offset[i] = at
                at += int(self.lengths[i])
        return number[self.bin_of], offset


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts longer than capacity are cut into full pieces, which are sequences of their own, and a rest. Rests and
    shorter texts are dealt to groups by a hash of their row, and each group is packed: best fit, then a local search.

    Cases: null and empty texts are one piece with the end id alone (no piece without an end id); rows that repeat are
    packed each; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    pieces = written(pieces_of(docs, tokenizer_path, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = spread(rest.count(), GROUP_PIECES)
    rest = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        bins = Bins(rows["length"].to_numpy(), capacity)
        bins.search()
        number, offset = bins.places()
        group = rows["group"][0].as_py() << 32
        return rows.select(names).append_column("sequence_id", pa.array(group + number)).append_column("offset", pa.array(offset))

    packed = rest.groupBy("group").applyInArrow(pack_group, f"{PIECES}, sequence_id long, offset long")
    return full.unionByName(packed)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)
