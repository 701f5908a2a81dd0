"""Distinct shingle sets of texts, and which of them can be alike at all, by packed counts of elements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET_HASHES, CHUNK_BYTES, QUESTION, Chunk, answered, packed, question, rows_of, unpacked, word_chunks
from ..functions.words import spread, window_hashes
from ..sources.storage import discarded, written

SET_CHUNK = "chunk long, doc_ids binary, valid binary, n_shingles binary, set_ids binary, own_ids binary, own_sizes binary, elements binary"


class Sets:
    """The distinct shingle sets of a chunk: values[bounds[s]:bounds[s + 1]] is set s, sorted. Texts with fewer words have
    the whole sequence as one shingle, or none without `short`."""

    def __init__(self, chunk: Chunk, width: int, short: bool = True):
        n = np.diff(chunk.bounds)
        vocabulary = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in chunk.vocabulary), np.uint64, len(chunk.vocabulary))
        words = vocabulary[chunk.index]
        starts = chunk.starts(width)
        hashes = window_hashes(words, width)[starts] if len(starts) else np.empty(0, np.uint64)
        owners = chunk.owner[starts]
        few = np.flatnonzero((n > 0) & (n < width) & short)
        whole = np.array([xxhash.xxh3_64_intdigest(words[chunk.bounds[d] : chunk.bounds[d + 1]].tobytes(), 5) for d in few], np.uint64)
        hashes, owners = np.concatenate((hashes, whole)), np.concatenate((owners, few))
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[first], owners[first]
        self.n_shingles = np.bincount(owners, minlength=len(n))
        bounds = np.concatenate(([0], np.cumsum(self.n_shingles)))
        # A set is known by a hash of its sorted content.
        self.ids = np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64).view(np.int64)
        _, at = np.unique(np.where(self.n_shingles > 0, self.ids, 0), return_index=True)
        self.documents = np.sort(at[self.n_shingles[at] > 0])  # the first document of each set
        sizes = self.n_shingles[self.documents]
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))
        self.values = hashes[np.arange(self.bounds[-1]) + np.repeat(bounds[self.documents] - self.bounds[:-1], sizes)]
        self.sizes = sizes


def cells(hashes: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and one of 2^24 cells in it of sorted hashes, sorted too."""
    place = (hashes >> np.uint64(32)) * np.uint64(n_buckets)
    return (place >> np.uint64(32)).astype(np.int64), ((place & np.uint64(0xFFFFFFFF)) >> np.uint64(8)).astype(np.int64)


def shared_cells(asked: list[np.ndarray], along: list[np.ndarray]) -> list[np.ndarray]:
    """For each cell that chunks ask about, whether two sets or more have elements in it."""
    keys = [np.cumsum(x.astype(np.int64)) for x in asked]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    several = np.bincount(which, weights=np.concatenate(along))[which] > 1
    return [np.packbits(x) for x in np.split(several, np.cumsum([len(x) for x in keys])[:-1])]


def first_chunks(asked: list[np.ndarray], chunks: np.ndarray) -> list[np.ndarray]:
    """For each set that chunks ask about, whether a chunk is the first one that has it."""
    _, which = np.unique(np.concatenate(asked), return_inverse=True)
    sizes = [len(x) for x in asked]
    who = np.repeat(chunks, sizes)
    least = np.full(int(which.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, which, who)
    return np.split((who == least[which]).astype(np.uint8), np.cumsum(sizes)[:-1])


def cells_or_sets(asked: list[np.ndarray], along: list[np.ndarray], chunks: np.ndarray) -> list[np.ndarray]:
    """A bucket holds cells, as steps of 32 bits, or whole hashes of sets."""
    return first_chunks(asked, chunks) if asked[0].dtype == np.uint64 else shared_cells(asked, along)


def own_cells(sets: Sets, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, cell and number of elements of each cell that the sets touch, and the cell of each element of sets.values."""
    distinct, which = np.unique(sets.values, return_inverse=True)
    bucket, cell = cells(distinct, n_buckets)
    new = np.ones(len(distinct), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])
    number = np.cumsum(new) - 1
    return bucket[new], cell[new], np.bincount(number[which], minlength=int(new.sum())), number[which]


def set_documents(described: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id of each document, from the chunks that describe() makes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            n = unpacked(row["n_shingles"])
            columns = [pa.array(unpacked(row["doc_ids"]), mask=~unpacked(row["valid"]).astype(bool)), pa.array(n), pa.array(unpacked(row["set_ids"]), mask=n == 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_id"])

    return described.select("doc_ids", "valid", "n_shingles", "set_ids").mapInArrow(rows, "doc_id long, n_shingles long, set_id long")


def described_sets(docs: DataFrame, width: int, percent: int, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES, lower: bool = True, short: bool = True) -> tuple[DataFrame, int]:
    """SET_CHUNK rows of docs (doc_id, text), written, and the number of buckets for hashes of their words.

    They have each document's set, and the elements of sets that can link, each kept by the first chunk that has it: only if percent of its elements are in
    other sets too can a set be so much alike with one, and a count of elements by hash cells (never too low) rules that out for the rest.
    """
    chunks = word_chunks(docs, lower=lower, limit=chunk_bytes)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = spread(n_words, bucket_hashes)

    def ask_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            sets = Sets(Chunk(row), width, short)
            bucket, cell, n, _ = own_cells(sets, n_buckets)
            present, starts = np.unique(bucket, return_index=True)
            pieces = [slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=False)]
            if pieces:
                steps = [packed(np.diff(cell[p], prepend=0).astype(np.uint32)) for p in pieces]
                counts = [packed(np.minimum(n[p], 2).astype(np.uint8)) for p in pieces]
                columns = [pa.array(present), pa.array([row["chunk"]] * len(pieces), pa.int64()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "asked", "with_it"])
            for batch in question(row["chunk"], np.sort(sets.ids[sets.documents].view(np.uint64)), n_buckets):
                yield batch.set_column(0, "bucket", pc.add(batch["bucket"], n_buckets))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            sets = Sets(chunk, width, short)
            bucket, _, _, number = own_cells(sets, n_buckets)
            bits = {x["bucket"]: unpacked(x["said"]) for x in row["answers"] or []}
            present, counts = np.unique(bucket, return_counts=True)
            several = np.concatenate([np.unpackbits(bits[b], count=c) for b, c in zip(present.tolist(), counts.tolist(), strict=True)] or [np.empty(0, np.uint8)])
            owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
            common = np.bincount(owner, weights=several[number], minlength=len(sets.sizes))
            first = np.concatenate([bits[b] for b in sorted(bits) if b >= n_buckets] or [np.empty(0, np.uint8)]).astype(bool)
            own = np.empty(len(sets.sizes), bool)
            own[np.argsort(sets.ids[sets.documents].view(np.uint64))] = first
            own &= 100 * common >= percent * sets.sizes
            columns = [
                row["chunk"],
                row["doc_ids"],
                row["valid"],
                packed(sets.n_shingles.astype(np.int64)),
                packed(sets.ids),
                packed(sets.ids[sets.documents][own]),
                packed(sets.sizes[own].astype(np.uint32)),
                sets.values[np.repeat(own, sets.sizes)].tobytes(),
            ]
            kinds = [pa.int64()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SET_CHUNK.split(", ")])

    asked = answered(chunks.mapInArrow(ask_cells, QUESTION), 2 * n_buckets, cells_or_sets)
    described = written(chunks.join(asked, "chunk", "left").mapInArrow(describe, SET_CHUNK), "shingle-sets")
    discarded(chunks)
    return described, n_buckets


def able_sets(described: DataFrame) -> DataFrame:
    """set_id, s (its elements), for each set that can link, once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, ends = unpacked(row["own_ids"]), np.cumsum(unpacked(row["own_sizes"]).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.frombuffer(row["elements"], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["set_id", "s"])

    return described.select("own_ids", "own_sizes", "elements").where("length(elements) > 0").mapInArrow(rows, "set_id long, s array<long>")
