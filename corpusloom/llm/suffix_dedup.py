"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET_HASHES, CHUNK_BYTES, QUESTION, Chunk, answered, in_order, question, rows_of, seen_twice, word_chunks
from .common import mix64, spread, window_hashes, written

RESULT = "doc_id long, start_word long, end_word long, n_words long, partner_id long"
LIVE = "chunk long, n_live long, live binary"


def word_hashes(chunk: Chunk) -> np.ndarray:
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in chunk.vocabulary), np.uint64, len(chunk.vocabulary))
    return own[chunk.index]


def first_minima(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the first least value among each `span` consecutive ones, by windows that double."""
    best, width = np.arange(len(values)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        best, width = np.where(values[right] < values[left], right, left), width + step
    return best


def minimisers(chunk: Chunk, words: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of width + span - 1 words; for each the place of the window of `width` words that has the least hash
    among the `span` inside it; and these windows' hashes."""
    starts = chunk.starts(width + span - 1)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    hashes = window_hashes(words, width)
    order = mix64(hashes ^ np.uint64(0xA5A5A5A5))
    places = first_minima(order, span)[starts]
    return starts, places, hashes[places]


def repeated_passages(docs: DataFrame, min_words: int = 50, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """Passages that documents share with others: doc_id, start_word, end_word, n_words, partner_id.

    One row for each maximal stretch [start_word, end_word) of a document that is covered by passages of min_words words which
    also stand in another document; partner_id is the least one that has the first of them, a null id if no other has.

    A suffix begins at each word, and its head are its first min_words words. The stretches are those of suffixes whose head another
    document's suffix shares. The `width` words with the least hash among the `span` windows of a head, its core, are the same wherever
    the head stands; width + span - 1 = min_words. Cores are compared over the whole table first, one of some ten suffixes
    being new to them, and only suffixes whose core stands in another document too are sorted by their heads' hashes, in parts. All heads
    are compared, not only neighbours, so that how many other documents share a core hides no passage.

    A chunk sends each head once, with the least document that has it, so that a passage in a third of all documents is
    no large group. Heads are told apart by 64-bit hashes; cores by 32 bits within a bucket, where a chance collision only keeps
    a suffix for the sort.

    Cases: null and empty texts and those under min_words words give no row; repeats inside one document alone don't count; rows
    that repeat are documents of their own; null ids stay null; an empty table gives an empty result; other columns are ignored.
    """
    width = (3 * min_words + 4) // 5 + 1
    span = min_words - width + 1
    chunks = word_chunks(docs, limit=chunk_bytes)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_cores = spread(2 * n_words, span + 1)
    core_parts = spread(n_cores, bucket_hashes)

    def ask_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            yield from question(chunk.number, np.unique(minimisers(chunk, word_hashes(chunk), width, span)[2]), core_parts, kind=np.uint32)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which words of a chunk begin suffixes whose core another document has."""
        for row in rows_of(batches):
            chunk = Chunk(row)
            starts, _, keys = minimisers(chunk, word_hashes(chunk), width, span)
            distinct, which = np.unique(keys, return_inverse=True)
            owner = chunk.owner[starts]
            # Starts are in the order of their documents: another document than the first one that has the core.
            first = np.full(len(distinct), len(chunk.doc_ids))
            np.minimum.at(first, which, owner)
            shared = in_order(row["answers"]).astype(bool)
            shared[which[owner != first[which]]] = True
            live = np.zeros(len(chunk.index), bool)
            live[starts] = shared[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.number]), pa.array([int(live.sum())]), pa.array([np.packbits(live).tobytes()], pa.binary())], names=[x.split()[0] for x in LIVE.split(", ")]
            )

    cores = answered(chunks.mapInArrow(ask_cores, QUESTION), core_parts, seen_twice)
    state = written(chunks.join(cores, "chunk").mapInArrow(sieve, LIVE), "suffix-cores")
    n_live = state.agg(F.sum("n_live")).first()[0] or 0
    parts = spread(n_live, bucket_hashes)
    kept = chunks.join(state.where("n_live > 0").select("chunk", "live"), "chunk")

    def ask_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            _, _, distinct, _, least, _ = heads(chunk, row["live"], min_words)
            along = np.stack((~chunk.valid[least], chunk.doc_ids[least]), axis=1).astype(np.int64)
            yield from question(chunk.number, distinct, parts, lambda s, along=along: along[s].reshape(-1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            starts, owner, _, which, least, second = heads(chunk, row["live"], min_words)
            kind, ids = in_order(row["answers"]).reshape(-1, 2)[which].T
            near = np.where(owner == least[which], second[which], least[which])
            inside = near >= 0
            # 0 for an id, 1 for a null id, 2 for no other document: the least of the chunk's own and the other chunks'.
            near_kind, near_id = np.where(inside, (~chunk.valid[near]).astype(np.int64), 2), np.where(inside, chunk.doc_ids[near], 0)
            nearer = (near_kind < kind) | ((near_kind == kind) & (near_id < ids))
            kind, ids = np.where(nearer, near_kind, kind), np.where(nearer, near_id, ids)
            found = kind < 2
            starts, owner, kind, ids = starts[found], owner[found], kind[found], ids[found]
            new = np.ones(len(starts), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] > starts[:-1] + min_words)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(starts))[: len(first)] - 1
            base = chunk.bounds[owner[first]]
            begin, end = starts[first] - base, starts[last] + min_words - base
            columns = [pa.array(begin), pa.array(end), pa.array(end - begin), pa.array(ids[first], mask=kind[first] == 1)]
            yield pa.RecordBatch.from_arrays([chunk.ids().take(pa.array(owner[first])), *columns], names=[x.split()[0] for x in RESULT.split(", ")])

    said = answered(kept.mapInArrow(ask_heads, QUESTION), parts, least_other)
    return kept.join(said, "chunk").mapInArrow(finish, RESULT)


def heads(chunk: Chunk, live: bytes, width: int) -> tuple[np.ndarray, ...]:
    """Of the suffixes kept: starts and documents; the distinct hashes of their first words and each one's place among
    these; and for each hash the least document of the chunk that has it, and the second or -1. Null ids come last."""
    starts = np.flatnonzero(np.unpackbits(np.frombuffer(live, np.uint8), count=len(chunk.index)))
    hashes, owner = window_hashes(word_hashes(chunk), width)[starts], chunk.owner[starts]
    by_id = np.lexsort((chunk.doc_ids, ~chunk.valid))
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    distinct, which = np.unique(hashes, return_inverse=True)
    least = np.full(len(distinct), len(by_id))
    np.minimum.at(least, which, rank[owner])
    other = rank[owner] != least[which]
    second = np.full(len(distinct), len(by_id))
    np.minimum.at(second, which[other], rank[owner[other]])
    return starts, owner, distinct, which, by_id[least], np.append(by_id, -1)[second]


def least_other(asked: list[np.ndarray], along: list[np.ndarray], chunks: np.ndarray) -> list[np.ndarray]:
    """For each hash a chunk asks, the least document of the other chunks that ask it: 0 and its id, 1 and 0 for a null id, 2 and 0 for none."""
    hashes, (null, ids) = np.concatenate(asked), np.concatenate(along).reshape(-1, 2).T
    order = np.lexsort((np.where(null == 1, 0, ids), null, hashes))
    ordered = hashes[order]
    # Each chunk asks a hash once: the others' least is the group's first, and for that itself the one after it.
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    at = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    at[first] += 1
    alone = np.append(first, True)[at] & first
    best = order[np.minimum(at, len(order) - 1)]
    out = np.empty((len(order), 2), np.int64)
    out[order, 0] = np.where(alone, 2, null[best])
    out[order, 1] = np.where(alone | (null[best] == 1), 0, ids[best])
    return [x.reshape(-1) for x in np.split(out, np.cumsum([len(x) for x in asked])[:-1])]


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
