"""Substring dedup by level-wise doubling of repeated windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET_HASHES, CHUNK, CHUNK_BYTES, QUESTION, Chunk, answered, in_order, packed, question, rows_of, seen_twice, word_chunks
from .common import discarded, spread, window_hashes, written

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
STATE = f"{CHUNK}, live binary"


def word_hashes(chunk: Chunk) -> np.ndarray:
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in chunk.vocabulary), np.uint64, len(chunk.vocabulary))
    return own[chunk.index]


def widths_of(window: int, first: int) -> list[int]:
    """The lengths from window down by halves to about first, shortest first. Each is at most twice the one before."""
    out = [window]
    while out[0] > first and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def windows_at(chunk: Chunk, live: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the live windows of a width: where they start, their distinct hashes, each one's place among these, and how many have it."""
    starts = np.flatnonzero(live)
    hashes = window_hashes(word_hashes(chunk), width)[starts] if len(starts) else np.empty(0, np.uint64)
    distinct, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return starts, distinct, which, counts


def starts_mask(chunk: Chunk, width: int) -> np.ndarray:
    mask = np.zeros(len(chunk.index), bool)
    mask[chunk.starts(width)] = True
    return mask


def doubled(chunk: Chunk, repeated: np.ndarray, width: int, longer: int) -> np.ndarray:
    """Windows of the longer width whose first and last `width` words are repeated windows both."""
    step = longer - width
    both = repeated.copy()
    last = max(len(both) - step, 0)  # a chunk may have fewer words than the step
    both[:last] &= repeated[step:]
    both[last:] = False
    return both & starts_mask(chunk, longer)


def live_of(row: dict, chunk: Chunk, width: int) -> np.ndarray:
    if row.get("live") is None:
        return starts_mask(chunk, width)
    return np.unpackbits(np.frombuffer(row["live"], np.uint8), count=len(chunk.index)).astype(bool)


def results(chunk: Chunk, which: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    """RESULT rows of the chunk's documents `which`."""
    shas, spans = [], []
    for d in which:
        a, b = chunk.bounds[d], chunk.bounds[d + 1]
        gone = removed[a:b]
        shas.append(hashlib.sha256(b" ".join([chunk.vocabulary[i] for i in chunk.index[a:b][~gone].tolist()])).hexdigest())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
    n = np.diff(chunk.bounds)[which]
    gone = np.bincount(chunk.owner[removed], minlength=len(chunk.doc_ids))[which]
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [chunk.ids().take(pa.array(which)), pa.array(n.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array(shas, pa.string()), pa.array(spans, kinds)],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
    )


def subset(chunk: Chunk, row: dict, docs: np.ndarray, live: np.ndarray) -> dict:
    """The chunk with these documents alone, as a STATE row."""
    inside = np.isin(chunk.owner, docs)
    used, index = np.unique(chunk.index[inside], return_inverse=True)
    return {
        "chunk": row["chunk"],
        "n_words": int(inside.sum()),
        "doc_ids": packed(chunk.doc_ids[docs]),
        "valid": packed(chunk.valid[docs].view(np.uint8)),
        "bounds": packed(np.concatenate(([0], np.cumsum(np.diff(chunk.bounds)[docs]))).astype(np.int64)),
        "index": packed(index.astype(np.uint32)),
        "vocabulary": zstandard.compress(b" ".join([chunk.vocabulary[i] for i in used.tolist()]), 1),
        "live": np.packbits(live[inside]).tobytes(),
    }


def state_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 2 + [pa.binary()] * 6
    names = [x.split()[0] for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def substring_dedup(docs: DataFrame, window: int = 20, first: int = 5, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (removed words, [start, end)).

    A word is removed when a window of `window` words covers it whose words also start earlier: in a smaller doc_id,
    or earlier in the same document. Windows are judged on the texts as they are given.

    Lengths double from about `first` to `window`. At each length only windows live so far are hashed and asked about;
    those repeated anywhere stay, and a window of twice the length is live when both its halves stayed. Documents without a live
    window leave with their result at once; the levels end early when none is left. At the last length the earliest window of each hash
    stays and covers nothing. The short levels compare 32 bits within a bucket, where a chance
    collision only keeps a window live a level longer; the last compares 64 bits.

    Cases: null and empty texts have no words (kept_sha256 is that of no bytes); null ids count as the smallest; rows
    that repeat one id are told apart by their place in the input; an empty table gives an empty result; other columns are ignored.
    """
    chunks = word_chunks(docs, limit=chunk_bytes)
    widths = widths_of(window, first)
    state = chunks_live = chunks.withColumn("live", F.lit(None).cast("binary"))
    done: list[DataFrame] = []
    for width, longer in zip(widths, widths[1:], strict=False):
        n_words = state.agg(F.sum("n_words")).first()[0] or 0
        n_buckets = spread(n_words, bucket_hashes)

        def ask(batches: Iterator[pa.RecordBatch], width=width, n_buckets=n_buckets) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                chunk = Chunk(row)
                distinct = windows_at(chunk, live_of(row, chunk, width), width)[1]
                yield from question(chunk.number, distinct, n_buckets, kind=np.uint32)

        def extend(batches: Iterator[pa.RecordBatch], width=width, longer=longer) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                chunk = Chunk(row)
                starts, _, which, counts = windows_at(chunk, live_of(row, chunk, width), width)
                twice = in_order(row["answers"]).astype(bool) | (counts > 1)
                repeated = np.zeros(len(chunk.index), bool)
                repeated[starts] = twice[which] if len(starts) else False
                live = doubled(chunk, repeated, width, longer)
                alive = np.unique(chunk.owner[live])
                yield state_and_results(chunk, row, alive, live)

        asked = state.mapInArrow(ask, QUESTION)
        both = state.join(answered(asked, n_buckets, seen_twice), "chunk", "left")
        split = written(both.mapInArrow(extend, f"{STATE}, result array<struct<{', '.join(x.replace(' ', ':', 1) for x in RESULT.split(', '))}>>"), f"windows-{longer}")
        if state is chunks_live:
            discarded(chunks)  # all that later levels need of it is in the new state
        done.append(split.select(F.inline("result")))
        state = split.drop("result").where("doc_ids is not null")

    n_words = state.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = spread(n_words, bucket_hashes)

    def ask_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            starts, distinct, _, _ = windows_at(chunk, live_of(row, chunk, window), window)
            earliest = earliest_of(chunk, starts, window)
            at = starts[earliest]
            d = chunk.owner[at]
            keys = np.where(chunk.valid[d], chunk.doc_ids[d], np.iinfo(np.int64).min), at - chunk.bounds[d]
            along = np.stack(keys, axis=1)
            yield from question(chunk.number, distinct, n_buckets, lambda s, along=along: along[s].reshape(-1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            chunk = Chunk(row)
            starts, _, which, _ = windows_at(chunk, live_of(row, chunk, window), window)
            removed = np.zeros(len(chunk.index), bool)
            if len(starts):
                later = np.ones(len(starts), bool)
                mine = in_order(row["answers"]).astype(bool)
                later[earliest_of(chunk, starts, window)[mine]] = False
                edges = np.zeros(len(chunk.index) + 1, np.int64)
                np.add.at(edges, starts[later], 1)
                np.add.at(edges, starts[later] + window, -1)
                removed = np.cumsum(edges)[:-1] > 0
            yield results(chunk, np.arange(len(chunk.doc_ids)), removed)

    last = state.join(answered(state.mapInArrow(ask_last, QUESTION), n_buckets, is_earliest), "chunk", "left")
    out = last.mapInArrow(finish, RESULT)
    for df in done:
        out = out.unionByName(df)
    return out


def earliest_of(chunk: Chunk, starts: np.ndarray, width: int) -> np.ndarray:
    """For each distinct window, in the order of its hash: which of starts is earliest by doc_id, place, and row."""
    hashes = window_hashes(word_hashes(chunk), width)[starts] if len(starts) else np.empty(0, np.uint64)
    d = chunk.owner[starts]
    ids = np.where(chunk.valid[d], chunk.doc_ids[d], np.iinfo(np.int64).min)
    order = np.lexsort((starts, starts - chunk.bounds[d], ids, hashes))
    sorted_hashes = hashes[order]
    heads = np.flatnonzero(np.concatenate(([True], sorted_hashes[1:] != sorted_hashes[:-1]))) if len(order) else np.empty(0, np.int64)
    return order[heads]


def is_earliest(asked: list[np.ndarray], along: list[np.ndarray], chunks: np.ndarray) -> list[np.ndarray]:
    """For each hash a chunk asks, whether its own earliest window is the earliest of all."""
    hashes, keys = np.concatenate(asked), np.concatenate(along).reshape(-1, 2)
    who = np.repeat(chunks, [len(x) for x in asked])
    order = np.lexsort((who, keys[:, 1], keys[:, 0], hashes))
    ordered = hashes[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    out = np.zeros(len(hashes), np.uint8)
    out[order[first]] = 1
    return np.split(out, np.cumsum([len(x) for x in asked])[:-1])


def state_and_results(chunk: Chunk, row: dict, alive: np.ndarray, live: np.ndarray) -> pa.RecordBatch:
    """One row: the chunk with its live documents (null where none is), and the results of the others."""
    others = np.setdiff1d(np.arange(len(chunk.doc_ids)), alive)
    ready = results(chunk, others, np.zeros(len(chunk.index), bool))
    kept = subset(chunk, row, alive, live) if len(alive) else dict.fromkeys([x.split()[0] for x in STATE.split(", ")]) | {"chunk": row["chunk"], "n_words": 0}
    batch = state_batch([kept])
    column = pa.ListArray.from_arrays(pa.array([0, ready.num_rows], pa.int32()), ready.to_struct_array())
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "result"])


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
