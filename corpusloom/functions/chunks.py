"""Texts as chunks of word numbers, and questions that chunks ask about hashes of the whole table.

A chunk holds some megabytes of documents in one row: their words as numbers in the chunk's own vocabulary. Hashes
that all chunks must compare (windows, words) go to buckets, as one packed row for each chunk and bucket instead of a row
for each hash: Spark deals, sorts and spills these rows, and numpy compares the hashes of a bucket inside a task.
A bucket's answer is a bit or a number for each hash asked, in the order asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .words import Words, text_slices

CHUNK = "chunk long, n_words long, doc_ids binary, valid binary, bounds binary, index binary, vocabulary binary"
#: Text of a chunk and hashes of a bucket, about. Rows on the way are chunks times buckets at most: larger ones of both keep these few on
#: a larger table, and take more of a task's memory.
CHUNK_BYTES, BUCKET_HASHES = 8 << 20, 2_000_000


def packed(values: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    raw = np.ascontiguousarray(values)
    return raw.dtype.char.encode() + zstandard.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def word_chunks(docs: DataFrame, lower: bool = False, limit: int = CHUNK_BYTES) -> DataFrame:
    """CHUNK rows of docs (doc_id, text), written, so that a chunk stays the same chunk whatever is lost later."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in text_slices(batches, limit=limit):
            words = Words(part["text"], lower)
            ids = part["doc_id"].cast(pa.int64())
            number += 1
            row = [
                number,
                len(words),
                packed(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)),
                packed(ids.is_valid().to_numpy(zero_copy_only=False).view(np.uint8)),
                packed(words.bounds),
                packed(words.index.astype(np.uint32)),
                zstandard.compress(b" ".join(words.vocabulary.cast(pa.binary()).to_pylist()), 1),
            ]
            kinds = [pa.int64()] * 2 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in CHUNK.split(", ")])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, CHUNK), "word-chunks")


class Chunk:
    """A chunk's arrays, from a row with the columns of CHUNK."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.doc_ids, self.valid = unpacked(row["doc_ids"]), unpacked(row["valid"]).astype(bool)
        self.bounds, self.index = unpacked(row["bounds"]), unpacked(row["index"]).astype(np.int64)
        self.vocabulary = zstandard.decompress(row["vocabulary"]).split(b" ") if len(self.index) else []
        self.owner = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.bounds))

    def starts(self, width: int) -> np.ndarray:
        """Where windows of this width start that stay inside a document."""
        n = len(self.index) - width + 1
        return np.flatnonzero(self.owner[:n] == self.owner[width - 1 :]) if n > 0 else np.empty(0, np.int64)

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=~self.valid)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches one by one, so that one chunk is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


QUESTION = "bucket long, chunk long, asked binary, with_it binary"


def question(chunk: int, hashes: np.ndarray, n_buckets: int, with_it: Callable[[slice], np.ndarray] | None = None, kind=np.uint64, bits: int = 64) -> Iterator[pa.RecordBatch]:
    """QUESTION rows for sorted hashes, of which the lower bits are sent; with_it gives what goes along with those of a slice."""
    buckets = ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    present, starts = np.unique(buckets, return_index=True)
    ends = np.append(starts[1:], len(hashes))
    pieces = [slice(a, b) for a, b in zip(starts, ends, strict=False)]
    if len(pieces):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(present),
                pa.array([chunk] * len(pieces), pa.int64()),
                pa.array([packed((hashes[s] & np.uint64((1 << bits) - 1)).astype(kind)) for s in pieces], pa.binary()),
                pa.array([packed(with_it(s)) if with_it else None for s in pieces], pa.binary()),
            ],
            names=["bucket", "chunk", "asked", "with_it"],
        )


def per_bucket(questions: DataFrame, n_buckets: int, handle: Callable[[list[dict]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What handle makes of each bucket's QUESTION rows, one bucket in memory at a time."""

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in rows_of(batches):
            if held and held[0]["bucket"] != row["bucket"]:
                yield from handle(held)
                held = []
            held.append(row)
        if held:
            yield from handle(held)

    dealt = questions.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(by_bucket, schema)


def answered(questions: DataFrame, n_buckets: int, answer: Callable[[list[np.ndarray], list[np.ndarray], np.ndarray], list[np.ndarray]]) -> DataFrame:
    """chunk, answers: for each chunk that asked, array<struct<bucket, said>> with answer's arrays, packed.

    answer gets the hashes that each chunk asked of one bucket, what went along, and the chunks' numbers.
    """

    def handle(held: list[dict]) -> Iterator[pa.RecordBatch]:
        asked = [unpacked(r["asked"]) for r in held]
        along = [unpacked(r["with_it"]) for r in held if r["with_it"] is not None]
        said = answer(asked, along, np.array([r["chunk"] for r in held]))
        columns = [pa.array([r["chunk"] for r in held], pa.int64()), pa.array([held[0]["bucket"]] * len(held), pa.int64()), pa.array([packed(x) for x in said], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "said"])

    said = per_bucket(questions, n_buckets, handle, "chunk long, bucket long, said binary")
    return said.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "said")).alias("answers"))


def in_order(answers: list[dict] | None) -> np.ndarray:
    """A chunk's answers, in the order in which question() got the hashes."""
    parts = [unpacked(x["said"]) for x in sorted(answers or [], key=lambda x: x["bucket"])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def seen_twice(asked: list[np.ndarray], _along: list[np.ndarray], _chunks: np.ndarray) -> list[np.ndarray]:
    """For each hash, whether another chunk asks it too."""
    _, which, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    twice = (counts[which] > 1).astype(np.uint8)
    return np.split(twice, np.cumsum([len(x) for x in asked])[:-1])
