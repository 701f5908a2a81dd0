"""Token ids in binary files: documents compressed one by one with a shared dictionary, and found by an offset index.

A folder holds:
- dictionary.zdict: a zstandard dictionary trained on serialized id arrays,
- shard-NNNNNN.tok: MAGIC, the dictionary's sha256 (32 bytes), the bytes an id takes (1 byte), then one zstandard
  frame for each document, in ascending doc_id order (null first) over all shards,
- shard-NNNNNN.idx: MAGIC, the dictionary's sha256, the number of documents (8 bytes), then for all documents doc_id
  (int64), whether it is not null (uint8), the frame's offset in the .tok file (uint64, one more than documents), and the
  number of ids (uint32); little-endian throughout,
- manifest: a Parquet table with a row for each shard.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, spread, text_slices
from .tokens import SLICE, Ragged, coder

MAGIC = b"CLTOK1\n\0"
SHARDS = "shard int, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"
LEVEL = 3
#: The dictionary is trained on about so many documents, of at most so many bytes each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_bytes(path: str) -> bytes:
    store, at = opened(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_whole(path: str, data: bytes) -> None:
    store, at = opened(path)
    with store.open_output_stream(at) as f:
        f.write(data)


def ended(ids: Ragged, end_id: int | None) -> Iterator[np.ndarray]:
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for a, b in zip(ids.bounds, ids.bounds[1:], strict=False):
        yield np.concatenate((ids.values[a:b], tail))


def id_type(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def sample_limit(n: int, wanted: int) -> int:
    """What 62 bits of a hash must be under, so that about `wanted` of n rows are picked; never 0, however large n is."""
    return (1 << 62) if n <= wanted else max(1, (wanted << 62) // n)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int | None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Trained on the id arrays of about sample_docs distinct texts, picked by a hash of the text, of sample_bytes each at most.

    Copies of a text count once, and meet before they go to the driver.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    placed = docs.select("text", place.alias("place"))
    n_texts = placed.agg(F.approx_count_distinct("place")).first()[0]
    picked = placed.where(F.col("place") < F.lit(sample_limit(n_texts, sample_docs)))

    def serialize(batches):
        for part in text_slices(batches, limit=SLICE):
            kind = id_type(coder(tokenizer_path).n_ids)
            data = [x[: sample_bytes // kind.itemsize].astype(kind).tobytes() for x in ended(coder(tokenizer_path).encode(part["text"]), end_id)]
            yield pa.RecordBatch.from_arrays([part["place"], pa.array(data, pa.binary())], names=["place", "ids"])

    distinct = picked.groupBy("place").agg(F.min("text").alias("text"))
    samples = sorted(bytes(r.ids) for r in distinct.mapInArrow(serialize, "place long, ids binary").select("ids").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their bytes themselves serve
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\0" * 8


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, docs_per_shard: int = 8192) -> DataFrame:
    """Write the ids of every whole text; returns the manifest.

    Shards are ranges of doc_id. Each is written by one task under a name of that attempt and then renamed,
    so that a task that runs again replaces its file. Files go wherever pyarrow.fs opens path.

    Cases: null text is empty (only its end id); null ids come first; rows that share an id are ordered by a hash of their text, so that reruns agree, and rows that repeat are written each; an empty table
    gives a dictionary and no shard; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(texts, tokenizer_path, end_id)
    store, at = opened(path)
    store.create_dir(at, recursive=True)
    write_whole(f"{path}/dictionary.zdict", dictionary)
    shards = spread(texts.count(), docs_per_shard)

    def write_shard(batches):
        me = TaskContext.get()
        store, folder = opened(path)
        kind, digest = id_type(coder(tokenizer_path).n_ids), hashlib.sha256(dictionary).digest()
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        name, mine = f"{folder}/shard-{me.partitionId():06d}", f"{folder}/_attempt-{me.taskAttemptId()}"
        ids, present, sizes, counts = [], [], [], []
        with store.open_output_stream(f"{mine}.tok") as out:
            out.write(MAGIC + digest + bytes([kind.itemsize]))
            for part in text_slices(batches, limit=SLICE):
                ids.append(part["doc_id"].fill_null(0).to_numpy(zero_copy_only=False))
                present.append(part["doc_id"].is_valid().to_numpy(zero_copy_only=False))
                for x in ended(coder(tokenizer_path).encode(part["text"]), end_id):
                    frame = pack(x.astype(kind).tobytes())
                    out.write(frame)
                    sizes.append(len(frame))
                    counts.append(len(x))
        if not counts:
            store.delete_file(f"{mine}.tok")
            return
        offsets = np.cumsum([len(MAGIC) + 33, *sizes]).astype("<u8")
        doc_ids, valid, counts = np.concatenate(ids).astype("<i8"), np.concatenate(present), np.array(counts, "<u4")
        with store.open_output_stream(f"{mine}.idx") as out:
            out.write(MAGIC + digest + np.array([len(counts)], "<u8").tobytes() + doc_ids.tobytes() + valid.astype("u1").tobytes() + offsets.tobytes() + counts.tobytes())
        for kind_of in ("tok", "idx"):
            store.move(f"{mine}.{kind_of}", f"{name}.{kind_of}")
        known = doc_ids[valid]
        row = [me.partitionId(), int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, len(counts), int(counts.sum()), int(offsets[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] + [pa.int64()] * 5, strict=True)], names=[x.split()[0] for x in SHARDS.split(", ")])

    # Rows of one id are ordered by a hash of their text and may fill several shards; the last key only tells equal rows apart.
    order = ["doc_id", "tie", "row"]
    keyed = texts.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(write_shard, SHARDS).write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark, path: str) -> DataFrame:
    """The shards with start, the ids of all shards before. One row for each shard meets in the window."""
    rows = spark.read.schema(SHARDS).parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """One shard, opened for reading; checks that the dictionary is the one it was written with."""

    def __init__(self, path: str, shard: int, dictionary: bytes):
        digest = hashlib.sha256(dictionary).digest()
        index = read_bytes(f"{path}/shard-{shard:06d}.idx")
        if index[: len(MAGIC)] != MAGIC or index[len(MAGIC) : len(MAGIC) + 32] != digest:
            raise ValueError(f"shard {shard} was not written with this dictionary")
        at = len(MAGIC) + 32
        n = int(np.frombuffer(index, "<u8", 1, at)[0])
        self.doc_ids = np.frombuffer(index, "<i8", n, at + 8)
        self.valid = np.frombuffer(index, "u1", n, at + 8 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<u8", n + 1, at + 8 + 9 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u4", n, at + 16 + 17 * n)
        store, name = opened(f"{path}/shard-{shard:06d}.tok")
        self.file = store.open_input_file(name)
        head = self.file.read_at(len(MAGIC) + 33, 0)
        if head[len(MAGIC) : len(MAGIC) + 32] != digest:
            raise ValueError(f"shard {shard} was not written with this dictionary")
        self.kind = np.dtype(f"<u{head[-1]}")
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, of which only its own bytes are read."""
        a, b = self.offsets[i], self.offsets[i + 1]
        return np.frombuffer(self.unpack(self.file.read_at(int(b - a), int(a))), self.kind).astype(np.uint32)

    def find(self, doc_id: int) -> list[int]:
        first = int((~self.valid).sum())
        a, b = (first + int(np.searchsorted(self.doc_ids[first:], doc_id, side)) for side in ("left", "right"))
        return list(range(a, b))


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, ids."""
    dictionary = read_bytes(f"{path}/dictionary.zdict")

    def read_shards(batches):
        for batch in batches:
            for number, start in zip(batch["shard"].to_pylist(), batch["start"].to_pylist(), strict=True):
                shard = Shard(path, number, dictionary)
                starts = start + np.concatenate(([0], np.cumsum(shard.counts.astype(np.int64))))[:-1]
                for i in range(0, len(starts), 512):
                    at = slice(i, i + 512)
                    ids = [shard.document(j) for j in range(*at.indices(len(starts)))]
                    raw = [x.astype("<u4").tobytes() for x in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[at], mask=~shard.valid[at]),
                            pa.array(starts[at]),
                            pa.array(shard.counts[at].astype(np.int64)),
                            pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                            pa.array(raw, pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    manifest = read_manifest(spark, path).select("shard", "start")
    parts = max(1, manifest.count())
    return manifest.repartitionByRange(parts, "shard").mapInArrow(read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each document with this doc_id, read by the manifest and the offset index alone."""
    dictionary = read_bytes(f"{path}/dictionary.zdict")
    rows = spark.read.schema(SHARDS).parquet(f"{path}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    shards = [Shard(path, r.shard, dictionary) for r in rows.select("shard").orderBy("shard").collect()]
    return [s.document(i) for s in shards for i in s.find(doc_id)]


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).drop("ids")
