"""The chunks of functions/chunks.py, under this folder's name."""

from ..functions.chunks import BUCKET_HASHES, CHUNK, CHUNK_BYTES, QUESTION, Chunk, answered, in_order, packed, per_bucket, question, rows_of, seen_twice, unpacked, word_chunks

__all__ = ["BUCKET_HASHES", "CHUNK", "CHUNK_BYTES", "QUESTION", "Chunk", "answered", "in_order", "packed", "per_bucket", "question", "rows_of", "seen_twice", "unpacked", "word_chunks"]
