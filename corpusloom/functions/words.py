"""Words of texts as arrays, and hashes of them.

Text rule: a word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A null text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step inside a task works on.
SLICE_BYTES = 8 << 20


def spread(n_rows: int, per_part: int) -> int:
    """How many parts keep each near per_part rows; grows with the rows and has no upper limit."""
    return max(1, -(-n_rows // per_part))


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of about limit bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a slice of texts.

    bounds[i]:bounds[i + 1] are text i's places in index; vocabulary[index[j]] is the word at place j.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate(([0], np.cumsum(real)))[offsets]
        encoded = words.filter(pa.array(real)).dictionary_encode()
        self.vocabulary: pa.Array = encoded.dictionary
        self.index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.index)

    def vocabulary_hash(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each vocabulary word."""
        words = self.vocabulary.cast(pa.binary()).to_pylist()
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of `width` consecutive word hashes, in their order; window i starts at word i."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        if k % 4 == 3:
            out = mix64(out)
    return mix64(out)
