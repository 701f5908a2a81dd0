"""Token ids of whole texts by the tokenizers library, encoding each distinct piece of text once.

A text's ids are those of tokenizer.encode(text, add_special_tokens=False), which also takes a special token's string in a text for
that token. Both kinds of vocabulary used here split texts before they merge, and never join what stands
on either side of the places where this module cuts; texts for which that isn't sure, such as those with a special
token's string, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import Words

#: A task has one core: the library's own threads would only multiply memory and compete with other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Runs of blanks, blanks at an end, and any white space but space and line feed: such texts are encoded whole by a
#: byte-level vocabulary, which keeps white space.
ODD_BLANKS = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b\x0c\r\x1c-\x1f]|\x{85}|\x{a0}|\x{1680}|[\x{2000}-\x{200a}]"
    r"|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{3000}"
)
#: Distinct pieces whose ids a worker remembers from one slice to the next, at most.
REMEMBERED = 250_000
ENCODED_AT_ONCE = 5_000
#: Bytes of text encoded as one.
SLICE = 4 << 20


class Ragged:
    """Lists of integers, end to end."""

    def __init__(self, bounds: np.ndarray, values: np.ndarray):
        self.bounds, self.values = bounds, values

    def take(self, which: np.ndarray) -> Ragged:
        sizes = np.diff(self.bounds)[which]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        places = np.arange(bounds[-1]) + np.repeat(self.bounds[which] - bounds[:-1], sizes)
        return Ragged(bounds, self.values[places])


def ragged(lists: list[list[int]]) -> Ragged:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64)
    return Ragged(bounds, np.fromiter((i for x in lists for i in x), np.uint32, int(bounds[-1])))


def joined(parts: list[Ragged]) -> Ragged:
    ends = np.cumsum([0, *(int(x.bounds[-1]) for x in parts)])
    return Ragged(np.concatenate([np.zeros(1, np.int64), *(x.bounds[1:] + e for x, e in zip(parts, ends, strict=False))]), np.concatenate([np.empty(0, np.uint32), *(x.values for x in parts)]))


class Coder:
    """A tokenizer in a worker, with the ids of pieces it has met."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        #: A word vocabulary drops white space, so that any word can be encoded alone.
        self.by_word = bool(spec["model"].get("end_of_word_suffix"))
        plain = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec.get("normalizer") and not spec["pre_tokenizer"].get("add_prefix_space")
        self.whole = not (self.by_word or plain)
        added = [re.escape(x["content"]) for x in spec.get("added_tokens") or []]
        #: Such texts are encoded whole; in any case of letters, as a normalizer may change that.
        odd = [*([f"(?i:{'|'.join(added)})"] if added else []), *([] if self.by_word else [ODD_BLANKS])]
        self.odd = "|".join(odd)
        self.n_ids = self.tokenizer.get_vocab_size()
        self.known, self.known_ids = pa.array([], pa.string()), Ragged(np.zeros(1, np.int64), np.empty(0, np.uint32))

    def lists(self, texts: list[str]) -> Ragged:
        parts = []
        for i in range(0, len(texts), ENCODED_AT_ONCE):
            encoded = self.tokenizer.encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False)
            parts.append(ragged([x.ids for x in encoded]))
        return joined(parts)

    def pieces(self, vocabulary: pa.Array, counts: np.ndarray) -> Ragged:
        """The ids of each of these distinct pieces; those met twice are remembered."""
        found = pc.index_in(vocabulary, value_set=self.known)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        fresh = self.lists(vocabulary.take(pa.array(new)).to_pylist())
        where = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        where[new] = len(self.known) + np.arange(len(new))
        both = joined([self.known_ids, fresh])
        again = np.flatnonzero(counts[new] > 1)[: max(0, REMEMBERED - len(self.known))]
        if len(again):
            self.known = pa.concat_arrays([self.known, vocabulary.take(pa.array(new[again]))])
            self.known_ids = joined([self.known_ids, fresh.take(again)])
        return both.take(where)

    def encode(self, texts: pa.Array) -> Ragged:
        """The ids of each text; null texts have none."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if self.whole:
            return self.lists(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.odd else np.zeros(len(texts), bool)
        if not odd.any():
            return self.cut(texts)
        easy, hard = np.flatnonzero(~odd), np.flatnonzero(odd)
        both = joined([self.cut(texts.take(pa.array(easy))), self.lists(texts.take(pa.array(hard)).to_pylist())])
        order = np.empty(len(texts), np.int64)
        order[np.concatenate((easy, hard))] = np.arange(len(texts))
        return both.take(order)

    def cut(self, texts: pa.Array) -> Ragged:
        """Texts cut into words, or before each blank, so that every piece but a text's first begins with its blank."""
        if self.by_word:
            words = Words(texts)
            ids = self.pieces(words.vocabulary, np.bincount(words.index, minlength=len(words.vocabulary))).take(words.index)
            return Ragged(ids.bounds[words.bounds], ids.values)
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = units.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        encoded = units.flatten().dictionary_encode()
        index, vocabulary = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
        firsts = bounds[:-1][np.diff(bounds) > 0]
        start, at = np.unique(index[firsts], return_inverse=True)
        index[firsts] = len(vocabulary) + at
        after = pc.if_else(pc.starts_with(vocabulary, "\n"), vocabulary, pc.binary_join_element_wise("", vocabulary, " "))
        all_pieces = pa.concat_arrays([after, vocabulary.take(pa.array(start))])
        used = np.bincount(index, minlength=len(all_pieces))
        # A word may stand both first and, as another piece, after a blank; equal pieces meet here again.
        again = all_pieces.dictionary_encode()
        same = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(same, weights=used, minlength=len(again.dictionary))
        ids = self.pieces(again.dictionary, counts).take(same[index])
        return Ragged(ids.bounds[bounds], ids.values)


@cache
def coder(path: str) -> Coder:
    return Coder(path)
