"""Helpers that several operators of this folder share.

Text rule used throughout: a word is a maximal run of characters other than
space, tab, line feed, vertical tab, form feed and carriage return. A null text
counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.words import SLICE_BYTES, Words, mix64, spread, text_slices, window_hashes
from ..sources.storage import discarded, new_path, shared_dir, written

__all__ = ["SLICE_BYTES", "Words", "crc_mod", "discarded", "mix64", "new_path", "shared_dir", "spread", "text_slices", "window_hashes", "written"]


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n: the folds that training and held-out rows are told apart by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
