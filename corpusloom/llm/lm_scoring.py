"""Scoring texts by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import BUCKET_HASHES, CHUNK_BYTES, QUESTION, Chunk, in_order, packed, per_bucket, question, rows_of, unpacked, word_chunks
from .common import mix64, spread, written

#: Word classes (0 holds the end of a text alone) and groups of a class: both are chosen by softmax, over as many weights in a row.
CLASSES = 16
#: Number of the end of a text, in place of a word's hash.
END = 1
#: The table has a row for so many training tokens, and between these numbers of rows; the upper one bounds what is broadcast (64 bytes a row).
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS = 64, 1 << 16, 1 << 17
#: A task trains on so many bytes of packed text at least for each byte of the table, which it sends back once.
TEXT_A_TABLE = 1
BATCH = 8192
RATE = 0.5
#: Occurrences that a word's own contexts need to outweigh those of all words.
PRIOR = 4.0
#: Rows of the weight table that travel as one.
BLOCK = 1024
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
COUNTED = "chunk long, bucket long, said binary, tokens array<long>, types array<long>"


class Tokens:
    """The tokens of a chunk: each text's words, then its end, which has number len(vocabulary)."""

    def __init__(self, chunk: Chunk, folds: int):
        n = len(chunk.doc_ids)
        self.bounds = chunk.bounds + np.arange(n + 1)
        self.owner = np.repeat(np.arange(n), np.diff(self.bounds))
        self.word = np.full(self.bounds[-1], len(chunk.vocabulary), np.int64)
        ends = np.zeros(self.bounds[-1], bool)
        ends[self.bounds[1:] - 1] = True
        self.word[~ends] = chunk.index
        self.hashes = np.fromiter((*map(xxhash.xxh3_64_intdigest, chunk.vocabulary), END), np.uint64, len(chunk.vocabulary) + 1)
        self.fold = np.array([zlib.crc32(str(d).encode()) % folds if ok else -1 for d, ok in zip(chunk.doc_ids.tolist(), chunk.valid, strict=True)], np.int64)
        self.train = self.fold[self.owner] > 0

    def before(self, values: np.ndarray, k: int, none: int = 0) -> np.ndarray:
        """values k tokens earlier in the same text, `none` before its start."""
        out = np.full_like(values, none)
        if k < len(values):
            same = self.owner[k:] == self.owner[:-k]
            out[k:][same] = values[:-k][same]
        return out

    def history(self) -> list[np.ndarray]:
        """The numbers of the three words before each token; that after the last word's stands for none."""
        words = self.word.astype(np.int32)
        return [self.before(words, k, len(self.hashes)) for k in (1, 2, 3)]

    def features(self, history: list[np.ndarray], at: np.ndarray | slice) -> np.ndarray:
        """The hashed features of these tokens: the word before, the pair before, none (all tokens have that one), and two skips."""
        known = np.append(self.hashes, np.uint64(0))
        one, two, three = (known.take(h[at]) for h in history)
        columns = [one, mix64(two) + one, np.zeros_like(one), mix64(two + np.uint64(2)), mix64(three + np.uint64(3))]
        return np.stack([mix64(c + np.uint64(k * 0x1000193)) for k, c in enumerate(columns, 1)])


def places_of(features: np.ndarray, rows: int) -> np.ndarray:
    """The row of the table for each feature."""
    return (features >> np.uint64(64 - (rows.bit_length() - 1))).astype(np.uint16 if rows <= 1 << 16 else np.int64)


def within(features: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The features of the choice among a class's groups: those of the token but its skips, told apart by its class."""
    return (features[:3] ^ mix64(classes.astype(np.uint64) + np.uint64(77))) * np.uint64(0x9E3779B97F4A7C15)


def log_softmax(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Natural logarithms of the probabilities of a batch; places has a line for each feature."""
    logits = weights.take(places[0], axis=0)
    for line in places[1:]:
        logits += weights.take(line, axis=0)
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def train_batch(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, places: np.ndarray, target: np.ndarray) -> None:
    """One adaptive gradient step, on the rows of the batch's features alone; squares has a number for each row."""
    gradient = log_softmax(weights, places)
    np.exp(gradient, out=gradient)
    gradient[np.arange(len(target)), target] -= 1
    for line in places:
        order = np.argsort(line, kind="stable" if line.dtype == np.uint16 else None)  # 16 bits are sorted by digits
        ordered = line.take(order)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rows, counts = ordered.take(starts).astype(np.intp), np.diff(np.append(starts, len(line)))
        # The mean over the batch's tokens with this feature; most features stand at one token only, and need no sum.
        mean = gradient.take(order.take(starts), axis=0)
        several = np.flatnonzero(counts > 1)
        if len(several):
            sizes = counts.take(several)
            at = np.cumsum(sizes) - sizes
            inside = np.arange(sizes.sum()) + np.repeat(starts.take(several) - at, sizes)
            mean[several] = np.add.reduceat(gradient.take(order.take(inside), axis=0), at, axis=0) / sizes[:, None].astype(np.float32)
        seen = squares.take(rows) + np.einsum("ij,ij->i", mean, mean) / np.float32(mean.shape[1])
        squares[rows] = seen
        mean *= (np.float32(RATE / len(places)) / (np.sqrt(seen) + np.float32(1e-3)))[:, None]
        weights[rows] = weights.take(rows, axis=0) - mean
        touched[rows] += counts


def groups_of(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A word's group in its class: by how often it occurs, in powers of two; by its hash where it is unknown."""
    return np.where(counts > 0, np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1), ((hashes >> np.uint64(8)) % np.uint64(CLASSES)).astype(np.int64))


def classes_of(contexts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Learned classes: what kind of word (by hash, in CLASSES - 1 kinds) stands before a word most over its share; by its hash where it is unknown."""
    share = (contexts.sum(axis=0) + 1) / (contexts.sum() + CLASSES - 1)
    over = (contexts + PRIOR * share) / ((contexts.sum(axis=1, keepdims=True) + PRIOR) * share)
    known = np.where(contexts.any(axis=1), over.argmax(axis=1), (hashes % np.uint64(CLASSES - 1)).astype(np.int64))
    return np.where(hashes == END, 0, 1 + known)


def word_counts(chunks: DataFrame, folds: int, n_buckets: int) -> DataFrame:
    """COUNTED: for each chunk and bucket that it asks about words, their count and class (16 times the count, plus the class); and once a bucket the
    tokens and types of each class and group, over the training texts."""
    kinds = CLASSES - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            tokens = Tokens(Chunk(row), folds)
            n = len(tokens.hashes)
            words = tokens.word[tokens.train]
            before = (tokens.before(mix64(tokens.hashes[tokens.word]), 1) % np.uint64(kinds)).astype(np.int64)[tokens.train]
            seen = np.bincount(words * kinds + before, minlength=n * kinds).reshape(n, kinds)
            order = np.argsort(tokens.hashes)
            # All of a word's occurrences but those at a text's start have a word before them; these count as kind 0.
            yield from question(row["chunk"], tokens.hashes[order], n_buckets, lambda s, seen=seen[order].astype(np.uint32): seen[s].T.reshape(-1))

    def total(held: list[dict]) -> Iterator[pa.RecordBatch]:
        asked = [unpacked(r["asked"]) for r in held]
        distinct, which = np.unique(np.concatenate(asked), return_inverse=True)
        contexts, start = np.zeros((len(distinct), kinds)), 0
        for r, own in zip(held, asked, strict=True):
            contexts[which[start : start + len(own)]] += unpacked(r["with_it"]).reshape(kinds, -1).T  # a chunk asks a word once
            start += len(own)
        counts, classes = contexts.sum(axis=1).astype(np.int64), classes_of(contexts, distinct)
        leaf = classes * CLASSES + groups_of(counts, distinct)
        tokens = np.bincount(leaf, weights=counts, minlength=CLASSES**2).astype(np.int64).tolist()
        types = np.bincount(leaf[counts > 0], minlength=CLASSES**2).tolist()
        said = np.split((counts * CLASSES + classes)[which], np.cumsum([len(x) for x in asked])[:-1])
        n = len(held)
        columns = [[r["chunk"] for r in held], [r["bucket"] for r in held], [packed(x) for x in said], [tokens, *[None] * (n - 1)], [types, *[None] * (n - 1)]]
        types_of = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types_of, strict=True)], names=[x.split()[0] for x in COUNTED.split(", ")])

    return written(per_bucket(chunks.mapInArrow(ask, QUESTION), n_buckets, total, COUNTED), "word-counts")


def leaf_sums(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types of each class and group, as squares of CLASSES; only these sums go to the driver."""
    out = np.zeros((2, CLASSES * CLASSES))
    for k, column in enumerate(("tokens", "types")):
        sums = counted.where("tokens is not null").select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
        for row in sums:
            out[k, row["at"]] = row["n"]
    return out[0].reshape(CLASSES, -1), out[1].reshape(CLASSES, -1)


class Known:
    """What the counts say of a chunk's vocabulary: each word's count, class and group."""

    def __init__(self, tokens: Tokens, answers: list[dict] | None):
        said = np.empty(len(tokens.hashes), np.int64)
        said[np.argsort(tokens.hashes)] = in_order(answers)
        self.counts, self.classes = said // CLASSES, said % CLASSES
        self.groups = groups_of(self.counts, tokens.hashes)


def train_round(chunks: DataFrame, start: np.ndarray, folds: int, tasks: int) -> np.ndarray:
    """Weights after each of `tasks` tasks has gone once through its chunks from `start`: the tasks' mean, row by row, by how often each met the row."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(start)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, touched = shared.value.copy(), np.full(len(shared.value), 1e-2, np.float32), np.zeros(len(shared.value), np.float32)
        for row in rows_of(batches):
            tokens = Tokens(Chunk(row), folds)
            known = Known(tokens, row["answers"])
            history, train = tokens.history(), np.flatnonzero(tokens.train)
            for i in range(0, len(train), BATCH):
                at = train[i : i + BATCH]
                part, own = tokens.features(history, at), tokens.word[at]
                classes = known.classes[own]
                train_batch(weights, squares, touched, places_of(part, len(weights)), classes)
                train_batch(weights, squares, touched, places_of(within(part, classes), len(weights)), known.groups[own])
        for block in range(0, len(weights), BLOCK):
            part = slice(block, block + BLOCK)
            if touched[part].any():
                data = np.concatenate((weights[part] * touched[part, None], touched[part, None]), axis=1, dtype=np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(data.reshape(-1))], pa.binary())], names=["block", "task", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(unpacked(x).astype(np.float64) for x in group["sums"].to_pylist())
        return pa.table({"block": group["block"][:1], "sums": pa.array([packed(total)], pa.binary())})

    learned = chunks.repartition(tasks, "chunk").mapInArrow(learn, "block long, task long, sums binary")
    # Sums of sums: no group gets more than about the square root of all tasks' blocks.
    width = int(tasks**0.5) + 1
    some = learned.withColumn("part", F.pmod("task", F.lit(width))).groupBy("block", "part").applyInArrow(add, "block long, sums binary")
    rows = some.groupBy("block").applyInArrow(add, "block long, sums binary").collect()  # as large as the weight table
    out = start.copy()
    for row in rows:
        sums = unpacked(bytes(row["sums"])).reshape(-1, CLASSES + 1)
        met = sums[:, -1] > 0
        at = row["block"] + np.flatnonzero(met)
        out[at] = (sums[met, :-1] / sums[met, -1:]).astype(np.float32)
    return out


def token_scores(weights: np.ndarray, tokens: Tokens, known: Known, leaf_tokens: np.ndarray, leaf_types: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token of a chunk."""
    history, target, group = tokens.history(), known.classes[tokens.word], known.groups[tokens.word]
    own = np.log10((known.counts + 0.1) / (leaf_tokens + 0.1 * (leaf_types + 1))[known.classes, known.groups])
    given = np.empty(len(target))
    for i in range(0, len(target), BATCH):
        part, c, g = tokens.features(history, slice(i, i + BATCH)), target[i : i + BATCH], group[i : i + BATCH]
        at = np.arange(len(c))
        given[i : i + BATCH] = log_softmax(weights, places_of(part, len(weights)))[at, c] + log_softmax(weights, places_of(within(part, c), len(weights)))[at, g]
    return given / np.log(10) + own[tokens.word]


def score_texts(docs: DataFrame, folds: int = 10, rounds: int = 2, most_rows: int = MOST_ROWS, tokens_a_row: int = TOKENS_A_ROW, chunk_bytes: int = CHUNK_BYTES, bucket_hashes: int = BUCKET_HASHES) -> DataFrame:
    """One row per document: SCORES. Texts of fold 0 (crc32 of doc_id as text, modulo folds) are held out, others are learned from.

    A token's probability has three factors: that of its class, that of its group in the class, and its own share of the group. The first two are
    softmaxes over CLASSES weights, summed over rows of one table that hashed features of the tokens before it choose (the word before, the pair and,
    for the class, two skips); the second's features are told apart by the class. The weights come from gradient steps that tasks take
    on their own texts, averaged after each of `rounds` shares of all texts. The third is the add-0.1 share of the word's count in the group, with
    one unknown word for each group. base_score is the add-0.1 unigram model.

    Classes are learned: by what words stand before a word more than before others; groups hold words of like counts. Counts and contexts are
    summed over all training texts by the words' 64-bit hashes and sent back to the chunks that asked for them. The table has a
    row for each tokens_a_row training tokens, most_rows at most (a power of two), which bounds what is broadcast and goes through the driver.

    Cases: null and empty texts have their end as the one token; null ids are neither held out nor learned from; rows that repeat count
    each; without a training text all tokens are unknown; an empty table gives an empty result; other columns are ignored.
    """
    chunks = word_chunks(docs, lower=True, limit=chunk_bytes)
    size = F.sum(F.length("index") + F.length("vocabulary") + F.length("bounds") + F.length("doc_ids"))
    n_words, n_bytes = chunks.agg(F.sum("n_words"), size).first()
    counted = word_counts(chunks, folds, spread(n_words or 0, bucket_hashes))
    leaf_tokens, leaf_types = leaf_sums(counted)
    by_chunk = counted.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "said")).alias("answers"))
    known = written(chunks.join(by_chunk, "chunk"), "known-words")

    rows = min(most_rows, max(LEAST_ROWS, 1 << int(leaf_tokens.sum() // tokens_a_row).bit_length()))
    weights = np.zeros((rows, CLASSES), np.float32)
    tasks = spread((n_bytes or 0) // rounds, TEXT_A_TABLE * weights.nbytes)
    for k in range(rounds):
        weights = train_round(known.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == k), weights, folds, tasks)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all, v_all = leaf_tokens.sum(), leaf_types.sum()
        for row in rows_of(batches):
            chunk = Chunk(row)
            tokens = Tokens(chunk, folds)
            words = Known(tokens, row["answers"])
            base = np.log10((words.counts + 0.1) / (n_all + 0.1 * (v_all + 1)))
            n = len(chunk.doc_ids)
            by_text = lambda x: np.bincount(tokens.owner, weights=x, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.ids(),
                    pa.array(tokens.fold == 0),
                    pa.array(np.diff(tokens.bounds)),
                    pa.array(by_text(words.counts[tokens.word] > 0).astype(np.int64)),
                    pa.array(np.full(n, int(n_all), np.int64)),
                    pa.array(by_text(base[tokens.word])),
                    pa.array(by_text(token_scores(model.value, tokens, words, leaf_tokens, leaf_types))),
                ],
                names=[x.split()[0] for x in SCORES.split(", ")],
            )

    return known.mapInArrow(score, SCORES)


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
