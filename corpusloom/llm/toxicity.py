"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, crc_mod, discarded, text_slices, written

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
# Digits and signs that stand for letters inside words; l, 1, ! and | all become i, as nothing tells which of both is meant.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INSIDE = re.compile(r"(?<=[^\W\d_])\d+|[\d@$!|]+(?=[^\W\d_])")
HIDDEN = r"[\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
OTHER_SCRIPT = "[" + "".join(LOOKALIKES) + "]"
#: Labelled rows of each class that are learned from, about; terms and exceptions kept at most.
SAMPLE_DOCS, MOST_TERMS, MOST_EXCEPTIONS = 30_000, 20_000, 5_000
#: Letters of the shortest and the longest beginning of a word that is a term of its own.
SHORTEST, LONGEST = 3, 8
#: A term counts from this many distinct texts, standard errors, and weight (the logarithm of how much likelier toxic texts have it) on.
LEAST_TEXTS, LEAST_Z, LEAST_WEIGHT = 3, 3.0, 1.5
#: Words that every text is taken to have besides its own, and the weight a word below which densities hardly differ.
MORE_WORDS, FLOOR = 10, 0.002
BINS = 16
RESULT = "score double, predicted int, n_hits int, n_excepted int"


@dataclass
class Lexicon:
    """terms: weights of ` word ` (whole words) and ` begin` (words' beginnings); exceptions: phrases ` one two ` inside which terms don't count."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -20.0
    slope: float = 0.0


def fold(texts: pa.Array) -> pa.Array:
    """Lower-case words of letters between single spaces, one before and after them, with look-alikes and substituted digits as the letters they stand for."""
    out = pc.utf8_lower(pc.utf8_normalize(pc.fill_null(texts.cast(pa.string()), ""), form="NFKC"))
    out = pc.replace_substring_regex(out, HIDDEN, "")

    def where(pattern: str, change) -> None:
        nonlocal out
        if pc.any(hit := pc.match_substring_regex(out, pattern)).as_py():
            out = pc.replace_with_mask(out, hit, pa.array([change(x) for x in out.filter(hit).to_pylist()], pa.string()))

    to_latin, to_letters = str.maketrans(LOOKALIKES), str.maketrans(SUBSTITUTES)
    where(OTHER_SCRIPT, lambda x: x.translate(to_latin))
    where(r"\pL[0-9]|[0-9@$!|]\pL", lambda x: INSIDE.sub(lambda m: m[0].translate(to_letters), x))
    words = pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring(out, "l", "i"), r"[^\pL\pM]+", " "), " ")
    return pc.binary_join_element_wise("", words, "", " ")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text, toxic: about sample_docs labelled rows of each class, picked by a hash of the id. The labels taken are as many at most at any table size, and are
    sent to the documents, whose texts stay where they are."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for toxic, n in counts.items():
        limit = F.when(F.col("toxic") == toxic, F.lit((1 << 62) if n <= sample_docs else (sample_docs << 62) // n)).otherwise(limit)
    taken = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")


def counted(rows: DataFrame, of: str) -> DataFrame:
    """term, toxic, clean: in how many texts of each class the strings of the array column `of` stand."""
    one = rows.select("toxic", F.explode(of).alias("term"))
    return one.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def word_counts(train: DataFrame) -> DataFrame:
    """term, toxic, clean of each folded word; a slice of texts gives each of its words once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, toxic = Words(fold(part["text"])), part["toxic"].to_numpy()
            n = max(1, len(words.vocabulary))
            pairs = np.unique(words.owner * n + words.index)
            all_of = np.bincount(pairs % n, minlength=n)[: len(words.vocabulary)]
            of_toxic = np.bincount(pairs % n, weights=toxic[pairs // n], minlength=n)[: len(words.vocabulary)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.vocabulary, pa.array(of_toxic), pa.array(all_of - of_toxic)], names=["term", "toxic", "clean"])

    return train.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def weighed(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """counts (term, toxic, clean) with weight and z, how many standard errors the weight is from 0."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1))
    return counts.withColumn("weight", weight).withColumn("z", weight / F.sqrt(1 / t + 1 / c))


def chosen_terms(words: DataFrame, n_toxic: int, n_clean: int, most: int = MOST_TERMS) -> dict[str, float]:
    """Words and words' beginnings that toxic texts have more often.

    Of beginnings with the same texts, the longest stays. A term goes where a beginning of it weighs at least as much, and a beginning
    that counts only for one longer term goes.
    """
    begins = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("term"), F.lit(LONGEST))), lambda n: F.concat(F.lit(" "), F.substring("term", F.lit(1), n)))
    forms = F.array_distinct(F.concat(F.when(F.length("term") >= SHORTEST, begins).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit(" "), "term", F.lit(" ")))))
    each = words.where("toxic > 0 or clean > 0").select(F.explode(forms).alias("term"), "toxic", "clean").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = written(weighed(each.where(F.col("toxic") >= LEAST_TEXTS), n_toxic, n_clean).where((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT)), "toxic-terms")
    shorter = good.select(F.expr("substring(term, 1, length(term) - 1)").alias("term"), "toxic", "clean").distinct()
    closed = written(good.join(shorter, ["term", "toxic", "clean"], "left_anti"), "toxic-terms")
    begins_of = F.transform(F.sequence(F.lit(2), F.length("term")), lambda n: F.substring("term", F.lit(1), n - 1))
    longer = closed.select(F.col("term").alias("whole"), F.col("weight").alias("own"), F.col("toxic").alias("own_toxic"), F.col("clean").alias("own_clean"), F.explode(begins_of).alias("term"))
    pairs = longer.join(closed.select("term", "weight", "toxic", "clean"), "term").withColumnRenamed("weight", "begin_weight")
    # What is left of a beginning without one of its longer terms must count by itself.
    left = pairs.select("term", "whole", "own", "begin_weight", (F.col("toxic") - F.col("own_toxic")).alias("toxic"), (F.col("clean") - F.col("own_clean")).alias("clean"))
    alone = (F.col("toxic") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT)
    goes = F.when(F.col("begin_weight") >= F.col("own"), F.col("whole")).when(~alone, F.col("term"))
    covered = weighed(left, n_toxic, n_clean).select(goes.alias("term")).where("term is not null").distinct()
    rows = closed.join(covered, "term", "left_anti").orderBy(F.desc("z"), "term").limit(most).collect()
    discarded(good)
    discarded(closed)
    return {r["term"]: round(r["weight"], 4) for r in rows}


class Matcher:
    """Finds a lexicon's terms in folded texts."""

    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[dict[int, float], list[int]]:
        """Where words that count begin, with the greatest weight of a term there; and where words begin that an exception holds."""
        found, spans = {}, []
        for end, (size, weight) in () if self.empty else self.automaton.iter(text):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > found.get(start, -math.inf):
                found[start] = weight
        out = [s for s in found if any(a <= s < b for a, b in spans)]
        return {s: w for s, w in found.items() if s not in out}, out


def learned_exceptions(train: DataFrame, lexicon: Lexicon, n_toxic: int, n_clean: int, most: int = MOST_EXCEPTIONS) -> list[str]:
    """Phrases of a matched word and its neighbour that clean texts have more often."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for part in text_slices(batches):
            rows = []
            for text in fold(part["text"]).to_pylist():
                own = set()
                for s in matcher.hits(text)[0]:
                    end = text.index(" ", s + 1)
                    if s:
                        own.add(text[text.rindex(" ", 0, s) : end + 1])
                    if end < len(text) - 1:
                        own.add(text[s : text.index(" ", end + 1) + 1])
                rows.append(list(own))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), part["toxic"]], names=["phrases", "toxic"])

    counts = counted(train.select("text", "toxic").mapInArrow(phrases, "phrases array<string>, toxic int"), "phrases")
    rows = weighed(counts, n_toxic, n_clean).where((F.col("clean") >= LEAST_TEXTS) & (F.col("z") <= -1) & (F.col("weight") < 0)).orderBy("z", "term").limit(most).collect()
    return [r["term"] for r in rows]


def density(total: float, n_words: int) -> float:
    """A text's weight for its length, on a logarithmic scale."""
    return math.log(total / (n_words + MORE_WORDS) + FLOOR)


def measured(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs' other columns with density, n_hits and n_excepted in place of text."""
    added = "density double, n_hits int, n_excepted int"
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for part in text_slices(batches):
            rows = []
            for text in fold(part["text"]).to_pylist():
                found, excepted = matcher.hits(text)
                rows.append((density(sum(found.values()), text.count(" ") - 1), len(found), len(excepted)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            made = [pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part[f.name] for f in rest), *made], names=[*(f.name for f in rest), "density", "n_hits", "n_excepted"])

    return docs.mapInArrow(measure, StructType([*rest, *StructType.fromDDL(added).fields]))


def fitted_curve(bins: list[tuple[float, int, int]], ridge: float = 0.01) -> tuple[float, float]:
    """bias and slope (0 at least) of a logistic curve through counts (density, toxic, clean), by Newton's method."""
    x = np.array([b[0] for b in bins])
    toxic, clean = (np.array([b[k] for b in bins], float) for k in (1, 2))
    features, weights = np.stack((np.ones(len(x)), x), axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        n = toxic + clean
        gradient = features.T @ (toxic - n * p) - ridge * weights
        hessian = (features * (n * p * (1 - p))[:, None]).T @ features + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    if weights[1] < 0:
        share = (toxic.sum() + 0.5) / (toxic.sum() + clean.sum() + 1)
        return math.log(share / (1 - share)), 0.0
    return float(weights[0]), float(weights[1])


def fit_toxicity(labelled: DataFrame, terms: dict[str, float] | None = None, exceptions: list[str] | None = None) -> Lexicon:
    """A lexicon from rows (text, toxic 0 or 1); terms and exceptions, given as plain words and phrases, are taken besides the learned ones.

    Each distinct text counts once, as toxic if a row of it is. Three of four, by a hash of the text, give the terms and exceptions; the
    others, which these haven't seen, the curve from density to score (all texts, if one class is missing among them).
    """
    whole = lambda x: fold(pa.array([x]))[0].as_py()
    text = F.coalesce("text", F.lit(""))
    train = written(labelled.where("toxic in (0, 1)").groupBy(F.xxhash64(text).alias("key")).agg(F.any_value(text).alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic")), "toxic-train")
    learn, rest = train.where("pmod(key, 4) <> 0"), train.where("pmod(key, 4) = 0")
    n_toxic, n_clean = learn.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    lexicon = Lexicon()
    if n_toxic and n_clean:
        lexicon.terms = chosen_terms(word_counts(learn), n_toxic, n_clean)
    lexicon.terms |= {whole(k): v for k, v in (terms or {}).items() if whole(k).strip()}
    if lexicon.terms and n_clean:
        lexicon.exceptions = learned_exceptions(learn, lexicon, n_toxic, n_clean)
    lexicon.exceptions += [whole(x) for x in exceptions or [] if whole(x).strip()]
    at = (F.floor(F.col("density") * BINS) / BINS).alias("at")
    for part in (rest, train):
        rows = measured(part.select("text", "toxic"), lexicon).groupBy(at).agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
        bins = [(r["at"] + 0.5 / BINS, r["toxic"], r["clean"]) for r in rows]
        if any(b[1] for b in bins) and any(b[2] for b in bins):
            break
    if bins:
        lexicon.bias, lexicon.slope = fitted_curve(bins)
    discarded(train)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs' other columns and RESULT, from text alone: the lexicon's weight in a text for its length, as a probability; predicted is 1 from 0.5 on.

    Look-alike letters of other scripts, hidden characters and digits or signs for letters are folded first; terms inside exception phrases don't count.

    Cases: null and empty texts have no hit and get the score of such texts; rows that repeat get equal scores; without labels of both classes and without given
    terms nothing is found; an empty table gives an empty result; a column with a name of RESULT gives way to the result.
    """
    added = [x.split()[0] for x in RESULT.split(", ")]
    rows = measured(docs.drop(*added, "density"), lexicon)
    score = 1 / (1 + F.exp(-(F.lit(lexicon.bias) + F.lit(lexicon.slope) * F.col("density"))))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*[c for c in rows.columns if c not in ("density", *added)], *added)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit_toxicity(labelled_sample(docs, labels.where(crc_mod("doc_id", 5) != 0)))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity(docs.select("doc_id", held_out.alias("held_out"), "text"), lexicon)
