"""Operators 11 to 13 against plain Python, and the faults of others that were mended with them."""

import hashlib
import os
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import hard_negatives, language_id, merkle, packing, queries, suffix_dedup, token_files, toxicity

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        run, slot = nodes[i - i % 3 : i - i % 3 + 3], i % 3
        out.append((slot, run[:slot] + run[slot + 1 :]))
        i //= 3
    return out


def manifest(rows):
    """All of op 11's columns for rows (doc_id, source, lang, n_chars, text), one tree after another in memory."""
    by_source = defaultdict(list)
    for row in rows:
        tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        now = (*row[:4], row[4].replace("\n", "")) if tampered else row
        by_source[row[1]].append((row[0] is not None, row[0] or 0, hashed(*map(field, row)), hashed(*map(field, now))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s])]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, leaf, now) in enumerate(sorted(by_source[s])):
            path, node = way(trees[k], i) + way(top, k), now
            for slot, others in path:
                node = hashed(*others[:slot], node, *others[slot:])
            out.append((doc_id if known else None, leaf, trees[k][-1][0], top[-1][0], hashed(*(x for _, others in path for x in others)), node, node == top[-1][0]))
    return Counter(out)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifested(df):
    tampered = F.coalesce(F.crc32(df["doc_id"].cast("string")) % 2 == 0, F.lit(False))
    now = F.when(tampered, F.replace(df["text"], F.lit("\n"), F.lit(""))).otherwise(df["text"])
    return Counter(tuple(r) for r in merkle.merkle_manifest(df, now).collect())


def test_merkle_nulls_ties_and_repeats(spark):
    rng = random.Random(3)
    ids = [None, None, 5, 5, 5, -1, -4097, 4095, 4096, 1 << 40, -(1 << 62), *range(30)]
    rows = [(rng.choice(ids), rng.choice([None, "", "a", "b", "é"]), rng.choice([None, "en"]), rng.choice([None, 0, 7]), rng.choice([None, "", "x\ny", "\n", "ü" * 9000])) for _ in range(700)]
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit("mine")).withColumn("tree", F.lit(1))
    got = manifested(df)
    assert got == manifest(rows) == manifested(df.repartition(2)) and {k[-1] for k in got} == {True, False}


def test_merkle_small_trees(spark):
    for n in (0, 1, 3, 4):
        rows = [(k, "s", None, k, "t\nt") for k in range(n)]
        assert manifested(spark.createDataFrame(rows, DOCS)) == manifest(rows)


def test_merkle_many_sources_and_groups(spark, monkeypatch):
    """Groups of 9 leaves, so that trees take several rounds."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "GROUP", 9)
    rows = [(k, f"s{k % 13}" if k % 3 else "hot", "en", k, f"text {k}\n") for k in range(1500)]
    assert sum(manifest(rows).values()) == 1500
    index = merkle.bitmaps(spark.createDataFrame([(t, d) for t in "ab" for d in range(9000)], "tree string, doc_id long")).collect()
    assert sum(r.n for r in index) == 18000 and {r.chunk for r in index} == {0, 1, 2}
    levels = merkle.reduced([hashed(str(k)) for k in range(7)], 2)
    assert [len(x) for x in levels] == [7, 3, 1] and merkle.folded(levels[0][4], merkle.path_in(levels, 4)) == levels[-1][0]
    assert manifested(spark.createDataFrame(rows, DOCS)) == manifest(rows)


@tables
def test_op11_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, LARGER).collect()) == manifest(rows)


def negatives(rows, k=5, most=3):
    """All of op 12's columns by Python's integers; rows (vec_id, label, vector), anchors those divisible by 50."""
    whole = [(v, label, [int(np.floor(256 * float(x))) for x in vector]) for v, label, vector in rows if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)]
    first = lambda found, n: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:n]
    out = []
    for i, (a, label, own) in enumerate(whole):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(own, other, strict=False)), v, other_label) for j, (v, other_label, other) in enumerate(whole) if j != i]
        for score, positive, _ in first([x for x in scored if x[2] == label], k):
            fitting = [x for x in scored if x[2] != label and 50 * score <= 100 * x[0] <= 95 * score]
            out += [(a, positive, n + 1, x[1], score, x[0]) for n, x in enumerate(first(fitting, most))]
    return Counter(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).withColumn("row", F.lit("x")).withColumn("rank", F.lit(1))
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect())


def test_hard_negatives(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.3, 0.5, 1.0]) for _ in range(6)]  # noqa: E731  few values: many ties
    rows = [(k, rng.choice([0, 0, 0, 1, 2, -3]), vector()) for k in range(400)]
    rows += [(None, 1, vector()), (None, 0, vector()), (50, 0, vector()), rows[100], (401, None, vector()), (402, 1, None), (403, 0, [1.0, None]), (404, 0, [float("nan")] * 6), (405, 0, [float("inf")] * 6), (450, 0, []), (451, 0, [0.7])]
    assert mined(spark, rows) == negatives(rows) and negatives(rows)
    assert not mined(spark, rows[:0])


def test_hard_negatives_of_large_components(spark):
    rows = [(k, k % 2, [float(1 << (17 + k % 5)), 0.5 * k, -3.25]) for k in range(60)]
    assert mined(spark, rows) == negatives(rows) and negatives(rows)


def test_exact_scores():
    rng = np.random.default_rng(1)
    for low, high, width in ((-160, 160, 64), (0, 2, 5), (-3, 1, 1), (-(1 << 30), 1 << 30, 7), (-(1 << 40), 1 << 40, 3)):
        a, c = (rng.integers(low, high, (n, width)).astype(float) for n in (5, 11))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
        assert hard_negatives.exact_scores(a, c).tolist() == want


@tables
def test_op12_against_plain_python(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, list(r.embedding)) for r in spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.QUERIES["op12_hard_negatives"](spark, LARGER).collect()) == negatives(rows)


def test_fold():
    given = ["Idiot", "1D10T!", "ІdіоТ", "tr@$h", "ＳＣＵＭ", "mo\u200bron", "call 555-0123 at 9", "c1own clown", None, "", "é ü ß"]
    want = [" idiot ", " idiot ", " idiot ", " trash ", " scum ", " moron ", " caii at ", " ciown ciown ", "  ", "  ", " é ü ß "]
    assert [unicodedata.normalize("NFC", x) for x in toxicity.fold(pa.array(given)).to_pylist()] == want


def test_matcher_counts_a_word_once_and_skips_exceptions():
    matcher = toxicity.Matcher(toxicity.Lexicon({" trash ": 2.0, " tra": 1.0, " scum ": 3.0}, [" trash can "]))
    assert matcher.hits(" trash trash can trade scum ") == ({0: 2.0, 16: 1.0, 22: 3.0}, [6])
    assert toxicity.Matcher(toxicity.Lexicon()).hits(" a ") == ({}, [])


def test_toxicity_learns_words_beginnings_and_exceptions(spark):
    rng = random.Random(2)
    plain = ["able", "bread", "cloud", "dream", "earth", "flame", "grape", "house", "wordy", "worth"]
    text = lambda *more: " ".join(rng.sample([rng.choice(plain) for _ in range(rng.randint(4, 30))] + list(more), k=4))

    def toxic():
        w = [rng.choice(plain) for _ in range(rng.randint(3, 25))]
        for _ in range(max(2, len(w) // 8)):
            w.insert(rng.randrange(len(w)), rng.choice(["worthless", "vequ" + rng.choice("abcdefghij") * 3, "junk"]))
        return " ".join(w)

    rows = [(text(), 0) for _ in range(400)] + [("we eat junk food " + text(), 0) for _ in range(20)] + [(toxic(), 1) for _ in range(120)]
    rows += [("one hot copy of it all", 1)] * 300 + [(None, 0), ("", 0), ("x", None)]
    lexicon = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, toxic int"))
    assert " worthies" in lexicon.terms and any(t.startswith(" vequ") and len(t) == 5 for t in lexicon.terms) and " wor" not in lexicon.terms
    assert not {" copy ", " hot "} & set(lexicon.terms)
    assert " junk food " in lexicon.exceptions
    tests = [(toxic(), 1) for _ in range(60)] + [(text(), 0) for _ in range(60)] + [("junk food " + text(), 0)] * 2 + [(None, 0), ("", 0), ("able " * 20000, 0), ("w0rthle$s vequaaa", 1)]
    got = toxicity.toxicity(spark.createDataFrame([(t, x, 1.5) for t, x in tests], "text string, want int, score double"), lexicon).collect()
    assert len(got) == len(tests) and sum(r.predicted != r.want for r in got) <= 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.toxicity(spark.createDataFrame([], "text string"), lexicon).collect() == []


def test_toxicity_without_labels_takes_given_terms(spark):
    rows = spark.createDataFrame([("a fool", 1), ("a fine day", 0)], "text string, toxic int")
    bare = toxicity.fit_toxicity(rows.limit(0), {"fool": 5.0}, ["fool's gold"])
    assert bare.terms == {" fooi ": 5.0} and bare.exceptions == [" fooi s goid "]
    assert [r.n_hits for r in toxicity.toxicity(rows, bare).orderBy("toxic").collect()] == [0, 1]


@tables
def test_op13_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = queries.QUERIES["op13_toxicity"](spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    own = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in own) >= 0.95 * len(own) and sum(b for a, b in own if a) >= 0.8 * sum(a for a, _ in own) > 0


def test_no_language_is_lost(spark):
    one = spark.range(20000).select(F.lit("le chat est sur la table").alias("text"), F.lit("fr").alias("lang"))
    rows = [("hi yo", "xx"), ("123", "yy"), (None, "zz"), *((f"word number {chr(97 + k % 26)}{chr(97 + k // 26)} of many", "en") for k in range(600))]
    got = language_id.fit_dictionaries(one.union(spark.createDataFrame(rows, "text string, lang string")))
    assert list(got) == ["fr", "en", "xx"] and got["fr"] == b"le chat est sur la table" and got["xx"].startswith(b"hi yo") and len(got["xx"]) >= 8
    assert 300 < len(got["en"].split(b"word number")) - 1 < 500


def test_dictionary_of_one_copied_text(spark):
    copies = spark.range(20000).select("id", F.lit("some words that all documents share " * 3).alias("text"))
    assert token_files.train_dictionary(copies, public_tokenizers.path("byte_bpe_50k.json"), 2) != b"\0" * 8


def test_token_files_with_one_id(spark, tmp_path):
    """Rows of one id fill several shards, in the same order every time."""
    rows = spark.createDataFrame([(None if k % 5 == 0 else 7, f"text {k % 50}") for k in range(200)], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    runs = []
    for k, parts in enumerate((2, 5)):
        shards = token_files.write_tokens(rows.repartition(parts), f"file://{tmp_path}/{k}", path, 2, docs_per_shard=40)
        assert shards.count() > 3
        runs.append(sorted((r.start, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(spark, f"file://{tmp_path}/{k}").collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 200


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [9007199254740993, None, 9007199254740995]
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in got} == set(ids) and {r.sequence_id for r in got} == {got[0].sequence_id}


def test_first_minima():
    rng = np.random.default_rng(3)
    for n, span in ((100, 20), (20, 20), (50, 1), (57, 7), (1000, 32)):
        values = rng.integers(0, 9, n).astype(np.uint64)
        assert suffix_dedup.first_minima(values, span).tolist() == [i + int(values[i : i + span].argmin()) for i in range(n - span + 1)]
