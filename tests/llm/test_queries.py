"""The registered queries themselves on driver tables: SQL twins, brute force, exact round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from tokenizers import Tokenizer

import public_tokenizers
from corpusloom.llm import language_id, queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")


def documents(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def split(text):
    return (text or "").encode().split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    want = c.execute(queries.ORACLES[name])
    names = sorted(x[0] for x in want.description)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(got.columns) == names
    at = [[x[0] for x in want.description].index(n) for n in names]
    assert Counter(plain(r) for r in got.select(*names).collect()) == Counter(plain([r[i] for i in at]) for r in want.fetchall())


def test_op1_against_plain_python(spark):
    docs = documents(SMALL)
    got = {r.doc_id: r for r in queries.QUERIES["op1_language_id"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    learned = spark.read.parquet(f"{SMALL}/documents.parquet").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2")
    dictionaries = language_id.fit_dictionaries(learned)
    packers = {k: zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in dictionaries.items()}
    right = n = 0
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and 0 <= r.score <= 1
        text = language_id.letters_only(pa.array([d["text"]]))[0].as_py()
        if not text or not re.search(r"[^\W\d_]", text):
            assert r.lang_pred == "und"
            continue
        raw = text.encode()
        sizes = {k: sum(len(p.compress(raw[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(raw), language_id.BLOCK_BYTES)) for k, p in packers.items()}
        assert r.lang_pred == min(sizes, key=sizes.get)
        if r.held_out and d["lang"]:
            n, right = n + 1, right + (r.lang_pred == d["lang"])
    assert n > 20 and right >= 0.9 * n


@pytest.mark.parametrize(("name", "vocabulary", "end"), [("op2_token_files", "byte_bpe_50k.json", 2), ("op10_best_fit_packing", "word_bpe_49k.json", 0)])
def test_tokens_against_the_library(spark, name, vocabulary, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    ids = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, end] for d in documents(SMALL)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    rows = queries.QUERIES[name](spark, SMALL).collect()
    if end == 2:
        start = 0
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted(ids)
        for r in sorted(rows, key=lambda r: r.start):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), crc(ids[r.doc_id]))
            start += r.n_tokens
        return
    pieces = {(d, k): (a, x[a : a + 2048]) for d, x in ids.items() for k, a in enumerate(range(0, len(x), 2048))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == {k: (a, len(x), crc(x)) for k, (a, x) in pieces.items()}
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0 and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_op3_against_all_pairs(spark):
    docs = documents(LARGER)
    sets = {}
    for d in docs:
        w = lower(d["text"]).encode().split()
        sets[d["doc_id"]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(sets, key=lambda d: len(sets[d]))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if 100 * len(sets[a]) < 75 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op3_jaccard_join"](spark, LARGER).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()} and len({c for _, c in got.values()}) < len(docs)


def test_op5_gain_and_base(spark):
    rows = queries.QUERIES["op5_lm_scoring"](spark, LARGER).collect()
    counts = Counter()
    texts = {d["doc_id"]: [*lower(d["text"]).encode().split(), None] for d in documents(LARGER)}
    for d, w in texts.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = texts[r.doc_id]
        base = sum(np.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n) and abs(r.base_score - base) < 1e-6 * len(w)
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.03, gain


def test_op7_against_all_windows(spark):
    want, seen = {}, set()
    for d in sorted(documents(LARGER), key=lambda d: d["doc_id"]):
        w = split(d["text"])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = hashlib.md5(b" ".join(w[k : k + 20])).digest()
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d["doc_id"]] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op7_substring_dedup"](spark, LARGER).collect()} == want


def test_op9_against_all_passages(spark):
    docs, at = documents(LARGER), {}
    for d in docs:
        w = split(d["text"])
        for k in range(len(w) - 49):
            at.setdefault(hashlib.md5(b" ".join(w[k : k + 50])).digest(), set()).add(d["doc_id"])
    want = {}
    for d in docs:
        w = split(d["text"])
        words = {k + j for k in range(len(w) - 49) if len(at[hashlib.md5(b" ".join(w[k : k + 50])).digest()]) > 1 for j in range(50)}
        if words:
            want[d["doc_id"]] = words
    got = {}
    for r in queries.QUERIES["op9_suffix_dedup"](spark, LARGER).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


def test_op8_leaves_textless_rows_alone(spark):
    from corpusloom.llm.mixing import mix_sources

    rng = random.Random(1)
    rows = [(k, None if k % 3 else " ".join(["w"] * rng.randint(1, 30)), "a" if k % 2 else "b") for k in range(300)] + [(900, "", "only empty"), (None, None, None)]
    taken = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(taken) == 2 * len(rows) and all(r.taken == 0 for r in taken if r["size"] == 0)
    assert sum(r.taken for r in taken) == int(1.5 * sum(len((t or "").split()) for _, t, _ in rows))
