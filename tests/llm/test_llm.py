"""The ten operators on small fixtures, against plain Python: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from corpusloom.llm import common, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, packing, quality_rules, substring_dedup, suffix_dedup, token_files, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, digest string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base, passage = words(rng, 120), words(rng, 70)
    texts = [base, base, base + " tail end", words(rng, 90) + " " + passage + "\n" + words(rng, 20), passage + " " + words(rng, 60)]
    texts += [None, "", "   \n\t ", "one", "one", "One", "a b c", "É ü ß", "x" * 30000, words(rng, 9000), "line\nline\nline\n" * 20]
    texts += [words(rng, rng.randint(3, 200)) for _ in range(30)]
    # Near copies, a chain of them among these.
    chain = base.split()
    for k in range(8):
        chain = chain[:]
        chain[10 * k + 3] = "changed"
        texts.append(" ".join(chain))
    sources = ["a", "b", None, "ä", "c"]
    out = [(k, t, ["en", "de", None][k % 3], sources[k % 5], 1, True, "r", "d") for k, t in enumerate(texts)]
    out += [(None, base, "en", "a", 1, False, None, None), (3, texts[3], "en", None, 1, None, None, None), (3, texts[3], "en", None, 1, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def split(text):
    return (text or "").encode().split()


def test_words_and_slices():
    import pyarrow as pa

    texts = ["a b\x0bc\x1cd", None, "", " \t x \r\n", "É é\xa0z"]
    w = common.Words(pa.array(texts))
    got = [[w.vocabulary[i].as_py().encode() for i in w.index[w.bounds[k] : w.bounds[k + 1]]] for k in range(len(texts))]
    assert got == [split(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 1, 1, 200)])], names=["text"])
    assert [b.num_rows for b in common.text_slices([batch], limit=52)] == [1, 3, 1]


def test_exact_dedup(docs, rows):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = Counter((r[0], max((x for x in groups[r[1] or ""] if x is not None), default=None), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_quality_rules(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())

    def measures(r):
        text, w = r[1] or "", split(r[1])
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        repeats = len(covered)
        return (r[0], len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, len(w) < 50 or 100 * repeats > 50 * len(w))

    assert got == Counter(map(measures, rows))
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_thresholds_adapt(spark):
    rng = random.Random(3)
    plain = [(k, words(rng, 100), "en", "s") for k in range(300)]
    junk = [(1000 + k, " ".join(x + "#%" for x in words(rng, 100).split()), "en", "s") for k in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(300)) and not any(got[1000 + k] for k in range(5))


def test_mixing(spark, docs, rows):
    taken = mixing.mix_sources(docs)
    got = taken.groupBy("row_id", "doc_id", "source", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    total = sum(sizes.values())
    assert len(got) == len(rows) and all(r.source_size == sizes[r.source] for r in got)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in targets.items()) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == int(1.5 * total)
    again = mixing.mix_sources(docs.repartition(2)).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    first = taken.groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, first), key=str)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_jaccard_classes(docs, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()), key=str)
    sets = []
    for r in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)
    assert got == want
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def linked_classes(texts, percent=75):
    """The least place of the texts that links lead to from each, by comparing all pairs."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := split(t)) else frozenset() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_jaccard_in_many_chunks_and_blocks(spark, monkeypatch):
    """Small chunks, buckets and blocks, a hot signature, groups of near copies and half copies: no link is lost."""
    rng, texts = random.Random(21), []
    shared = words(rng, 60)
    for _ in range(6):
        base = words(rng, 100).split()
        for _ in range(12):
            near = base[:]
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(100)] = "changed" + str(rng.randrange(50))
            texts.append(" ".join(near))
    texts += [shared + " " + words(rng, rng.randint(5, 60)) for _ in range(80)]
    rng.shuffle(texts)
    real = jaccard_join.across_components
    monkeypatch.setattr(jaccard_join, "across_components", lambda rest, percent, nearest=False: real(rest, percent, nearest, block=3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, chunk_bytes=6000, bucket_hashes=500).collect()}
    want = linked_classes(texts)
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) < len(texts) - 20


def test_circles_open_without_whole_sets(spark):
    """Members of open circles come with the sketches that known has; elements need not be there, n."""
    drawn = jaccard_join.sketched([np.arange(k, k + 20, dtype=np.uint64).tobytes() for k in range(3)])
    known = spark.createDataFrame([(k + 1, 20, [1], drawn[k]) for k in range(3)], "set_id long, n long, circles array<long>, sketch binary")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    rest = jaccard_join.open_circles(known, links)
    assert {(r.circle, r.set_id, r.n_shingles, r.asks, bytes(r.sketch)) for r in rest.collect()} == {(1, k + 1, 20, k == 2, drawn[k]) for k in range(3)}
    pairs = jaccard_join.across_components(jaccard_join.open_circles(known, links, spark.createDataFrame([(3,)], "set_id long")), 75)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3), (2, 3)}
    several = spark.createDataFrame([(k + 1, 20, [1, 7, 8], drawn[k]) for k in range(3)], "set_id long, n long, circles array<long>, sketch binary")
    found = jaccard_join.across_components(jaccard_join.open_circles(several, links), 75, nearest=True).collect()
    assert [(r.a, r.b, r.several) for r in found] == [(3, 2, True)]


def test_last_circles_cost_a_row_a_set(spark):
    """Sets that are all nearly alike, linked or not: rows follow sets, not pairs, and what is linked is joined, in blocks and pieces too."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.sort(np.concatenate((rng.choice(base, 52, replace=False), rng.integers(0, 1 << 63, 1, dtype=np.uint64)))) for _ in range(40)]
    elements = [x.tobytes() for x in sets]
    known = spark.createDataFrame([(k, len(sets[k]), [7, 9], e, d) for k, (e, d) in enumerate(zip(elements, jaccard_join.sketched(elements), strict=True))], "set_id long, n long, circles array<long>, elements binary, sketch binary")
    linked = [(a, b) for a in range(40) for b in range(a) if jaccard_join.linked(len(np.intersect1d(sets[a], sets[b])), 53, 53, 75)]
    rest = jaccard_join.open_circles(known, spark.createDataFrame([linked[0]], "a long, b long"), known.select("set_id")).cache()
    pairs = jaccard_join.across_components(rest, 75).select("a", "b").distinct().count()
    assert pairs > 300 and 50 < len(linked) < pairs

    def components(links):
        label = list(range(40))
        for a, b in [linked[0], *links]:
            label = [label[a] if x == label[b] else x for x in label]
        return len(set(label))

    for block, piece in ((4096, 1 << 21), (7, 1 << 21), (4096, 600), (7, 60)):
        parts = jaccard_join.may_link(rest, 75, block, piece).cache()
        groups = parts.select("home", "i", "j", "root", "p", "q").distinct().count()
        found = [tuple(r) for r in jaccard_join.joining_links(parts.join(known.select("set_id", "elements"), "set_id"), 75).collect()]
        assert components(found) == components(linked) and set(found) <= {(b, a) for a, b in linked}
        assert len(found) <= parts.count() - groups
    assert jaccard_join.may_link(rest, 75).count() == 40


def test_sketches_in_slices_are_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 500, 1, 40, 900, 7)]
    whole = jaccard_join.sketches(np.concatenate(sets), np.array([len(x) for x in sets]))
    monkeypatch.setattr(jaccard_join, "SIGNED_ELEMENTS", 50)
    assert jaccard_join.sketched([x.tobytes() for x in sets]) == whole and jaccard_join.sketched([]) == []


def test_sketches_bound_from_below():
    rng = np.random.default_rng(2)
    sets = [rng.choice(3000, n, replace=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 5, 40, 130, 300, 700, 1500)]
    drawn = jaccard_join.Sketches(jaccard_join.sketches(np.concatenate(sets), np.array([len(s) for s in sets])))
    for x in range(len(sets)):
        others = np.array([y for y in range(len(sets)) if y != x])
        for y, apart in zip(others, drawn.apart(x, others), strict=True):
            assert apart <= len(np.setxor1d(sets[x], sets[y])) and (apart - len(sets[x]) - len(sets[y])) % 2 == 0


def test_signatures_are_complete():
    """Sets at the similarity's edge share a signature, whatever their size."""
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 20, 31, 50, 77, 120, 300, 800]:
        for _ in range(12):
            common = rng.integers(0, 2**63, n, dtype=np.uint64)
            extra = n // 3
            left = int(rng.integers(0, extra + 1))
            a = np.sort(np.concatenate((common, rng.integers(0, 2**63, left, dtype=np.uint64))))
            b = np.sort(np.concatenate((common, rng.integers(0, 2**63, extra - left, dtype=np.uint64))))
            assert jaccard_join.linked(n, len(a), len(b), 75)
            sigs, who = jaccard_join.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 75)
            assert set(sigs[who == 0].tolist()) & set(sigs[who == 1].tolist()), (n, left)


def test_substring_dedup(docs, rows):
    got = {}
    for r in substring_dedup.substring_dedup(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    seen = {}
    # The rows that repeat one id come in an order of their own; they are equal here, so that only the first keeps its words.
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        w = split(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.setdefault(key, r[0])
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (len(w), sum(gone), hashlib.sha256(kept).hexdigest()) in got[r[0]]
    assert sum(map(len, got.values())) == len(rows)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    assert substring_dedup.widths_of(20, 5) == [5, 10, 20] and substring_dedup.widths_of(7, 2) == [2, 4, 7]


def test_windows_differ_by_the_order_of_their_words(spark):
    own = np.array([3, 5, 7, 11, 13, 17, 19, 23], np.uint64)
    for k in range(7):
        swapped = own.copy()
        swapped[[k, k + 1]] = swapped[[k + 1, k]]
        assert common.window_hashes(own, 8)[0] != common.window_hashes(swapped, 8)[0]
    first = [f"w{k}" for k in range(20)]
    other = first[:2] + ["w3", "w2"] + first[4:]
    got = substring_dedup.substring_dedup(spark.createDataFrame([(1, " ".join(first)), (2, " ".join(other)), (3, " ".join(first))], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 0, 3: 20}


def test_substring_dedup_of_chunks_with_few_words(spark):
    for n in range(1, 7):
        text = " ".join("abcdef"[:n])
        got = substring_dedup.substring_dedup(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string").repartition(3))
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got.collect()) == [(k, n, 0) for k in range(3)]


def test_longer_doubling_agrees(docs):
    assert substring_dedup.substring_dedup.__defaults__[:2] == (20, 5)
    a = substring_dedup.substring_dedup(docs, 20, 20, chunk_bytes=20_000, bucket_hashes=700).drop("spans")
    b = substring_dedup.substring_dedup(docs, 20, 3).drop("spans")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_suffix_dedup(spark, docs, rows):
    plain = docs.where("doc_id is not null and doc_id <> 3")
    own = [r for r in rows if r[0] is not None and r[0] != 3]
    covered = {}
    for r in suffix_dedup.repeated_passages(plain).collect():
        assert r.n_words >= 50 and r.partner_id != r.doc_id
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    at = {}
    for r in own:
        w = split(r[1])
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(r[0])
    for r in own:
        w = split(r[1])
        need = {k + j for k in range(len(w) - 49) if len(at[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        assert need <= covered.get(r[0], set())
        if not need:
            assert r[0] not in covered
    assert suffix_dedup.repeated_passages(docs.limit(0)).count() == 0
    assert suffix_dedup.repeated_passages(docs).where("n_words < 50").count() == 0


def test_suffix_dedup_with_null_and_repeated_ids(docs, rows):
    """Rows that repeat an id, and those without one, are documents of their own."""
    at = {}
    for k, r in enumerate(rows):
        w = split(r[1])
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i : i + 50]), set()).add(k)
    want, got = Counter(), Counter()
    for k, r in enumerate(rows):
        w = split(r[1])
        covered = {i + j for i in range(len(w) - 49) if len(at[tuple(w[i : i + 50])]) > 1 for j in range(50)}
        want[r[0]] += len(covered)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r.doc_id] += r.n_words
    assert got == +want and got[None] and got[3]


def shared_words(texts, n=50):
    """For each text, the places of words that n-word passages cover which stand in another text too."""
    at = {}
    for k, t in enumerate(texts):
        w = split(t)
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for k, t in enumerate(texts):
        w = split(t)
        out[k] = {i + j for i in range(len(w) - n + 1) if len(at[tuple(w[i : i + n])]) > 1 for j in range(n)}
    return out


def suffix_covered(spark, texts, **sizes):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    out = {k: set() for k in range(len(texts))}
    for r in suffix_dedup.repeated_passages(docs, **sizes).collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_suffix_dedup_across_parts(spark):
    """Passages whose words are dealt over many parts and chunks are found whole."""
    rng, texts = random.Random(11), []
    for _ in range(60):
        passage = words(rng, 50)
        texts += [words(rng, rng.randint(5, 30)) + " " + passage + " " + words(rng, rng.randint(5, 30)) for _ in range(2)]
    covered = suffix_covered(spark, texts, bucket_hashes=20, chunk_bytes=5000)
    for k, need in shared_words(texts).items():
        assert need and need <= covered[k]


def test_suffix_dedup_around_common_cores(spark):
    """A core in thousands of documents hides no passage around it, and a second occurrence in a document counts as the first."""
    import xxhash

    rng = random.Random(12)
    own = lambda w: np.array([xxhash.xxh3_64_intdigest(x) for x in split(w)], np.uint64)
    # The least by the order of minimisers, so that it is kept in all passages around it.
    core = min((words(rng, 31) for _ in range(3000)), key=lambda w: int(common.mix64(common.window_hashes(own(w), 31) ^ np.uint64(0xA5A5A5A5))[0]))
    texts = [words(rng, rng.randint(0, 24)) + " " + core + " " + words(rng, rng.randint(0, 24)) for _ in range(3000)]
    for k in range(20):
        passage = words(rng, k) + " " + core + " " + words(rng, 19 - k)
        texts += [words(rng, 25) + " " + passage + " " + words(rng, 25) for _ in range(2)]
    again = words(rng, 9) + " " + core + " " + words(rng, 10)
    texts += [words(rng, 7) + " " + core + " " + words(rng, 40) + " " + again + " " + words(rng, 9), again]
    rng.shuffle(texts)
    need = shared_words(texts)
    assert sum(map(bool, need.values())) == 42
    assert suffix_covered(spark, texts) == need


def test_lm_scoring(docs, rows):
    got = lm_scoring.score_texts(docs).collect()
    assert len(got) == len(rows)
    counts, texts = Counter(), []
    for r in rows:
        w = [*re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode().split(), None]
        fold = None if r[0] is None else zlib.crc32(str(r[0]).encode()) % 10
        texts.append((r[0], fold == 0, w))
        if fold:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((d, held, len(w), sum(counts[x] > 0 for x in w), n, round(sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for d, held, w in texts)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(docs.limit(0)).count() == 0


def chunk_of(texts, ids):
    """A chunk as workers get it."""
    import pyarrow as pa

    from corpusloom.llm.chunks import Chunk, packed

    w = common.Words(pa.array(texts), lower=True)
    row = {"chunk": 1, "doc_ids": packed(np.array(ids)), "valid": packed(np.ones(len(ids), np.uint8)), "bounds": packed(w.bounds), "index": packed(w.index.astype(np.uint32))}
    import zstandard

    return Chunk(row | {"vocabulary": zstandard.compress(b" ".join(x.as_py().encode() for x in w.vocabulary))})


def test_token_scores_against_plain_python():
    """Each token's probability is that of its class, its group and its share, and all words' probabilities after a history sum to 1."""
    rng, gen = random.Random(4), np.random.default_rng(1)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(30)]
    t = lm_scoring.Tokens(chunk_of(texts, list(range(30))), 10)
    rows, n, kinds = 1 << 12, len(t.hashes), lm_scoring.CLASSES - 1
    known = lm_scoring.Known.__new__(lm_scoring.Known)
    known.counts = np.bincount(t.word[t.train], minlength=n)
    before = gen.integers(0, 4, (n, kinds)) * (known.counts > 0)[:, None]
    known.classes, known.groups = lm_scoring.classes_of(before, t.hashes), lm_scoring.groups_of(known.counts, t.hashes)
    assert known.classes[-1] == 0 and known.classes[:-1].min() >= 1 and known.classes.max() < 16 and known.groups.max() < 16
    leaf = known.classes * 16 + known.groups
    leaf_tokens = np.bincount(leaf, weights=known.counts, minlength=256).reshape(16, 16)
    leaf_types = np.bincount(leaf[known.counts > 0], minlength=256).reshape(16, 16)
    weights = gen.normal(size=(rows, 16)).astype(np.float32)
    got, at = lm_scoring.token_scores(weights, t, known, leaf_tokens, leaf_types), 0
    mix = lambda x: int(common.mix64(np.array([x % 2**64], np.uint64))[0])

    def chosen(features):
        z = sum(weights[f >> 52].astype(np.float64) for f in features)
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    for d in range(30):
        own = t.word[t.bounds[d] : t.bounds[d + 1]].tolist()
        for k, w in enumerate(own):
            one, two, three = (int(t.hashes[own[k - j]]) if k >= j else 0 for j in (1, 2, 3))
            f = [mix(x + j * 0x1000193) for j, x in enumerate([one, mix(two) + one, 0, mix(two + 2), mix(three + 3)], 1)]
            inside = lambda c: chosen([(x ^ mix(c + 77)) * 0x9E3779B97F4A7C15 % 2**64 for x in f[:3]])
            share = (known.counts[w] + 0.1) / (leaf_tokens[known.classes[w], known.groups[w]] + 0.1 * (leaf_types[known.classes[w], known.groups[w]] + 1))
            want = log10(chosen(f)[known.classes[w]] * inside(int(known.classes[w]))[known.groups[w]] * share)
            assert abs(got[at] - want) < 1e-4
            at += 1
    # All known words and an unknown one for each group.
    total = sum(chosen(f)[c] * inside(c)[g] * ((leaf_tokens[c, g] + 0.1 * leaf_types[c, g] + 0.1) / (leaf_tokens[c, g] + 0.1 * (leaf_types[c, g] + 1))) for c in range(16) for g in range(16))
    assert abs(total - 1) < 1e-6


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << 12, 16)).astype(np.float32)
    places, target = rng.integers(0, 1 << 12, (5, 50)).astype(np.uint16), rng.integers(0, 16, 50)
    places[0] = 7  # one feature at all tokens
    assert np.allclose(np.exp(lm_scoring.log_softmax(weights, places)).sum(axis=1), 1, atol=1e-5)
    squares, touched = np.full(len(weights), 1e-2, np.float32), np.zeros(len(weights), np.float32)
    before = lm_scoring.log_softmax(weights, places)[np.arange(50), target].sum()
    plain = weights.copy()
    gradient = np.exp(lm_scoring.log_softmax(weights, places))
    gradient[np.arange(50), target] -= 1
    lm_scoring.train_batch(weights, squares, touched, places, target)
    # One step by hand on the feature that all tokens have, and on one that a single token has.
    for line, row in ((0, 7), (1, int(next(p for p in places[1] if (places[1:] == p).sum() == 1)))):
        mean = gradient[places[line] == row].mean(axis=0)
        step = lm_scoring.RATE / 5 * mean / (np.sqrt(1e-2 + (mean**2).mean()) + 1e-3)
        assert np.allclose(weights[row], plain[row] - step, atol=1e-4) and touched[row] == (places == row).sum()
    for _ in range(5):
        lm_scoring.train_batch(weights, squares, touched, places, target)
    assert lm_scoring.log_softmax(weights, places)[np.arange(50), target].sum() > before


def test_language_id(spark, docs):
    rng = random.Random(2)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    kinds = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["sch", "ein", "ung", "be"], "cc": ["qu", "eux", "oi", "le"]}
    train = spark.createDataFrame([(lang, make(p, 80)) for lang, p in kinds.items() for _ in range(40)] + [(None, "x"), ("aa", None)], "lang string, text string")
    dictionaries = language_id.fit_dictionaries(train)
    assert sorted(dictionaries) == ["aa", "bb", "cc"]
    test = spark.createDataFrame([(k, lang, make(p, 30)) for lang, p in kinds.items() for k in range(20)], "k long, lang string, text string")
    got = language_id.identify(test, dictionaries).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 58 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? --"), (4, "\n"), (5, "\u0301\u0302 \u0903")], "k long, text string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.identify(odd, dictionaries).collect()} == {("und", 0.0, True)}
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), {}).collect()} == {"und"}
    many = spark.range(600).selectExpr("concat('l', lpad(id % 300, 3, '0')) as lang", "concat('some words ', id, ' of a text') as text")
    assert len(language_id.fit_dictionaries(many)) == 300
    # Equal languages: the text compresses alike, so that the first one wins and the margin rejects.
    tie = spark.createDataFrame([(k, "the same words in both") for k in ("x", "y")], "lang string, text string")
    r = language_id.identify(spark.createDataFrame([(1, "the same words", 9)], "k long, text string, score int"), language_id.fit_dictionaries(tie)).first()
    assert r.lang_pred == "x" and r.rejected and r.score == 0.5
    assert language_id.fit_dictionaries(train.limit(0)) == {} and language_id.identify(odd.limit(0), dictionaries).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(rows, name):
    import pyarrow as pa

    odd = [" lead", "a  b", "a\n\nb", "a\n b \nc", "don't we'll\nI'm", "tab\tx", "a\xa0b c", "é ́x Σ ΑΣ", "x <|endoftext|> y", "<|endoftext|>", "a<|startoftext|>b c", "a<|STARTOFTEXT|> b", "<|startoftext|><|endoftext|> x  y\n", "\n", " ", "a ", "日本 語 12 345", "c\x1cd e", "™ a™"]
    texts = [r[1] for r in rows] + odd
    coder, plain = tokens.Coder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):  # the second time from what is remembered
        got = coder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert got.values[got.bounds[k] : got.bounds[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_dictionary_sample_at_any_size(spark):
    share = lambda n: token_files.sample_limit(n, 2000) / (1 << 62)
    assert share(0) == share(2000) == 1 and abs(share(10**6) * 10**6 - 2000) < 1e-6 and abs(share(5 * 10**10) * 5 * 10**10 - 2000) < 1e-3
    assert token_files.sample_limit(10**30, 2000) == 1
    # Copies of one text are one sample.
    path = public_tokenizers.path("byte_bpe_50k.json")
    hot = spark.range(5000).selectExpr("id as doc_id", "if(id % 5 < 4, 'one hot text', concat('text ', id)) as text")
    few = spark.range(1001).selectExpr("id as doc_id", "if(id = 0, 'one hot text', concat('text ', id)) as text")
    assert len(token_files.train_dictionary(hot, path, 2)) > 8 and len(token_files.train_dictionary(few, path, 2)) > 8


def test_token_files(spark, docs, rows):
    path = common.new_path(spark, "test-tokens")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, docs_per_shard=20)
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    start = 0
    for r in got:
        raw = np.array(ids[r.doc_id], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids[r.doc_id]), zlib.crc32(raw), raw)
        start += r.n_tokens
    assert [x.tolist() for x in token_files.read_document(spark, path, 5)] == [ids[5]]
    assert len(token_files.read_document(spark, path, 3)) == 3 and token_files.read_document(spark, path, 10**6) == []
    with pytest.raises(ValueError):
        token_files.Shard(path, got and 0, b"another dictionary")
    empty = common.new_path(spark, "test-tokens")
    token_files.write_tokens(docs.limit(0), empty, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 0, capacity=256).collect()
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 256)):
            want[(r[0], k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()))] += 1
    assert pieces == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert len(bins) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(docs.limit(0), path).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    for kind in range(5):
        lengths = rng.integers(1, 60 + 30 * kind, 400)
        b = packing.Bins(lengths, 100 + 20 * kind)
        before, squares = (b.fill > 0).sum(), (b.fill**2).sum()
        b.search()
        assert (b.fill > 0).sum() <= before and (b.fill**2).sum() >= squares and b.fill.max() <= b.capacity
        assert np.array_equal(np.bincount(b.bin_of, weights=lengths, minlength=len(b.fill)), b.fill)
    b = packing.Bins(np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10)
    b.search()
    assert (b.fill > 0).sum() == 3
