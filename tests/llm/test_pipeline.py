"""The pipeline's stages on a small table with planted copies, against what is expected of each."""

import random

import pytest

import corpus_pipeline
from corpusloom.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    kinds = [("en", ["th", "er", "on", "ing"]), ("de", ["sch", "ein", "ung", "be"])]
    rows = []
    for k in range(60):
        lang, parts = kinds[k % 2]
        rows.append((k, make(parts, 90), lang, f"s{k % 3}"))
    near = rows[0][1].split()
    near[45] = "different"
    rows += [(100, rows[1][1], "de", "s0"), (101, " ".join(near), "en", "s1"), (102, None, "en", "s1"), (103, "12 34 !!", None, None), (104, "", "en", "s2")]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(*r, 1, True, "row", "key") for r in rows], SCHEMA)


def test_stages(spark, docs):
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, ""), f"test-{name}")
        assert at.columns == docs.columns
        kept[name] = sorted(r.doc_id for r in at.select("doc_id").collect())
    assert kept["language_id"] == sorted([*range(60), 5, 5, 100, 101])
    assert kept["exact_dedup"] == sorted([*(set(range(60)) - {1}), 100, 101])
    assert kept["jaccard_join"] == sorted([*(set(range(60)) - {1}), 100])
    assert set(kept["mixing"]) <= set(kept["jaccard_join"]) and max(kept["mixing"].count(d) for d in kept["mixing"]) <= 2
    words = lambda ids: 90 * len(ids)
    assert abs(words(kept["mixing"]) - 1.5 * words(kept["jaccard_join"])) <= 90 * 3
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "")
    assert packed.where("start = 0").count() == len(kept["mixing"])
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_empty_table(spark, docs):
    at = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, ""), f"empty-{name}")
    assert at.count() == 0


def test_near_copies_by_row(spark):
    """Repeated and null ids of unequal texts: one row of each class stays, and each row that has none."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    a, c, d = words(80), words(80), words(80)
    near = [" ".join([*a.split()[:k], "odd", *a.split()[k + 1 :]]) for k in (20, 60)]
    rows = [(1, a), (3, near[0]), (3, c), (None, near[1]), (None, d), (None, d), (7, None), (7, ""), (None, None), (9, c.upper()), (3, c)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (3, c), (None, d), (7, ""), (None, "")], key=str)
    only = spark.createDataFrame([(None, a, "en", "s", 1), (None, near[0], "en", "s", 1)], docs.schema)
    assert corpus_pipeline.drop_near_copies(spark, only, "").count() == 1
