"""Parts of reports against values by hand: briefs, totals, sets in order, bounds, reasons, landings, density, toolchains."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import brief, gate, search, totals
from corpusloom.sources import settings


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_shards_keep_to_their_budget(spark):
    facts = [("f", "00-a", k, "x" * 7) for k in range(9)] + [("f", "10-b", 0, "y" * 100), ("g", "00-a", 0, "")]
    df = spark.createDataFrame(facts, "feature string, shard string, place int, text string")
    got = rows(brief.shards(df, ["feature"], [F.col("place")], 10))
    # Five lines of seven characters and four line feeds are 39 characters.
    assert got == [("f", "00-a", 5, 10, 4), ("f", "10-b", 0, 0, 1), ("g", "00-a", 1, 0, 0)]
    routed = brief.routed(spark.createDataFrame([("00-a", 5), ("10-b", 7), ("1", 1)], "shard string, tokens int"), {"r": ["00", "1"], "s": ["10", "10-b"], "t": ["9"]})
    assert rows(routed) == [("00-a", 5, "r"), ("1", 1, "r"), ("10-b", 7, "r"), ("10-b", 7, "s")]


def test_run_costs(spark):
    df = spark.createDataFrame([("f", "00-DIGEST.md", 100), ("f", "90-open-questions.md", 50), ("f", "70-risk.md", 1000), ("g", "40-routes.md", 7)], "feature string, shard string, tokens long")
    got = {(r.feature, r.size, r.step): (r.agents, r.per_agent, r.tokens) for r in brief.run_costs(df, ["feature"]).collect()}
    assert got["f", "medium", "intake"] == (2, 1200 + 150 + 1200, 2 * 2550)
    assert got["f", "medium", "plan-attack"][1] - got["g", "medium", "plan-attack"][1] == 1100
    assert got["f", "medium", "spec"][1] - got["g", "medium", "spec"][1] == 150
    assert len(got) == 2 * 4 * 13


def test_totals_and_sketches(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.choice(["x", None]), k % 2500, 2) for k in range(6000)]
    df = spark.createDataFrame(data, "p string, q string, v long, n long")
    got = {(r.p, r.q, r.level): r for r in totals.totals(df, ["p", "q"], {"sum": F.col("n")}, {"values": F.col("v")}).collect()}
    assert len(got) == 4 + 2 + 2 + 1
    for (p, q, level), r in got.items():
        own = [d for d in data if (level & 2 or d[0] == p) and (level & 1 or d[1] == q)]
        assert (r.n, r.sum) == (len(own), 2 * len(own))
        exact = len({d[2] for d in own})
        assert abs(r["values"] - exact) <= 0.06 * exact  # three times the sketch's standard error, and a little
    assert got[None, None, 3].n == 6000


def test_sets_in_order_and_bounds(spark):
    df = spark.createDataFrame([("k", 3, "a"), ("k", 1, "b"), ("k", 2, "a"), ("k", 4, "b"), ("m", 1, None)], "k string, at int, v string")
    assert rows(totals.ordered_distinct(df, ["k"], "v", ["at"])) == [("k", ["b", "a"]), ("m", [None])]
    report = rows(totals.bounded(df, "x", F.col("at"), [-F.col("at"), F.col("k")], 2))
    assert report == [("x", 0, "suppressed: 3"), ("x", 1, "4"), ("x", 2, "3")]
    assert rows(totals.bounded(df, "x", F.col("at"), [F.col("at")], 9).where("place = 0")) == []
    kinds = spark.createDataFrame([("component", False), ("hook", False), ("util", False), ("util", True), ("class", True), ("other", True)], "kind string, exported boolean").withColumn("source", F.lit("s"))
    assert rows(totals.kept_entities(kinds)) == [("class", True), ("component", False), ("hook", False), ("util", True)]


def test_reasons_and_clusters_of_precedents(spark):
    df = spark.createDataFrame([("RedButton", "src/red/x.tsx", ["button"], ["size"], 5, False, "test", False), ("Other", "x", [], [], 0, True, "source", True)], "name string, path string, hosts array<string>, props array<string>, n int, old boolean, class string, exported boolean")
    why = search.reasons("a red butt size button", F.col("name"), F.col("n"), F.col("old"), F.col("path"), F.col("hosts"), F.col("props"), F.col("class"), F.col("exported"))
    assert [r.w for r in df.select("name", why.alias("w")).orderBy(F.desc("name")).collect()] == [["name:red", "path:red", "name~butt", "prop:size", "name:button", "host:button", "usage:5", "class:test", "not-exported"], []]
    ranked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rank int, id string")
    members = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("z", "c2")], "id string, cluster string")
    assert rows(search.precedent_report(ranked, members), "rank", "cluster", "clusters") == [(1, "c1", 1), (2, "c1", 1), (3, None, 1)]


def test_landings_and_density(spark):
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 4)], "node long, component long")
    changed = spark.createDataFrame([(2,), (3,), (4,), (5,), (9,)], "node long")
    assert rows(gate.landed_clusters(members, changed)) == [(1, 2, 1), (4, 3, 2)]
    text = ["let a = 1; // one", "", "/* two", "three", "*/ let b = '// no';", 'let c = "/*";', "  ", "d(); /* four */", "e();", "// five /* ", "f();"]
    lines = spark.createDataFrame([("x", k, t) for k, t in enumerate(text)] + [("y", 1, " ")], "file string, line int, text string")
    assert rows(gate.comment_density(lines)) == [("x", 6, 9, 0.6667), ("y", 0, 0, 0.0)]


def test_picks_and_toolchains(spark):
    packages = [("a", '{"dependencies": {"react": "18.2", "zustand": "4", "vite": "5"}, "devDependencies": {"jest": "29", "typescript": "5"}, "workspaces": ["p/*"]}'), ("b", '{"dependencies": {"next": "14", "@tanstack/react-router": "1"}}'), ("c", '{"workspaces": {"packages": ["x"]}}'), ("d", '{"dependencies": {"@tanstack/react-router": "1", "react": "1"}}')]
    df = spark.createDataFrame(packages, "root string, text string")
    needed = settings.dependencies(df)
    files = spark.createDataFrame([("a", "pnpm-workspace.yaml"), ("b", "nx.json"), ("b", "turbo.json"), ("c", "nx.json")], "root string, path string")
    assert rows(settings.picks(needed), "root", "kind", "package", "version") == [("a", "state", "zustand", "4"), ("a", "testing", "jest", "29")]
    assert rows(settings.toolchains(needed, df, files)) == [("a", "18.2", True, "vite", "pnpm-workspaces"), ("b", None, False, "next", "nx"), ("c", None, False, "unknown", "npm/yarn-workspaces"), ("d", "1", False, "unknown", None)]
    routers = {r.root: r.router for r in settings.frameworks(needed, spark.createDataFrame([], "root string, path string")).collect()}
    assert routers == {"a": "unknown", "b": "pages", "d": "@tanstack/react-router"}
