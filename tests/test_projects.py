"""Components, module resolution, ignore files and type members against plain Python."""

import posixpath
import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import components, ignore, resolve, types


def graph(rng, n, edges):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(edges)]


def reach(edges, a):
    seen, queue = {a}, [a]
    while queue:
        x = queue.pop()
        for s, d in edges:
            if s == x and d not in seen:
                seen.add(d)
                queue.append(d)
    return seen


def test_strongly_connected(spark):
    rng = random.Random(4)
    long = [(100 + k, 100 + (k + 1) % 9) for k in range(9)]  # a cycle of nine
    chain = [(200 + k, 201 + k) for k in range(6)]
    for edges in (graph(rng, 40, 45) + long + chain + [(3, 100), (104, 200), (300, 300)], graph(rng, 12, 14), long[:3]):
        df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (1, None)], "src long, dst long")
        got = {r.node: r.component for r in components.strongly_connected(df).collect()}
        to = {n: reach(edges, n) for e in edges for n in e}
        assert got == {n: min(m for m in to[n] if n in to[m]) for n in to}
    assert components.strongly_connected(df.limit(0)).count() == 0


def test_components_pass_no_labels_through_the_driver(spark, monkeypatch):
    """Joins of labels and edges are no broadcasts, however small the tables are; a cycle and an edge out of it."""
    plans, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    found = components.strongly_connected(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 3}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def undirected(edges):
    both = edges + [(b, a) for a, b in edges]
    return {n: min(reach(both, n)) for e in edges for n in e}


def test_grown_components(spark):
    rng = random.Random(6)
    old = [(a + 1000, b + 1000) for a, b in graph(rng, 60, 30)]
    labels = components.connected_components(spark.createDataFrame(old, "src long, dst long"))
    for new in ([(a + 1000, b + 1000) for a, b in graph(rng, 60, 6)], [(5, 6), (6, 1003), (7, 7)], [(old[0][0], old[0][1])], [(2000, 1), (1, 2001), (None, 4)]):
        got = components.grown_components(labels, spark.createDataFrame(new, "src long, dst long")).collect()
        want = undirected(old + [e for e in new if None not in e])
        before = undirected(old)
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
        assert {r.node for r in got if r.moved} == {n for n in want if before.get(n) != want[n]}
    assert {r.moved for r in components.grown_components(labels, spark.createDataFrame([], "src long, dst long")).collect()} == {False}


def meant(files, aliases, base, path, spec):
    """The file that a specifier means, tried one after another."""

    def found(p):
        if p.startswith("..") or p.startswith("/"):
            return None
        tries = [p] if posixpath.splitext(p)[1] or re.search(r"[^/]\.$", p) else []
        tries += [p + e for e in resolve.EXTENSIONS]
        bare = re.sub(resolve.SWAPPED, "", p)
        tries += [bare + e for e in resolve.EXTENSIONS] if bare != p else []
        tries += [posixpath.join(p, f"index{e}") for e in resolve.EXTENSIONS]
        return next((posixpath.normpath(t) for t in tries if t in files), None)

    if spec.startswith("."):
        whole = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
        if re.search(r"/$", spec):
            return next((t for e in resolve.EXTENSIONS for t in [posixpath.normpath(posixpath.join(whole, f"index{e}"))] if t in files and not t.startswith("..")), None)
        return found("" if whole == "." else whole)
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        if star and not (spec.startswith(head) and spec.endswith(tail)) or not star and spec != pattern:
            continue
        middle = spec[len(head) : max(len(head), len(spec) - len(tail))]
        for t in targets:
            hit = found(posixpath.normpath(t.replace("*", middle, 1) if star else t))
            if hit:
                return hit
    return None if spec.startswith("/") else found(posixpath.normpath(posixpath.join(base, spec)))


def test_resolution_in_full(spark):
    rng = random.Random(8)
    names, exts = ["a", "b", "ui", "x.y"], [*resolve.EXTENSIONS, ".css", ".d.ts"]
    files = {"/".join(rng.choice(["src", "lib", "ui", "a"]) for _ in range(rng.randint(0, 2))) for _ in range(4)}
    files = {posixpath.join(f, rng.choice([*names, "index"]) + rng.choice(exts)) for f in files | {"", "src", "src/ui"} for _ in range(7)}
    aliases = [("@/*", ["none/*", "src/*"]), ("@ui", ["src/ui", "lib/ui"]), ("*.view", ["src/*", "*"]), ("@/a*", ["lib/a*"]), ("~*x", ["*/index"])]
    specs = [".", "..", "./", "../", "./a", "./a.js", "./b.mjs", "../ui", "../../..", "./x.y", "./a.css", "./../src/ui/", "../a.", "/src/a", "react", "src/a", "lib", "@scope/p/q", "@ui", "@uix", "~x", "~srcx", "a.view", "ui/a.view"]
    specs += [f"@/{n}" for n in [*names, "a.jsx", "ui/a", "ui", ""]]
    paths = ["src/ui/a.ts", "main.ts", "src/a.ts"]
    rows = [(p, s) for p in paths for s in specs]
    alias_rows = [(k, p, j, t) for k, (p, targets) in enumerate(aliases) for j, t in enumerate(targets)]
    df = spark.createDataFrame([*rows, rows[0]], "path string, source string")
    known = spark.createDataFrame([(f,) for f in files], "path string")
    table = spark.createDataFrame(alias_rows, "place int, pattern string, target_place int, target string")
    for base in ("", "src"):
        bases = spark.createDataFrame([(base,)], "base string") if base else None
        got = {(r.path, r.source): r.resolved for r in resolve.resolve_modules(df, known, table, bases).collect()}
        want = {(p, s): meant(files, aliases, base, p, s) for p, s in rows}
        assert got == want and sum(v is not None for v in want.values()) > 20
    two = resolve.resolve_modules(
        spark.createDataFrame([("p", "m.ts", "@/a"), ("q", "m.ts", "@/a"), ("q", "m.ts", "./n")], "root string, path string, source string"),
        spark.createDataFrame([("p", "s/a.ts"), ("q", "t/a.ts"), ("p", "n.ts")], "root string, path string"),
        spark.createDataFrame([("p", 0, "@/*", 0, "s/*"), ("q", 0, "@/*", 0, "t/*")], "root string, place int, pattern string, target_place int, target string"),
        by=("root",),
    )
    assert sorted(map(tuple, two.collect()), key=str) == sorted([("p", "m.ts", "@/a", "s/a.ts"), ("q", "m.ts", "@/a", "t/a.ts"), ("q", "m.ts", "./n", None)], key=str)


def glob_match(pattern, path, anchored):
    """Whether a pattern matches from one of the places where it may start to a segment's end, one character after another."""

    def ends(p, i):
        if not p:
            return {i}
        if p.startswith("**"):
            rest = p[3:] if p[2:3] == "/" else p[2:]
            return {e for j in range(i, len(path) + 1) for e in ends(rest, j)}
        if p[0] == "*":
            stop = path.find("/", i)
            return {e for j in range(i, (len(path) if stop < 0 else stop) + 1) for e in ends(p[1:], j)}
        if i < len(path) and (p[0] == path[i] or p[0] == "?" and path[i] != "/"):
            return ends(p[1:], i + 1)
        return set()

    starts = [0] if anchored else [0, *(k + 1 for k, c in enumerate(path) if c == "/")]
    return any(e == len(path) or path[e] == "/" for s in starts for e in ends(pattern, s))


def test_nested_ignore_files(spark):
    rng = random.Random(9)
    folders = ["", "a", "a/b", "a/b/c", "d"]
    paths = sorted({"/".join([*f.split("/")[: len(f) and 9], rng.choice(["x.log", "keep.log", "b", "a.b", "dist/m.js", "we ird", "p[1]"])]).lstrip("/") for f in folders for _ in range(9)})
    texts = {
        "": "*.log\n# no\n\n  dist/  \r\n/d/keep*\nb\n" + "z" * 600,
        "a": "!keep.log\nb/**/x*\n**/c\n!/b/c\np[1]",
        "a/b": "?.b\n*\n!c\n!*.log\nwe\\ ird",
        "d": "**\n!a**b\n!dist",
        "nowhere": "*",
    }
    rules = ignore.ignore_rules(spark.createDataFrame(list(texts.items()), "folder string, text string"))
    assert rules.where("folder = ''").count() == 4
    got = {r.path: r.ignored for r in ignore.ignored_paths(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string"), rules).collect()}

    def want(path):
        out = False
        for folder in sorted(texts, key=lambda f: (f.count("/") + bool(f))):
            if folder and not path.startswith(folder + "/"):
                continue
            for raw in re.split(r"\r?\n", texts[folder]):
                p = raw.strip()
                if not p or p.startswith("#"):
                    continue
                negate, p = p.startswith("!"), p.removeprefix("!").replace("\\ ", " ").removesuffix("/")
                if len(p.removeprefix("/")) <= 512 and glob_match(p.removeprefix("/"), path[len(folder) + bool(folder) :], "/" in p):
                    out = not negate
        return out

    assert got == {p: want(p) for p in paths} | {None: False} and {True, False} == {*got.values()}


def test_members_of_types(spark):
    rng = random.Random(10)
    names = [f"T{k}" for k in range(8)]
    declared = [("f", n) for n in names] + [("g", "T0")]
    members = [(f, t, p, rng.choice("uvwxyz"), f"{t}.{p}") for f, t in declared for p in range(rng.randint(0, 3))]
    refs = [(f, t, p, rng.choice([*names, "Gone", "T1<A, B<C>>"])) for f, t in declared for p in range(rng.randint(0, 3))]

    def walk(file, name, seen):
        if name in seen:
            return [], []
        seen.add(name)
        if (file, name) not in declared:
            return [], [name]
        own, missing = [(m[3], name, m[4]) for m in sorted(members) if m[:2] == (file, name)], []
        for r in sorted(r for r in refs if r[:2] == (file, name)):
            more, gone = walk(file, re.sub("<.*", "", r[3]), seen)
            own, missing = own + more, missing + gone
        return own, missing

    resolved, unresolved = types.resolved_members(
        spark.createDataFrame(declared, "file string, type string"),
        spark.createDataFrame(members, "file string, type string, place int, member string, kind string"),
        spark.createDataFrame(refs, "file string, type string, place int, parent string"),
    )
    want, missing = {}, set()
    for f, t in declared:
        own, gone = walk(f, t, set())
        for name, at, kind in own:
            want.setdefault((f, t, name), (at, kind))
        missing |= {(f, t, n) for n in gone}
    assert {(r.file, r.type, r.member): (r.declared_in, r.kind) for r in resolved.collect()} == want
    assert {tuple(r) for r in unresolved.collect()} == missing and missing


def test_members_of_types_meet_once_and_large_files_are_dealt_out(spark):
    """A file's rows are shuffled once, not in rounds; a file with many types is walked by several tasks, with the same result."""
    rng = random.Random(3)
    types_ = [(f, f"T{k}") for f, n in (("f", 60), ("g", 5), ("h", 1)) for k in range(n)]
    size = {"f": 60, "g": 5, "h": 1}
    members = [(f, t, p, rng.choice("uvwxyz")) for f, t in types_ for p in range(rng.randint(0, 3))]
    refs = [(f, t, p, f"T{rng.randrange(size[f] + 1)}") for f, t in types_ for p in range(rng.randint(0, 2))]
    tables = spark.createDataFrame(types_, "file string, type string"), spark.createDataFrame(members, "file string, type string, place int, member string"), spark.createDataFrame(refs, "file string, type string, place int, parent string")
    whole = types.walked_members(*tables)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(file") == 2  # rows, and numbers of types
    rows = sorted(map(str, whole.collect()))
    assert rows == sorted(map(str, types.walked_members(*tables, starts=7).collect())) and len(rows) > 200


def test_resolution_sends_only_aliases_to_all_tasks(spark):
    """Specifiers and files grow with the code base, whatever Spark guesses their size to be."""
    files = spark.range(50).select(F.concat(F.lit("src/f"), "id", F.lit(".ts")).alias("path"))
    imports = files.select("path", F.explode(F.array(F.lit("./f1"), F.lit("@/f2"), F.lit("lodash"))).alias("source"))
    found = resolve.resolve_modules(imports, files, {"@/": "src/"})
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    assert {(r.source, r.resolved) for r in found.collect()} == {("./f1", "src/f1.ts"), ("@/f2", "src/f2.ts"), ("lodash", None)}


def test_resolution_shuffles_few_rows(spark, tmp_path):
    """A specifier goes out once for each path that it may mean, not for each kind of answer, and what is found comes back once; orders with nulls are files as others are."""
    from datetime import datetime

    from corpusloom.jobs import project_jobs

    rng = random.Random(2)
    orders = [(k, rng.randint(1, 9), rng.choice(list(project_jobs.PRIORITIES)), datetime(1990 + rng.randrange(9), 1, 1)) for k in range(300)]
    orders += [(301, None, "2-HIGH", datetime(1995, 1, 1)), (302, 3, "2-HIGH", None), (303, 4, "none", datetime(1995, 1, 1)), (304, 5, "none", datetime(1995, 1, 1)), (None, 6, "2-HIGH", datetime(1997, 1, 1)), (-5, 6, "5-LOW", datetime(1997, 1, 1))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp").repartition(2).write.parquet(f"{tmp_path}/orders.parquet")
    found = project_jobs.resolved_files(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*\b(kind|isnull)", plan)
    rows = [(r.path, r.source, r.resolved) for r in found.collect()]
    want = set()
    paths = {(c, k, d and d.year): c and d and project_jobs.PRIORITIES.get(p) and f"src/c{c}/{d.year}{project_jobs.PRIORITIES[p]}" for k, c, p, d in orders}
    for (c, k, y), path in paths.items():
        up = ["..", "../x/.."][k % 3] if k is not None and 0 <= k and k % 3 < 2 else "../../src"
        with_year = [f"./{y}", f"./{y}/", f"./{y}.tsx"] if y else []
        with_both = [f"{up}/c{c + 1}/{y}.js", f"@/c{c + 1}/{y}", f"~{c + 1}/{y}.view", f"src/c{c + 1}/{y}.mjs", f"../../../c{c}/{y}"] if y and c else []
        missing = [None] if not (y and c) else []
        want |= {(path, source) for source in [*with_year, *with_both, *missing, "home", "@scope/lib/x"]}
    assert len(rows) == len(want) and {r[:2] for r in rows} == want
    files = {p for p in paths.values() if p}
    aliases = {}
    for _, pattern, _, target in sorted(project_jobs.ALIASES):
        aliases.setdefault(pattern, []).append(target)
    for path, source, resolved in rows:
        if path and source:
            assert resolved == meant(files, list(aliases.items()), "", path, source)
