"""Rules over source lines on a code base of our own: each rule fires where it should, and not beside it."""

from pyspark.sql import functions as F

from corpusloom.functions import fixed_values as V
from corpusloom.operators import audit, cluster, code_rules, conventions, costs, gate, resolve, rules, search, sites

FILES = {
    "src/ui/Dialog.tsx": [
        "import moment from 'moment';",
        "import { get } from 'lodash';",
        "import * as icons from '@mui/icons-material';",
        "import type { Theme } from './theme';",
        "import './side-effect';",
        "window.addEventListener('resize', run);",
        "const ob = new ResizeObserver(run);",
        "eval (code); evaluate(x); new  Function('a');",
        "localStorage . setItem('session_token', v); localStorage.setItem('color', v); sessionStorage.setItem('theme', v);",
        "const a = NEXT_PUBLIC_API_KEY, b = PUBLIC_URL, c = VITE_CLIENT_SECRET_2;",
        ".a { color: #FFF !important } /* #000 */",
        ".b { color: #1a2b3c; background: #abcdef }",
        '<div className="p-[13px] flex" />',
        "// eslint-disable-next-line react-hooks/exhaustive-deps",
    ],
    "app/page.tsx": ["// a comment", "'use client';", "", "import fs from 'node:fs';", "import path from './path';", "useState(1);"],
    "app/list/view.tsx": ["import { x } from './x';", "'use client';", "const [a] = useState(1);", "<Row onPick={run} />"],
    "src/clean.tsx": ["addEventListener('x', f); return () => removeEventListener('x', f);", "useEffect(f, []);"],
    "src/elements.tsx": [
        "<img src=\"a\"> <img alt='' src=\"a\"> <img {...rest}>",
        '<iframe src="a" /> <iframe title="t" />',
        '<ol onClick={a}> <svg onClick={a}> <td onClick={a} onKeyUp={b} role="x" tabIndex={0}> <td onClick={a} onKeyUp={b}>',
        '<a onClick={f}> <a onClick={f} href="/">',
        '<p tabIndex={2}> <p tabIndex="-1"> <p tabIndex={0}>',
        '<label aria-hidden="true"> <p aria-hidden="true"> <p aria-hidden tabIndex={-1}>',
        '<input> <input type="submit"> <select id="a"> <textarea {...x}> <textarea name="t">',
        '<svg role="img"> <svg role="img" aria-label="x">',
        "<div dangerouslySetInnerHTML={{ __html: a }} /> <div dangerouslySetInnerHTML={{ __html: DOMPurify.clean(a) }} />",
        "<a href={to}> <Link href={`/a`}> <a href={\"/b\"}> <link href={to}>",
        '<a target="_blank"> <a target="_blank" rel="noopener noreferrer"> <Link target={"_blank"}> <form target="_blank">',
        "<Row style={{ a: 1 }} items={[1]} /> <div style={{ a: 1 }} /> <Row style={css} />",
        "<Row onPick={() => go(1)} /> <Row onPick={x => x} /> <Row onPick={onPick} /> <button onClick={() => go(1)} />",
        "<li key={index}> <li key={ i }> <li key={item.id}> <li key={idx} autoFocus>",
    ],
}


def lines_of(spark):
    return spark.createDataFrame([(f, k, t) for f, own in FILES.items() for k, t in enumerate(own, 1)], "file string, line int, text string")


def test_code_rules(spark):
    tokens = spark.createDataFrame([("#1a2b3c",)], "token string")
    got = {}
    for r in code_rules.code_findings(lines_of(spark), tokens, is_next=True, tailwind=True).collect():
        got.setdefault(r.rule, []).append((r.file.split("/")[-1], r.line, r.hits))
    want = {
        "SEC-EVAL": [("Dialog.tsx", 8, 2)],
        "SEC-TOKEN-IN-STORAGE": [("Dialog.tsx", 9, 1)],
        "SEC-PUBLIC-ENV-SECRET": [("Dialog.tsx", 10, 2)],
        "STYLE-IMPORTANT": [("Dialog.tsx", 11, 1)],
        # A token that comes first hides the colour after it.
        "STYLE-HARDCODED-COLOR": [("Dialog.tsx", 11, 1)],
        "STYLE-ARBITRARY-VALUE": [("Dialog.tsx", 13, 1)],
        "PERF-HEAVY-IMPORT": [("Dialog.tsx", 1, 1), ("Dialog.tsx", 3, 1)],
        "LEAK-NO-TEARDOWN": [("Dialog.tsx", 1, 2)],
        "REACT-DEPS-SUPPRESSED": [("Dialog.tsx", 1, 1)],
        "NEXT-SERVER-MODULE-IN-CLIENT": [("page.tsx", 4, 1)],
        "NEXT-CLIENT-BOUNDARY-TOO-HIGH": [("page.tsx", 1, 1)],
        "NEXT-MISSING-USE-CLIENT": [("view.tsx", 1, 2)],
        "NEXT-RAW-IMG": [("elements.tsx", 1, 1)] * 3,
        "A11Y-IMG-ALT": [("elements.tsx", 1, 1)],
        "A11Y-IFRAME-TITLE": [("elements.tsx", 2, 1)],
        "A11Y-CLICK-NONINTERACTIVE": [("elements.tsx", 3, 1)] * 2,
        "A11Y-ANCHOR-NO-HREF": [("elements.tsx", 4, 1)],
        "A11Y-POSITIVE-TABINDEX": [("elements.tsx", 5, 1)],
        "A11Y-ARIA-HIDDEN-FOCUSABLE": [("elements.tsx", 6, 1)] * 2,
        "A11Y-FORM-LABEL": [("elements.tsx", 7, 1)] * 2,
        "A11Y-SVG-NO-NAME": [("elements.tsx", 8, 1)],
        "SEC-DANGEROUS-HTML": [("elements.tsx", 9, 1)] * 2,
        "SEC-HREF-EXPR": [("elements.tsx", 10, 1)],
        "SEC-TARGET-BLANK": [("elements.tsx", 11, 1)] * 2,
        "PERF-INLINE-LITERAL-PROP": [("elements.tsx", 12, 1)],
        "PERF-INLINE-FN-PROP": [("elements.tsx", 13, 1)] * 2,
        "PERF-INDEX-KEY": [("elements.tsx", 14, 1)] * 3,
        "A11Y-AUTOFOCUS": [("elements.tsx", 14, 1)],
    }
    assert {k: sorted(v) for k, v in got.items()} == want
    plain = {r.rule for r in code_rules.code_findings(lines_of(spark)).collect()}
    assert not any(r.startswith("NEXT-") for r in plain) and "STYLE-ARBITRARY-VALUE" not in plain and "STYLE-HARDCODED-COLOR" in plain
    assert code_rules.code_findings(lines_of(spark).limit(0), tokens, True, True).count() == 0
    odd = spark.createDataFrame([("f", 1, None), (None, 2, "eval(x)")], "file string, line int, text string")
    assert [r.rule for r in code_rules.code_findings(odd).collect()] == ["SEC-EVAL"]


def test_imports_and_directives(spark):
    got = {(r.file, r.line): (r.source, r.namespace, r.default_name, r.named, r.type_only) for r in code_rules.imports(lines_of(spark)).collect()}
    assert got["src/ui/Dialog.tsx", 2] == ("lodash", None, None, ["get"], False) and got["src/ui/Dialog.tsx", 3] == ("@mui/icons-material", "icons", None, [], False)
    assert got["src/ui/Dialog.tsx", 4] == ("./theme", None, None, ["Theme"], True) and got["src/ui/Dialog.tsx", 5] == ("./side-effect", None, None, [], False)
    both = spark.createDataFrame([("f", 1, "import React, { useState, useRef as r } from \"react\"")], "file string, line int, text string")
    assert code_rules.imports(both).first()[2:] == ("react", None, "React", ["useState", "useRef as r"], False)
    assert [(r.file, r.directive) for r in code_rules.directives(lines_of(spark)).collect()] == [("app/page.tsx", "use client")]


def test_public_secrets_by_purpose(spark):
    rows = [("f", 1, "NEXT_PUBLIC_STRIPE_PUBLISHABLE_TOKEN VITE_DB_PASSWORD"), ("f", 2, "GATSBY_API_KEY PUBLIC_URL"), ("f", 3, None)]
    got = sorted((r.line, r.severity) for r in rules.public_secrets(spark.createDataFrame(rows, "file string, line int, text string"), "file").collect())
    assert got == [(1, "critical"), (1, "medium"), (2, "critical")]


def test_call_sites(spark):
    lines = spark.createDataFrame([("a.tsx", 2, "<Row theme={theme} data-x={1} aria-y {...rest} /> <div />"), ("a.tsx", 4, "<Ui.Cell key={k} size={theme} />"), ("a.tsx", 9, "<Row b />"), ("b.tsx", 1, "<Row />")], "file string, line int, text string")
    bound = spark.createDataFrame([("a.tsx", "Row", "r"), ("a.tsx", "Ui", "u")], "file string, name string, target string")
    spans = spark.createDataFrame([("a.tsx", 1, 6, "Page"), ("a.tsx", 3, 5, "Inner")], "file string, first int, last int, owner string")
    found = sites.call_sites(code_rules.jsx_elements(lines), bound, spans)
    got = sorted((r.line, r.target, r.attrs, r.spread, r.owner) for r in found.collect())
    assert got == [(2, "r", ["theme"], True, "Page"), (4, "u", ["size"], False, "Inner"), (9, "r", ["b"], False, None)]
    assert sorted(map(tuple, sites.render_edges(found).collect())) == [("Inner", "u"), ("Page", "r")]
    own = spark.createDataFrame([("Page", "theme"), ("Inner", "other")], "target string, attribute string")
    assert [tuple(r)[:4] for r in sites.pass_edges(found, own).collect()] == [("Page", "r", "theme", "theme")]
    declared = spark.createDataFrame([("r", "theme", "Theme", True), ("r", "isOpen", "x", False), ("r", "c", "boolean", None)], "target string, attribute string, type string, required boolean")
    r = sites.prop_report(declared, found).first()
    assert [(p.name, p.passed_at, p.dead) for p in r.props] == [("theme", 1, False), ("c", 0, True), ("isOpen", 0, True)]
    assert (r.required_count, r.boolean_traps, r.never_passed, r.undeclared, r.spread_sites) == (1, 2, ["c", "isOpen"], ["b"], 1)
    assert sorted((r.target, r.usage_count, r.truncated) for r in sites.who_uses(found, 1).collect()) == [("r", 2, 1), ("u", 1, 0)]


def test_exports_and_owners(spark):
    e = spark.createDataFrame([("1", "f", "A", True, False), ("2", "f", "B", False, True), ("3", "g", "C", True, True)], "id string, file string, name string, exported boolean, is_default boolean")
    named = spark.createDataFrame([("g", "C"), ("f", "A")], "file string, name string")
    assert sorted(map(tuple, resolve.export_table(e, named).collect())) == [("f", "A", "1"), ("f", "default", "1"), ("g", "C", "3"), ("g", "default", "3")]
    spans = spark.createDataFrame([("f", 0, 5000, "long"), ("f", 100, 200, "short"), ("f", 9, 3, "void")], "f string, a long, b long, o string")
    places = spark.createDataFrame([("f", p) for p in (0, 99, 100, 200, 201, 5000, 5001)], "f string, p long")
    got = {r.p: r.o for r in resolve.owners(places, spans, "f", "p", "a", "b", "o", bin_width=64).collect()}
    assert got == {0: "long", 99: "long", 100: "short", 200: "short", 201: "long", 5000: "long"}


def test_search_filters(spark):
    rows = [
        (1, "ConfirmDialog", "src/ui/a.tsx", "source", "component", True, 9, ["open", "title"], ["useState"], ["Row"], ["div"]),
        (2, "confirm", "src/ui/b.stories.tsx", "story", "component", False, 9, ["open"], [], [], None),
        (3, "confirm", "src/ui/c.test.tsx", "test", "component", True, 9, ["open", "title"], ["useState"], ["Row"], []),
        (4, "useConfirm", "src/hooks/d.ts", "source", "hook", True, None, None, ["useState"], None, []),
    ]
    e = spark.createDataFrame(rows, "id long, name string, file string, file_class string, kind string, exported boolean, usage_count long, props array<string>, hooks array<string>, renders array<string>, hosts array<string>")
    ids = lambda **c: sorted(r.id for r in search.filtered(e, **c).collect())
    assert ids() == [1, 2, 4] and ids(with_tests=True) == [1, 2, 3, 4] and ids(kind="hook") == [4] and ids(file_part="UI/") == [1, 2]
    assert ids(exported=True) == [1, 4] and ids(min_usage=1) == [1, 2] and ids(props=["title", "open"]) == [1] and ids(hook="useState") == [1, 4] and ids(renders="Row") == [1]
    got = [(r.id, r.hits, r.score) for r in search.full_search(e, "confirm", None).collect()]
    assert got == [(1, 3000, 3900), (4, 3000, 3000), (2, 3000, 3900 - 1500 - 800)]
    assert [r.id for r in search.full_search(e, "", None).collect()] == [1, 2, 4]
    assert search.full_search(e, "open div", None).where("id = 1").first().hits == 2800


def test_contract_clusters(spark):
    rows = [
        (1, ["a", "b", "c", "d"], ["div"], ["x"], [], [], 5, 1, True),
        (2, ["a", "b", "c"], ["p"], ["y"], [], [], 2, 1, False),
        (3, ["a", "b", "c", "d"], ["li"], ["z"], [], [], 2, 9, False),
        (4, ["q"], ["div"], ["x"], [], [], 1, 1, False),
        (5, [], [], [], [], [], 1, 1, False),
    ]
    e = spark.createDataFrame(rows, "id long, props array<string>, hosts array<string>, names array<string>, renders array<string>, hooks array<string>, usage_count long, recency long, deprecated boolean")
    pairs, members = cluster.contract_clusters(e)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 800), (1, 3, 800), (2, 3, 800)]
    assert [(r["rank"], r.id, r.size, r.total_usage) for r in members.orderBy("rank").collect()] == [(1, 3, 3, 9), (2, 2, 3, 9), (3, 1, 3, 9)]
    assert [tuple(r) for r in cluster.duplicates(members).collect()] == [(1, 3, 9, 3)]


def test_convention_summary(spark):
    texts = spark.createDataFrame([("import { format } from 'date-fns'; a ?? b; error.message; x.user_id",), ("import dayjs from 'dayjs'; a ?? c; a.userId; b.userName",), (None,)], "text string")
    got = {r.convention: (r.verdict, r.winner, r.hits) for r in conventions.summary(conventions.pattern_counts(texts, "text", V.COUNTERS), V.CONVENTIONS).collect()}
    assert len(got) == 11 and got["dateFormatting"] == ("COMPETING", "date-fns", 1) and got["nullHandling"] == ("DOMINANT", "?? (nullish coalescing)", 2)
    assert got["forms"] == ("NONE-FOUND", None, 0) and got["wireCasing"] == ("COMPETING", "camelCase", 2)


def test_gate_checks(spark):
    diff = "--- a/x\n+++ b/x\n@@ -3 +5,3 @@\n-old\n\\ No newline at end of file\n+++ counter\n+-- y\n++++ b/not-a-file\n@@ -9,0 +20 @@\n+end\n--- a/z\n+++ b/z\n@@ -1 +0,0 @@\n-gone"
    added = gate.added_lines(spark.createDataFrame([(1, diff)], "id long, d string"), "id", "d")
    assert sorted(tuple(r)[1:] for r in added.collect()) == [("x", 5, "++ counter"), ("x", 6, "-- y"), ("x", 7, "+++ b/not-a-file"), ("x", 20, "end")]
    new = spark.createDataFrame([(1, "n", "a\nb")], "id long, file string, body string")
    assert sorted(tuple(r)[1:] for r in gate.with_untracked(added.limit(0), new, "id", "body").collect()) == [("n", 1, "a"), ("n", 2, "b")]
    paths = ["src/debug.ts", "a/untitled-1", "x.log", "x.ORIG", "src/test_x.py", "src/tested.ts", "src/mytmp/x.ts"]
    plan = spark.createDataFrame([("none",)], "path string")
    assert {r.path for r in gate.footprint(spark.createDataFrame([(p,) for p in paths], "path string"), plan).where("scratch").collect()} == set(paths[:5])
    lines = spark.createDataFrame([("see PLAN.md",), ("AC-12 done",), ("MAC-12",), ("D-x",), (None,)], "text string")
    assert gate.forbidden_references(lines).count() == 2
    groups, one = spark.createDataFrame([("a",), ("b",)], "g string"), spark.createDataFrame([("a",), ("a",)], "g string")
    assert sorted(map(tuple, gate.rollup({"x": one, "y": one.limit(0)}, groups, "g").collect())) == [("a", 2, 0, "BLOCK"), ("b", 0, 0, "PASS")]


def test_registries_pruning_and_costs(spark):
    present = spark.createDataFrame([("a-b", "x/a-b.md"), ("a-b", "y/a-b.md"), ("Bad", "Bad.md"), ("c", "d.md")], "name string, file string")
    known = spark.createDataFrame([("a-b",), ("gone",), ("c",)], "name string")
    assert sorted(map(tuple, audit.registry_check(present, known, file="file").collect())) == [("Bad", "bad-name"), ("Bad", "unregistered"), ("a-b", "duplicate"), ("c", "misnamed"), ("gone", "missing")]
    prior = spark.createDataFrame([("a", "1", "t"), ("b", "2", "t"), ("c", "3", "t"), ("d", "4", "t"), ("e", "5", "other")], "path string, sha string, tool string")
    fresh = spark.createDataFrame([("a", "t")], "path string, tool string")
    disk = spark.createDataFrame([("b", "2"), ("c", "changed"), ("e", "5")], "path string, sha string")
    assert sorted(map(tuple, audit.prune_plan(prior, fresh, disk, "path", "sha", ["tool"]).collect())) == [("b", "delete"), ("c", "keep"), ("d", "gone")]
    waves = costs.wave_costs(spark.createDataFrame([("f", 1000, 5000)], "f string, digest long, shards long"))
    got = {(r.size, r.wave): (r.agents, r.per_agent) for r in waves.collect()}
    assert len(got) == 4 * 13 and got["medium", "explore"] == (4, 1200 + 1400 + 1200 + 1000 + 1000) and got["micro", "synthesize"][0] == 0 and got["large", "design again"] == (4, 1200 + 3000 + 1200 + 1000)
    total = costs.forecast(waves, ["size"]).where("size = 'micro'").first()
    assert total.total == total.subtotal + int(total.subtotal * 0.12 + 0.5) and total.headroom == 400_000 - total.total


def test_bodies_with_other_names_cluster(spark):
    money = "export function formatMoney(cents) {\n  const value = cents / 100;\n  if (!value) return '0';\n  return '$' + value.toFixed(2);\n}"
    copy = money.replace("formatMoney", "toCurrency").replace("cents", "amount").replace("value", "v1").replace("100", "1000")
    other = "export const run = async () => { for (const x of list) { await x(); } }"
    rows = [(1, money), (2, copy), (3, other), (4, "a b"), (5, "a b"), (6, None)]
    got = sorted(map(tuple, cluster.body_clusters(spark.createDataFrame(rows, "id long, source string"), "id", "source").collect()))
    assert got == [(1, 1, 2), (2, 1, 2)]


def test_file_counts_and_neighbourhood(spark):
    lines = spark.createDataFrame([("a", 1, "useState(1); useState(2); useReducer(f)"), ("a", 2, "if (x && y) useEffect(f)"), ("a", 3, None), ("b", 1, "axios.get(u)")], "file string, line int, text string")
    got = {r.file: tuple(r)[1:] for r in code_rules.file_counts(lines).collect()}
    assert got == {"a": (3, 2, 1, 0, False, 3), "b": (1, 0, 0, 0, True, 1)}
    findings = spark.createDataFrame([("a", "high"), ("a", "low"), ("b", "high")], "file string, severity string")
    assert [tuple(r) for r in code_rules.neighbourhood(spark.createDataFrame([("a",), ("a",)], "file string"), findings).collect()] == [("a", 0, 1, 0, 1)]


def test_what_a_text_breaks_is_found_once_for_each_distinct_text(spark):
    """Lines with the same text have the same findings in every file, but for those that hang on the file; a rule's pattern meets a text once."""
    texts = ["'use client';", "import fs from 'fs';", "eval(x); eval(y);", "<img src='a.png'>", "setTimeout(run, 5);", "nothing", None]
    files = [("app/a/page.tsx", texts), ("src/b.tsx", texts[1:])]
    lines = spark.createDataFrame([(f, n + 1, t) for f, rows in files for n, t in enumerate(rows * 3)], "file string, line int, text string")
    out = code_rules.code_findings(lines, None, is_next=True)
    got = {(r.rule, r.file, r.line, r.hits) for r in out.collect()}
    for f, rows in files:
        at = [n + 1 for n, t in enumerate(rows * 3) if t == "eval(x); eval(y);"]
        assert {x for x in got if x[:2] == ("SEC-EVAL", f)} == {("SEC-EVAL", f, n, 2) for n in at}
        assert ("LEAK-NO-TEARDOWN", f, 1, 3) in got
    assert {x[1] for x in got if x[0] in ("NEXT-SERVER-MODULE-IN-CLIENT", "NEXT-CLIENT-BOUNDARY-TOO-HIGH")} == {"app/a/page.tsx"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "eval" not in plan and "setTimeout" not in plan


def test_the_gate_joins_orders_and_lines_once(spark):
    from corpusloom.jobs import code_jobs

    checks = code_jobs.gate_checks(spark, "/root/testdata/sf0.001")
    for name in ("secrets", "findings", "forbidden"):
        assert "lineitem.parquet" not in checks[name]._jdf.queryExecution().executedPlan().toString()
        assert not any(f.endswith("lineitem.parquet") for f in checks[name].inputFiles())


def test_elements_by_text_are_those_of_each_line(spark):
    rows = [(f, n, t) for f in "abc" for n, t in enumerate(["<W a={b} /><X.Y c />", "<W a={b} /><X.Y c />", "plain", None, "<img src='x' />"])]
    lines = spark.createDataFrame(rows, "file string, line int, text string")
    plain = lambda df: sorted(map(str, df.select("file", "line", "place", "tag", "attrs", "raw").collect()))
    found = code_rules.elements_by_text(lines)
    assert plain(found) == plain(code_rules.jsx_elements(lines)) and found.count() == 15
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()  # elements were searched before, once for a text
