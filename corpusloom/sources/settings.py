"""Projects' settings as tables: packages, frameworks, aliases and ignored folders of many projects at once.

All inputs are tables with a project (root), and a path or text of one of its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frameworks by the package that tells of them, the first that a project has is its own; and those that the rules know.
FRAMEWORKS = [("next", "next"), ("react", "react"), ("angular", "@angular/core"), ("vue", "vue"), ("svelte", "svelte"), ("solid", "solid-js"), ("remix", "@remix-run/react")]
SUPPORTED = ["next", "react"]
#: Fixed value: an alias in a bundler's settings.
BUNDLER_ALIAS = r"['\"]([@~][\w./-]*)['\"]\s*:\s*(?:path\.resolve\([^,]*,\s*)?['\"]([^'\"]+)['\"]"
#: The packages of each kind of work, in the order in which they are told.
PICKS = {
    "state": ["redux", "@reduxjs/toolkit", "zustand", "jotai", "recoil", "mobx", "valtio", "xstate", "effector"],
    "server_state": ["@tanstack/react-query", "react-query", "swr", "@apollo/client", "urql", "relay-runtime", "trpc", "@trpc/client"],
    "styling": ["tailwindcss", "styled-components", "@emotion/react", "@stitches/react", "sass", "vanilla-extract", "@vanilla-extract/css", "unocss"],
    "ui": ["@mui/material", "antd", "@chakra-ui/react", "@mantine/core", "react-bootstrap", "@radix-ui/react-dialog", "shadcn-ui", "@headlessui/react"],
    "forms": ["react-hook-form", "formik", "zod", "yup", "@hookform/resolvers"],
    "i18n": ["react-i18next", "next-intl", "i18next", "react-intl", "lingui"],
    "testing": ["jest", "vitest", "@testing-library/react", "@testing-library/user-event", "playwright", "@playwright/test", "cypress", "@storybook/react", "msw"],
    "a11y": ["eslint-plugin-jsx-a11y", "axe-core", "@axe-core/react", "jest-axe", "@axe-core/playwright"],
    "perf": ["@next/bundle-analyzer", "webpack-bundle-analyzer", "rollup-plugin-visualizer", "size-limit", "lighthouse", "web-vitals"],
    "visual": ["@storybook/test-runner", "chromatic", "@percy/cli", "jest-image-snapshot", "loki"],
}
#: Bundlers by package, and kinds of workspaces by the file that tells of them; the first that a project has is its own.
BUNDLERS = ["vite", "next", "webpack", "parcel"]
WORKSPACES = [("pnpm-workspace.yaml", "pnpm-workspaces"), ("", "npm/yarn-workspaces"), ("nx.json", "nx"), ("turbo.json", "turborepo")]
MAP = "map<string, string>"


def loose_json(text: Column) -> Column:
    """JSON text without comments and trailing commas; addresses in strings keep their slashes."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?m)(^|[^:\"'\\])//.*$", "$1"), r",(\s*[}\]])", "$1")


def dependencies(packages: DataFrame, text: str = "text") -> DataFrame:
    """root, package, version from package files: those needed to run, to develop and from peers; of several the last counts. Broken files give none."""
    fields = F.from_json(text, f"dependencies {MAP}, devDependencies {MAP}, peerDependencies {MAP}")
    kinds = [F.struct(F.lit(k).alias("rank"), fields[name].alias("found")) for k, name in enumerate(("dependencies", "devDependencies", "peerDependencies"))]
    rows = packages.select("root", F.inline(F.array(*kinds))).where("found is not null").select("root", "rank", F.explode("found").alias("package", "version"))
    return rows.groupBy("root", "package").agg(F.max_by("version", F.struct("rank", "version")).alias("version"))


def frameworks(needed: DataFrame, folders: DataFrame) -> DataFrame:
    """root, framework (the first that the project has, null without one), supported and router, from dependencies and the paths of folders (root, path)."""
    place = F.create_map(*[F.lit(x) for k, (_, package) in enumerate(FRAMEWORKS) for x in (package, k)])
    named = F.array(*[F.lit(name) for name, _ in FRAMEWORKS])
    has = lambda *p: F.bool_or(F.col("path").isin(*p))
    routes = folders.groupBy("root").agg(has("app", "src/app").alias("app"), has("pages", "src/pages").alias("pages"))
    found = needed.groupBy("root").agg(F.min(F.try_element_at(place, F.col("package"))).alias("first"), F.bool_or(F.col("package") == "next").alias("next"), F.max(F.when(F.col("package") == "react-router-dom", F.col("version"))).alias("router_version"), F.bool_or(F.col("package") == "@tanstack/react-router").alias("other_router"))
    app, pages = F.coalesce("app", F.lit(False)), F.coalesce("pages", F.lit(False))
    router = (
        F.when(F.col("next") & app & pages, "app+pages (mid-migration)")
        .when(F.col("next") & app, "app")
        .when(F.col("next"), "pages")
        .when(F.col("router_version").isNotNull(), F.concat(F.lit("react-router "), "router_version"))
        .when(F.col("other_router"), "@tanstack/react-router")
        .otherwise("unknown")
    )
    name = F.try_element_at(named, F.col("first") + 1)
    return found.join(routes, "root", "left").select("root", name.alias("framework"), F.coalesce(name.isin(SUPPORTED), F.lit(False)).alias("supported"), router.alias("router"))


def picks(needed: DataFrame) -> DataFrame:
    """root, kind, place, package, version: what a project uses for each kind of work, in the order of PICKS, from dependencies."""
    rows = [(kind, k, p) for kind, names in PICKS.items() for k, p in enumerate(names)]
    table = needed.sparkSession.createDataFrame(rows, "kind string, place int, package string")
    return needed.join(table, "package").select("root", "kind", "place", "package", "version")


def toolchains(needed: DataFrame, packages: DataFrame, files: DataFrame, text: str = "text") -> DataFrame:
    """root, react (its version), typescript, bundler and monorepo (null for none), from dependencies, package files (root, text) and the names of files at the root (root, path)."""
    has = lambda name: F.bool_or(F.col("package") == name)
    bundler = F.lit("unknown")
    for name in reversed(BUNDLERS):
        bundler = F.when(has(name), name).otherwise(bundler)
    used = needed.groupBy("root").agg(F.max(F.when(F.col("package") == "react", F.col("version"))).alias("react"), has("typescript").alias("typescript"), bundler.alias("bundler"))
    spaces = F.coalesce(F.get_json_object(text, "$.workspaces.packages"), F.get_json_object(text, "$.workspaces"))
    shared = packages.groupBy("root").agg(F.bool_or(F.coalesce(F.startswith(spaces, F.lit("[")), F.lit(False))).alias("workspaces"))
    there = files.groupBy("root").agg(F.collect_set("path").alias("names"))
    both = shared.join(used, "root", "left").join(there, "root", "left")
    kind = F.lit(None).cast("string")
    for name, space in reversed(WORKSPACES):
        kind = F.when(F.col("workspaces") if not name else F.coalesce(F.array_contains("names", name), F.lit(False)), space).otherwise(kind)
    return both.select("root", "react", F.coalesce("typescript", F.lit(False)).alias("typescript"), F.coalesce("bundler", F.lit("unknown")).alias("bundler"), kind.alias("monorepo"))


def compiler_aliases(configs: DataFrame, text: str = "text") -> DataFrame:
    """root, pattern, place, target: the paths of compiler settings, with comments or without, under their base folder; in the order of their targets."""
    options = F.from_json(loose_json(F.col(text)), "compilerOptions struct<baseUrl string, paths map<string, array<string>>>")["compilerOptions"]
    rows = configs.select("root", options["baseUrl"].alias("base"), F.explode(options["paths"]).alias("pattern", "targets"))
    rows = rows.select("root", "base", "pattern", F.posexplode("targets").alias("place", "target"))
    below = F.regexp_replace(F.coalesce("base", F.lit("")), r"^(\./?|\.$)|/+$", "")
    target = F.when(below != "", F.concat_ws("/", below, F.regexp_replace("target", r"^\./", ""))).otherwise(F.regexp_replace("target", r"^\./", ""))
    return rows.select("root", "pattern", "place", target.alias("target"))


def bundler_aliases(configs: DataFrame, text: str = "text") -> DataFrame:
    """root, pattern, place, target: aliases that a bundler's settings name in their text."""
    part = lambda k: F.regexp_extract_all(text, F.lit(BUNDLER_ALIAS), F.lit(k))
    rows = configs.select("root", F.inline(F.arrays_zip(part(1).alias("pattern"), part(2).alias("target"))))
    return rows.select("root", F.concat("pattern", F.lit("/*")).alias("pattern"), F.lit(0).alias("place"), F.concat(F.regexp_replace("target", r"^\./", ""), F.lit("/*")).alias("target"))


def ignored_folders(ignores: DataFrame, text: str = "text") -> DataFrame:
    """root, name: whole folders that a project's ignore file names; patterns, paths and names with a dot count for nothing here."""
    rows = ignores.select("root", F.explode(F.split(text, "\n")).alias("line")).where(~F.col("line").rlike(r"^\s*[#!]"))
    return rows.select("root", F.regexp_replace(F.trim("line"), "^/+|/+$", "").alias("name")).where("name rlike '^[^*/.]+$'").distinct()


def is_source_file(path: Column) -> Column:
    """Whether a path is one of source; declarations of types alone aren't."""
    return path.rlike(r"\.(tsx|jsx|ts|js|mjs|cjs|mts|cts)$") & ~path.rlike(r"\.d\.ts$")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file with one JSON object a line; lines that aren't such are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
