"""Names, paths, comments and statements: literal cases, each set as one table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.functions.imports import extract_imports, js_trim, line_at, strip_comments
from tallgrass.functions.names import builtin, package_root
from tallgrass.functions.paths import admitted, excluded, extension, glob_regex, globs_regex, in_build_like_directory, production_config

ROOTS = [
    ("./u", None), ("../h", None), ("/usr/x", None), ("lodash/fp/map", "lodash"), ("react/", "react"), ("lodash//map", "lodash"), ("@mobily/ts-belt/Array", "@mobily/ts-belt"),
    ("", None), (None, None), ("@", None), ("@scope", None), ("@scope/", None), ("@/", None), ("http://a/b", None), ("https://a/b", None), ("file:///a", None),
    (" react", " react"), ("   ", "   "), ("-leading-dash", "-leading-dash"), ("123-pkg", "123-pkg"), ("@/components/Button", "@/components"), ("~/x", "~"), ("#int/x", "#int"),
    ("fs/promises", "fs"), ("node:fs/promises", "node:fs"), ("http", "http"),
]


def test_package_root(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(ROOTS)], "i int, p string")
    got = {r["i"]: r["root"] for r in df.select("i", package_root(F.col("p")).alias("root")).collect()}
    assert [got[i] for i in range(len(ROOTS))] == [x for _, x in ROOTS]


def test_builtins(spark):
    names = ["fs", "node:fs", "bun:test", "bun", "node:test", "worker_threads", "async_hooks", "react", "node:bun", "events"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "p string").select(builtin(F.col("p"))).collect()]
    assert got == [True, True, True, True, False, False, False, False, False, True]


PATHS = [
    ("test/setup.ts", False), ("src/types.d.ts", False), ("next.config.js", True), ("jest.config.js", False), ("src/a.ts", True), ("src/a.mts", False), ("a.cjs", True), (".ts", False),
    ("x/node_modules/a/b.js", False), ("packages/a/dist/vite.config.js", True), ("packages/a/dist/a.js", False), ("my-test-utils.ts", False), ("nuxt.config.ts", True),
    ("next-pwa.config.mjs", True), ("src/Button.stories.tsx", False), ("src/happydom.ts", False), ("tests\\a.ts", False), ("latest/a.ts", True), ("src/contest/a.ts", True), ("readme.md", False), ("a", False),
]


def test_admission(spark):
    df = spark.createDataFrame(PATHS, "p string, want boolean")
    assert df.where(admitted(F.col("p")) != F.col("want")).collect() == []


def test_path_parts(spark):
    df = spark.createDataFrame([("a/b.tar.gz",), ("a.b/c",), ("/x/vite.config.ts",), ("/x/coverage/a.ts",)], "p string")
    rows = df.select(extension(F.col("p")), production_config(F.col("p")), excluded(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [(".gz", False, False), ("", False, False), (".ts", True, False), (".ts", False, True)]
    build = spark.createDataFrame([("a-dist/x.js",), ("a-dist.js",), ("b/a-dist/x.js",), ("my-static/y",)], "p string")
    assert [r[0] for r in build.select(in_build_like_directory(F.col("p"))).collect()] == [True, False, False, True]


GLOBS = [
    ("dist/**", "dist/a/b.js", True), ("dist/**", "x/dist/a.js", False), ("**/test/**", "test/a.ts", True), ("**/test/**", "x/y/test/z/a.ts", True), ("**/test/**", "x/test", False),
    ("**/*.test.*", "a.test.ts", True), ("**/*.test.*", "x/a.test.ts", True), ("*.js", "a.js", True), ("*.js", "x/a.js", False), ("src/?.ts", "src/a.ts", True), ("src/[ab].ts", "src/b.ts", True),
    ("src/[!ab].ts", "src/b.ts", False), ("{a,b}/**", "b/c.ts", True), ("./dist/**", "dist/a.js", True), ("a+b(c).ts", "a+b(c).ts", True), ("**/*.d.ts", "q/x.d.ts", True), ("**", "any/thing", True),
]


@pytest.mark.parametrize("glob, path, want", GLOBS)
def test_globs(glob, path, want):
    assert bool(re.match(globs_regex([glob]).replace(r"\z", r"\Z"), path)) is want


def test_globs_in_spark(spark):
    for glob, path, want in GLOBS:
        row = spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(globs_regex([glob]))).first()
        assert row[0] is want, glob
    assert glob_regex("a.b") == r"a\.b"
    assert spark.createDataFrame([("x",)], "p string").select(F.col("p").rlike(globs_regex([]))).first()[0] is False


R, T = "runtime", "type-only"
SOURCES = [
    ("import {a} from 'pkg-a'", [("pkg-a", R, 1)]),
    ("import 'side'\nimport\"side2\"", [("side", R, 1), ("side2", R, 2)]),
    ("const m = require('lodash');", [("lodash", R, 1)]),
    ("import type {P} from 'h'", [("h", T, 1)]),
    ("import { type S } from 'l'", [("l", T, 1)]),
    ("import { type S, v } from 'l'", [("l", R, 1)]),
    ("import type {A} from 'p'\nimport {b} from 'p'", [("p", R, 2), ("p", T, 1)]),
    ("const x = await import('x')", []),
    ("// import a from 'a'\n/* import b from 'b' */", []), ("", []), ("  \n ", []), (None, []),
    ("import a from 'p'\nimport b from 'p'\nimport c from 'p'", [("p", R, 1), ("p", R, 2), ("p", R, 3)]),
    ("import a from 'fs'\nimport 'node:path'\nimport 'bun:test'\nrequire('bun:sqlite')", []),
    ("/*\na\n*/\nimport x from 'p';\n// import z from 'q'\nrequire( \"r/s\" )", [("p", R, 4), ("r", R, 6)]),
    ("export * from 'x'; export {a} from 'x'", []),
    ("import $ from 'jquery'", []),
    ("import {a}from 'x'\nimport{a} from 'x'", []),
    ("import{type A} from 'x'", [("x", T, 1)]),
    ("import type X = require('x')", [("x", R, 1)]),
    ("import { type as t } from 'x'", [("x", T, 1)]),
    ("import { type A, } from 'x'", [("x", R, 1)]),
    ("import {\n type A,\n} from 'x'", [("x", R, 1)]),
    ("import { type\tA } from 'x'", []),
    ("import { type } from 'x'", [("x", R, 1), ("x", R, 1)]),
    ("import type from 'x'", []), ("import type, {a} from 'x'", []),
    ("import d, { type T } from 'x'", [("x", R, 1)]),
    ("import x from 'https://c/x.js';\nimport y from 'react';", []),
    ("const g='src/*.ts';\nimport r from 'react';\n/** d */", []),
    ("@import 'theme.css'", [("theme.css", R, 1)]),
    ("import type F = B;\nimport x from 'react';", [("react", R, 2), ("react", T, 1)]),
    ("import { prototype as p } from 'x'", [("x", R, 1), ("x", T, 1)]),
    ("import typeorm from 'typeorm'", [("typeorm", R, 1)]),
    ("// see http://e.com\nimport r from 'real'", [("real", R, 2)]),
    ("import a from 'nbsp'", [("nbsp", R, 1)]),
    ("import typeé from 'x'", []),
    ("a\r\nb\rc\nimport 'crlf'", [("crlf", R, 3)]),
]


def test_statements(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SOURCES)], "i int, content string")
    got = {}
    for r in extract_imports(df).orderBy("i", "pass", "match_seq").collect():
        got.setdefault(r["i"], []).append((r["package"], r["import_type"], r["line"]))
    for i, (source, want) in enumerate(SOURCES):
        assert got.get(i, []) == want, source


def test_statement_text(spark):
    df = spark.createDataFrame([("f.ts", "x;  import {\n a\n} from 'p' ; require ( 'q' )")], "file string, content string")
    assert [r["import_statement"] for r in extract_imports(df).orderBy("match_seq").collect()] == ["import {\n a\n} from 'p'", "require ( 'q' )"]


def test_comments_keep_lines(spark):
    texts = ["a/*x\ny\n*/b//c\nd", "/**/", "a//b\rc", "/* open", "x //y z"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "c string").select(strip_comments(F.col("c"))).collect()]
    assert got == ["a\n\nb\nd", "", "a\rc", "/* open", "x  z"]


def test_line_comments_end_at_line_ends_only(spark):
    others = "\x00\t\x0b\x0c\x85\u2027\u202a\ud7ff\ue000\ufffe\U00010000\U0010ffff"
    texts = [f"a//{others}{end}b" for end in "\n\r\u2028\u2029"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "c string").select(strip_comments(F.col("c"))).collect()]
    assert got == [f"a{end}b" for end in "\n\r\u2028\u2029"]


def test_lines_against_a_split(spark):
    text = "a\nbb\r\n\nc\rd\n"
    df = spark.range(len(text) + 2).select(F.col("id").cast("int").alias("o"), F.lit(text).alias("t"))
    for r in df.select("o", line_at(F.col("t"), F.col("o")).alias("n")).collect():
        assert r["n"] == len(text[: r["o"]].split("\n"))


def test_trim(spark):
    df = spark.createDataFrame([(" ﻿ a b　\n",), ("\x85a",)], "t string")
    assert [r[0] for r in df.select(js_trim(F.col("t"))).collect()] == ["a b", "\x85a"]


def test_random_sources_keep_invariants(spark):
    r = random.Random(0xC0FFEE)
    flavours = ["import x from '{}'", "import {{ type A, b }} from \"{}\"", "import type {{ A }} from '{}'", "require('{}')", "import '{}'", "// '{}'", "/* {}", "`${{{}}}`"]
    rows = [(i, "\n".join(r.choice(flavours).format("".join(r.choices("ab@/.-:#~' \t✓é", k=r.randint(0, 6)))) for _ in range(r.randint(0, 19)))) for i in range(200)]
    found = extract_imports(spark.createDataFrame(rows, "i int, content string")).collect()
    lines = {i: s.count("\n") + 1 for i, s in rows}
    assert found and all(0 < x["line"] <= lines[x["i"]] and x["package"] and x["import_type"] in (R, T) for x in found)


def test_lines_of_very_many_imports(spark):
    """Lines are added up block by block: over the borders of blocks, and blocks of blocks, none is lost."""
    n = 20_000
    text = "\n".join(f"import 'p{i % 7}'" + "\n" * (i % 3) for i in range(n))
    rows = extract_imports(spark.createDataFrame([(1, text)], "id int, content string")).orderBy("match_seq").select("line").collect()
    want, line = [], 1
    for i in range(n):
        want.append(line)
        line += 1 + i % 3
    assert [r["line"] for r in rows] == want
