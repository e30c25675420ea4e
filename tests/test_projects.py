"""Manifests, scans and whole projects in a temporary directory; the command line."""

import json
import re

import pytest

from tallgrass.cli import main, parse_options
from tallgrass.operators.audit import Options
from tallgrass.plans.projects import audit_projects, project_imports, read_manifests
from tallgrass.sources.files import build_globs, list_files, read_files, source_files
from tallgrass.sources.manifests import declared_packages, parse_json, parse_manifests, property_order


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def project(tmp_path):
    put(tmp_path, {
        "package.json": json.dumps({"name": "x", "scripts": {"build": "tsc --outDir build-output", "n": 1}, "dependencies": {"react": "1", "lodash": "1", "typed": "1"}, "devDependencies": {"express": "1", "vite": "1", "jest": "1"}, "peerDependencies": {"react-dom": "1"}}),
        "tsconfig.json": '{"compilerOptions": {"outDir": "./custom-dist"}}',
        "src/_app.tsx": "import React from 'react'\nimport type { T } from 'typed'",
        "src/server.js": "\nconst e = require('express')",
        "vite.config.ts": "import { defineConfig } from 'vite'",
        "jest.config.js": "require('jest')",
        "tests/a.ts": "import 'lodash'", "src/a.test.ts": "import 'lodash'", "dist/a.js": "import 'lodash'", "build-output/a.js": "import 'lodash'", "custom-dist/a.js": "import 'lodash'",
        "my-static/a.js": "import 'lodash'", ".hidden/a.js": "import 'lodash'", "src/types.d.ts": "import 'lodash'", "generated/a.js": "import 'lodash'",
    })
    return tmp_path


def test_scan(spark, project):
    roots = spark.createDataFrame([("p", str(project))], "project_id string, root string")
    names = lambda **k: sorted(r["rel_path"] for r in list_files(roots, **k).collect())
    assert names() == ["generated/a.js", "src/_app.tsx", "src/server.js", "vite.config.ts"]
    assert names(exclude=["generated/**"]) == ["src/_app.tsx", "src/server.js", "vite.config.ts"]
    assert names(auto_detect=False) == ["build-output/a.js", "custom-dist/a.js", "generated/a.js", "my-static/a.js", "src/_app.tsx", "src/server.js", "vite.config.ts"]
    assert build_globs(str(project)) == ["build-output/**", "./custom-dist/**"]


def test_audit_of_a_project(spark, project):
    r = audit_projects(spark, {"p": str(project)}, exclude=["generated/**"]).first().asDict(recursive=True)
    assert r["unused"] == ["lodash"] and r["typeOnly"] == ["typed"] and r["unusedPeer"] == []
    assert r["misplaced"] == [{"packageName": "express", "locations": [{"file": str(project / "src/server.js"), "line": 2, "importStatement": "require('express')"}]}]
    assert r["totalIssues"] == 3
    assert audit_projects(spark, {"p": str(project)}, Options(check_all=True)).first()["totalIssues"] == 4
    spark.catalog.clearCache()


def test_many_projects(spark, tmp_path):
    for i in range(5):
        put(tmp_path / str(i), {"package.json": json.dumps({"dependencies": {f"k{j}": "1" for j in range(3)}}), "a.js": f"import 'k{i % 3}'"})
    put(tmp_path / "bad", {"package.json": "[]", "a.js": "import 'x'"})
    roots = {str(i): str(tmp_path / str(i)) for i in range(5)} | {"bad": str(tmp_path / "bad"), "gone": str(tmp_path / "gone")}
    out = {r["project_id"]: r["unused"] for r in audit_projects(spark, roots).collect()}
    assert out == {str(i): [f"k{j}" for j in range(3) if j != i % 3] for i in range(5)}
    errors = {r["project_id"]: r["error"]["type"] for r in read_manifests(spark, roots).where("error is not null").collect()}
    assert errors == {"bad": "PARSE_ERROR", "gone": "FILE_NOT_FOUND"}
    assert project_imports(spark, roots).count() == 6
    spark.catalog.clearCache()


def test_reading(spark, tmp_path):
    put(tmp_path, {"a.js": b"x\xff\ry\r\n", "b.js": ""})
    rows = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.js", "b.js", "none.js", ".")], "path string")
    got = {r["path"].rsplit("/", 1)[-1]: (r["content"], r["error"] and r["error"]["type"]) for r in read_files(rows).collect()}
    assert got["a.js"] == ("x�\ry\r\n", None) and got["b.js"] == ("", None) and got["none.js"] == (None, "FILE_NOT_FOUND")
    assert [e for c, e in got.values() if e == "READ_ERROR"] == ["READ_ERROR"]
    assert source_files(spark, {"p": str(tmp_path)}).count() == 2


@pytest.mark.parametrize("text, fine", [("{}", True), ("[]", False), ("null", False), ("0", False), ('"x"', False), ("", False), ('{"a":1} junk', False), ('{"a": NaN}', False), ('{"name": null}', True), ('{"dependencies": "abc"}', True), ('{"dependencies": []}', True), ('{"dependencies": {"a": 1}}', True), ("﻿{}", False)])
def test_manifest_roots(spark, text, fine):
    row = parse_manifests(spark.createDataFrame([("p", "x", text)], "project_id string, path string, raw string")).first()
    assert (row["error"] is None) is fine
    if not fine:
        assert row["error"]["type"] == "PARSE_ERROR"


def test_declared_order(spark):
    raw = '{"name": "n", "version": null, "dependencies": {"b": "1", "10": "1", "a": "1", "2": "1", "b": "2"}, "devDependencies": null, "peerDependencies": {"z": {}}}'
    parsed = parse_manifests(spark.createDataFrame([("p", "x", raw)], "project_id string, path string, raw string"))
    rows = [(r["category"], r["ord"], r["package"]) for r in declared_packages(parsed).orderBy("category", "ord").collect()]
    assert rows == [("dependencies", 0, "2"), ("dependencies", 1, "10"), ("dependencies", 2, "b"), ("dependencies", 3, "a"), ("peerDependencies", 0, "z")]
    assert parsed.first()["name"] == "n" and parsed.first()["version"] is None
    assert property_order(["01", "1", "x", "0"]) == ["0", "1", "01", "x"]
    assert parse_json("[1]") == ([1], None)


def test_options():
    o = parse_options(["-j", "--text", "-a", "-p", "-i", "a, b,,", "--ignore", "c", "-e", "x/**", "word", "--no-auto-detect", "-h"])
    assert (o.format, o.check_all, o.check_peer, o.ignored, o.exclude, o.no_auto_detect, o.show_help, o.warnings) == ("text", True, True, ["a", "b", "c"], ["x/**"], True, True, [])
    o = parse_options(["-i", "-j", "--exclude", "--ignore=x", "-z"])
    assert o.format == "json" and o.ignored == [] and o.warnings == ["--ignore requires a value but none was provided; flag ignored.", "--exclude requires a value but none was provided; flag ignored.", "Unknown option --ignore=x ignored. Run with --help to see supported flags.", "Unknown option -z ignored. Run with --help to see supported flags."]
    assert parse_options([]).format == "text" and not parse_options([]).check_all


def test_command_line(spark, project, capsys):
    assert main(["--json", "-e", "generated/**", "--bogus"], str(project)) == 1
    out = capsys.readouterr()
    assert json.loads(out.out)["unused"] == ["lodash"] and "warning: Unknown option --bogus" in out.err
    assert main(["-i", "lodash,typed,express", "-e", "generated/**"], str(project)) == 0
    assert "No issues found" in re.sub(r"\x1b\[\d+m", "", capsys.readouterr().out)
    assert main(["--help"]) == 0 and "Usage:" in capsys.readouterr().out
    assert main([], str(project / "nowhere")) == 1 and "not found" in capsys.readouterr().err
    put(project, {"package.json": "{"})
    assert main([], str(project)) == 1 and "Failed to parse" in capsys.readouterr().err
    spark.catalog.clearCache()
