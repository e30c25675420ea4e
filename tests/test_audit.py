"""Buckets and reports."""

import json
import random
import re

from tallgrass.operators.audit import Options, all_dependencies, audit, buckets, first_at_line, production_dependencies, usage
from tallgrass.report import error_message, exit_code, json_report, text_report

DECLARED = "project_id string, category string, ord int, package string"
IMPORTS = "project_id string, package string, import_type string, file string, line int, import_statement string, pass int, match_seq int"


def rows(section, *names, project="p"):
    return [(project, section, i, n) for i, n in enumerate(names)]


def imp(package, kind="runtime", file="/src/a.ts", line=1, text="import", number=1, project="p"):
    return (project, package, kind, file, line, text, number, 0)


def reported(spark, declared, imports, options=Options(), projects=("p",)):
    d, i = spark.createDataFrame(declared, DECLARED), spark.createDataFrame(imports, IMPORTS)
    out = audit(spark.createDataFrame([(x,) for x in projects], "project_id string"), d, i, options)
    return {r["project_id"]: r.asDict(recursive=True) for r in out.collect()}


BASE = rows("dependencies", "react", "lodash", "types-only", "both") + rows("devDependencies", "jest", "express", "vite-plugin") + rows("peerDependencies", "react-dom", "typescript")
USED = [imp("react"), imp("types-only", "type-only"), imp("both"), imp("both", "type-only", line=2), imp("express", line=3), imp("express", file="/vite.config.ts"), imp("vite-plugin", file="/x/vite.config.ts"), imp("typescript", "type-only"), imp("nowhere")]


def test_modes(spark):
    r = reported(spark, BASE, USED)["p"]
    assert (r["unused"], r["unusedPeer"], r["typeOnly"]) == (["lodash"], [], ["types-only"])
    assert r["misplaced"] == [{"packageName": "express", "locations": [{"file": "/src/a.ts", "line": 3, "importStatement": "import"}]}]
    assert r["totalIssues"] == 3
    r = reported(spark, BASE, USED, Options(check_peer=True))["p"]
    assert (r["unusedPeer"], r["totalIssues"]) == (["react-dom"], 4)
    r = reported(spark, BASE, USED, Options(check_all=True))["p"]
    assert r["unused"] == ["lodash", "react-dom", "jest"] and r["unusedPeer"] == ["react-dom"]
    assert r["typeOnly"] == ["types-only", "typescript"] and r["misplaced"] == [] and r["totalIssues"] == 6


def test_bag_and_ignored(spark):
    twice = rows("dependencies", "a") + rows("devDependencies", "a") + rows("peerDependencies", "a")
    r = reported(spark, twice, [], Options(check_all=True))["p"]
    assert r["unused"] == ["a", "a", "a"] and r["unusedPeer"] == ["a"] and r["totalIssues"] == 4
    r = reported(spark, BASE, USED, Options(ignored=("lodash", "express", "zzz")))["p"]
    assert r["unused"] == [] and r["misplaced"] == [] and r["ignored"] == ["lodash", "express", "zzz"] and r["totalIssues"] == 1
    both = rows("dependencies", "x") + rows("devDependencies", "x")
    assert [m["packageName"] for m in reported(spark, both, [imp("x")])["p"]["misplaced"]] == ["x"]


def test_projects_apart_and_empty(spark):
    declared = rows("dependencies", "a", project="p") + rows("dependencies", "a", project="q")
    out = reported(spark, declared, [imp("a", project="q")], projects=("p", "q", "none"))
    assert out["p"]["unused"] == ["a"] and out["q"]["totalIssues"] == 0 and out["none"]["totalIssues"] == 0
    assert reported(spark, [], [], projects=())== {}


def test_keep_first_on_a_line(spark):
    i = spark.createDataFrame([imp("a", text="third", number=3), imp("a", text="first", number=1), imp("a", line=2, text="other")], IMPORTS)
    assert sorted(r["import_statement"] for r in first_at_line(i).collect()) == ["first", "other"]


def test_section_unions(spark):
    d = spark.createDataFrame(rows("peerDependencies", "react", "z") + rows("devDependencies", "react", "y") + rows("dependencies", "x", "react"), DECLARED)
    assert {r["package"]: r["category"] for r in all_dependencies(d).collect()} == {"x": "dependencies", "react": "dependencies", "y": "devDependencies", "z": "peerDependencies"}
    assert sorted(r["package"] for r in production_dependencies(d).collect()) == ["react", "x"]


def test_plan_aggregates_before_the_shuffle(spark):
    i = spark.createDataFrame(USED, IMPORTS)
    plan = usage(i)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_random_projects_keep_invariants(spark):
    r = random.Random(0xABCDEF)
    declared, imports = [], []
    for p in range(50):
        for s in ("dependencies", "devDependencies", "peerDependencies"):
            if r.random() > 0.3:
                declared += rows(s, *sorted({f"k{r.randint(0, 40)}" for _ in range(r.randint(0, 29))}), project=str(p))
        imports += [imp(f"k{r.randint(0, 40)}", r.choice(["runtime", "type-only"]), r.choice(["/src/a.ts", "/vite.config.ts"]), r.randint(1, 5), project=str(p)) for _ in range(r.randint(0, 20))]
    for options in (Options(), Options(check_peer=True), Options(check_all=True), Options(ignored=("k1", "k2"))):
        out = reported(spark, declared, imports, options, [str(p) for p in range(50)])
        assert len(out) == 50
        for p, x in out.items():
            used = {(i[1], i[2]) for i in imports if i[0] == p}
            names = [d for d in declared if d[0] == p and d[3] not in options.ignored]
            wanted = ["dependencies", "peerDependencies", "devDependencies"] if options.check_all else ["dependencies"]
            assert x["unused"] == [d[3] for s in wanted for d in names if d[1] == s and not {(d[3], "runtime"), (d[3], "type-only")} & used]
            assert x["totalIssues"] == len(x["unused"]) + len(x["unusedPeer"]) + len(x["misplaced"]) + len(x["typeOnly"])


RESULT = {"unused": ["a"], "unusedPeer": ["p"], "misplaced": [{"packageName": "m", "locations": [{"file": "/r/src/x.ts", "line": 3, "importStatement": "import 'm'"}] * 2}], "typeOnly": ["t"], "totalIssues": 4}
CLEAN = {"unused": [], "unusedPeer": [], "misplaced": [], "typeOnly": [], "totalIssues": 0}
plain = lambda s: re.sub(r"\x1b\[\d+m", "", s)


def test_json_report():
    assert list(json.loads(json_report(RESULT, ["i"]))) == ["unused", "unusedPeer", "misplaced", "typeOnly", "ignored", "totalIssues"]
    assert json_report(CLEAN) == '{\n  "unused": [],\n  "unusedPeer": [],\n  "misplaced": [],\n  "typeOnly": [],\n  "ignored": [],\n  "totalIssues": 0\n}'


def test_text_report():
    text = plain(text_report(RESULT, ["i", "j"], "/r"))
    assert "ℹ️  Ignored packages: i, j" in text and "  • m (used in 2 files)\n    └─ src/x.ts:3\n       import 'm'" in text and "  ○ t" in text
    assert [text.index(x) for x in ("Unused Dependencies:", "Unused peerDependencies:", "Misplaced Dependencies:", "Type-Only Imports:", "Total Issues: 4")] == sorted(text.index(x) for x in ("Unused Dependencies:", "Unused peerDependencies:", "Misplaced Dependencies:", "Type-Only Imports:", "Total Issues: 4"))
    assert "Misplaced" not in text_report({**RESULT, "misplaced": []})
    assert "No issues found" in text_report(CLEAN) and "Total Issues" not in text_report(CLEAN) and "Ignored" in text_report(CLEAN, ["x"])
    assert exit_code(RESULT) == 1 and exit_code(CLEAN) == 0


def test_errors():
    assert error_message({"type": "FILE_NOT_FOUND", "path": "p", "message": None}).startswith("package.json not found at p.")
    assert error_message({"type": "PARSE_ERROR", "path": "p", "message": "m"}) == "Failed to parse p: m"
    assert error_message({"type": "READ_ERROR", "path": "p", "message": "m"}) == "Failed to read p: m"


def test_bucket_rows_have_no_duplicates_by_default(spark):
    d, i = spark.createDataFrame(BASE, DECLARED), spark.createDataFrame(USED, IMPORTS)
    got = buckets(d, i, Options(check_peer=True)).select("bucket", "package").collect()
    assert len(got) == len(set(got))
