"""Trees of files that queries write: one project at a time for each task, and none stays."""

import json
import os
import tempfile
from pathlib import Path

import pandas as pd
import pytest

from tallgrass.queries import QUERIES
from tallgrass.sources.files import Folder, list_files, listed_parts, on_trees, read_files, read_parts, to_scan, tops

DATA = Path("/root/testdata/sf0.001")
SETTINGS = {"package.json": "{}", "tsconfig.json": json.dumps({"compilerOptions": {"outDir": "made"}})}


def left(folder):
    return [str(x) for x in Path(folder).rglob("package.json")]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["audit_tree", "read_tree", "scan_tree"])
def test_no_tree_stays(spark, name):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = [set(left(x)) for x in (shared, *Path(tempfile.gettempdir()).glob("projects-*"))]
    assert QUERIES[name](spark, str(DATA)).count() > 0
    after = [set(left(x)) for x in (shared, *Path(tempfile.gettempdir()).glob("projects-*"))]
    assert set().union(*after) <= set().union(*before)


def made(spark, projects=7, each=40):
    rows = [(f"p{p}", f"{('src', 'made', 'src/deep/er', f'own{i}/x')[i % 4]}/f{i}.ts", f"import a from 'x{p}-{'y' * (i % 9)}'") for p in range(projects) for i in range(each - p)]
    return spark.createDataFrame(rows, "project_id string, rel_path string, content string")


def test_one_project_at_a_time(spark):
    files = made(spark).coalesce(1)
    count = lambda _, root, rows: iter([pd.DataFrame({"n": [sum(len(x[2]) for x in os.walk(os.path.dirname(root)) if "file-" not in x[0])], "own": [sum(len(x[2]) for x in os.walk(root))], "rows": [len(rows)]})])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # projects go over the edges of batches
    try:
        got = on_trees(files, lambda _: SETTINGS, count, "n long, own long, rows long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [r["rows"] for r in got] == [40 - p for p in range(7)]
    assert all(r["own"] == r["rows"] + 2 and r["n"] <= 42 for r in got)  # spare files count too, and are the largest project's at most


def test_the_same_as_over_roots(spark, tmp_path):
    """What scans and reads trees as they are written finds what list_files and read_files find in trees that stay."""
    files = made(spark).coalesce(1)
    for r in files.collect():
        for name, text in {r["rel_path"]: r["content"], **SETTINGS}.items():
            path = tmp_path / r["project_id"] / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)

    def work(project, root, _):
        for part in listed_parts(project, root, *tops(root, ["own4*/**"])):
            yield from read_parts(part)

    schema = "project_id string, path string, rel_path string, content string, error struct<type: string, path: string, message: string>"
    got = to_scan(on_trees(files, lambda _: SETTINGS, work, schema))
    roots = spark.createDataFrame([(f"p{p}", str(tmp_path / f"p{p}")) for p in range(7)], "project_id string, root string")
    want = read_files(list_files(roots, ["own4*/**"]))
    plain = lambda df: sorted((r["project_id"], r["rel_path"], r["content"], r["error"]) for r in df.collect())
    assert plain(got) == plain(want) and 0 < len(plain(got)) < files.count()


def test_folder(tmp_path):
    tree = Folder(str(tmp_path))
    for files in ({"a.ts": "long text é", "x/y/b.ts": "b"}, {"c/a.ts": "s", "d.ts": ""}, {"x/y/b.ts": "one", "x/c.ts": "2", "x/y/z/d.ts": "3", "e.ts": "4"}, {}):
        tree.write(files.items())
        tree.write([(k, v + "!") for k, v in files.items() if k == "e.ts"])  # again: the later stays
        want = files | {k: v + "!" for k, v in files.items() if k == "e.ts"}
        found = {os.path.relpath(f"{d}/{n}", tree.root): Path(d, n).read_text() for d, _, names in os.walk(tree.root) for n in names}
        assert found == want
        assert {os.path.relpath(d, tree.root) for d, _, _ in os.walk(tree.root)} == {p for x in want for p in map(str, Path(x).parents)}
        tree.clear()
        assert not os.path.exists(tree.root)
