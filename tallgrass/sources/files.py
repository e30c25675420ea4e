"""Files below project roots.

Spark's own file sources drop names that begin with an underscore, which must be scanned, so that directories are
listed and files read by functions on the executors. The roots must be visible to all of them.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import chain, groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import admitted, globs_regex
from ..rules import BUILD_SUFFIXES, STATIC_GLOBS
from .manifests import parse_json

#: Paths that are sent on together.
LISTED = 4096
#: Files that are read together.
READ = 256
LISTING = "project_id string, path string, rel_path string"
ERROR = "error struct<type: string, path: string, message: string>"


def read_text(path: str) -> tuple[str | None, dict | None]:
    """A file's text and no error, or the other way round. Newlines stay; bytes that aren't UTF-8 become U+FFFD."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace"), None
    except FileNotFoundError:
        return None, {"type": "FILE_NOT_FOUND", "path": path, "message": None}
    except OSError as e:
        return None, {"type": "READ_ERROR", "path": path, "message": str(e)}


def read_json(path: str) -> tuple[object, dict | None]:
    text, error = read_text(path)
    if error:
        return None, error
    value, message = parse_json(text)
    return (None, {"type": "PARSE_ERROR", "path": path, "message": message}) if message else (value, None)


def build_globs(root: str) -> list[str]:
    """Output directories that the scripts of a project's manifest and its tsconfig.json name."""
    manifest, _ = read_json(os.path.join(root, "package.json"))
    config, _ = read_json(os.path.join(root, "tsconfig.json"))
    scripts = manifest.get("scripts") if isinstance(manifest, dict) else None
    found = [m[1] for s in (scripts.values() if isinstance(scripts, dict) else []) if isinstance(s, str) and (m := re.search(r"--outDir\s+(\S+)", s))]
    options = config.get("compilerOptions") if isinstance(config, dict) else None
    out_dir = options.get("outDir") if isinstance(options, dict) else None
    return list(dict.fromkeys(f"{x}/**" for x in [*found, *([out_dir] if isinstance(out_dir, str) and out_dir else [])]))


def build_like(root: str) -> list[str]:
    """Directories at the root whose names end like a build's."""
    try:
        return [f"{e.name}/**" for e in os.scandir(root) if e.is_dir() and e.name.endswith(tuple(BUILD_SUFFIXES))]
    except OSError:
        return []


def walk(root: str, ignored: re.Pattern, top: str = "") -> Iterator[str]:
    """Relative paths of the files in one directory at root and below it, or of those at root itself, that no glob leaves out; nothing
    that begins with a dot."""
    for folder, folders, names in os.walk(os.path.join(root, top)):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if rel == "." else f"{rel}/"
        folders[:] = sorted(d for d in folders if top and not d.startswith(".") and not ignored.match(f"{prefix}{d}/x"))
        for name in sorted(names):
            if not name.startswith(".") and not ignored.match(prefix + name):
                yield prefix + name


def tops(root: str, exclude: Sequence[str] = (), auto_detect: bool = True) -> tuple[list[str], str]:
    """What is walked on its own below a root, the root's own files first, and the expression of all that is left out."""
    own = build_globs(root) + build_like(root) if auto_detect else []
    ignored = globs_regex([*STATIC_GLOBS, *own, *exclude]).replace(r"\z", r"\Z")
    found = re.compile(ignored, re.DOTALL)
    try:
        names = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and not found.match(f"{e.name}/x"))
    except OSError:
        names = []
    return ["", *names], ignored


def listed_parts(project: str, root: str, names: Sequence[str], ignored: str) -> Iterator[pd.DataFrame]:
    """What the walks of some of a root's directories find, in parts."""
    files = chain.from_iterable(walk(root, re.compile(ignored, re.DOTALL), x) for x in names)
    while found := list(islice(files, LISTED)):
        yield pd.DataFrame({"project_id": project, "path": [os.path.join(os.path.abspath(root), x) for x in found], "rel_path": found})


def read_parts(paths: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows with a path, and the content or the error of each, in parts."""
    for i in range(0, len(paths), READ):
        part = paths.iloc[i : i + READ]
        read = [read_text(p) for p in part["path"]]
        yield part.assign(content=[x[0] for x in read], error=[x[1] for x in read])


def to_scan(listed: DataFrame, path_mode: str = "relative", also: Column | None = None) -> DataFrame:
    """Of what was listed, that which a scan takes, and what else is asked for."""
    taken = admitted(F.col("path") if path_mode == "absolute" else F.concat(F.lit("/"), F.col("rel_path")))
    return listed.where(taken if also is None else also | taken)


def list_files(roots: DataFrame, exclude: Sequence[str] = (), auto_detect: bool = True, path_mode: str = "relative") -> DataFrame:
    """(project_id, path, rel_path) of every file to scan below each root of roots (project_id, root).

    Names are judged on their path from the root, so that where a checkout lies doesn't matter; path_mode="absolute"
    judges the whole path. The directories at a root are dealt out and walked on their own, and paths are sent on in parts, so that
    a large repository isn't one task's list.
    """

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, root in zip(batch["project_id"], batch["root"], strict=True):
                names, ignored = tops(root, exclude, auto_detect)
                yield pd.DataFrame({"project_id": project, "root": root, "top": names, "ignored": ignored})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, root, top, ignored in zip(batch["project_id"], batch["root"], batch["top"], batch["ignored"], strict=True):
                yield from listed_parts(project, root, [top], ignored)

    begun = roots.select("project_id", "root").mapInPandas(begin, "project_id string, root string, top string, ignored string").repartition("project_id", "top")
    return to_scan(begun.mapInPandas(run, LISTING), path_mode)


def read_files(paths: DataFrame) -> DataFrame:
    """paths with their content, or the error that reading them gave. Files are dealt out evenly before they are read."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from read_parts(batch)

    return paths.repartition("path").mapInPandas(run, f"{columns}, content string, {ERROR}")


class Folder:
    """A folder for one tree of files after another. Files and folders of a tree that is done become spare and are renamed into the next one: new ones in place
    of some that were just deleted cost ext4 a search through all of these."""

    def __init__(self, base: str):
        self.root, self.base, self.spare, self.made = f"{base}/root", base, {"file": [], "folder": []}, set()

    def take(self, kind: str, path: str) -> bool:
        """Puts a spare one at a path, if there is one."""
        if self.spare[kind]:
            os.rename(self.spare[kind].pop(), path)
            return True
        return False

    def folder(self, path: str) -> None:
        if path not in self.made:
            if path != self.root:
                self.folder(os.path.dirname(path))
            if not self.take("folder", path):
                os.mkdir(path)
            self.made.add(path)

    def write(self, files: Iterable[tuple[str, str]]) -> None:
        """Writes files (rel_path, content); of two with one path the later stays."""
        for rel_path, content in files:
            path = f"{self.root}/{rel_path}"
            self.folder(os.path.dirname(path))
            again = os.path.lexists(path) or self.take("file", path)
            with open(path, "r+b" if again else "wb") as f:  # a file cut to nothing first would be flushed when it is closed
                f.write(content.encode())
                f.truncate()

    def clear(self) -> None:
        """Leaves no tree."""

        def put(kind: str, path: str) -> None:
            self.spare[kind].append(f"{self.base}/{kind}-{len(self.spare[kind])}")
            os.rename(path, self.spare[kind][-1])

        for folder, _, names in os.walk(self.root, topdown=False):
            for name in names:
                put("file", f"{folder}/{name}")
            put("folder", folder)
        self.made.clear()


def on_trees(files: DataFrame, more: Callable[[str], Mapping[str, str]], work: Callable[[str, str, pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What work(project_id, root, rows) gives for each project, while its files (project_id, rel_path, content) and those of
    more(project_id), texts by rel_path, are on disk. rows are the project's rows without their content.

    A project's rows must follow each other in one partition. Their task writes them to a folder of its own, has work run to its end and clears the
    folder before it comes to the next project, so that the disk holds the largest project of each running task, however many there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryDirectory(prefix="projects-") as base:
            tree = Folder(base)
            parts = (x for batch in batches for x in batch.groupby("project_id", sort=False))
            for project, own in groupby(parts, key=lambda x: x[0]):
                rows = []
                tree.write(more(project).items())
                for _, part in own:
                    tree.write(zip(part["rel_path"], part["content"], strict=True))
                    rows.append(part.drop(columns="content"))
                yield from work(project, tree.root, pd.concat(rows))
                tree.clear()

    return files.mapInPandas(run, schema)


def kept(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table, for rows that are read more than once: below the session's checkpoint folder, or on this machine for a
    local master. It goes when the application ends."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base or tempfile.gettempdir()}/projects-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def roots_table(spark: SparkSession, roots: Mapping[str, str] | DataFrame) -> DataFrame:
    """(project_id, root): a table as it is, or one of a few projects given by name."""
    if isinstance(roots, DataFrame):
        return roots.select("project_id", "root")
    return spark.createDataFrame(list(roots.items()), "project_id string, root string")


def source_files(spark: SparkSession, roots: Mapping[str, str] | DataFrame, exclude: Sequence[str] = (), auto_detect: bool = True, path_mode: str = "relative") -> DataFrame:
    """(project_id, path, rel_path, content) of the files of each project; files that can't be read are left out."""
    read = read_files(list_files(roots_table(spark, roots).repartition("project_id"), exclude, auto_detect, path_mode))
    return read.where("error is null").drop("error")
