"""The audit of projects in directories: scan, extraction, joins, report."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.imports import extract_imports
from ..operators.audit import Options, audit
from ..sources.files import read_files, roots_table, source_files
from ..sources.manifests import declared_packages, parse_manifests


def read_manifests(spark: SparkSession, roots: Mapping[str, str] | DataFrame) -> DataFrame:
    """Parsed manifests of projects (id to root, or a table of both), with the error of those that can't be read or aren't objects."""
    return manifests_of(read_files(roots_table(spark, roots).select("project_id", F.concat(F.regexp_replace("root", "(?<=.)/+$", ""), F.lit("/package.json")).alias("path"))))


def manifests_of(read: DataFrame) -> DataFrame:
    """The same of texts that were read (project_id, path, content, error)."""
    parsed = parse_manifests(read.where("error is null").withColumnRenamed("content", "raw"))
    failed = read.where("error is not null").select("project_id", "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.array().cast(parsed.schema["declared"].dataType).alias("declared"), "error")
    return parsed.unionByName(failed)


def project_imports(spark: SparkSession, roots: Mapping[str, str] | DataFrame, exclude: Sequence[str] = (), auto_detect: bool = True, path_mode: str = "relative") -> DataFrame:
    """Imports of all files of the projects; file is the absolute path."""
    return imports_of(source_files(spark, roots, exclude, auto_detect, path_mode))


def imports_of(read: DataFrame) -> DataFrame:
    """The same of texts that were read (project_id, path, content)."""
    return extract_imports(read.select("project_id", F.col("path").alias("file"), "content"))


def audit_projects(spark: SparkSession, roots: Mapping[str, str] | DataFrame, options: Options = Options(), exclude: Sequence[str] = (), auto_detect: bool = True, path_mode: str = "relative") -> DataFrame:
    """One report row per project with a readable manifest. Nothing is kept: files are scanned once for usage and once for
    locations. project_audit keeps them in between."""
    return audit_read(read_manifests(spark, roots), project_imports(spark, roots, exclude, auto_detect, path_mode), options)


def audit_read(manifests: DataFrame, imports: DataFrame, options: Options = Options()) -> DataFrame:
    """The same of manifests, with those that can't be read, and imports."""
    fine = manifests.where("error is null")
    return audit(fine, declared_packages(fine), imports, options)


@contextmanager
def project_audit(spark: SparkSession, roots: Mapping[str, str] | DataFrame, options: Options = Options(), exclude: Sequence[str] = (), auto_detect: bool = True, path_mode: str = "relative") -> Iterator[DataFrame]:
    """The same report for use within the context: manifests and imports are kept, on disk where memory runs out, and released at its end."""
    manifests = read_manifests(spark, roots).where("error is null").persist()
    imports = project_imports(spark, roots, exclude, auto_detect, path_mode).persist()
    try:
        yield audit(manifests, declared_packages(manifests), imports, options)
    finally:
        manifests.unpersist()
        imports.unpersist()
