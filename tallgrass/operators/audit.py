"""Joins and aggregates of the audit (A1-A4, D1, D3, D4, F12, F14, J1-J4, U2), for any number of projects."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import production_config
from ..rules import DEPENDENCIES, DEV, PEER, RUNTIME

KEY = ["project_id", "package"]


@dataclass(frozen=True)
class Options:
    check_all: bool = False
    check_peer: bool = False
    ignored: Sequence[str] = field(default_factory=tuple)


def rank(category: Column, order: Sequence[str]) -> Column:
    out = F.lit(len(order))
    for i in range(len(order) - 1, -1, -1):
        out = F.when(category == order[i], i).otherwise(out)
    return out


def not_ignored(rows: DataFrame, ignored: Sequence[str]) -> DataFrame:
    return rows.where(~F.col("package").isin(list(ignored))) if ignored else rows


def usage(imports: DataFrame) -> DataFrame:
    """How each package of each project is imported: combined before the shuffle, a row for each package after it."""
    return imports.groupBy(*KEY).agg(F.bool_or(F.col("import_type") == RUNTIME).alias("has_runtime"), F.bool_or(F.col("import_type") != RUNTIME).alias("has_type_only"))


def judged(declared: DataFrame, used: DataFrame) -> DataFrame:
    """declared, each row with two flags, from one join: unused (imported in no way) and type_only (only for types)."""
    both = declared.join(used, KEY, "left")
    return both.select(*declared.columns, F.col("has_runtime").isNull().alias("unused"), (F.coalesce("has_type_only", F.lit(False)) & ~F.coalesce("has_runtime", F.lit(True))).alias("type_only"))


def first_at_line(locations: DataFrame, order: Sequence[str] = ("pass", "match_seq")) -> DataFrame:
    """Of several imports of a package on one line of a file, the one that comes first."""
    w = Window.partitionBy(*KEY, "file", "line").orderBy(*order)
    return locations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def misplaced_locations(declared: DataFrame, imports: DataFrame, order: Sequence[str] = ("pass", "match_seq")) -> DataFrame:
    """Where packages of the development section are imported at runtime outside production configs.

    imports is filtered before the join; Spark broadcasts the section if its size allows it and else may split
    the partitions of packages that are imported very often."""
    dev = declared.where(F.col("category") == DEV).select(*KEY, "ord")
    runtime = imports.where((F.col("import_type") == RUNTIME) & ~production_config(F.col("file")))
    return first_at_line(runtime.join(dev, KEY), order)


def with_locations(found: DataFrame, order: Sequence[str] = ("file", "pass", "match_seq")) -> DataFrame:
    """(project_id, package, ord, locations): one row per package, its places in order."""
    place = F.struct(*order, F.struct("file", "line", F.col("import_statement").alias("importStatement")).alias("at"))
    return found.groupBy(*KEY, "ord").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["at"]).alias("locations"))


def all_dependencies(declared: DataFrame) -> DataFrame:
    """Each package of a project once: where it is declared first, of dependencies, development and peers."""
    w = Window.partitionBy(*KEY).orderBy(rank(F.col("category"), [DEPENDENCIES, DEV, PEER]), "ord")
    return declared.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def production_dependencies(declared: DataFrame) -> DataFrame:
    return all_dependencies(declared.where(F.col("category") == DEPENDENCIES))


def buckets(declared: DataFrame, imports: DataFrame, options: Options) -> DataFrame:
    """(project_id, bucket, at, package) of everything that is wrong, except where: unused, unusedPeer, typeOnly and
    misplaced. With check_all all sections count, as a bag: a peer that isn't used is in two buckets, and a package of two
    sections in one bucket twice; misplaced is empty then. at gives the order within a bucket."""
    declared = not_ignored(declared, options.ignored)
    order = [DEPENDENCIES, PEER, DEV] if options.check_all else [DEPENDENCIES]
    at = F.struct(rank(F.col("category"), order).alias("section"), F.col("ord").alias("ord"))
    rows = judged(declared, usage(imports))
    counted = F.col("category").isin(order)
    names = [F.when(counted & F.col("unused"), "unused"), F.when(counted & F.col("type_only"), "typeOnly")]
    if options.check_all or options.check_peer:
        names.append(F.when((F.col("category") == PEER) & F.col("unused"), "unusedPeer"))
    out = rows.select("project_id", F.explode(F.array_compact(F.array(*names))).alias("bucket"), at.alias("at"), "package")
    if not options.check_all:
        found = misplaced_locations(declared, imports).select(*KEY, "ord").distinct()
        out = out.unionByName(found.select("project_id", F.lit("misplaced").alias("bucket"), F.struct(F.lit(0).alias("section"), "ord").alias("at"), "package"))
    return out


def total_issues(declared: DataFrame, imports: DataFrame, options: Options) -> DataFrame:
    """(project_id, total_issues long) of projects with any."""
    return buckets(declared, imports, options).groupBy("project_id").agg(F.count("*").alias("total_issues"))


REPORT_TYPE = "array<struct<packageName: string, locations: array<struct<file: string, line: int, importStatement: string>>>>"


def audit(projects: DataFrame, declared: DataFrame, imports: DataFrame, options: Options) -> DataFrame:
    """One row per project of projects (project_id): unused, unusedPeer, misplaced, typeOnly, ignored, totalIssues."""
    rows = buckets(declared, imports, options).where("bucket != 'misplaced'")
    names = lambda bucket: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == bucket, F.struct("at", "package")))), lambda x: x["package"]).alias(bucket)
    lists = rows.groupBy("project_id").agg(names("unused"), names("unusedPeer"), names("typeOnly"))
    out = projects.select("project_id").distinct().join(lists, "project_id", "left")
    empty = F.array().cast("array<string>")
    wrong = F.array().cast(REPORT_TYPE)
    if not options.check_all:
        found = with_locations(misplaced_locations(not_ignored(declared, options.ignored), imports))
        place = F.struct("ord", F.col("package").alias("packageName"), "locations")
        grouped = found.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: F.struct(x["packageName"].alias("packageName"), x["locations"].alias("locations"))).alias("misplaced"))
        out = out.join(grouped, "project_id", "left")
        wrong = F.coalesce("misplaced", wrong)
    out = out.select("project_id", *(F.coalesce(c, empty).alias(c) for c in ("unused", "unusedPeer")), wrong.alias("misplaced"), F.coalesce("typeOnly", empty).alias("typeOnly"), F.array(*map(F.lit, options.ignored)).cast("array<string>").alias("ignored"))
    return out.withColumn("totalIssues", F.size("unused") + F.size("unusedPeer") + F.size("misplaced") + F.size("typeOnly"))


def has_issues(report: DataFrame) -> Column:
    return report["totalIssues"] > 0
