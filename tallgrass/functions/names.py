"""From an import's path to the package it names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import BUILTINS


def package_root(path: Column) -> Column:
    """The package of a path: the first part, or two for a scope; null for addresses, relative and absolute paths, and
    scopes without a name. White space stays."""
    parts = F.split(path, "/", -1)
    second = F.get(parts, 1)
    return (
        F.when(path.isNull() | (path == ""), None)
        .when(path.rlike(r"^(?:https?|file):"), None)
        .when(path.startswith(".") | path.startswith("/"), None)
        .when(path.startswith("@"), F.when(second != "", F.concat_ws("/", F.get(parts, 0), second)))
        .otherwise(F.get(parts, 0))
    )


def builtin(package: Column) -> Column:
    return package.isin(BUILTINS)
