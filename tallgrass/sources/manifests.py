"""Manifests (S3-S5, P1, P2): strict JSON, and one row per declared package."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import SECTIONS

NOT_AN_OBJECT = "package.json root must be a JSON object"


def parse_json(text: str) -> tuple[object, str | None]:
    """A value and no message, or a message. Nothing may follow the value, and NaN and Infinity are no numbers."""

    def refuse(name: str) -> None:
        raise ValueError(f"Unexpected token {name}")

    try:
        return json.loads(text, parse_constant=refuse), None
    except (ValueError, RecursionError) as e:
        return None, str(e)


def property_order(keys: list[str]) -> list[str]:
    """Keys in the order of an object's properties: array indexes first, by value, then the others as they came."""
    index = lambda k: k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1
    return sorted(filter(index, keys), key=int) + [k for k in keys if not index(k)]


def declared_rows(text: str | None, path: str) -> tuple[list[tuple[str, int, str]], dict | None]:
    """(category, ord, package) of each key of the three sections; or the error. Sections that aren't objects have none."""
    value, message = parse_json(text if text is not None else "")
    if message is None and not isinstance(value, dict):
        message = NOT_AN_OBJECT
    if message is not None:
        return [], {"type": "PARSE_ERROR", "path": path, "message": message}
    return [(s, i, k) for s in SECTIONS if isinstance(value.get(s), dict) for i, k in enumerate(property_order(list(value[s])))], None


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """(project_id, path, name, version, declared: array of (category, ord, package), error) of manifests
    (project_id, path, raw)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for project, path, raw in zip(batch["project_id"], batch["path"], batch["raw"], strict=True):
                rows, error = declared_rows(raw, path)
                root = {} if error else parse_json(raw)[0]
                text = lambda key, root=root: root[key] if isinstance(root.get(key), str) else None
                out.append((project, path, text("name"), text("version"), [{"category": c, "ord": i, "package": p} for c, i, p in rows], error))
            yield pd.DataFrame(out, columns=["project_id", "path", "name", "version", "declared", "error"])

    return manifests.select("project_id", "path", "raw").mapInPandas(run, "project_id string, path string, name string, version string, declared array<struct<category: string, ord: int, package: string>>, error struct<type: string, path: string, message: string>")


def declared_packages(parsed: DataFrame) -> DataFrame:
    """(project_id, category, ord, package): one row per declared key."""
    return parsed.select("project_id", F.inline("declared"))
