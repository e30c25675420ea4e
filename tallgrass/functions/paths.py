"""Which files are scanned."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import BUILD_SUFFIXES, DEV_CONFIGS, EXCLUDED_DIRECTORIES, EXCLUDED_NAMES, EXTENSIONS, PRODUCTION_TOOLS


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the name on; empty for names that only begin with a dot."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def analyzable(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def production_config(path: Column) -> Column:
    return basename(path).rlike(rf"^(?:{'|'.join(PRODUCTION_TOOLS)})\.config\.(?:js|ts|mjs|cjs)\z")


def any_of(parts: Iterable[str]) -> str:
    """An expression that finds any of the literal parts."""
    return "|".join(x.replace(".", r"\.") for x in parts)


def excluded(path: Column) -> Column:
    """In a directory, or with a name, that belongs to builds, tests or development tools."""
    slashed = F.regexp_replace(path, r"\\", "/")
    rooted = F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))
    directories = [x if x.startswith("/") else f"/{x}" for x in EXCLUDED_DIRECTORIES]
    return rooted.rlike(any_of(directories)) | basename(path).rlike(any_of(EXCLUDED_NAMES + DEV_CONFIGS))


def admitted(path: Column) -> Column:
    """The cascade: declarations and other extensions go, production configs stay, excluded paths go, the rest stays."""
    return F.when(path.endswith(".d.ts"), False).when(~analyzable(path), False).when(production_config(path), True).when(excluded(path), False).otherwise(True)


def in_build_like_directory(rel_path: Column) -> Column:
    """Below a directory at the root whose name ends like a build's."""
    return rel_path.rlike(rf"^[^/]*(?:{'|'.join(BUILD_SUFFIXES)})/")


def glob_regex(glob: str) -> str:
    """A glob over relative paths as an anchored regular expression that Java and Python both read.

    ** spans directories where it is a whole part; * and ? stay within a part; [...] and {a,b} are known. A leading ./
    is dropped. What ends in /** takes all that is below.
    """
    glob = re.sub(r"^(?:\./)+", "", glob)
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob[i:] == "**" and (i == 0 or glob[i - 1] == "/"):
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]"
            i = end
        elif c == "{" and glob.find("}", i) > 0:
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += "\\" + c if c in r"\.^$+()|{}[]&-#~" else c
        i += 1
    return out


def globs_regex(globs: Iterable[str]) -> str:
    """One anchored expression for all; it matches nothing if there are none."""
    parts = list(dict.fromkeys(glob_regex(g) for g in globs))
    return rf"^(?:{'|'.join(parts)})\z" if parts else r"(?!)"
