"""Usage of packages over a stream of source files, as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.imports import extract_imports
from ..operators.audit import usage


def usage_stream(files: DataFrame) -> DataFrame:
    """How each package of each project is imported in the files (project_id, file, content) so far: the same table as a batch gives, for
    output mode update or complete. The state is a row of two flags for each package."""
    return usage(extract_imports(files))
