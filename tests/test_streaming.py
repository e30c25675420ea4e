"""Extraction is row by row: a stream of files gives the rows that a table of them does."""

from tallgrass.functions.imports import extract_imports
from tallgrass.streaming import usage_stream


def test_stream_of_files(spark, tmp_path):
    files = spark.createDataFrame([("a.ts", "import 'a'\nimport 'b'"), ("b.ts", "require('c')")], "file string, content string")
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    query = extract_imports(stream).select("file", "package", "line").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("found").collect())) == [("a.ts", "a", 1), ("a.ts", "b", 2), ("b.ts", "c", 1)]


def test_usage_of_a_stream(spark, tmp_path):
    """Files that come later change the usage of a package that is known."""
    schema = "project_id string, file string, content string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / f"{n}"))
    put(1, [("p", "a.ts", "import type { T } from 'a'")])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    query = usage_stream(stream).writeStream.format("memory").queryName("used").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    assert list(map(tuple, spark.table("used").collect())) == [("p", "a", False, True)]
    put(2, [("p", "b.ts", "import 'a'\nimport 'b'")])
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("used").collect())) == [("p", "a", True, True), ("p", "b", True, False)]
