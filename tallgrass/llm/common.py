"""What several corpus operators share: batches, words, tables in the shared folder, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bounds on what one Arrow batch brings into a Python worker.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20

#: Most rows of slim tables (ids, hashes), and most bytes of what their rows hold besides, that a join broadcasts.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so that long texts don't pile up in a worker.

    Spark reads the bounds from the session when the plan runs: wider ones are narrowed, a caller's own narrower ones stay.
    """
    conf, size = df.sparkSession.conf, df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size(conf.get(f"spark.sql.execution.arrow.{name}")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of a column, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.binary_length(batch.column(column))
        ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local master without one gets a temporary folder; a cluster, whose
    executors would each write to a folder of their own, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint. For slim rows; Spark's cleaner drops the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def checked_small(df: DataFrame, held: Column | None = None) -> DataFrame:
    """df with a hint to broadcast it if it has few enough rows, which are counted; any join is right either way.

    held: the bytes that a row holds beyond a few fixed columns; their sum is bounded as well."""
    rows, total = df.agg(F.count("*"), F.sum(held if held is not None else F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder. For whole texts, and for rows that are read twice.

    It goes by forget(), or when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = folder(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    STORED[id(out)] = path
    weakref.finalize(out, STORED.pop, id(out), None)
    return out


#: Paths of stored tables, by the identity of their frames.
STORED: dict[int, str] = {}


def folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and the path, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def forget(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more; of other frames nothing."""
    if path := STORED.pop(id(df), None):
        files, at = folder(df.sparkSession, path)
        files.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def runs_of(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, and so on, in one array."""
    n = np.asarray(n, dtype=np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - n, n)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v as links from each node to the smallest node of its component, without the smallest itself."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # hook the roots of both ends to the smaller label, then shorten the paths
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            short = new[new]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v: long), component being the smallest node reachable.

    Rounds of large-star and small-star: every round links the neighbours of each node to the smallest of them, by a
    grouped minimum (combined before the shuffle) and an equi-join that AQE may split where one node has very many
    links; for that a second key, which follows from the first, has the grouped side dealt anew. The rounds grow with the logarithm of the longest chain. Each round ends in a checkpoint; only one number
    goes to the driver.
    """
    state = lambda df: df.agg(F.count("*"), F.countDistinct("v"), F.bit_xor(F.xxhash64("u", "v"))).first()
    pairs = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    now = state(pairs)
    while now[0]:
        # large-star: to all neighbours above a node, from the smallest neighbour or the node itself
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.pmod("u", F.lit(16)).alias("again"), F.least("u", "m").alias("m"))
        large = pairs.join(low, (pairs["u"] == low["n"]) & (F.pmod("u", F.lit(16)) == low["again"])).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small-star: to all neighbours below a node and the node itself, from the smallest of them
        large = cut(large)
        low = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        down = large.join(low, large["v"] == low["n"]).select(F.col("m").alias("x"), F.col("u").alias("y")).where("x < y")
        new = cut(down.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(low.select(F.col("m").alias("u"), F.col("n").alias("v"))).distinct())
        pairs, was, now = new, now, state(new)
        if now == was:
            break
    stars = pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionAll(pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
