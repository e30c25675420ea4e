"""Operator 8, best-fit packing of texts into training sequences, with conflicts between pieces."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, as_bytes, checked_small, cut, sliced

#: Words that a bin holds; pieces that are packed together at most, about.
CAPACITY, TOGETHER = 2048, 4096
#: Rows of one id and one content that may meet in a group by their hash.
ALIKE = 16
CHUNK = 4 << 20

PIECES = "piece int, start long, length long, bin_group int, bin_no int"


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (length, source, cluster), taken in the order given; no bin gets a source or a cluster twice.

    Open bins stand in order of what is left in them. The search begins at the first bin that is large enough and goes
    on to the next larger one until neither its bitmap of sources nor that of clusters has the piece's bit.
    """
    open_bins: list[tuple[int, int]] = []  # (left, bin), in order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        source_bit, cluster_bit = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and (sources[open_bins[at][1]] & source_bit or clusters[open_bins[at][1]] & cluster_bit):
            at += 1
        if at < len(open_bins):
            left, k = open_bins.pop(at)
        else:
            left, k = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[k] |= source_bit
        clusters[k] |= cluster_bit
        if left > length:
            insort(open_bins, (left - length, k))
        out.append(k)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, together: int = TOGETHER) -> DataFrame:
    """One row per piece: id, piece, start (word), length (words), bin_group, bin_no. A bin is (bin_group, bin_no).

    Lengths are words. A text longer than the capacity is cut into pieces, all but the last of the capacity itself;
    full pieces have a bin of their own. The others are packed, longest first, ties by id and piece, so that no bin holds
    two pieces of one source or of one cluster of duplicates (texts that are equal when A-Z are lower-cased). Null
    sources don't conflict. A text without words (or null) gives one row with length 0 and null bin. Repeated rows are
    packed as rows of their own, never into one bin. An empty table gives no rows.

    Rows are dealt to groups of about `together` by a hash of id and content and packed group by group: memory and time of a
    task don't grow with the table, and the hot source is spread evenly. Rows that repeat an id (or a null id) with one
    content over ALIKE times are dealt one by one. Groups share no bins. Very long texts are measured whole; columns with other
    names aren't read.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK):
            texts = as_bytes(batch.column("text"))
            hashes = [xxhash.xxh3_128_digest(x.translate(LOWER)) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(hashes, pa.binary())], names=["id", "source", "words", "cluster"])

    def fill(table: pa.Table) -> pa.Table:
        group = table.column("bin_group")[0].as_py()
        rows = sorted(zip(table.column("id").to_pylist(), table.column("source").to_pylist(), table.column("words").to_pylist(), table.column("cluster").to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[3], x[1] or ""))
        source_no: dict = {}
        cluster_no: dict = {}
        out, open_pieces, full = [], [], 0
        for doc, source, words, cluster in rows:
            s = -1 if source is None else source_no.setdefault(source, len(source_no))
            c = cluster_no.setdefault(cluster, len(cluster_no))
            if not words:
                out.append((doc, 0, 0, 0, group, None))
            for k, start in enumerate(range(0, words, capacity)):
                length = min(capacity, words - start)
                if length == capacity:
                    out.append((doc, k, start, length, group, full))
                    full += 1
                else:
                    open_pieces.append((-length, len(out), s, c))
                    out.append((doc, k, start, length, group, None))
        open_pieces.sort()
        for (_, at, _, _), k in zip(open_pieces, best_fit([(-n, s, c) for n, _, s, c in open_pieces], capacity), strict=True):
            out[at] = (*out[at][:5], full + k)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((table.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["id", *(x.split()[0] for x in PIECES.split(", "))])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[source_col].cast("string").alias("source"))
    kind = rows.schema["id"].dataType.simpleString()
    slim = cut(arrow_map(rows, measure, f"id {kind}, source string, words long, cluster binary"))
    groups = max(1, -(-slim.count() // together))
    alike = slim.groupBy("id", "cluster").agg(F.count("*").alias("n")).where(F.col("n") > ALIKE).select(F.col("id").alias("of"), F.col("cluster").alias("of_cluster"), F.lit(1).alias("often"))
    # slim is a checkpoint, so that a row's running number is the same whenever a task runs
    numbered = slim.withColumn("row", F.monotonically_increasing_id())
    salted = numbered.join(checked_small(cut(alike)), F.col("id").eqNullSafe(F.col("of")) & (F.col("cluster") == F.col("of_cluster")), "left")
    dealt = salted.select("id", "source", "words", "cluster", F.pmod(F.xxhash64("id", "cluster", F.when(F.col("often") == 1, F.col("row"))), F.lit(groups)).cast("int").alias("bin_group"))
    return dealt.groupBy("bin_group").applyInArrow(fill, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
