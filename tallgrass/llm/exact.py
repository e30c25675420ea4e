"""Operator 2, exact dedup by a content sort."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, LOWER_AZ, UPPER_AZ, arrow_map, as_bytes, checked_small, cut, stored

#: Leading bytes of a normalised text that a splitter holds; longer texts that agree in all of them are told apart by their
#: SHA-256. Ranges for each shuffle partition; texts sampled for each range, and in all.
KEY, RANGES, EACH, SAMPLE = 4096, 3, 20, 20_000
#: Rows of a run that are held at once; a longer run goes on as a new piece, put together like runs that cross partitions.
HELD = 1 << 16

#: fold_case, or bytes where texts are compared as they are.
Fold = Callable[[bytes], bytes]


def fold_case(text: bytes) -> bytes:
    """A-Z to a-z and nothing else."""
    return text.translate(LOWER)


def sort_key(text: bytes) -> tuple[bytes, bytes]:
    """The order of contents: normalised bytes, from KEY on the hash."""
    return text[:KEY], hashlib.sha256(text).digest() if len(text) > KEY else b""


def splitters(rows: DataFrame, field: str, fold: Fold) -> list[tuple[bytes, bytes]]:
    """Quantiles of the contents of a sample; a content that is very frequent comes several times.

    At most SAMPLE keys of KEY bytes go to the driver. Which rows are sampled only moves the borders of the ranges."""
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(SAMPLE, EACH * ranges)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sort_key(fold(x)) for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["key", "sha"])

    n = rows.count()
    sample = rows.select(F.col("row").getField(field).alias("text"))
    if n > wanted:
        sample = sample.where(F.rand(11) < wanted / n)
    found = sorted((bytes(r["key"]), bytes(r["sha"])) for r in arrow_map(sample, keys, "key binary, sha binary").limit(2 * wanted).collect())
    ranges = max(1, min(ranges, len(found) // 5))
    return [found[len(found) * i // ranges] for i in range(1, ranges)]


def normal(text: Column, fold: Fold) -> Column:
    """The normalised bytes of a text, as fold makes them; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    return (F.translate(whole, UPPER_AZ, LOWER_AZ) if fold is fold_case else whole).cast("binary")


def content_sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: Column, fold: Fold) -> DataFrame:
    """(part, id, spread, row, norm): range partitions of the normalised bytes, each in order of them, the row that stays in front of its equals.

    A content that fills several ranges is dealt over them by a hash of its rows' ids, so that a group of copies of
    any size is spread; only such a content's rows are in more than one range. The sort is Spark's external one, which spills to disk.
    """
    rows = docs.select(docs[id_col].alias("id"), carry.alias("row"))
    borders = docs.sparkSession.sparkContext.broadcast(splitters(rows, text_col, fold))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = borders.value
        for batch in batches:
            parts, spread = [], []
            for k, text in enumerate(as_bytes(batch.column("row").field(text_col))):
                key = sort_key(fold(text))
                low = bisect_left(known, key)
                same = bisect_right(known, key, low) - low
                parts.append(low + zlib.crc32(repr(batch.column("id")[k].as_py()).encode()) % same if same > 1 else low)
                spread.append(same > 1)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column("id"), pa.array(spread, pa.bool_()), batch.column("row")], names=["part", "id", "spread", "row"])

    # texts are normalised again behind the shuffle, so that each is sent once
    kind = f"part int, id {rows.schema['id'].dataType.simpleString()}, spread boolean, row {rows.schema['row'].dataType.simpleString()}"
    whole = arrow_map(rows, deal, kind).repartition("part").withColumn("norm", normal(F.col("row").getField(text_col), fold))
    return whole.sortWithinPartitions("part", "norm", F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last())


def best_of(keep: str, key: str) -> Column:
    """The id that stays and the run that has it; null ids stay only where there is no other."""
    if keep == "largest":
        return F.max(F.struct(F.col(key).alias("id"), (-F.col("part")).alias("part"), (-F.col("run")).alias("run")))
    return F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("part").alias("part"), F.col("run").alias("run")))


def crossing(runs: DataFrame, keep: str, size: Column) -> DataFrame:
    """Of runs (id, part, run, text) that may go on elsewhere: (at_part, at_run, all_id, all_size, wins) of those that do.

    Runs are put together by their whole texts, combined before the shuffle. A text has a run for each range at most, or for HELD rows."""
    members = F.collect_list(F.struct("part", "run")).alias("members")
    whole = runs.groupBy("text").agg(best_of(keep, "id").alias("best"), F.sum(size).alias("all_size"), members).where(F.size("members") > 1)
    each = whole.select("best", "all_size", F.explode("members").alias("at"))
    wins = (F.abs("best.part") == F.col("at.part")) & (F.abs("best.run") == F.col("at.run"))
    return each.select(F.col("at.part").alias("at_part"), F.col("at.run").alias("at_run"), F.col("best.id").alias("all_id"), "all_size", wins.alias("wins"))


def small_crossing(runs: DataFrame, keep: str, size: Column) -> DataFrame:
    """crossing(), broadcast if it is small enough: a very common text has a run for every HELD rows. Else a join shuffles by run, of which none is hot."""
    return checked_small(cut(crossing(runs, keep, size)), held=F.length(F.col("all_id").cast("string")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", also: tuple[str, ...] = (), fold: Fold = fold_case) -> DataFrame:
    """One row per row of docs: id, keep_id (id of the row that stays), group_size, kept, text_sha256, and the columns in also.

    Texts are equal if they are identical after A-Z are lower-cased; null counts as empty. Of rows with equal texts
    and equal ids just one is kept; a null id stays only where a group has no other. Ids may be of any type that sorts.
    An empty table gives no rows; other columns aren't read, whatever they are called. Long texts are compared whole.

    Neighbours in the order of contents are compared in full. Runs of a content that is spread over ranges, and pieces of a very long run, are put
    together by their whole texts, one for each range or piece.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_was, text_was, spread_was, run, first = None, None, False, 0, False
        held: list = []

        def flush(last: bool) -> pa.RecordBatch:
            n, edge = len(held), first or last or spread_was
            columns = [
                pa.array([x[0] for x in held], kind), pa.array([held[0][0]] * n, kind), pa.array([n] * n, pa.int64()), pa.array([True] + [False] * (n - 1)), pa.array([hashlib.sha256(text_was).digest()] * n, pa.binary()),
                pa.array([part_was] * n, pa.int32()), pa.array([run] * n, pa.int32()), pa.array([text_was if edge else None] + [None] * (n - 1), pa.binary()), pa.array([x[1] for x in held], carried),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["id", "keep_id", "group_size", "kept", "sha", "part", "run", "text", "also"])

        ready: list = []
        kind = carried = None
        for batch in batches:
            kind, carried = batch.schema.field("id").type, batch.column("row").field("also").type
            for part, row, spread, text, more in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "spread")), as_bytes(batch.column("norm")), batch.column("row").field("also").to_pylist(), strict=True):
                same = part == part_was and text == text_was
                if held and (not same or len(held) >= HELD):
                    ready.append(flush(same))
                    if len(ready) >= 1024:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready = []
                    held, run, first = [], run + 1, same
                part_was, text_was, spread_was = part, text, spread
                held.append((row, more))
        if held:
            ready.append(flush(False))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    text = "text"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias(text), F.struct(*(docs[c] for c in also) or [F.lit(0).alias("none")]).alias("also"))
    spread = content_sorted(rows, "id", text, keep, F.struct("text", "also"), fold).select("part", "id", "spread", "norm", "row")
    kind, more = rows.schema["id"].dataType.simpleString(), rows.schema["also"].dataType.simpleString()
    slim = cut(arrow_map(spread, local, f"id {kind}, keep_id {kind}, group_size long, kept boolean, sha binary, part int, run int, text binary, also {more}"))
    runs = slim.where("text is not null").select(F.col("keep_id").alias("id"), "group_size", "part", "run", "text")
    joined = slim.join(small_crossing(runs, keep, F.col("group_size")), (F.col("part") == F.col("at_part")) & (F.col("run") == F.col("at_run")), "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("wins").isNull(), F.col("keep_id")).otherwise(F.col("all_id")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("wins", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(F.col("also")[c].alias(c) for c in also),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever they are called: of each group of equal texts one row.

    Null and empty texts are one group, of which one row stays. Of rows with equal texts and ids (repeated rows) just one stays; a
    null id stays only where a group has no other. Very long texts are compared whole. An empty table gives no rows.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_was, text_was, run = None, None, -1
        for batch in batches:
            begins, runs = [], []
            for part, text in zip(batch.column("part").to_pylist(), as_bytes(batch.column("norm")), strict=True):
                begin = part != part_was or text != text_was
                if begin:
                    run += 1
                    runs.append(run)
                begins.append(begin)
                part_was, text_was = part, text
            kept = batch.filter(pa.array(begins, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("row", "id", "part", "spread")), pa.array(runs, pa.int32())], names=["row", "id", "part", "spread", "run"])

    rows = content_sorted(docs, id_col, text_col, keep, F.struct(*(docs[c] for c in docs.columns)), fold_case)
    slim = stored(arrow_map(rows, heads, f"row {rows.schema['row'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, part int, spread boolean, run int"))
    runs = slim.where("spread").select("id", "part", "run", normal(F.col("row").getField(text_col), fold_case).alias("text"))
    losers = checked_small(cut(crossing(runs, keep, F.lit(1)).where("not wins").select("at_part", "at_run")))
    return slim.join(losers, (F.col("part") == F.col("at_part")) & (F.col("run") == F.col("at_run")), "left_anti").select("row.*")


