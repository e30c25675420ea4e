"""Operator 4, near-dedup: SimHash fingerprints compared exactly, tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, as_bytes, checked_small, connected_components, cut, forest, fresh, runs_of, sliced

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a cell that are held as residents or pass by as visitors together, and the sides of the tiles that
#: are compared at once.
RESIDENTS, VISITORS, TILE, STRIP = 1 << 16, 1 << 17, 1024, 256
#: Links are thinned to a forest whenever so many have gathered.
LINKS = 1 << 18
CHUNK = 2 << 20
SPAN = 64


def fingerprints_of(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    digest, counts, hashes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.translate(LOWER).split()
        if len(words) > SHINGLE:
            shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
        else:
            shingles = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes += [digest(x, SEED) for x in shingles]
        counts.append(len(hashes) - before)
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        heads = (np.cumsum(n) - n)[full]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, fp long) of every row, read off whole texts; no words give zero. The tag is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK):
            fps = fingerprints_of(as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(fps.view(np.int64))], names=["id", "tag", "fp"])

    rows = docs.select(docs[id_col].alias("id"), tag_of(docs[text_col]).alias("tag"), docs[text_col].alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, fp long")


def tag_of(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters."""
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


def tiles(fps: np.ndarray, side: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fingerprints in order of their quarters' population counts, cut into tiles with the least and greatest counts."""
    if not len(fps):
        return []
    q = quarters(fps)
    order = np.lexsort((q[:, 3], q[:, 1], q[:, 2], q[:, 0]))
    fps, q = fps[order], q[order]
    return [(fps[i : i + side], q[i : i + side].min(0), q[i : i + side].max(0)) for i in range(0, len(fps), side)]


def compared(held: list, visitors: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between residents and visitors within the radius.

    A pair differs in at least as many bits as the counts of its quarters differ in all; a pair of tiles whose counts
    are further apart than the radius is skipped.
    """
    for strip, low, high in tiles(visitors, STRIP):
        for tile, low2, high2 in held:
            if np.maximum(0, np.maximum(low2 - high, low - high2)).sum() > radius:
                continue
            near = np.bitwise_count(strip[:, None] ^ tile[None, :]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                different = strip[i] != tile[j]
                if different.any():
                    yield strip[i[different]], tile[j[different]]


def links_in(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by (cell, side): residents of a cell are held, visitors pass by in batches."""
    cell_now, resident, held, found, size = None, [], None, [], 0

    def thin() -> pa.RecordBatch:
        u, v = forest(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
        fp = batch.column("fp").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])]))
        for i, j in zip(cuts, [*cuts[1:], len(cell)], strict=True):
            part = fp[i:j].view(np.uint64)
            if cell[i] != cell_now:
                cell_now, resident, held = cell[i], [], None
            if side[i] == 0:
                resident.append(part)
                continue
            if not resident:
                continue
            if held is None:
                held = tiles(np.concatenate(resident), TILE)
            for u, v in compared(held, part, radius):
                found.append((u.view(np.int64), v.view(np.int64)))
                size += len(u)
                if size >= LINKS:
                    yield thin()
                    found, size = [], 0
    if found:
        yield thin()


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v: long) that join all distinct fingerprints (column fp) at most radius bits apart; a spanning forest
    of each task's links instead of all pairs.

    A cell holds the fingerprints with the same population counts in both halves. Each fingerprint is a resident of
    its own cell and visits the cells in half the neighbourhood where the counts differ by the radius at most: a fixed
    number of copies. Cells with more than RESIDENTS or VISITORS are cut into chunks of each, by the fingerprints'
    hash, and each chunk of the one meets each of the other, so that no group grows with the table. How many a cell has
    is counted first: at most 33 * 33 counts go to the driver.
    """
    low, high = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("fp", 32))
    rows = fps.select("fp", low.cast("int").alias("a"), high.cast("int").alias("b"))
    sizes = {(r["a"], r["b"]): r["n"] for r in rows.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    ball = [(x, y) for x, y in product(range(-radius, radius + 1), repeat=2) if abs(x) + abs(y) <= radius and (x, y) >= (0, 0)]
    count = np.zeros((33 + 2 * SPAN, 33 + 2 * SPAN), dtype=np.int64)  # with a margin, which stays empty
    for (a, b), n in sizes.items():
        count[a + SPAN, b + SPAN] = n
    residents = -(-count // RESIDENTS)
    visitors = np.maximum(1, -(-sum(np.roll(count, (x, y), (0, 1)) for x, y in ball) // VISITORS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt_out(a: np.ndarray, b: np.ndarray, r: np.ndarray, v: np.ndarray, side: int, fp: np.ndarray) -> pa.RecordBatch:
            cell = (a * 64 + b).astype(np.int64) << 40 | r << 20 | v
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(fp), side, dtype=np.int32)), pa.array(fp)], names=["cell", "side", "fp"])

        for batch in batches:
            fp, a, b = (batch.column(c).to_numpy() for c in ("fp", "a", "b"))
            mix = ((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
            for x, y in ball:
                at = (a + x + SPAN, b + y + SPAN)
                who = np.repeat(np.arange(len(fp)), residents[at])
                yield dealt_out((a + x)[who], (b + y)[who], runs_of(residents[at]), (mix % visitors[at])[who], 1, fp[who])
            at = (a + SPAN, b + SPAN)
            who = np.repeat(np.arange(len(fp)), visitors[at])
            yield dealt_out(a[who], b[who], (mix % residents[at])[who], runs_of(visitors[at]), 0, fp[who])

    dealt = arrow_map(rows, deal, "cell long, side int, fp long").repartition("cell").sortWithinPartitions("cell", "side")
    return arrow_map(dealt, lambda batches: links_in(batches, radius), "u long, v long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Fingerprints at most radius bits apart are linked, equal ones too. Texts without words (also null ones) have
    fingerprint zero and are linked like others. Repeated rows and ids get a row each; a null id takes part but is
    never the smallest, unless its component has no other. Other columns aren't read; no rows give no rows.
    """
    return tagged_components(docs, id_col, text_col, radius).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tagged_components(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, tag, fp, component_id) of each row of docs."""
    slim = cut(fingerprints(docs, id_col, text_col))
    nodes = slim.groupBy("fp").agg(F.min("id").alias("least"))
    linked = connected_components(near_links(nodes.select("fp"), radius))
    # The smallest id of each component. A component may hold a third of all fingerprints, so that linked is not dealt by component:
    # one row for each component is broadcast if they are few; else a second key deals both sides anew, and AQE may split the large ones.
    whole = nodes.join(linked, nodes["fp"] == linked["node"]).groupBy("component").agg(F.min("least").alias("whole"))
    whole = checked_small(cut(whole.select(F.col("component").alias("part"), F.pmod("component", F.lit(16)).alias("part_second"), "whole")))
    named = linked.join(whole, (F.col("component") == F.col("part")) & (F.pmod("component", F.lit(16)) == F.col("part_second"))).select("node", "whole")
    # a second key, so that the grouped side is dealt anew and AQE may split the partition of a very common fingerprint
    second = F.pmod(slim["fp"], F.lit(16))
    each = nodes.join(named, nodes["fp"] == named["node"], "left").select(nodes["fp"].alias("of"), F.pmod(nodes["fp"], F.lit(16)).alias("of_second"), F.coalesce("whole", "least").alias("component_id"))
    return slim.join(each, (slim["fp"] == each["of"]) & (second == each["of_second"])).select("id", "tag", "fp", "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the smallest id.

    Rows of the component that repeat that id all stay; the exact dedup before leaves none. Rows with a null id stay.
    Rows that share an id with different texts are told apart: each goes or stays by its own text.
    """
    found = tagged_components(docs, id_col, text_col, radius)
    gone, gone_tag = fresh(docs, "gone", "gone_tag")
    losers = checked_small(cut(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(gone), F.col("tag").alias(gone_tag)).distinct()))
    return docs.join(losers, (docs[id_col] == losers[gone]) & (tag_of(docs[text_col]) == losers[gone_tag]), "left_anti")
