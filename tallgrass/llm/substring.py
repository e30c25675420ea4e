"""Operator 10, substring dedup: a count-min sketch tells which word windows may be repeated, and those are grouped exactly."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, checked_small, cut, forget, runs_of, sliced, stored
from .exact import exact_groups

#: Words in a window; words in an anchor. The window's anchor is that of its ANCHOR-word runs with the least hash:
#: windows of the same words have the same anchor, and neighbouring windows mostly share theirs.
WINDOW, ANCHOR = 13, 5
#: Rows of the sketch, and counters in each for every anchor that is expected.
ROWS, ROOM = 2, 8
#: Anchors that a shard of the sketch is made for; shards at least; shards from which on they grow, and the most they are made for.
SHARD, LEAST, MANY, LARGEST = 1 << 21, 16, 4096, 1 << 23
#: Anchors that a task gathers before it sends their counters on.
GATHER = 1 << 20
CHUNK = 1 << 20
#: Words whose hashes a worker remembers.
KNOWN = 1 << 17
#: Words that have a short code, and bytes of text that are sampled to choose them. Which words have one only changes sizes.
CODES, CODE_SAMPLE = 50_000, 64 << 20
#: Candidates that are sampled for very common windows, what share of them makes one, and over how many groups its rows are dealt.
HOT_SAMPLE, HOT_SHARE, SALTS = 400_000, 2000, 1024

WORD = re.compile(rb"[^\x20\x09-\x0D]+")

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    return x ^ (x >> np.uint64(29))


class Anchors:
    """The anchor of every window of a batch of texts, and where each text's words and windows lie."""

    def __init__(self, texts: list[bytes], known: dict[bytes, int], window: int):
        self.words = [x.split() for x in texts]  # bytes.split() splits at exactly \x20 and \x09-\x0D
        digest, hashes, size = xxhash.xxh3_64_intdigest, [], min(ANCHOR, window)
        for words in self.words:
            for w in words:
                h = known.get(w)
                if h is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    h = known[w] = digest(w)
                hashes.append(h)
        self.n = np.array([len(x) for x in self.words], dtype=np.int64)
        self.many = np.maximum(self.n - window + 1, 0)
        h, begins = np.array(hashes, dtype=np.uint64), np.cumsum(self.n) - self.n
        total = max(len(h) - size + 1, 0)
        least = np.zeros(total, dtype=np.uint64)
        for k in range(size):
            least = least * M2 + h[k : k + total]
        least, reach, width = mixed(mixed(least) + M2), window - size + 1, 1
        while width < reach:  # minimum over `reach` neighbours, doubling what is covered
            step = min(width, reach - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        self.anchor = least[np.repeat(begins, self.many) + runs_of(self.many)]

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.many)


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array of numbers as a column of bytes; ends has where each ends."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))


def shards_for(anchors: int) -> int:
    """A shard's memory is bounded, so that shards grow in number with the table, from MANY on in size as well."""
    return max(LEAST, min(anchors // SHARD, MANY), anchors // LARGEST)


def sent_rows(anchor: np.ndarray, doc: np.ndarray, keys: np.ndarray, shards: int, turn: int) -> Iterator[pa.RecordBatch]:
    """A task's own sketch, by shard: kind 0 has the anchors with count one and the texts that ask about them, kind 1 those of two and more,
    kind 2 what the task can answer by itself: the texts in which it has met anchors of kind 1.

    So an anchor that very many texts share is sent once by each task.
    """
    names = ["shard", "kind", "docs", "counts", "anchors"]
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(starts, len(anchor)))
    often = np.repeat(sizes > 1, sizes)
    # anchors are least hashes, so that they lie low; their hashes don't
    shard_of = lambda a: ((mixed(a) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def ends_of(sorted_values: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values))

    def row(kind: int, shard: np.ndarray, a: np.ndarray, d: np.ndarray | None) -> pa.RecordBatch:
        ends = ends_of(shard)
        if d is None:
            empty = np.zeros(len(ends), dtype=np.int64)
            docs, counts = lists(empty[:0], empty, pa.int64()), lists(empty[:0], empty, pa.int32())
        else:
            runs = ends_of(shard * (len(keys) + 1) + d)
            upto = np.searchsorted(runs, ends, side="right")
            docs, counts = lists(keys[d[runs - 1]], upto, pa.int64()), lists(np.diff(runs, prepend=0).astype(np.int32), upto, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(shard[ends - 1].astype(np.int32)), pa.array(np.full(len(ends), kind, dtype=np.int32)), docs, counts, blobs(a, ends)], names=names)

    if (~often).any():
        a, d = anchor[~often], doc[~often]
        shard = shard_of(a)
        order = np.lexsort((d, shard))
        yield row(0, shard[order], a[order], d[order])
    if often.any():
        a = anchor[starts[sizes > 1]]
        yield row(1, shard_of(a), a, None)
        a, d = anchor[often], doc[often]
        order = np.argsort(d, kind="stable")
        yield row(2, np.full(len(d), turn % shards), a[order].astype(np.uint32), d[order])


def told(key: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    """(key, anchors): a row for each text; of an anchor 32 bits are enough to find it in its text again."""
    order = np.argsort(key, kind="stable")
    key, anchor = key[order], anchor[order].astype(np.uint32)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return pa.RecordBatch.from_arrays([pa.array(key[ends - 1]), blobs(anchor, ends)], names=["key", "anchors"])


def suspects(rows: DataFrame, words: int, window: int) -> DataFrame:
    """(key, anchors) of the texts with anchors that the merged sketch counts twice or more. rows: (key, text).

    Each task counts an anchor once for each text and sends its counters to their shards. A shard adds them up and answers
    for every text that asks. Counters are never less than the number of texts with the anchor, so none is lost.
    """
    expected = max(1, words // ANCHOR)
    shards = shards_for(expected)
    bits = max(4, int(ROOM * max(1, expected // shards)).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        anchors, docs, keys, size, held, turn = [], [], [], 0, 0, 0
        for batch in sliced(batches, "text", CHUNK):
            w = Anchors(as_bytes(batch.column("text")), known, window)
            text = w.text_of()
            order = np.lexsort((w.anchor, text))
            a, t = w.anchor[order], text[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])[: len(a)]
            anchors.append(a[once])
            docs.append(t[once] + held)
            keys.append(batch.column("key").to_numpy())
            size, held = size + int(once.sum()), held + batch.num_rows
            if size >= GATHER:
                yield from send(anchors, docs, keys, turn)
                anchors, docs, keys, size, held, turn = [], [], [], 0, 0, turn + 1
        if size:
            yield from send(anchors, docs, keys, turn)

    def send(anchors: list, docs: list, keys: list, turn: int) -> Iterator[pa.RecordBatch]:
        a, d, k = np.concatenate(anchors), np.concatenate(docs), np.concatenate(keys)
        first = np.zeros(len(k), dtype=bool)  # repeated rows count once
        first[np.unique(k, return_index=True)[1]] = True
        yield from sent_rows(a[first[d]], d[first[d]], k, shards, turn + int(k[0] % 1009))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asks, askers, often = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if not asks:
                return
            a, k = np.concatenate(asks), np.concatenate(askers)
            twice = np.unique(np.concatenate(often)) if often else np.zeros(0, dtype=np.uint64)
            maybe = np.ones(len(a), dtype=bool)
            for r in range(ROWS):
                step = np.uint64((r + 1) * int(M2) & 0xFFFFFFFFFFFFFFFF)
                cell = lambda x, step=step: (mixed(x + step) >> np.uint64(64 - bits)).astype(np.int64)
                counters = np.zeros(1 << bits, dtype=np.uint8)  # they stop at two
                own = np.sort(cell(a))
                counters[own] = 1
                counters[own[1:][own[1:] == own[:-1]]] = 2
                counters[cell(twice)] = 2
                maybe &= counters[cell(a)] > 1
            if maybe.any():
                yield told(k[maybe], a[maybe])

        for batch in batches:
            for i, (shard, kind) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if shard != now:
                    yield from done()
                    now, asks, askers, often = shard, [], [], []
                blob = batch.column("anchors")[i].as_buffer()
                if kind == 1:
                    often.append(np.frombuffer(blob, dtype=np.uint64))
                    if len(often) >= 256:
                        often = [np.unique(np.concatenate(often))]
                    continue
                who = np.repeat(batch.column("docs")[i].values.to_numpy(), batch.column("counts")[i].values.to_numpy())
                if kind == 2:
                    yield told(who, np.frombuffer(blob, dtype=np.uint32))
                else:
                    asks.append(np.frombuffer(blob, dtype=np.uint64))
                    askers.append(who)
        yield from done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, out = None, [], [], []

        def whole() -> bytes:
            return held[0] if len(held) == 1 else np.unique(np.frombuffer(b"".join(held), dtype=np.uint32)).tobytes()

        for batch in batches:
            for key, blob in zip(batch.column("key").to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                if key != now:
                    if held:
                        keys.append(now)
                        out.append(whole())
                    now, held = key, []
                held.append(blob)
                if len(held) >= 1024:  # a text that comes very often
                    held = [whole()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], names=["key", "anchors"])
            keys, out = [], []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([whole()], pa.binary())], names=["key", "anchors"])

    sent = arrow_map(rows.select("key", "text"), count, "shard int, kind int, docs array<long>, counts array<int>, anchors binary")
    answers = arrow_map(sent.repartition("shard").sortWithinPartitions("shard"), answer, "key long, anchors binary")
    return arrow_map(answers.repartition("key").sortWithinPartitions("key"), merge, "key long, anchors binary")


def key_of(id_: Column, text: Column) -> Column:
    """Tells rows with equal ids and different texts apart."""
    return F.xxhash64(id_, text)


def copies(rows: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(id, key, runs) of the texts whose words are all those of a text with a smaller id: they go whole. And the number of words in all.

    Only one text of each content is looked into for windows; its id is the smallest, so that nothing is lost. Texts whose
    contents have equal hashes are compared in full, by a content sort of just those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.split() for x in as_bytes(batch.column("text"))]
            content = [xxhash.xxh3_128_digest(b" ".join(x)) for x in words]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array([len(x) for x in words], pa.int32()), pa.array(content, pa.binary())], names=["id", "key", "n", "content"])

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.split() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array([len(x) for x in words], pa.int32()), pa.array([b" ".join(x) for x in words], pa.binary()).cast(pa.string())], names=["id", "key", "n", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    slim = cut(arrow_map(rows, run, f"id {kind}, key long, n int, content binary").where(F.col("n") >= window))
    again = slim.groupBy("content").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col("content").alias("of"), F.crc32("content").alias("of_crc"))
    # the second key follows from the first; with it the grouped side is dealt anew, and AQE may split the copies of one text
    alike = cut(slim.join(again, (F.col("content") == F.col("of")) & (F.crc32("content") == F.col("of_crc")), "left_semi").select(F.col("id").alias("of_id"), F.col("key").alias("of_key")).distinct())
    texts = rows.join(checked_small(alike), (F.col("id") == F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi")
    groups = exact_groups(arrow_map(texts, spaced, f"id {kind}, key long, n int, text string"), "id", "text", "smallest", ("key", "n"), fold=bytes)
    later = groups.where("id > keep_id").select("id", "key", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("length"))).alias("runs")).distinct()
    return cut(later), slim.agg(F.sum("n")).first()[0] or 0


def word_codes(rows: DataFrame, size: int) -> dict[bytes, bytes]:
    """Short codes of frequent words: the UTF-8 form of their numbers from 1 on, most frequent first.

    They are chosen from a sample of about CODE_SAMPLE bytes. Other words are written out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("text")):
                found.update(text.split())
        top = found.most_common(2 * CODES)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    sample = rows.select("text") if size <= CODE_SAMPLE else rows.select("text").where(F.rand(5) < CODE_SAMPLE / size)
    top = arrow_map(sample, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1 and length(word) < 64").orderBy(F.desc("n"), "word").limit(CODES).collect()
    return {bytes(r["word"]): chr(i).encode() for i, r in enumerate(top, 1)}


def windows_of(rows: DataFrame, found: DataFrame, codes: dict[bytes, bytes], window: int) -> DataFrame:
    """(code, id, key, place) of each window whose anchor the sketch suspects. rows: (id, key, text).

    A code spells the window's words: that of a frequent word is one character, any other word stands between \\0 and a space, which
    no word has. So codes are equal if and only if the words are, and grouping by them compares words, not hashes.
    """
    kind = rows.schema["id"].dataType.simpleString()
    short = rows.sparkSession.sparkContext.broadcast(codes)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        get = short.value.get
        for batch in sliced(batches, "text", CHUNK):
            w = Anchors(as_bytes(batch.column("text")), known, window)
            suspected = batch.column("anchors").to_pylist()
            have = np.frombuffer(b"".join(suspected), dtype=np.uint32).astype(np.uint64) | np.repeat(np.arange(len(suspected), dtype=np.uint64) << np.uint64(32), [len(x) // 4 for x in suspected])
            text = w.text_of()
            asked = text.astype(np.uint64) << np.uint64(32) | (w.anchor & np.uint64(0xFFFFFFFF))
            starts = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])[: len(asked)])  # neighbours mostly share their anchor
            at = np.flatnonzero(np.repeat(np.isin(asked[starts], have), np.diff(np.append(starts, len(asked)))))
            text, place = text[at], runs_of(w.many)[at]
            ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text)) if len(text) else []
            begin, out = 0, []
            for end in ends:
                spelled = [get(x) or b"\0%s " % x for x in w.words[text[begin]]]
                whole, where = b"".join(spelled), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
                places = place[begin:end]
                out += [whole[i:j] for i, j in zip(where[places].tolist(), where[places + window].tolist(), strict=True)]
                begin = end
            if out:
                yield from pa.Table.from_arrays([pa.array(out, pa.binary()), batch.column("id").take(pa.array(text)), batch.column("key").take(pa.array(text)), pa.array(place.astype(np.int32))], names=["code", "id", "key", "place"]).to_batches(max_chunksize=1 << 14)

    asked = found.withColumnRenamed("key", "of")
    joined = rows.join(checked_small(asked, held=F.length("anchors")), F.col("key") == F.col("of")).select("id", "key", "text", "anchors")
    return arrow_map(joined, candidates, f"code binary, id {kind}, key long, place int")


def later_windows(found: DataFrame) -> DataFrame:
    """(id, key, place) of each window whose words are also those of a window with a smaller id. found: (code, id, key, place), stored.

    Windows are grouped by their codes, once. Those that make up over 1 / HOT_SHARE of a sample get their least id by another way to the
    same result, a minimum that is combined before its shuffle and broadcast (HOT_SHARE rows at most), and are dealt by a salt: no task gets
    all their rows.
    """
    n = found.count()
    sample = found.select("code") if n <= HOT_SAMPLE else found.select("code").where(F.rand(3) < HOT_SAMPLE / n)
    often = F.col("count") > max(1, min(n, HOT_SAMPLE) // HOT_SHARE)
    hot = [F.lit(r["code"]) for r in sample.groupBy("code").count().where(often).select("code").collect()]
    least = found.where(F.col("code").isin(hot) if hot else F.lit(False)).groupBy("code").agg(F.min("id").alias("common_least"))
    known = found.join(F.broadcast(least), "code", "left").withColumn("salt", F.when(F.col("common_least").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "place"), F.lit(SALTS))))
    return known.withColumn("least", F.coalesce("common_least", F.min("id").over(Window.partitionBy("code", "salt")))).where("id > least").select("id", "key", "place")


def repeated(rows: DataFrame, window: int) -> DataFrame:
    """(id, key, runs: array of (start, length)) of each text with words to remove, as a checkpoint. rows: (id, key, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places").to_pylist():
                runs: list[list[int]] = []
                for p in sorted(places):
                    if runs and p <= runs[-1][0] + runs[-1][1]:
                        runs[-1][1] = p + window - runs[-1][0]
                    else:
                        runs.append([p, window])
                out.append([{"start": a, "length": n} for a, n in runs])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))], names=["id", "key", "runs"])

    whole, words = copies(rows, window)
    gone = checked_small(whole.select(F.col("id").alias("gone"), F.col("key").alias("gone_key")))
    rows = rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("key") == F.col("gone_key")), "left_anti")
    suspected = stored(suspects(rows, words, window))
    found = stored(windows_of(rows, suspected, word_codes(rows, 6 * words), window))
    parts = arrow_map(later_windows(found).groupBy("id", "key").agg(F.collect_set("place").alias("places")), to_runs, f"id {kind}, key long, runs array<struct<start:int,length:int>>")
    out = cut(parts.unionAll(whole))
    forget(suspected)
    forget(found)
    return out


def with_runs(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(row, runs): docs' rows as structs, and the runs of words to remove from the text, null if there are none."""
    id_, key = docs[id_col], key_of(docs[id_col], docs[text_col])
    found = repeated(docs.select(id_.alias("id"), key.alias("key"), docs[text_col].alias("text")).where("id is not null"), window)
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), id_.alias("row_id"), key.alias("row_key"))
    return row.join(checked_small(found, held=8 * F.size("runs")), (F.col("row_id") == F.col("id")) & (F.col("row_key") == F.col("key")), "left").select("row", "runs")


def left_words(text: bytes, runs: list | None) -> tuple[int, list[bytes]]:
    """How many words the text has, and those outside the runs."""
    words = text.split()
    if not runs:
        return len(words), words
    out, at = [], 0
    for r in runs:
        out += words[at : r["start"]]
        at = r["start"] + r["length"]
    return len(words), out + words[at:]


def left_text(text: bytes, runs: list) -> bytes:
    """The text without the runs of words and the white space behind each; all else stays as it is."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, begin = [], 0
    for r in runs:
        out.append(text[begin : at[r["start"]]])
        begin = at[r["start"] + r["length"]]
    return b"".join(out).rstrip() if begin == len(text) else b"".join(out) + text[begin:]


def substring_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    A word goes if a window that covers it also starts in a row with a smaller id; null texts have no words. Rows with
    equal ids don't touch each other; rows with a null id are kept whole and touch no others. Ids may be of any type that
    sorts. Very long texts are read whole. Other columns aren't read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [left_words(*x) for x in zip(as_bytes(batch.column("row").field("text")), batch.column("runs").to_pylist(), strict=True)]
            total, gone = [n for n, _ in found], [n - len(left) for n, left in found]
            sha = [hashlib.sha256(b" ".join(left)).hexdigest() for _, left in found]
            yield pa.RecordBatch.from_arrays([batch.column("row").field("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    placed = with_runs(slim, "id", "text", window)
    kind = slim.schema["id"].dataType.simpleString()
    return arrow_map(placed, run, f"id {kind}, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, window: int = WINDOW) -> DataFrame:
    """docs with the repeated words cut out of their texts, each with the white space behind it; all else stays as it is.
    chars_col, if given, gets the new number of code points of such texts. Texts that lose all words are left out.

    Null and empty texts stay, as do rows with a null id, which touch no others; rows with equal ids don't touch each other. Very long
    texts are read whole. Columns may have any names. An empty table gives no rows.
    """
    names = docs.columns
    at, chars = names.index(text_col), names.index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            fields = [row.field(i) for i in range(row.type.num_fields)]
            texts, lost, whole = fields[at].to_pylist(), [], []
            for i, (text, runs) in enumerate(zip(as_bytes(fields[at]), batch.column("runs").to_pylist(), strict=True)):
                if runs:
                    texts[i] = left_text(text, runs).decode("utf-8", "replace")
                    lost.append(i)
                whole.append(not runs or bool(texts[i].strip()))
            fields[at] = pa.array(texts, fields[at].type)
            if chars is not None and lost:
                counts = fields[chars].to_pylist()
                for k in lost:
                    counts[k] = len(texts[k])
                fields[chars] = pa.array(counts, fields[chars].type)
            yield pa.RecordBatch.from_arrays(fields, names=names).filter(pa.array(whole, pa.bool_()))

    placed = with_runs(docs, id_col, text_col, window)
    return arrow_map(placed, run, docs.schema)
