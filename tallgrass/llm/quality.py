"""Operator 1, quality rules: repetition found by a suffix array over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, as_bytes, sliced

#: A word window of this length that is found twice counts into n_repeat_words.
WINDOW = 5
#: Repeats of at least MIN_REPEAT words count as spans. A text goes if the union of the spans covers more than
#: MAX_COVERED of its words, or if one repeat is longer than MAX_LONGEST words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.15, 50
#: Bytes of text that are sorted together; a longer text is sorted alone.
CHUNK = 1 << 20

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from it on that also starts elsewhere.

    Prefix doubling sorts the suffixes; only groups that are still tied are sorted again. Two suffixes have equal ranks
    at level k if their first 2**k symbols are equal, so that the levels, from the highest down, give the longest
    common prefix of neighbours in the suffix array. The longer of a suffix's two is its deepest LCP interval.
    Matches must end before the end of the array: the caller ends each text with a symbol of its own.
    """
    n = len(symbols)
    suffixes = np.argsort(symbols, kind="stable")
    inner = symbols[suffixes]
    starts = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, dtype=np.int32)
    rank[suffixes] = np.repeat(starts, sizes)
    levels, step = [rank], 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(slots):
        tied = suffixes[slots]
        key = rank[tied].astype(np.int64) * n + rank[tied + step]
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        suffixes[slots] = tied
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        rank = rank.copy()
        rank[tied] = np.repeat(slots[first], sizes)
        levels.append(rank)
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    low = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]])
    a, b = suffixes[low].copy(), suffixes[low + 1].copy()
    common = np.zeros(len(low), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][a] == levels[k][b])
        common[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    between = np.zeros(n + 1, dtype=np.int64)
    between[low + 1] = common
    longest = np.empty(n, dtype=np.int64)
    longest[suffixes] = np.maximum(between[:-1], between[1:])
    return longest


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the union of the spans holds."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def judged(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    ids: list[int] = []
    counts, chars, symbols, dup_lines = [], [], [], []
    for text in texts:
        words = text.split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
        base, known = len(ids), {}
        put = known.setdefault
        ids += [base + put(w, len(known)) for w in words]
        ids.append(base + len(words))  # the end of a text equals nothing else
        counts.append(len(words))
        chars.append(len(b"".join(words).decode("utf-8", "replace")))
        symbols.append(len(text) - len(text.translate(None, b"#*$%&|<>")))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    n_words = np.array(counts, dtype=np.int64)
    if not len(n_words):
        return [np.array([], dtype=x) for x in ("i8", "i8", "i8", "i8", "i8", "?", "?", "i8", "i8")]
    n, heads = len(ids), np.cumsum(n_words + 1) - n_words - 1
    longest = longest_repeats(np.array(ids, dtype=np.int64))
    per_text = lambda held: np.add.reduceat(held.astype(np.int64), heads)
    twice = np.flatnonzero(longest >= WINDOW)
    n_repeat = per_text(covered(twice, np.full(len(twice), WINDOW), n))
    spans = np.flatnonzero(longest >= min_repeat)
    n_covered = per_text(covered(spans, longest[spans], n))
    top = np.maximum.reduceat(longest, heads)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~failed & (n_covered <= max_covered * n_words) & (top <= max_longest)
    return [n_words, np.array(chars, dtype=np.int64), np.array(symbols, dtype=np.int64), np.array(dup_lines, dtype=np.int64), n_repeat, failed, kept, n_covered, top]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of docs: its id and FIELDS. Rows are judged alone: no shuffle, and a lost task is run again.

    A null or empty text has no words and fails the base rules. Repeated rows and ids get a row each; a null id stays
    null. Other columns aren't read. Of an empty table the result is empty. A text is held whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK):
            out = judged(as_bytes(batch.column("text")), min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out)], names=["id", *(x.split()[0] for x in FIELDS.split(", "))])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever they are called.

    Each row is judged by itself, as in quality_rules: a null or empty text goes, as does a very long one that repeats itself;
    repeated rows stay or go together. An empty table gives no rows."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col, CHUNK):
            yield batch.filter(pa.array(judged(as_bytes(batch.column(at)), min_repeat, max_covered, max_longest)[6]))

    return arrow_map(docs, run, schema)
