"""Suffix-array rules against brute force."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallgrass.llm.quality import judged, keep_quality, longest_repeats, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, min_repeat, max_covered, max_longest):
    words, n = WORDS.findall(text or ""), 0
    n = len(words)
    windows = {}
    for i in range(n - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    longest, spans = 0, set()
    for i in range(n):
        best = max((next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0)
        longest = max(longest, best)
        if best >= min_repeat:
            spans.update(range(i, i + best))
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = n < 10 or 100 * len(hit) > 20 * n
    kept = not failed and len(spans) <= max_covered * n and longest <= max_longest
    return [n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed, kept, len(spans), longest]


text = st.lists(st.sampled_from(["a", "b", "é", "c#", "\n", "a b c d e f", "\t", "\x0b", "\x1c", "日"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, min_size=1, max_size=4), st.integers(1, 8))
def test_against_brute_force(texts, min_repeat):
    got = [x.tolist() for x in judged([t.encode() for t in texts], min_repeat, 0.3, 6)]
    assert [list(x) for x in zip(*got, strict=True)] == [brute(t, min_repeat, 0.3, 6) for t in texts]


def test_long_repeats():
    block = np.arange(3000)
    symbols = np.concatenate([block, [10_000], block, [10_001]])
    found = longest_repeats(symbols)
    assert found[0] == 3000 and found[3001] == 3000 and found[3000] == 0 and found[2999] == 1
    assert longest_repeats(np.concatenate([np.zeros(1000, dtype=np.int64), [1]]))[0] == 999


def test_rows(spark):
    r = random.Random(1)
    clean = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(200))
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, clean, "x"), (2, None, "x"), (3, "", None), (3, clean, "x"), (None, clean, "x"), (5, f"{clean} {passage} {clean[::-1]} {clean[::-1].upper()} {clean.upper()} {passage}", "y"), (6, "one two three four five six seven", "z"), (7, "\n".join([clean, "same line", "same line"]), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ID string")
    got = sorted(map(tuple, quality_rules(docs).drop("word_chars").collect()), key=repr)
    want = sorted(((i, *(x for k, x in enumerate(brute(t, 10, 0.15, 50)) if k != 1)) for i, t, _ in rows), key=repr)
    assert got == want
    assert [g[6] for g in got if g[0] == 5] == [False], "a repeat of 60 words"
    kept = keep_quality(docs)
    assert kept.schema == docs.schema and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 1, 3, 7]
    assert quality_rules(docs.limit(0)).count() == 0 and keep_quality(docs.limit(0)).count() == 0
