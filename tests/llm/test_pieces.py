"""Encoding and decoding against the SentencePiece library, and Viterbi against brute force."""

import random
import struct
from pathlib import Path

import numpy as np
import pytest

from tallgrass.llm import pieces
from tallgrass.llm.pieces import MODEL, UNIGRAM, Known, Model, decode, encode, load

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not Path(MODEL).exists(), reason="no vocabulary file")

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "  two  spaces ", "line\nbreak\ttab", "日本語のテキスト 😀 foo", "▁x ▁", "x" * 300, "ab" * 200 + "é" * 90, "\x00\x07", "def f(x):\n    return   x", "ﷺ", "Über naïve café №5", "﻿bom",
    "The quick brown fox jumps over the lazy dog. " * 5, "a" * 64, "a" * 65, "1234567890", "😀" * 10, "e\u0301",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(model, words):
    return np.frombuffer(Known(model).ids([words])[0], dtype="<i4").tolist()


def fuzz(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefgh  \n▁éßñ日😀.,'0019", k=r.randint(0, 120))) for _ in range(n)]


def test_model_against_library(library):
    model = Model(load(MODEL))
    for text in TEXTS + fuzz(300, 1):
        words = model.words(text)
        ids = ids_of(model, words)
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids) == text.replace("▁", " "), text


def test_long_words_merge_alike():
    model = Model(load(MODEL))
    r = random.Random(2)
    for _ in range(50):
        word = "▁" + "".join(r.choices("thereinganto", k=40))
        (_, cuts, _), = list(model.merged(np.frombuffer(word.encode("utf-32-le"), dtype="u4").reshape(1, -1)))
        assert cuts[0].tolist() == model.merge_long(word)


def proto(pieces, byte_fallback=False):
    """A unigram model of the given (piece, score, kind), as the file format has it."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    block = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    number = lambda field, value: varint(field << 3) + varint(value)
    out = b"".join(block(1, block(1, p.encode()) + b"\x15" + struct.pack("<f", s) + number(3, k)) for p, s, k in pieces)
    trainer = number(3, UNIGRAM) + number(4, len(pieces)) + number(35, int(byte_fallback)) + number(40, 0) + block(45, b"<unk>")
    return out + block(2, trainer) + block(3, block(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))


VOCABULARY = [("<unk>", 0.0, 2), ("▁", -3.0, 1), *((c, -5.0 - i / 3, 1) for i, c in enumerate("abcdeé日")), ("ab", -6.1, 1), ("▁ab", -7.2, 1), ("bc", -6.0, 1), ("abc", -8.4, 1), ("cde", -9.0, 1), ("de", -7.5, 1), ("▁a", -5.9, 1), ("ea", -6.6, 1), ("日a", -7.7, 1)]


def best_score(model, word, memo):
    """The best sum of scores over all segmentations, by recursion."""
    if not word:
        return 0.0
    if word not in memo:
        options = [float(model.score[model.by_text[word[:k]]]) + best_score(model, word[k:], memo) for k in range(1, len(word) + 1) if word[:k] in model.by_text]
        if word[0] not in model.by_text:
            options.append(model.least - 10 + best_score(model, word[1:], memo))
        memo[word] = max(options)
    return memo[word]


def test_viterbi():
    blob = proto(VOCABULARY)
    model, library = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert model.kind == UNIGRAM and model.alone
    r = random.Random(3)
    for text in [""] + ["".join(r.choices("abcdeé日x ", k=r.randint(0, 30))) for _ in range(300)]:
        words = model.words(text)
        assert ids_of(model, words) == library.encode(text), text
        for w in set(words):
            if all(c in model.by_text for c in w):
                assert sum(float(model.score[i]) for i in ids_of(model, [w])) == pytest.approx(best_score(model, w, {}), abs=1e-4)


def test_byte_fallback_of_a_unigram_model():
    blob = proto([*VOCABULARY, *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))], byte_fallback=True)
    model, library = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in ("xx a😀b", "abc dé", "x"):
        ids = ids_of(model, model.words(text))
        assert ids == library.encode(text) and model.decode(ids) == text


def test_generations(library, monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 5)
    known = Known(Model(load(MODEL)))
    for text in TEXTS + fuzz(50, 8) + TEXTS:
        assert np.frombuffer(known.ids([known.model.words(text)])[0], dtype="<i4").tolist() == library.encode(text)


def test_rows(spark, library):
    rows = [(i, t, i) for i, t in enumerate([*TEXTS, None, TEXTS[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Tokens int")
    out = decode(encode(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == (r["text"] or "").replace("▁", " ") and r["Tokens"] == r["doc_id"]
    assert encode(docs.limit(0)).count() == 0
    assert decode(spark.createDataFrame([(None,), ([],), ([1, 2],)], "ids array<int>")).collect()[0]["decoded"] == ""
    with pytest.raises(ValueError):
        encode(docs.withColumnRenamed("Tokens", "IDS"))
