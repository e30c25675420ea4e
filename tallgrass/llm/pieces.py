"""Operator 6, SentencePiece encoding and decoding in numpy, words of equal length together."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, sliced

#: The public vocabulary file that the query uses; its kind is BPE with byte fallback.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Longer words are merged one by one; words of each of two generations whose pieces a worker remembers.
LONG, KNOWN = 64, 1 << 17
CHUNK = 2 << 20
#: Leading bits of a key that tell where to look.
LEAD = 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, blob[at : at + size]
            at += size


def pack_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


class Known:
    """Pieces of the words seen lately: two generations of bounded size, the older dropped as a whole."""

    def __init__(self, model: Model):
        self.model, self.young, self.old = model, {}, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.young) > KNOWN:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = {w for words in texts for w in words if w not in young}
        young.update((w, old[w]) for w in new if w in old)
        young.update(self.model.encode_words([w for w in new if w not in old]))
        return [b"".join(map(young.__getitem__, words)) for words in texts]


class Model:
    """A SentencePiece vocabulary with the identity normaliser."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.kind, self.fallback, self.prefix, squeeze, charsmap = UNIGRAM, False, True, True, b""
        for number, value in fields(blob):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append(x.get(1, b"").decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif number == 2:
                x = dict(fields(value))
                self.kind, self.fallback = x.get(3, UNIGRAM), bool(x.get(35, 0))
                if x.get(24, 0):
                    raise ValueError("white space as suffix isn't supported")
            elif number == 3:
                x = dict(fields(value))
                charsmap, self.prefix, squeeze = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1))
                if not x.get(5, 1):
                    raise ValueError("unescaped white space isn't supported")
        if charsmap or squeeze or self.kind not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and BPE models with the identity normaliser, kept white space and no user symbols are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.by_text = {self.pieces[i]: i for i in normal}
        self.score = np.array(scores, dtype=np.float32)
        self.least = float(self.score[normal].min()) if normal else 0.0
        self.longest = max((len(self.pieces[i]) for i in normal), default=1)
        #: If no piece has a space after another character, words that begin with their spaces are encoded alone.
        self.alone = not any(SPACE in p.lstrip(SPACE) for p in self.by_text)
        keys = self.mixed(np.array([self.key(np.frombuffer(self.pieces[i].encode("utf-32-le"), dtype=np.uint32)) for i in normal], dtype=np.uint64))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(normal, dtype=np.int32)[order]
        #: where the keys with each leading value begin, and how many share one at most
        bounds = np.searchsorted(self.keys >> np.uint64(64 - LEAD), np.arange((1 << LEAD) + 1, dtype=np.uint64))
        self.begin, self.crowd = bounds[:-1].astype(np.int32), int(np.diff(bounds).max(initial=0))
        self.keys = np.concatenate([self.keys, np.zeros(self.crowd + 1, dtype=np.uint64)])
        self.ids = np.concatenate([self.ids, np.full(self.crowd + 1, -1, dtype=np.int32)])
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have the same hash")
        self.raw = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else (" ⁇ " if k == UNKNOWN else p.replace(SPACE, " ")).encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    @staticmethod
    def key(chars: np.ndarray) -> np.uint64:
        out = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in chars:
                out = out * BASE + np.uint64(int(c) + 1)
        return out

    @staticmethod
    def mixed(keys: np.ndarray) -> np.ndarray:
        """Hashes spread over all their bits."""
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return keys ^ (keys >> np.uint64(29))

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The pieces with these hashes; -1 where there is none. The leading bits tell where to look in the sorted keys."""
        keys = self.mixed(keys)
        at = self.begin[keys >> np.uint64(64 - LEAD)]
        found = np.where(self.keys[at] == keys, self.ids[at], -1)
        for k in range(1, self.crowd):
            here = self.keys[at + k] == keys
            if here.any():
                found[here] = self.ids[at[here] + k]
        return found

    def words(self, text: str) -> list[str]:
        """The text with spaces escaped, cut where no piece can reach across."""
        if not text:
            return []
        escaped = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.alone:
            return [escaped]
        first, *rest = escaped.split(SPACE)
        out, spaces = [first] if first else [], 0
        for x in rest:
            spaces += 1
            if x:
                out.append(SPACE * spaces + x)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word's pieces, as bytes of int32."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if self.kind == BPE and length > LONG:
                out.update((w, pack_ids(self.ids_of(w, self.merge_long(w)))) for w in group)
                continue
            chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, length)
            for rows, cuts, pieces in self.merged(chars) if self.kind == BPE else self.viterbi(chars):
                blob, size = pieces.astype("<i4").tobytes(), 4 * pieces.shape[1]
                for at, k in enumerate(rows.tolist()):
                    out[group[k]] = blob[at * size : (at + 1) * size]
                for at in np.flatnonzero((pieces < 0).any(1)).tolist():
                    out[group[rows[at]]] = pack_ids(self.ids_of(group[rows[at]], cuts[at].tolist()))
        return out

    def hashes(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all prefixes of each word, and the powers with which those of substrings follow."""
        n, length = chars.shape
        prefix, power = np.zeros((n, length + 1), dtype=np.uint64), np.ones(length + 1, dtype=np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * BASE + chars[:, j].astype(np.uint64) + np.uint64(1)
        power[1:] = np.cumprod(np.full(length, BASE))
        return prefix, power

    def viterbi(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The best segmentation of each of n words of one length: all words advance by one character at a time, and
        the maximum over the possible last pieces is taken for all at once. Ties go to the longest piece.

        Words that have as many pieces come together: their numbers, the ends of the pieces, and the pieces (or -1)."""
        n, length = chars.shape
        prefix, power = self.hashes(chars)
        best = np.full((n, length + 1), -np.inf, dtype=np.float32)
        best[:, 0] = 0
        back, last = np.zeros((n, length + 1), dtype=np.int32), np.full((n, length + 1), -1, dtype=np.int32)
        missing = np.float32(self.least - UNKNOWN_PENALTY)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                piece = self.probe(prefix[:, j] - prefix[:, i] * power[j - i])
                score = np.where(piece >= 0, self.score[piece], missing if i == j - 1 else np.float32(-np.inf)) + best[:, i]
                better = score > best[:, j]
                best[better, j] = score[better]
                back[better, j] = i
                last[better, j] = piece[better]
        at, rows = np.full(n, length), np.arange(n)
        ends, pieces = [], []
        while len(rows):
            ends.append(at[rows].copy())
            pieces.append(last[rows, at[rows]])
            at[rows] = back[rows, at[rows]]
            done = at[rows] == 0
            if done.any():
                yield rows[done], np.stack([x[done] for x in ends[::-1]], 1), np.stack([x[done] for x in pieces[::-1]], 1)
                ends, pieces = [x[~done] for x in ends], [x[~done] for x in pieces]
                rows = rows[~done]

    def merged(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The BPE segmentation of each of n words of one length, in the same form: in each step every word merges its
        best pair, the leftmost of equals, until none has any. Only the pairs beside a merge are probed anew."""
        n, length = chars.shape
        prefix, power = self.hashes(chars)
        cuts, who = np.tile(np.arange(length + 1, dtype=np.int32), (n, 1)), np.arange(n)

        def pairs(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            piece = self.probe(prefix[rows, end] - prefix[rows, begin] * power[end - begin])
            return np.where(piece >= 0, self.score[piece], np.float32(-np.inf))

        score = pairs(who[:, None], cuts[:, :-2], cuts[:, 2:])
        while len(who):
            size = cuts.shape[1]
            line = np.arange(len(who))
            at = score.argmax(1) if size > 2 else np.zeros(len(who), dtype=np.int64)
            more = score[line, at] > -np.inf if size > 2 else np.zeros(len(who), dtype=bool)
            if not more.all():
                rows, ends = who[~more], cuts[~more]
                yield rows, ends[:, 1:], self.probe(prefix[rows[:, None], ends[:, 1:]] - prefix[rows[:, None], ends[:, :-1]] * power[ends[:, 1:] - ends[:, :-1]])
                cuts, score, who, at, line = cuts[more], score[more], who[more], at[more], line[: more.sum()]
            if not len(who):
                break
            keep = np.ones(cuts.shape, dtype=bool)
            keep[line, at + 1] = False
            cuts = cuts[keep].reshape(len(who), size - 1)
            score = score[keep[:, 1:-1]].reshape(len(who), size - 3)
            for beside in (at - 1, at):
                fits = np.flatnonzero((beside >= 0) & (beside + 2 < size - 1))
                b = beside[fits]
                score[fits, b] = pairs(who[fits], cuts[fits, b], cuts[fits, b + 2])

    def merge_long(self, word: str) -> list[int]:
        """The same for one word, with a heap of pairs."""
        n, get, score = len(word), self.by_text.get, self.score
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                piece = get(word[i : after[j]])
                if piece is not None:
                    heapq.heappush(heap, (-score[piece], i, j, after[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or j >= n or not alive[j] or after[i] != j or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [after[i] for i in range(n) if alive[i]]

    def ids_of(self, word: str, ends: list[int]) -> list[int]:
        """Pieces have their ids; other characters their bytes', or together the unknown one."""
        out: list[int] = []
        begin = 0
        for end in ends:
            part = word[begin:end]
            piece = self.by_text.get(part)
            if piece is not None:
                out.append(piece)
            elif self.fallback:
                out += [self.bytes_of[b] for b in part.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            begin = end
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(path: str) -> bytes:
    """The model file's bytes, read by the driver; they go to the tasks with the functions (half a megabyte)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """docs with one more column: the ids of each text's pieces (array<int>), those that the SentencePiece library
    gives without begin and end symbols. Null and empty texts have no ids. Rows are encoded alone and whole; all other
    columns stay, and ids_col must not be one of them."""
    if ids_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {ids_col} exists")
    blob, at = load(model_path), docs.columns.index(text_col)
    row_schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(blob)
        known = Known(model)
        for batch in sliced(batches, text_col, CHUNK):
            ids = known.ids([model.words(x or "") for x in batch.column(at).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return arrow_map(docs, run, StructType([*row_schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model_path: str = MODEL) -> DataFrame:
    """rows with one more column: the text of the ids. Null or no ids give the empty text; control ids give nothing.
    Text that was encoded comes back whole, but for the escape character itself, which comes back as a space."""
    if text_col.lower() in {c.lower() for c in rows.columns}:
        raise ValueError(f"column {text_col} exists")
    blob, at = load(model_path), rows.columns.index(ids_col)
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(blob)
        for batch in batches:
            column = batch.column(at)
            bounds, values = column.offsets.to_numpy().tolist(), column.values.to_numpy(zero_copy_only=False)
            texts = [model.decode(values[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return arrow_map(rows, run, StructType([*rows.schema.fields, StructField(text_col, StringType())]))
