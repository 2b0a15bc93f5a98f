"""SentencePiece encoding and decoding over an Aho-Corasick automaton of the pieces.

One pass over a text follows the automaton; at each position its output links give every piece that ends there, and the best
way to reach that position is relaxed from the position where the piece begins.

- Unigram models: the best sum of scores, the classical Viterbi recursion.
- BPE models, whose scores are merge ranks: sums of ranks don't give the segmentation that merging gives. Here a piece may follow
  the best piece before it only if merging the two texts leaves exactly these two pieces; the encoding of every
  prefix then ends in one such piece, and the pass yields the same ids as merging does. What merging leaves of a pair is
  worked out once per pair of pieces and kept.

No piece of the supported models goes across the start of a word, so words are encoded one by one and kept in a bounded table.
Characters without a piece fall back to bytes, or to the unknown piece. One scan, no shuffle; texts are read whole.

Defined cases: a null or empty text has no ids and decodes to an empty text. Equal texts get equal ids. Models with a
character map of their own (other than `identity`) are refused. Bytes that are no character decode to one replacement character
each. Only the id and the text are read.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_slice, ship

SPACE = "▁"
#: Entries of the tables of words and of pairs that a worker keeps.
WORDS, PAIRS = 200_000, 500_000
# Types of pieces and of models in a model file.
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A SentencePiece model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, trim = _UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.prefix, trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.trim = trim
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (_NORMAL, _USER)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces that go across words aren't supported")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == _BYTE}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.strange = re.compile(f"[^{re.escape(''.join(sorted(self.single)))}]")
        self.sizes = [len(p) for p in self.pieces]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.text = [b"" if k not in (_NORMAL, _USER, _BYTE) else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.text[self.unknown] = " ⁇ ".encode()
        self.apart = {i for i, k in enumerate(self.kinds) if k not in (_NORMAL, _USER, _BYTE)}  # no character goes across these

    # --- BPE -----------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[int]:
        """What merging the best-ranked neighbours, leftmost first, leaves of a text of single-character pieces."""
        n = len(text)
        part, after, before = list(text), [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (k := self.ids.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, self.pieces[k]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or part[i] + part[j] != piece:
                continue
            part[i], part[j] = piece, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [self.ids[p] for p in part if p]

    def _follows(self, a: int, b: int) -> bool:
        key = a * len(self.pieces) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return known

    def _begins(self, a: int) -> bool:
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = self.merged(self.pieces[a]) == [a]
        return known

    def _bpe(self, text: str) -> list[int]:
        """The same relaxation with validity for a score: a position's best state is the one piece that may end there, and it is
        reached only from a best state that it may follow."""
        last, known, n = [-1] * len(text), self.pairs.get, len(self.pieces)
        for end, (i, size) in self.automaton.iter(text):
            if last[end] < 0:
                begin = end - size
                if begin < 0:
                    if self._begins(i):
                        last[end] = i
                else:
                    before = last[begin]
                    if before >= 0:
                        good = known(before * n + i)
                        if good or good is None and self._follows(before, i):
                            last[end] = i
        return self._back(last, text)

    def _unigram(self, text: str) -> list[int]:
        """The best sum of scores at each position, relaxed from where the pieces that end there begin."""
        best, last = [float("-inf")] * len(text), [-1] * len(text)
        for end, (i, size) in self.automaton.iter(text):
            begin = end - size
            value = self.scores[i] + (best[begin] if begin >= 0 else 0.0)
            if value > best[end]:
                best[end], last[end] = value, i
        return self._back(last, text)

    def _back(self, last: list[int], text: str) -> list[int]:
        out, end, sizes = [], len(text) - 1, self.sizes
        while end >= 0:
            i = last[end]
            if i < 0:
                raise ValueError(f"no piece ends at position {end} of {text[:80]!r}")
            out.append(i)
            end -= sizes[i]
        out.reverse()
        return out

    # --- texts ---------------------------------------------------------------------------------------------

    def _strange(self, c: str) -> list[int]:
        raw = c.encode()
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def _word(self, unit: str) -> bytes:
        encode = self._bpe if self.kind == _BPE else self._unigram
        out, at = [], 0
        for m in self.strange.finditer(unit):
            if m.start() > at:
                out += encode(unit[at : m.start()])
            out += self._strange(m[0])
            at = m.end()
        if at < len(unit):
            out += encode(unit[at:])
        return np.array(out, "<u4").tobytes()

    def _kept(self, unit: str) -> bytes:
        """A word's ids from the older half of the table, or worked out; short ones go into the newer half."""
        data = self.older.get(unit) or self._word(unit)
        if len(unit) <= 64:
            if len(self.words) >= WORDS:
                self.older = dict(self.words)
                self.words.clear()
            self.words[unit] = data
        return data

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text = text or ""
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        known, word = self.words.get, self._kept
        return b"".join([known(u) or word(u) for u in self.units.findall(text)])

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, "<u4").tolist()
        if self.apart.isdisjoint(found):
            raw = b"".join([self.text[i] for i in found])
            if self.prefix and found and raw.startswith(b" ") and self.kinds[found[0]] != _BYTE:
                raw = raw[1:]
            return raw.decode("utf-8", "each")
        out, run, begun = [], [], False
        for i in [*found, -1]:
            if i >= 0 and i not in self.apart:
                run.append(self.text[i][1:] if self.prefix and not begun and self.kinds[i] != _BYTE and self.text[i].startswith(b" ") else self.text[i])
                begun = begun or bool(run[-1])
            else:
                out.append(b"".join(run).decode("utf-8", "each"))
                run = []
                if i >= 0 and self.text[i]:
                    out.append(self.text[i].decode())
                    begun = True
        return "".join(out)


codecs.register_error("each", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(model)
        ids = [np.frombuffer(m.encode(t), "<i4") for t in batch.column(1).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return per_slice(_texts(docs, id_col, text_col), "t", work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each array of ids."""

    def run(batches):
        m = _model(model)
        for batch in batches:
            texts = [m.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    ship(encoded.sparkSession)
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, *, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, text (decoded from the ids), ids_crc32, text_crc32 (of the decoded text) and same (it equals the text)."""
    names = ["doc_id", "n_ids", "ids", "text", "ids_crc32", "text_crc32", "same"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _model(model)
        texts = batch.column(1).to_pylist()
        ids = [m.encode(text) for text in texts]
        back = [m.decode(i) for i in ids]
        n = np.array([len(i) // 4 for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        crc, crc_back = (pa.array([zlib.crc32(x) for x in what], pa.int64()) for what in (ids, map(str.encode, back)))
        same = pa.array([a == b for a, b in zip(texts, back)], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists, pa.array(back, pa.string()), crc, crc_back, same], names)

    return per_slice(_texts(docs, id_col, text_col), "t", work, "doc_id long, n_ids long, ids array<int>, text string, ids_crc32 long, text_crc32 long, same boolean")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
