"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

The token streams of a partition's documents are laid end to end in their order. Windows are cut at document or sentence
boundaries so that padding plus truncation penalties is least: with positions p and penalties e,
f(j) = e(j) + min over p(j) - p(i) <= size of f(i) + size - (p(j) - p(i)). The minimum of f(i) + p(i) over the sliding range is
kept in a monotone queue, so each position costs constant time. Where boundaries lie far apart, positions on a coarse grid
are offered at a higher penalty. Work goes on in stretches of bounded length: all but the last windows of a stretch are
final, the rest is decided with the next one.

One scan, no shuffle: a partition packs its own documents, leaving one short window at its end. Sequence ids hold the
partition's number, so they are unique, and the same when a lost task runs again.

Texts of common characters are encoded by tiktoken with the tokenizer's own vocabulary, which gives the same ids several times
faster; all others, and texts that spell the special token, go through tokenizers.

Defined cases: a null or empty text is the end id alone. A null doc_id is carried through. Rows that repeat an id are
packed one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, slices, trim

# Fixed value: how a byte-level BPE tokenizer cuts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that tiktoken isn't trusted with: beyond Latin letters, with the special token, or with endless blanks.
_SPECIAL = "<|endoftext|>"
_WIDE, _BLANKS = re.compile(r"[^\x00-ɏ]"), re.compile(r"\s{500}")


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts under a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        byte = _byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max([*spec["model"]["vocab"].values(), *added.values()]) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" ").endswith((b".", b"!", b"?", b"\n")) or b"\n" in token

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if _SPECIAL in text or _BLANKS.search(text) or not text.isascii() and _WIDE.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self.fast._core_bpe.encode_to_tiktoken_buffer(text, set()), "<u4")


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: In padding tokens: the price of a cut at a sentence's end, and of one within a sentence.
SENTENCE, INSIDE = 4, 12
GRID = 16


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in (0, len(ids)] where a document may be cut, and their penalties; the last one is its end."""
    n = len(ids)
    at = np.flatnonzero(ends[ids]) + 1
    at = at[at < n]
    points, prices = np.append(at, n), np.append(np.full(len(at), SENTENCE), 0)
    gaps = np.diff(points, prepend=0)
    wide = np.flatnonzero(gaps > GRID)
    if len(wide):
        extra = (gaps[wide] - 1) // GRID
        step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        more = np.repeat(points[wide] - gaps[wide], extra) + step * GRID
        points, prices = np.concatenate([points, more]), np.concatenate([prices, np.full(len(more), INSIDE)])
        order = np.argsort(points, kind="stable")
        points, prices = points[order], prices[order]
    return points, prices


def windows(points: list[int], prices: list[int], size: int) -> list[int]:
    """Cheapest ends of windows that cover (0, points[-1]]; each gap between points is at most `size`."""
    origin = []
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f(i) + p(i), p(i), i), least first
    pop, drop, push = queue.popleft, queue.pop, queue.append
    for j, (p, price) in enumerate(zip(points, prices), 1):
        first = queue[0]
        while p - first[1] > size:
            pop()
            first = queue[0]
        origin.append(first[2])
        g = price + first[0] + size  # f(j) + p(j)
        while queue and queue[-1][0] >= g:
            drop()
        push((g, p, j))
    out, j = [], len(points)
    while j:
        out.append(points[j - 1])
        j = origin[j - 1]
    return out[::-1]


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


class _Packer:
    """Packs a stream of documents; rows of finished windows collect in `rows`."""

    def __init__(self, encoder: Encoder, size: int, end_id: int, first: int, stretch: int):
        self.encoder, self.size, self.end, self.next, self.stretch = encoder, size, end_id, first, stretch
        self.docs: deque = deque()  # (doc_id, ids, tokens already packed)
        self.points: list[int] = []
        self.prices: list[int] = []
        self.total = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, text: str) -> None:
        ids = np.append(self.encoder.ids(text), np.uint32(self.end)).astype("<u4", copy=False)
        points, prices = cut_points(ids, self.encoder.ends)
        self.points += (points + self.total).tolist()
        self.prices += prices.tolist()
        self.docs.append((doc_id, ids, 0))
        self.total += len(ids)
        if self.total >= self.stretch:
            self.pack(self.total - 8 * self.size)

    def pack(self, until: int | None = None) -> None:
        """Emits all windows, or those that end by `until`."""
        if not self.points:
            return
        begin, done = 0, 0
        for end in windows(self.points, self.prices, self.size):
            if until is not None and end > until:
                break
            self._emit(end - begin)
            begin = end
        done = int(np.searchsorted(self.points, begin, "right"))
        self.points, self.prices = [p - begin for p in self.points[done:]], self.prices[done:]
        self.total -= begin

    def _emit(self, length: int) -> None:
        offset = 0
        while offset < length:
            doc_id, ids, start = self.docs[0]
            n = min(length - offset, len(ids) - start)
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.next, offset))
            offset += n
            if start + n == len(ids):
                self.docs.popleft()
            else:
                self.docs[0] = (doc_id, ids, start + n)
        self.next += 1

    def taken(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), 20_000):
            part = self.rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], _NAMES)
        self.rows = []


def pack(docs: DataFrame, *, tokenizer: str, size: int = 1024, end_id: int = 0, stretch: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        packer = _Packer(_encoder(tokenizer), size, end_id, TaskContext.get().partitionId() << 32, stretch)
        for batch in batches:
            for part in slices(batch, "t"):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, text)
                yield from packer.taken()
        packer.pack()
        yield from packer.taken()
        trim()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, _SCHEMA)
