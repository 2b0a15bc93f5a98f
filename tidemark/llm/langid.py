"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, a ridge regression over hashed byte bigrams and
trigrams of the lower-cased text, predicts that bit. A text's language is the codeword with the least loss, each bit weighted by
how well its classifier does on held-out rows; a text whose two nearest codewords lie close together is flagged ambiguous.

Training reads a bounded sample of labelled rows, chosen by a hash of the id: `per_language` of each language, fewer where there are so
many languages that this would be more than `sample` rows, but two at least, so every language is learned. It is solved on the
driver from their feature vectors of fixed size. Prediction is one scan with the model in the closure (8192 numbers a bit);
whole texts are read, in pieces.

Defined cases: a text that is null or has no letter is `und` with score 0. Without any labelled text all are `und`. With one
language all texts with letters get it. Rows with a null id or a null label aren't learned from. Equal texts get equal answers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import per_slice, text_column

DIMENSIONS = 1 << 13
_SHIFT = np.uint32(32 - 13)
_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 20


def _fold_table() -> np.ndarray:
    """Bytes as features see them: letters lower, all other ASCII as space, the rest as it is."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for c in range(26):
        t[97 + c] = t[65 + c] = 97 + c
    return t


_FOLD = _fold_table()


def features(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed n-grams: a vector of length one."""
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), _PIECE):
        b = _FOLD[data[at : at + _PIECE + 2]].astype(np.uint32)
        if len(b) >= 2:
            two = (b[:-1] << np.uint32(8)) | b[1:]
            total += np.bincount((two * np.uint32(2654435761)) >> _SHIFT, minlength=DIMENSIONS)
            if len(b) >= 3:
                three = (two[:-1] << np.uint32(8)) | b[2:]
                total += np.bincount((three * np.uint32(2246822519)) >> _SHIFT, minlength=DIMENSIONS)
    return np.sqrt(total / max(1, total.sum())).astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 4
    x = np.zeros(DIMENSIONS, np.float32)
    x[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f2", n, 2 * n)
    return x


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all ways to split up to six languages in two, else the seeded random code that is spread most."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        splits = [[1] + [1 if mask >> i & 1 else -1 for i in range(n - 1)] for mask in range(2 ** (n - 1) - 1)]
        return np.array(splits, np.int8).T
    bits = max(16, 10 * int(np.ceil(np.log2(n))))
    best, spread = None, -1
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1, 1).astype(np.int8)
        if (abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > spread:
            best, spread = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    temperature: float = 6.0
    ambiguous: float = 0.02

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of margins: the nearest language, its score, and whether another is as near."""
        loss = np.log1p(np.exp(-2 * np.clip(margins[:, None, :] * self.code[None], -20, 20)))
        away = (loss * self.bit_weights).sum(axis=2) / self.bit_weights.sum()
        near = np.exp(-self.temperature * (away - away.min(axis=1, keepdims=True)))
        score = near.max(axis=1) / near.sum(axis=1)
        gap = np.partition(away, 1, axis=1)[:, 1] - away.min(axis=1) if away.shape[1] > 1 else np.full(len(away), np.inf)
        return away.argmin(axis=1), score, gap < self.ambiguous


def _labelled(docs: DataFrame, learn: Column, per_language: int, sample: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, int, int]:
    """A reproducible sample of about `per_language` rows of each language by a hash of the id, or fewer to keep to `sample` rows;
    how many of each that is, and how many languages there are."""
    lang = F.col(lang_col).cast("string")
    known = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    each = max(2, min(per_language, sample // max(1, len(counts))))
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1 << 30))
    limit = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, int(min(1.0, max(1.5 * each, each + 16) / n) * (1 << 30))))) if counts else None
    rows = known.filter(unit < F.element_at(limit, lang)) if counts else known.limit(0)
    return rows.select(lang.alias("lang"), F.col(text_col).alias("t"), unit.alias("unit")), each, len(counts)


def train(docs: DataFrame, *, learn: Column, per_language: int = 200, sample: int = 3200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits the bit classifiers on a bounded sample of the rows for which `learn` holds."""
    chosen, per_language, languages = _labelled(docs, learn, per_language, sample, id_col, text_col, lang_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_column(batch.column(1))
        x = [_packed(features(data[offsets[i] : offsets[i + 1]])) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["lang", "x", "unit"])

    place = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "x"))
    rows = per_slice(chosen, "t", work, "lang string, x binary, unit long").withColumn("place", place).filter(F.col("place") <= per_language).orderBy("unit", "lang", "x").collect() if languages else []
    if not rows:
        return None
    names = tuple(sorted({r["lang"] for r in rows}))
    taken: dict[str, list] = {n: [] for n in names}
    for r in rows:
        if len(taken[r["lang"]]) < per_language:
            taken[r["lang"]].append(_unpacked(r["x"]))
    y = np.concatenate([np.full(len(v), i) for i, v in enumerate(taken.values())])
    x = np.concatenate([np.array(v, np.float32) for v in taken.values()])
    code = codewords(len(names))
    target = code[y].astype(np.float64)
    share = 1.0 / np.bincount(y)[y]  # languages count alike
    root = np.sqrt(share / share.mean())[:, None]
    kernel = (x @ x.T).astype(np.float64) * root * root.T
    inverse = np.linalg.inv(kernel + 0.02 * np.eye(len(y)))
    alpha = inverse @ (target * root)
    left_out = target - alpha / np.diag(inverse)[:, None] / root  # leave-one-out predictions of ridge regression
    wrong = np.clip((np.sign(left_out) != target).mean(axis=0), 0.005, 0.45)
    return Model(names, code, (x.T @ (alpha * root)).astype(np.float32), np.log((1 - wrong) / wrong))


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, unsure = _judge(batch.column(1), model)
        return pa.RecordBatch.from_arrays([batch.column(0), lang, score, unsure], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return per_slice(rows, "t", work, "doc_id long, lang_pred string, score double, ambiguous boolean")


def _judge(texts: pa.Array, model: Model | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    data, offsets = text_column(texts)
    n = len(texts)
    lang, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
    good = [i for i, t in enumerate(texts.to_pylist()) if t and has_letter(t)] if model else []
    for k in range(0, len(good), 256):
        part = good[k : k + 256]
        x = np.array([features(data[offsets[i] : offsets[i + 1]]) for i in part])
        best, p, flag = model.decode((x @ model.weights).astype(np.float64))
        for i, b in zip(part, best):
            lang[i] = model.languages[b]
        score[part], unsure[part] = p, flag
    return pa.array(lang), pa.array(score), pa.array(unsure)


def learnable(id_col: str = "doc_id") -> Column:
    """The rows to learn from: those whose crc32(id as text) modulo 4 is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def identify(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document, learned from its own labelled rows."""
    out = predict(docs, train(docs, learn=learnable(columns.get("id_col", "doc_id")), **columns), **{k: v for k, v in columns.items() if k != "lang_col"})
    held = F.coalesce(~learnable("doc_id"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language could be told: neither `und` nor between two languages."""
    model = train(docs, learn=learnable(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    at = docs.schema.fieldNames().index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, _, unsure = _judge(batch.column(at), model)
        keep = [a != "und" and not b for a, b in zip(lang.to_pylist(), unsure.to_pylist())]
        return batch.filter(pa.array(keep, pa.bool_()))

    return per_slice(docs, text_col, work, docs.schema)
