"""Line-first quality rules.

Every line of a text is judged by itself: navigation, boilerplate, punctuation and repetition rules. Lines that fail go;
a document goes if the lines it lost hold too large a share of its words, or if it fails the base rules (too few words,
or more than half of the words in 3-word windows that occur again). One scan, no shuffle; texts are read whole.

The rules go by form and hold in any language: the density of separators and of links, symbols and capitals, runs of short
lines without a sentence mark, and lines of ordinary length without any. Lists of phrases in four languages only help.

Words are maximal runs of characters other than 0x20 and 0x09-0x0D; lines are split at 0x0A.

Defined cases: a null text has no words and fails. A null doc_id is carried through. Equal rows give equal rows. Of the
input only the id and the text are read by `judge`; `clean` keeps all columns of its input as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_slice

#: Parts of lines that belong to a page's frame rather than to its text, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "powered by wordpress",
    "licensed under", "is licensed", "released under the", "subscribe to our newsletter", "click here to", "copyright ©", "(c) copyright",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendung von cookies",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal",
)
#: Entries of navigation bars, lower case.
NAVIGATION = frozenset(
    "home menu login logout register search about contact help next previous prev back top share print sitemap faq skip more news blog "
    "startseite anmelden suche kontakt impressum hilfe weiter zurück accueil connexion recherche suivant précédent inicio buscar contacto ayuda siguiente anterior".split()
)
#: Marks that prose of any length has, and those between the entries of a bar.
MARKS = re.compile(r"[.!?:;…。！？؟।]")
SEPARATORS = re.compile(r"[|»«›‹·•]")
LINKS = ("http://", "https://", "www.")
SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_EDGES = "|»«›‹>·•/-,.: "


@dataclass(frozen=True)
class Limits:
    """Of a line: symbols a word, share of words in capitals, words for each separator and share of links from which it is
    navigation, words it may have without any sentence mark. Of short lines without a mark: words, and how many may follow each other.
    Of a document: words at least, percent of repeated words and of lost words at most."""

    symbols_per_word: float = 0.5
    capitals: float = 0.8
    words_per_separator: float = 4.0
    links: float = 0.4
    open_words: int = 10
    short_words: int = 4
    short_lines: int = 3
    least_words: int = 50
    repeated: int = 50
    lost: int = 40


def line_fails(line: str, limits: Limits) -> bool:
    """Whether a line with at least one word is navigation, boilerplate or noise."""
    raw = line.encode()
    words = raw.split()
    n, low = len(words), line.lower()
    for phrase in BOILERPLATE:
        if phrase in low:
            return True
    if n <= 8 and all(w.strip(_EDGES) in NAVIGATION or not w.strip(_EDGES) for w in low.split()):
        return True
    cells = len(SEPARATORS.findall(line, 1))  # a mark at the start is a bullet
    if cells and n - cells < limits.words_per_separator * cells:
        return True
    if any(k in low for k in LINKS) and sum(w.lstrip("(<[\"'").startswith(LINKS) for w in low.split()) >= limits.links * n:
        return True
    if len(raw) - len(raw.translate(None, SYMBOLS)) > limits.symbols_per_word * n:
        return True
    if n >= 5 and line != low and sum(w.isupper() for w in line.split()) > limits.capitals * n:
        return True
    return n > limits.open_words and not MARKS.search(line)


def listed(lines: list[str], limits: Limits) -> set[int]:
    """Places of lines that are short, without a sentence mark, and one of more than `short_lines` such lines on end (blank ones apart)."""
    found, run = set(), []
    for at, line in enumerate([*lines, "."]):
        if len(line) < 200 and len(line.split()) <= limits.short_words and not MARKS.search(line):
            if line.strip(_SPACES):
                run.append(at)
        else:
            if len(run) > limits.short_lines:
                found.update(run)
            run = []
    return found


#: Words from which windows are counted in arrays instead of tuples.
MANY = 50_000


def _repeated_many(words: list) -> int:
    """repeated_words of a long text, in memory of a few numbers a word."""
    seen: dict = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    _, pairs = np.unique(codes[:-1] * n + codes[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * n + codes[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window which occurs twice or more."""
    if len(words) >= MANY:
        return _repeated_many(words)
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, reach = 0, 0  # words below reach are counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def judge_text(text: str | None, limits: Limits) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, cleaned text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    dup, lost, seen, left = 0, 0, set(), []
    lines = text.split("\n")
    menu = listed(lines, limits)
    for at, line in enumerate(lines):
        if not line.strip(_SPACES):
            left.append(line)
        elif line in seen:
            dup += 1
            lost += len(line.encode().split())
        else:
            seen.add(line)
            if at in menu or line_fails(line, limits):
                lost += len(line.encode().split())
            else:
                left.append(line)
    repeated = repeated_words(words)
    failed = n < limits.least_words or 100 * repeated > limits.repeated * n
    kept = not failed and 100 * lost <= limits.lost * n
    return n, len(text) - sum(map(text.count, _SPACES)), len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated, failed, kept, lost, "\n".join(left)


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long"


def judge(docs: DataFrame, *, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of each document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge_text(t, limits)[:-1] for t in batch.column(1).to_pylist()]
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), types))], _NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return per_slice(rows, "t", work, _SCHEMA)


def clean(docs: DataFrame, *, limits: Limits = Limits(), text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with their failed lines removed and their length brought up to date."""
    schema = docs.schema
    at, count = schema.fieldNames().index(text_col), schema.fieldNames().index(chars_col) if chars_col in schema.fieldNames() else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [judge_text(t, limits) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array([f[-1] for f in found], pa.string())
        if count is not None:
            columns[count] = pa.array([len(f[-1]) for f in found], pa.int64()).cast(batch.column(count).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array([f[6] for f in found], pa.bool_()))

    return per_slice(docs, text_col, work, schema)
