"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, scheme separators, digits and identifier cues.
From each anchor a local parser expands to the boundaries of an email, address, number, account or secret and validates
it. A kind's spans are the leftmost non-overlapping matches of its pattern; a match that fails validation is dropped
and the search goes on behind it. Work is linear in the text: no two parts of a pattern can share a run of characters, and a value
that failed is not looked at again from a cue within it. One scan, no shuffle; texts are read whole.

Kinds: email, ip, card (14 to 19 digits, Luhn), phone (10 to 15 digits); added to these: url (an address that carries
credentials), iban (check digits modulo 97), account (a number behind a cue such as "account no"), secret (a value
behind a cue such as "password=", or an access key id).

Defined cases: a null or empty text has no spans. A null doc_id is carried through. Equal rows give equal rows. Other
columns are not read by `find`; `mask` keeps them as they are.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_slice

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_USERINFO = re.compile(r"://[^\s/?#@:]+:[^\s/?#@]+@[^\s/?#\"'<>]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:\s++(?:number|no|nr))?+\.?+\s*+(?:[:#=]\s*+)?+([0-9][0-9 -]{4,20}[0-9])(?![0-9A-Za-z])")
_VALUE = re.compile(r"[\"']?+\s*+[:=]\s*+[\"']?+([^\s\"']{6,}+)")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
_ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "ssn", "social security")
_SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    a.add_word("AKIA", ("key", 4))
    for name, cues in (("account", _ACCOUNT_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (name, len(cue)))
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    past = dict.fromkeys(KINDS, 0)  # where the search of each kind goes on

    def add(kind: str, start: int, end: int, good: bool = True) -> None:
        past[kind] = end
        if good:
            found.append((kind, start, end))

    for last, (anchor, size) in _ANCHORS.iter(text):
        at = last - size + 1
        if anchor == "digit":
            if at >= past["ip"]:
                m = _IP.match(text, at)
                if m:
                    add("ip", at, m.end(), all(map(_byte, m[0].split("."))))
                else:
                    past["ip"] = _DIGITS.match(text, at).end()
            if at >= past["card"]:
                m = _CARD.match(text, at)
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    add("card", at, m.end(), 14 <= len(digits) <= 19 and luhn(digits))
            if at >= max(2, past["iban"] + 2) and text[at - 2 : at].isupper() and not (at > 2 and text[at - 3].isalnum()):
                m = _IBAN.match(text, at - 2)
                if m and _iban(m[0]):
                    add("iban", at - 2, m.end())
        elif anchor == "at":
            start = at
            while start > past["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif anchor == "plus":
            if at >= past["phone"] and (m := _PHONE.match(text, at)):
                add("phone", at, m.end(), 10 <= sum(c in "0123456789" for c in m[0]) <= 15)
        elif anchor == "scheme":
            start = at
            while start > past["url"] and text[start - 1] in _SCHEME:
                start -= 1
            if start < at and (m := _USERINFO.match(text, at)):
                add("url", start, m.end())
        elif anchor == "key":
            if at >= past["secret"] and not (at and text[at - 1].isalnum()) and (m := _KEY.match(text, at)):
                add("secret", at, m.end())
        elif at >= past[anchor] and not (at and text[at - 1].isalpha()):
            m = (_NUMBER if anchor == "account" else _VALUE).match(text, last + 1)
            if m:  # a value without a digit has none behind a later cue either
                add(anchor, m.start(1), m.end(1), anchor == "account" or any(map(str.isdigit, m[1])))
    found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return found


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each kind and spans of each document; base_sha256 covers the spans of the four base kinds."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in KINDS[len(BASE) :])]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, strings = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            found = spans(text)
            base = [s for s in found if s[0] in BASE]
            for kind, into in zip(KINDS, counts):
                into.append(sum(s[0] == kind for s in found))
            hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            strings.append(_joined(found))
        counts = [pa.array(c, pa.int64()) for c in counts]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts[: len(BASE)], pa.array(hashes), pa.array(strings), *counts[len(BASE) :]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return per_slice(rows, "t", work, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def mask(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by the names of its kinds."""
    schema = docs.schema
    at, count = schema.fieldNames().index(text_col), schema.fieldNames().index(chars_col) if chars_col in schema.fieldNames() else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        new = [t and masked(t, spans(t)) for t in texts]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if count is not None:
            columns[count] = pa.array([c if a == b else len(b) for a, b, c in zip(texts, new, columns[count].to_pylist())], columns[count].type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return per_slice(docs, text_col, work, schema)
