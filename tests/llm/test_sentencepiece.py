import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.helpers import awkward, docs, empty, prose
from tidemark.llm import sentencepiece_ac as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
POOL = ["a", "b", "the", "ing", " ", "  ", "     ", "\n", "\t", "é", "中", "ﬁ", "①", "▁", "1", "=", "er", "er", "on", "😀", "\r", "A", "ñ", "\x00"[:0]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_texts_as_the_library(library):
    rnd, model = random.Random(6), sp.Model(PATH)
    texts = ["".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 18))) for _ in range(4000)] + [prose(rnd, 800), "x" * 5000, " " * 3000, "ab" * 3000]
    for t in texts:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t), repr(t)
        assert model.decode(model.encode(t)) == library.decode(ids), repr(t)


def test_runs_of_blanks_go_through_the_automaton(library, monkeypatch):
    model = sp.Model(PATH)
    for n in (*range(2, 70), 300):
        for word in ("", "a", "the x", "é", "\n", "=  b"):
            t = " " * n + word
            assert np.frombuffer(model.encode(t), "<u4").tolist() == library.encode(t), repr(t)


def test_any_ids_decode_as_the_library_does(library):
    rnd, model = random.Random(8), sp.Model(PATH)
    blank = [i for i, p in enumerate(model.pieces) if set(p) == {"▁"}]
    pools = [range(32000), range(259), [0, 1, 2, 35, 36, 194, 209, *blank[:4], *range(200, 250), 260, 300], [1, 2, *blank[:3], 300, 35]]
    for n in range(8000):
        ids = [rnd.choice(pools[n % 4]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_tables_may_overflow(library, monkeypatch):
    monkeypatch.setattr(sp, "WORDS", 5)
    monkeypatch.setattr(sp, "PAIRS", 7)
    rnd, model = random.Random(7), sp.Model(PATH)
    for _ in range(50):
        t = prose(rnd, 30)
        assert np.frombuffer(model.encode(t), "<u4").tolist() == library.encode(t)


def _message(number, data):
    return bytes([number << 3 | 2, len(data)]) + data


def test_unigram_models_take_the_best_sum(tmp_path):
    pieces = {"<unk>": (0.0, 2), "▁": (-3.0, 1), "a": (-2.0, 1), "b": (-2.5, 1), "ab": (-3.0, 1), "▁a": (-2.2, 1), "aba": (-9.0, 1), "▁ab": (-6.0, 1), "ba": (-4.0, 1)}
    data = b"".join(_message(1, _message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, (s, k) in pieces.items())
    data += _message(2, b"\x18\x01") + _message(3, b"\x18\x01\x20\x00")
    path = tmp_path / "m.model"
    path.write_bytes(data)
    model = sp.Model(str(path))

    def best(t):
        if not t:
            return 0.0, []
        return max((pieces[p][0] + best(t[len(p) :])[0], [model.ids[p], *best(t[len(p) :])[1]]) for p in pieces if p != "<unk>" and t.startswith(p))

    for word in ("a", "ab", "aba", "abab", "bba", "abba", "baab"):
        ids = np.frombuffer(model.encode(word), "<u4").tolist()
        assert sum(list(pieces.values())[i][0] for i in ids) == pytest.approx(best("▁" + word)[0])
        assert model.decode(model.encode(word)) == word
    assert np.frombuffer(model.encode("aéa"), "<u4").tolist()[1] == model.unknown


def test_operators(spark, library):
    rnd = random.Random(1)
    texts = [prose(rnd, 50), None, "", "Ünï 中"]
    ids = sp.encode(docs(spark, texts), model=PATH)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in sp.decode(ids, model=PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    got = sp.round_trip(awkward(spark), model=PATH).collect()
    assert len(got) == 13 and all(r["same"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted((r["doc_id"] or -1, r["text"] or "") for r in awkward(spark).collect())
    assert sp.round_trip(empty(spark), model=PATH).collect() == []
