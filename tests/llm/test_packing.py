import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, docs, empty, prose
from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def reference(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, size):
    """Every id in one piece, pieces in place, sequences full; texts: ids by document (rows may repeat)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for key, ids in texts.items():
        ids, own, at = np.array(ids, "<u4"), sorted(by_doc[key], key=lambda r: r["start"]), 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size,stretch", [(1024, 1 << 17), (64, 700)])
def test_pieces_hold_every_id_once(spark, size, stretch):
    rnd = random.Random(size)
    texts = [prose(rnd, rnd.choice([1, 5, 60, 400, 3000])) for _ in range(120)] + ["", None, "中文 text ﬁ   x", "a<|endoftext|>b", " " * 3000, "é" * 2000, "\n" * 700]
    rows = packing.pack(docs(spark, texts, partitions=2), tokenizer=PATH, size=size, stretch=stretch).collect()
    sequences = check(rows, {i: reference(t) for i, t in enumerate(texts)}, size)
    total = sum(r["length"] for r in rows)
    assert total > (0.97 if size == 1024 else 0.9) * size * (sequences - 2)


def test_fast_encoding_equals_the_tokenizer():
    rnd = random.Random(8)
    encoder = packing._encoder(PATH)
    pool = ["a", "The", " ", "  ", "\n", "'s", "'ll", "12", "é", "ñ", "!", "\t", "\xa0", "\x1c", "\x85", "ß", "中", "😀", "<|endoftext|>", "​", "ʼ", "_"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 20)))
        assert encoder.ids(text).tolist() == reference(text)[:-1], repr(text)


def test_windows_are_the_cheapest():
    """Against all ways to cut."""
    rnd = random.Random(1)
    for _ in range(200):
        points, prices, at = [], [], 0
        for _ in range(rnd.randint(1, 9)):
            at += rnd.randint(1, 10)
            points.append(at)
            prices.append(rnd.choice([0, 4, 12]))

        def cost(ends, size=10):
            begin, total = 0, 0
            for e in ends:
                if e - begin > size:
                    return float("inf")
                total += size - (e - begin) + prices[points.index(e)]
                begin = e
            return total

        every = [[p for i, p in enumerate(points[:-1]) if mask >> i & 1] + [points[-1]] for mask in range(2 ** (len(points) - 1))]
        assert cost(packing.windows(points, prices, 10)) == min(map(cost, every))


def test_awkward_rows(spark):
    rows = packing.pack(awkward(spark), tokenizer=PATH).collect()
    assert {r["doc_id"] for r in rows} == {None, *range(10)}
    assert [r["doc_tokens"] for r in rows if r["doc_id"] == 1] == [1] and sum(r["doc_id"] == 8 and r["start"] == 0 for r in rows) == 2
    assert packing.pack(empty(spark), tokenizer=PATH).collect() == []
