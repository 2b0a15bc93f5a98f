import random

import numpy as np
import pytest

from tests.llm.helpers import awkward, docs, edited, empty, prose
from tidemark.llm.common import words
from tidemark.llm import minhash
from tidemark.llm.minhash import keep_one, near_duplicates


def sets(texts, k):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def components(texts, k, percent):
    s = sets(texts, k)
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                common = len(s[a] & s[b])
                if 100 * common >= percent * (len(s[a]) + len(s[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, s


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_same_components_as_brute_force(spark, k, percent):
    rnd = random.Random(k)
    texts = [prose(rnd, rnd.randint(1, 250)) for _ in range(40)]
    big = prose(rnd, 150)
    texts += [edited(rnd, big, rnd.randint(0, 9)) for _ in range(120)]  # one group at all distances around the threshold
    texts += [texts[0]] * 60 + [edited(rnd, t, 2) for t in texts[:40] for _ in range(2)] + ["", None, "one", "one", "Two words", "two WORDS"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_duplicates(docs(spark, texts), k=k, percent=percent).collect()
    want, s = components(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(s[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got)
    assert len(set(want.values())) < len(want)


def by_rows(rows, k, percent):
    """Groups of rows (id, text), whatever their ids: for each row its set size and the smallest id of its group."""
    label, s = components(list(enumerate(t for _, t in rows)), k, percent)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[label[i]] = min(least.get(label[i], key), key)
    return [(key, len(s[i]), least.get(label[i]) if s[i] else key, label[i] if s[i] else -1 - i) for i, (key, _) in enumerate(rows)]


def repeating(rnd):
    """Rows whose ids repeat with equal, similar and other texts, and null ids in groups of their own and of others."""
    base = [prose(rnd, rnd.randint(20, 120)) for _ in range(25)]
    rows = [(i % 17, t) for i, t in enumerate(base)] + [(i % 5, edited(rnd, base[i % 25], rnd.randint(0, 3))) for i in range(60)]
    rows += [(7, base[2])] * 4 + [(None, base[3])] * 3 + [(None, t := prose(rnd, 60)), (None, t), (None, edited(rnd, t, 1))]
    rows += [(30, "a b c d e f"), (30, "a b c d e f"), (30, "z y x w v u"), (31, "z y x w v u"), (31, None), (31, ""), (None, None)]
    rnd.shuffle(rows)
    return rows


def test_repeated_and_null_ids(spark):
    rows = repeating(random.Random(9))
    df = spark.createDataFrame([(i, t, f"row{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, x string").repartition(3)
    want = by_rows(rows, 3, 85)
    got = near_duplicates(df, k=3, percent=85).collect()
    plain = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(plain((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(plain(w[:3]) for w in want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["component_id"] is not None)
    kept = keep_one(df, k=3, percent=85).collect()
    groups = [want[int(r["x"][3:])][3] for r in kept]
    assert sorted(groups) == sorted({w[3] for w in want})  # one row a group, none lost
    assert all(r["doc_id"] == want[int(r["x"][3:])][2] for r in kept)


def test_hot_hubs_are_split(spark):
    """Pairs that all have one hub confirm alike, split or not."""
    sets = spark.createDataFrame([(i, np.arange(20 + i % 9, dtype=np.uint64).tobytes()) for i in range(200)], "key long, items binary")
    pairs = spark.createDataFrame([(i, 0, i, 0) for i in range(1, 200)], "a long, b long, u long, v long")
    big = pairs.union(spark.range(200, 9000).selectExpr("id", "0L", "id", "0L"))
    _, parts = minhash._split(big, 10**9)
    assert [tuple(r) for r in parts.collect()] == [(0, 3)]
    want = {(i, 0) for i in range(1, 200) if 100 * 20 >= 80 * (20 + i % 9)}
    assert {tuple(r) for r in minhash._confirm(pairs, sets, 80).collect()} == {tuple(r) for r in minhash._confirm(big, sets, 80).collect()} == want


def test_a_crowd_of_unlike_members_makes_few_pairs(spark, monkeypatch):
    """Members of common passages only: they share bands and no rare item, and no two are similar."""
    rnd = random.Random(2)
    passages, n = [prose(rnd, 30) for _ in range(60)], 2500
    texts = [" ".join([passages[0], passages[1], passages[2], *rnd.sample(passages[3:], 7)]) for _ in range(n)]
    seen, real = [], minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    got = near_duplicates(docs(spark, texts)).collect()
    assert len(got) == n and sum(r["kept"] for r in got) > 0.9 * n
    assert len(seen) == 3 and seen[-1] < n * n // 2 // 50, seen


def around(rnd, base, near, far, popular):
    """Copies of a text: near ones with 1 to 4 edits of their own, far ones with 4 and one that some others have too, few with popular ones only."""
    places = [3 + 7 * i for i in range(popular)]
    others = [i for i in range(len(base)) if all(abs(i - p) > 3 for p in places)]
    out, fresh = [" ".join(base)], iter(range(10**9))

    def copy(own, shared):
        words = list(base)
        for at in rnd.sample(others, own):
            words[at] = f"own{next(fresh)}"
        for p in shared:
            words[places[p]] = f"popular{p}"
        return " ".join(words)

    out += [copy(rnd.randint(1, 4), []) for _ in range(near)] + [copy(4, [i % popular]) for i in range(far)]
    return out + [copy(0, rnd.sample(range(popular), rnd.randint(5, 8))) for _ in range(popular)]


def test_copies_around_one_text_make_few_pairs(spark, monkeypatch):
    """Copies just too far from all others are not held against each copy that shares a band with them."""
    rnd = random.Random(4)
    texts = around(rnd, [f"w{i}" for i in range(170)], 250, 360, 16)
    seen, real = [], minhash._confirm
    monkeypatch.setattr(minhash, "_confirm", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    got = near_duplicates(docs(spark, texts), k=3, percent=85).collect()
    want, _ = components(list(enumerate(texts)), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sum(i == c for i, c in want.items()) > 200
    assert len(seen) == 3 and seen[-1] < 20 * len(texts), seen


def test_awkward_rows(spark):
    got = near_duplicates(awkward(spark), k=3, percent=85).collect()
    assert len(got) == 13
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and all(by[i]["kept"] for i in (1, 2, 3))
    assert by[6]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert by[8]["component_id"] == by[9]["component_id"] == 8 and not by[9]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    kept = keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == [] and keep_one(empty(spark)).collect() == []


def test_word_hashes_follow_words_not_places():
    texts = ["a bb  ccc", "ccc bb", "", "a" * 3000000 + " a", "bb\x0bé", "\x1cccc"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, at = words(data, offsets, lower=True)
    seen = {}
    for i, t in enumerate(raw):
        own = h[at[i] : at[i + 1]]
        assert len(own) == len(t.split())
        for w, x in zip(t.split(), own):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
