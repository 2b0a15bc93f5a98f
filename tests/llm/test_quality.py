import random

from tests.llm.helpers import awkward, docs, empty, prose
from tidemark.llm import quality
from tidemark.llm.common import table


def line(n):
    """A sentence of 19 words that shares no three of them with another."""
    return " ".join(f"w{n}x{i}" for i in range(19)) + ".\n"


def brute(text):
    text = text or ""
    words = text.encode().split()
    covered = set()
    for i in range(len(words) - 2):
        for j in range(len(words) - 2):
            if i != j and words[i : i + 3] == words[j : j + 3]:
                covered |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, l in enumerate(lines) if l.strip(" \t\n\x0b\x0c\r") and l in lines[:i])
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_figures_equal_brute_force(spark):
    rnd = random.Random(2)
    pool = ["a", "b", "c", "\n", "a b c\n", "é|", "#x", " ", "\x1c", "\x0b", " ", "<&>"]
    texts = ["".join(rnd.choice(pool) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 40))) for _ in range(150)] + [prose(rnd, 120), None]
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeated = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["kept"] and r["base_failed"])


def test_long_texts_count_the_same():
    rnd = random.Random(5)
    for n in (3, 4, 50, 3000):
        words = [rnd.choice("abcdefghij").encode() for _ in range(n)]
        assert quality._repeated_many(words) == quality.repeated_words(words)


def test_lines_are_judged_first(spark):
    prose_ = "".join(map(line, range(8)))
    menu, rights, table = "Home | About | Contact | Search\n", "Example Ltd. All rights reserved.\n", "a | b | c | d | e | f\n"
    texts = [prose_, prose_ + menu + rights, menu + rights + "".join(f"{line(i)}c{i} | d{i} | e{i} | f{i} | g{i} | h{i} | i{i} | k{i} | l{i}\n" for i in range(4)) + line(9).replace(".", " ALL").upper() + line(10).upper(), prose_ + "BUY THIS NOW AND SAVE!!\n"]
    out = {r["doc_id"]: r for r in quality.clean(docs(spark, texts)).collect()}
    assert set(out) == {0, 1, 3}
    assert out[0]["text"] == prose_ and out[1]["text"] == prose_ and out[3]["text"] == prose_
    assert out[1]["n_chars"] == len(prose_)


def test_rules_of_form_in_any_language():
    limits, fails = quality.Limits(), lambda t: quality.line_fails(t, quality.Limits())
    assert fails("uno | dos") and fails("Über uns » Presse » Team") and fails("see https://a.org/x https://b.org") and fails("mot " * 11) and fails("Alle Rechte vorbehalten 2020")
    for good in ("Kurzer Titel", "Ein Satz mit einem | Strich, der lang genug ist, um Prosa zu sein.", "- one item of a list", "mot " * 10, "mot " * 200 + "fin.", "• ein Punkt", "read https://a.org/x before you go on with this."):
        assert not fails(good), good
    assert quality.listed(["a", "b c", "", "d", "e"], limits) == {0, 1, 3, 4} and quality.listed(["a", "b.", "c", "d", "e"], limits) == set()


def test_labels_of_the_corpus(spark, sf_dir):
    """Clean documents stay; junk goes."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    judged = quality.judge(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    count = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in judged}
    assert (1, False, False) not in count and (0, False, True) not in count and count[1, False, True] > 200 and count[0, False, False] > 20


def test_awkward_rows(spark):
    df = awkward(spark)
    got = quality.judge(df).collect()
    assert len(got) == 13 and all(r["base_failed"] for r in got)
    assert next(r for r in got if r["doc_id"] == 1)["n_words"] == 0
    assert quality.clean(df).columns == df.columns and quality.clean(df).count() == 0
    assert quality.judge(empty(spark)).collect() == [] and quality.clean(empty(spark)).collect() == []
