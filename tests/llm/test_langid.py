import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, docs, empty
from tidemark.llm import langid
from tidemark.llm.common import table


def test_held_out_accuracy_and_rules(spark, sf_dir):
    d = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_held_out_labels_are_never_used(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d).collect()}
    lied = d.withColumn("lang", F.when(langid.learnable(), F.col("lang")).otherwise("xx")).withColumn("source", F.lit("z"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(lied).collect()} == one


def test_codes_separate_languages():
    for n in (1, 2, 3, 4, 6, 7, 20, 64):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(r) for r in code}) == n
        if n > 6:
            apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
            assert apart[~np.eye(n, dtype=bool)].min() >= 3


def test_many_languages(spark):
    words = {f"l{i:02d}": [chr(97 + (i * 7 + j * 3) % 26) + chr(97 + (i + j * 5) % 26) + chr(97 + (i * 3 + j) % 26) for j in range(6)] for i in range(12)}
    rows = [(k * 40 + n, " ".join(w[(n + j * j) % 6] for j in range(60)), lang, "s", 1) for k, (lang, w) in enumerate(words.items()) for n in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95


def test_every_language_is_learned(spark):
    """More languages than the sample has room for at the usual count: each is learned from fewer rows."""
    lang = lambda k: f"l{k:03d}"
    rows = [(k * 12 + n, " ".join(chr(97 + k // 26 + j % 2) + chr(97 + k % 26) + chr(97 + (k * 5 + 3 * (j % 3)) % 26) for j in range(60)), lang(k)) for k in range(100) for n in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, learn=langid.learnable(), sample=300)
    assert model.languages == tuple(map(lang, range(100)))
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_decoding_equals_brute_force(spark):
    """Features, margins and weighted losses worked out one by one in plain Python."""
    rng = np.random.default_rng(4)
    code = langid.codewords(5)
    model = langid.Model(tuple("abcde"), code, rng.normal(size=(langid.DIMENSIONS, code.shape[1])).astype(np.float32) * 5, rng.uniform(0.1, 3, code.shape[1]))
    texts = ["The quick brown Fox", "ünïcödé 中文 zz9 !!", "a", "ab ab ab", "x" * 70, "1 a", None, "", "12 34"]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        if not any(map(str.isalpha, t or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        raw = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode()]
        counts = {}
        for k, factor in ((2, 2654435761), (3, 2246822519)):
            for j in range(len(raw) - k + 1):
                value = int.from_bytes(bytes(raw[j : j + k]), "big") * factor % 2**32 >> 19
                counts[value] = counts.get(value, 0) + 1
        total = max(1, sum(counts.values()))
        margins = [sum((c / total) ** 0.5 * float(model.weights[v, b]) for v, c in counts.items()) for b in range(code.shape[1])]
        away = [sum(w * np.log1p(np.exp(-2 * max(-20, min(20, m * int(bit))))) for m, bit, w in zip(margins, word, model.bit_weights)) / sum(model.bit_weights) for word in code]
        near = [np.exp(-model.temperature * (x - min(away))) for x in away]
        assert got[i]["lang_pred"] == "abcde"[int(np.argmin(away))] and abs(got[i]["score"] - max(near) / sum(near)) < 1e-3
        assert got[i]["ambiguous"] == (sorted(away)[1] - min(away) < model.ambiguous)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = langid.identify(df).collect()
    assert len(got) == 13
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ["text"] * 3).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ["12 ½ ² 3", "٣٤", "é", "中"] * 8)).collect() if r["doc_id"] % 4 < 2} == {"und"}
    assert langid.identify(empty(spark)).collect() == []
    assert langid.keep_identified(df).columns == df.columns and langid.keep_identified(df).filter("doc_id in (1, 2, 3)").count() == 0
