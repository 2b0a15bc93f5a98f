import random

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import SCHEMA, awkward, edited, empty, prose
from tidemark.llm import langid, pii, quality
from tidemark.llm.minhash import near_duplicates


def corpus(spark):
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.randint(60, 200)) for _ in range(30)]
    texts += [texts[3]] * 5 + [edited(rnd, texts[4], 1)] + [texts[5] + " write to x.y@mail.org today."] + ["1 2 3", "short", None, ""] + ["Home | About | Contact\n" * 40]
    rows = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_against_their_parts_one_by_one(spark, sf_dir):
    df = corpus(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "pii", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    text = {r["doc_id"]: r["text"] for r in df.collect()}

    a = stages["language"](spark, df, sf_dir)
    assert a.columns == df.columns
    judged = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert {r["doc_id"] for r in a.collect()} == {i for i, r in judged.items() if r["lang_pred"] != "und" and not r["ambiguous"]}

    b = stages["quality"](spark, a, sf_dir)
    want = {i: quality.judge_text(text[i], quality.Limits()) for i in (r["doc_id"] for r in a.collect())}
    assert b.columns == df.columns and {r["doc_id"]: r["text"] for r in b.collect()} == {i: w[-1] for i, w in want.items() if w[6]}

    c = stages["near_duplicates"](spark, b, sf_dir)
    kept = {r["doc_id"] for r in near_duplicates(b).collect() if r["kept"]}
    assert c.columns == df.columns and {r["doc_id"] for r in c.collect()} == kept and len(kept) < b.count()

    d = stages["pii"](spark, c, sf_dir)
    before = {r["doc_id"]: r["text"] for r in c.collect()}
    assert d.columns == df.columns and {r["doc_id"]: r["text"] for r in d.collect()} == {i: pii.masked(t, pii.spans(t)) for i, t in before.items()}

    e = stages["packing"](spark, d, sf_dir)
    assert {r["doc_id"] for r in e.collect()} == kept


def test_one_row_of_each_group_stays(spark, sf_dir):
    """Repeated rows, ids on two texts, and null ids: every group keeps one row, no group goes."""
    rnd = random.Random(4)
    a, b, c = (prose(rnd, 80) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (2, b), (2, edited(rnd, a, 1)), (None, c), (None, c), (3, edited(rnd, b, 1)), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = sorted((r["text"] or "", r["doc_id"]) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, sf_dir).collect())
    assert kept == sorted([("", 4), ("", 4), (a, 1), (b, 1), (c, None)])


def test_awkward_and_empty_tables(spark, sf_dir):
    for df in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf_dir)
            if name != "packing":
                assert out.columns == df.columns
                out.collect()
            else:
                out.collect()


def test_whole_run_and_registration(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 1024
    names = set(__spark_entry__.queries())
    assert {"pipeline", "op1_minmax_dedup", "op5_html_layout", "op7_sentencepiece", "op10_arc_to_warc"} <= names
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
