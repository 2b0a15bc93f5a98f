"""Small tables with awkward rows for the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, first=0, partitions=3):
    rows = [(first + i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and columns whose names clash with results."""
    rows = [
        (1, None, None, None, None), (None, "a text without an id and some words", "en", "s", 3), (2, "", "en", None, 0), (3, " \t\n ", None, "s", 4), (4, "one", "en", "s", 3), (5, "Ünïcode wörds é 中文 😀 end.", "de", "s", 5),
        (6, "word " * 30000, "en", "s", None), (7, "x" * 300000, "en", "s", 1), (8, "same text here and there today", "en", "s", 1), (8, "same text here and there today", "en", "s", 1), (9, "same text here and there today", "fr", "t", 1), (None, None, None, None, None), (0, "the\x00nul <|endoftext|> mark\r\nline", "en", "s", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("n_shingles", "kept", "score", "length", "shard", "slot", "id", "data", "t", "spans", "rank", "digest", "cell"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rnd: random.Random, n: int) -> str:
    parts = ["tion", "er", "an", "the", "or", "is", "ed", "on", "at", "ing", "ble", "wh"]
    out = []
    for _ in range(n):
        w = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
        out.append(w + rnd.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def edited(rnd: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"edit{rnd.randrange(40)}"
    return " ".join(words)
