import zlib
from collections import Counter

import pytest

from tests.llm.helpers import awkward, docs, empty
from tidemark.llm import sharding


@pytest.mark.parametrize("n", [1, 15, 16, 17, 1000])
def test_counts_slots_and_mixture(spark, n):
    df = docs(spark, [f"text {i} é" for i in range(n)])
    got = sharding.assign(df, shards=16).collect()
    shards = Counter(r["shard"] for r in got)
    assert len(got) == n and set(shards) <= set(range(16))
    assert max(shards.values()) - min([shards.get(s, 0) for s in range(16)]) <= 1
    for s, c in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(c))
    mixture = Counter((r["doc_id"] % 3, r["shard"]) for r in got)
    for source in range(3):
        own = [mixture.get((source, s), 0) for s in range(16)]
        assert max(own) - min(own) <= 3
    for r in got:
        raw = f"text {r['doc_id']} é".encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def brute(rows, shards, h):
    """Positions by plain sorting, given each row's shuffle key."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    placed = []
    for source, own in by.items():
        for k, r in enumerate(sorted(own, key=lambda r: h[r["doc_id"]]), 1):
            placed.append(((2 * k - 1) / (2 * len(own)), (h[r["doc_id"]] + 2**63) % 2**64 - 2**63, r["doc_id"]))
    placed.sort(key=lambda x: (x[0], x[1]))
    n = len(placed)
    return {d: p * shards // n for p, (_, _, d) in enumerate(placed)}


def test_equals_plain_sorting(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [f"t{i}" for i in range(700)]).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 11)))
    keys = df.select("doc_id", F.xxhash64(F.lit(20240229), "doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long")).alias("h")).collect()
    h = {r["doc_id"]: r["h"] % 2**64 for r in keys}  # within a source by the unsigned hash, rows of equal fractions by the signed one
    want = brute(df.collect(), 16, h)
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(df, shards=16).collect()}
    assert got == want


def test_order_of_input_and_partitions_do_not_matter(spark):
    df = docs(spark, [f"t{i}" for i in range(300)])
    one = {tuple(r) for r in sharding.assign(df).collect()}
    assert {tuple(r) for r in sharding.assign(df.orderBy("text").repartition(7)).collect()} == one
    assert {tuple(r) for r in sharding.assign(df, seed=5).collect()} != one


def test_awkward_rows_and_files(spark, tmp_path):
    df = awkward(spark)
    got = sharding.assign(df).collect()
    assert len(got) == 13 and sorted(r["size"] for r in got if r["doc_id"] == 1) == [1]
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 13 and set(back.select("document.*").columns) == set(df.columns)
    assert sharding.assign(empty(spark)).collect() == []
