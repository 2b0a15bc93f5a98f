import numpy as np
import pytest

from tidemark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every, scale=256):
    good = [(i, [int(np.floor(np.float64(np.float32(c)) * scale)) for c in x]) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)]
    queries = {}
    for i, x in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, x), x) if i in queries and len(queries[i]) == len(x) else x
    out = []
    for q, x in queries.items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).selectExpr("*", "'clash' AS score", "'clash' AS norm").repartition(3)
    return sorted(map(tuple, topk.top_k(df, **options).collect()))


@pytest.mark.parametrize("block,probe", [(4096, 1024), (16, 8)])
def test_equals_brute_force(spark, block, probe):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)]  # a third are copies: ties go to smaller ids
    rows += [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [float("nan")] * 12), (2005, [float("inf")] * 12), (2010, [0.0] * 12), (2011, [1.0] * 3), (2020, [1.0] * 3), (2030, [5.0] * 5), (None, [1.0] * 12)]
    assert run(spark, rows, k=5, every=10, block=block, probe=probe) == brute(rows, 5, 10)


def test_coordinate_pruning_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 8))
    rows = [(i, (base[i % 4] * rng.uniform(0.9, 1.1) + rng.normal(size=8) * 0.01).astype(np.float32).tolist()) for i in range(400)]
    assert run(spark, rows, k=3, every=7, block=64) == brute(rows, 3, 7)


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [3e6, 2e6]), (2, [-1e6, 1e6])]
    assert run(spark, rows, k=5, every=2) == brute(rows, 5, 2)
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**22, 5.0]])
    assert topk.products(q, v)[0, 0] == 2**62 + 15
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_meet_in_a_grid_and_not_by_dimension(spark):
    """More than one task though all vectors share their dimension; short vectors don't meet queries that need long ones."""
    block = lambda n, longest, first: (4, n, longest, np.arange(first, first + n).tobytes(), np.full((n, 4), longest / 2).tobytes())
    v = spark.createDataFrame([block(2, 2.0 ** (i % 6), 100 * i) for i in range(24)], topk._BLOCK)
    q = spark.createDataFrame([(4, np.arange(i, i + 1).tobytes(), np.ones((1, 4)).tobytes(), np.zeros(1).tobytes(), float(8 if i else -1e300)) for i in range(70)], "q_dim int, q_ids binary, q_data binary, least binary, need double")
    met = topk.grid(v, q)
    pairs = [(np.frombuffer(r["q_ids"], np.int64)[0], np.frombuffer(r["ids"], np.int64)[0] // 100) for r in met.collect()]
    assert sorted(pairs) == sorted((i, j) for i in range(70) for j in range(24) if not i or 2.0 ** (j % 6) >= 8)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cell" in plan and "Cartesian" not in plan
    assert met.rdd.mapPartitions(lambda rows: [any(True for _ in rows)]).filter(bool).count() > 8
