"""Every registered query of the engine against its SQL."""

import decimal
import math

import pytest

from pyspark.sql import functions as F

from tidemark.functions import compat
from tidemark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    assert len(set(columns)) == len(columns)
    if name not in SQL:
        assert rows
        return
    r = duck.sql(SQL[name])
    expected = [dict(zip(r.columns, x)) for x in r.fetchall()]
    assert sorted(r.columns) == columns
    key = lambda x: repr([plain(x[c]) for c in columns])
    assert sorted(key(x) for x in rows) == sorted(key(x) for x in expected)


def test_sketches_are_within_their_errors(spark, duck, sf_dir):
    """A10: distinct counts within four standard errors of 2 %, percentiles within a thousandth of the rows by rank."""
    for r in QUERIES["A10_approximate"](spark, sf_dir).collect():
        rows = duck.sql(f"SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = '{r['l_returnflag']}'").fetchall()
        exact = len({x[0] for x in rows})
        assert abs(r["parts"] - exact) <= 0.08 * exact + 1
        for column, value, share in ((1, r["median"], 0.5), (2, r["deciles"][0], 0.1), (2, r["deciles"][1], 0.9)):
            below, upto = sum(x[column] < value for x in rows), sum(x[column] <= value for x in rows)
            assert below <= share * len(rows) + len(rows) / 1000 + 1 and upto >= share * len(rows) - len(rows) / 1000 - 1


def test_whole_numbers_beyond_doubles(spark):
    big = 2**53 + 1
    one = spark.range(1).select(
        compat.integer_divide(F.lit(big), F.lit(1)).alias("a"), compat.integer_divide(F.lit(-7), F.lit(2)).alias("b"), compat.integer_divide(F.lit(7), F.lit(0)).alias("c"), compat.integer_divide(F.lit(-(2**63)), F.lit(3)).alias("d"),
        compat.lcm(F.lit(big), F.lit(1)).alias("e"), compat.lcm(F.lit(0), F.lit(5)).alias("f"), compat.lcm(F.lit(-4), F.lit(6)).alias("g"), compat.trunc(F.lit(1e300), 2).alias("h"), compat.trunc(F.lit(-1e300)).alias("i"), compat.trunc(F.lit(-1.789), 1).alias("j"),
        compat.to_unixtime(F.lit("1969-12-31 23:59:58.5").cast("timestamp_ntz")).alias("k"),
    )
    assert tuple(one.first()) == (big, -3, None, -(2**63 // 3), big, 0, 12, 1e300, -1e300, -1.7, -2)
