"""The merge kernel: order rules, equivalences and plan shape."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, merge
from tidemark.operators.merge import SEQ, WRITE, Snapshot
from tidemark.plans.versioned import events_log, tie_log

PK = ["k"]


def log(spark, rows, value=True):
    return spark.createDataFrame(rows, f"k long{', v string' if value else ''}, {SEQ} long, {WRITE} long")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_upsert_wins_a_tie_and_delete_wins_when_later(spark):
    up = log(spark, [(1, "a", 5, 0), (2, "b", 5, 0), (3, "c", 5, 1), (4, "d", 6, 0)])
    down = log(spark, [(1, 5, 0), (2, 5, 1), (3, 5, 0), (4, 5, 9)], False)
    for f in (merge.resolve, merge.shadowed):
        assert rows(merge.live(f(up, down, PK)), "k", "v") == [(1, "a"), (3, "c"), (4, "d")]
    assert rows(merge.resolve(up, down, PK), "k", "is_delete") == [(1, False), (2, True), (3, False), (4, False)]


def test_one_pass_equals_two_arms_on_random_logs(spark):
    rnd = random.Random(4)
    spots = list(itertools.product(range(6), range(6), range(3)))
    up = log(spark, [(k, f"{k}{s}{w}", s, w) for k, s, w in rnd.sample(spots, 50)])
    down = log(spark, rnd.sample(spots, 40), False)
    assert rows(merge.resolve(up, down, PK), "k", "is_delete", SEQ, WRITE) == rows(merge.shadowed(up, down, PK), "k", "is_delete", SEQ, WRITE)


@pytest.mark.parametrize("at", [0, 1, 250, 500, 900, 10**9])
def test_snapshot_and_delta_equal_the_whole_log(spark, sf_dir, at):
    up, down = tie_log(spark, sf_dir)
    columns = ["user_id", "event_type", "value"]
    base = merge.live(merge.resolve(up, down, ["user_id"], Snapshot.as_of_seq(at))).select(*columns)
    after = [x.filter(F.col(SEQ) > at) for x in (up, down)]
    for where in (None, "value > 50", "event_type = 'click'", "lower(event_type) = 'view' AND value < 70"):
        one = merge.read(up, down, ["user_id"], where=where, columns=columns)
        two = merge.read(*after, ["user_id"], base=base, where=where, columns=columns)
        assert sorted(one.collect()) == sorted(two.collect())


def test_a_filter_never_lets_an_older_version_resurface(spark):
    base = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    up = log(spark, [(1, "new", 9, 0)])
    down = log(spark, [(2, 9, 0)], False)
    assert rows(merge.read(up, down, PK, base=base, where="v = 'old'", columns=["k", "v"]), "k") == []


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_key_filters_reach_the_scan_and_others_stay_above(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    scan = merge.read(up, down, ["user_id"], where="user_id = 5")._jdf.queryExecution().executedPlan().toString()
    assert scan.count("EqualTo(user_id,5)") >= 2
    plan = plan_of(merge.read(up, down, ["user_id"], where="value > 50"))
    assert plan.index("value") < plan.index("Window")
    assert "WindowGroupLimit" in plan


def test_own_writes_win(spark):
    up = spark.createDataFrame([(1, "committed", 5, 0, "t"), (1, "own", None, 0, "me"), (2, "later", 9, 0, "t"), (3, "other open", None, 0, "x")], f"k long, v string, {SEQ} long, {WRITE} long, tx_uuid string")
    assert rows(merge.read(up, None, PK, snapshot=Snapshot.open_tx(9, "me"), columns=["k", "v"]), "k", "v") == [(1, "own")]


def test_empty_projection_keeps_the_count(spark):
    up = log(spark, [(1, "a", 1, 0), (2, "b", 1, 0)])
    df = merge.read(up, None, PK, columns=[])
    assert df.columns == [] and df.count() == 2


def test_audit_range_is_half_open(spark):
    up = log(spark, [(i, "v", i, 0) for i in range(5)]).withColumns({"commit_micros": F.col(SEQ), "began_at_micros": F.col(SEQ)})
    assert rows(audit.history(up, None, PK, window=audit.Range(low=1, high=3)), SEQ) == [(1,), (2,)]
    with pytest.raises(ValueError):
        audit.Range("other")


def test_scans_read_what_is_asked_for(spark, sf_dir):
    from tidemark.plans.registry import queries

    plan = queries()["P5_between"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = queries()["A1_global"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_discount:double>" in plan
    plan = queries()["O3_top_k_htap"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
