"""The merge-on-read kernel, history, branches and change statements over logs derived from the event and order tables.

The log of `events`: key user_id, commit number event_id, one write a commit; an error event is a tombstone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audit, dml, index, merge
from tidemark.operators.merge import MICROS, SEQ, TX, WRITE, Snapshot
from tidemark.plans.registry import query, table

PK = ["user_id"]
_COLUMNS = ["user_id", "event_type", "value"]


def events_log(spark, sf_dir):
    """(upserts, deletes) of the log of events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias(SEQ), F.lit(0).cast("long").alias(WRITE), F.unix_micros(F.col("ts").cast("timestamp")).alias(MICROS))
    e = e.withColumn("began_at_micros", F.col(MICROS) - 1)
    return e.filter("event_type <> 'error'"), e.filter("event_type = 'error'").drop("event_type", "value")


def multi_tx_log(spark, sf_dir):
    """The same rows with ten writes to a commit."""
    up, down = events_log(spark, sf_dir)
    move = {WRITE: F.col(SEQ) % 10, SEQ: F.expr(f"{SEQ} div 10"), MICROS: F.expr(f"({SEQ} div 10) * 1000000")}
    return up.withColumns(move), down.withColumns(move)


def tie_log(spark, sf_dir):
    """Deletes that meet an upsert at the same position are added: the upsert wins."""
    up, down = events_log(spark, sf_dir)
    return up, down.unionByName(up.filter(f"{SEQ} % 7 = 0").drop("event_type", "value"))


_EVENTS = "SELECT user_id, event_type, value, event_id AS commit_seq_num, 0::BIGINT AS write_seq_num, epoch_us(ts) AS commit_micros, event_type = 'error' AS is_delete FROM events"
_MULTI = "SELECT user_id, event_type, value, event_id // 10 AS commit_seq_num, event_id % 10 AS write_seq_num, (event_id // 10) * 1000000 AS commit_micros, event_type = 'error' AS is_delete FROM events"


def _resolved(log: str, where: str = "TRUE", columns: str = "user_id, event_type, value, commit_seq_num", keep: str = "NOT is_delete", partition: str = "user_id") -> str:
    """The oracle's resolve: one winner a key."""
    order = "commit_seq_num DESC, write_seq_num DESC, is_delete ASC"
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn FROM ({log}) l WHERE {where}) r WHERE rn = 1 AND ({keep})"


_AT = 700


@query("flagship", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({_resolved(_EVENTS, 'commit_seq_num <= 900')}) t GROUP BY event_type")
def flagship(spark, sf_dir):
    """Current state as of a commit, aggregated."""
    up, down = events_log(spark, sf_dir)
    state = merge.read(up, down, PK, snapshot=Snapshot.as_of_seq(900), columns=_COLUMNS)
    return state.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- scans -------------------------------------------------------------------------------------------------


@query("S1_versioned_scan", f"SELECT user_id, value FROM ({_resolved(_EVENTS)}) t WHERE event_type = 'click' AND value > 20")
def versioned_scan(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return merge.read(up, down, PK, where="event_type = 'click' AND value > 20", columns=["user_id", "value"])


@query("S2_read_data", f"SELECT event_type, user_id FROM ({_resolved(_EVENTS, f'commit_seq_num <= {_AT}')}) t WHERE user_id BETWEEN 1 AND 60 AND value > 10")
def read_data(spark, sf_dir):
    """Snapshot, ids, filter and projection together."""
    up, down = events_log(spark, sf_dir)
    ids = spark.range(1, 61).select(F.col("id").alias("user_id").cast(up.schema["user_id"].dataType))
    return merge.read(up, down, PK, snapshot=Snapshot.as_of_seq(_AT), ids=ids, where="value > 10", columns=["event_type", "user_id"])


@query("S3_empty_projection", f"SELECT count(*) AS n FROM ({_resolved(_EVENTS)}) t")
def empty_projection(spark, sf_dir):
    """No columns, as many rows: counted here, as a result has at least one column."""
    up, down = events_log(spark, sf_dir)
    return merge.read(up, down, PK, columns=[]).agg(F.count("*").alias("n"))


@query("S3_projection", f"SELECT value, user_id FROM ({_resolved(_EVENTS)}) t")
def projection(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return merge.read(up, down, PK, columns=["value", "user_id"])


@query("S5_seq_ceiling", "SELECT user_id, event_id FROM events WHERE event_type <> 'error' AND event_id <= 500")
def seq_ceiling(spark, sf_dir):
    up, _ = events_log(spark, sf_dir)
    return merge.capped(up, 500).select("user_id", F.col(SEQ).alias("event_id"))


@query("S10_null_fill", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS n_note FROM nation")
def null_fill(spark, sf_dir):
    """Old segments read with a newer schema: an absent nullable column is null."""
    newer = table(spark, sf_dir, "nation").schema.add("n_note", "string")
    return spark.read.schema(newer).parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_note")


@query("S12_count", "SELECT count(*) AS n FROM lineitem")
def count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


# --- the merge kernel --------------------------------------------------------------------------------------


@query("M1_latest", f"SELECT user_id, event_type, value, commit_seq_num FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_seq_num DESC, write_seq_num DESC) AS rn FROM ({_MULTI}) l WHERE NOT is_delete) t WHERE rn = 1")
def latest(spark, sf_dir):
    up, _ = multi_tx_log(spark, sf_dir)
    return merge.latest(up, PK).select(*_COLUMNS, SEQ)


@query("M2_lexicographic", f"SELECT commit_seq_num, write_seq_num, (commit_seq_num > 50 OR (commit_seq_num = 50 AND write_seq_num >= 5)) AS ge, (commit_seq_num > 50 OR (commit_seq_num = 50 AND write_seq_num > 5)) AS gt FROM ({_MULTI}) l")
def lexicographic(spark, sf_dir):
    up, down = multi_tx_log(spark, sf_dir)
    log = up.select(SEQ, WRITE).unionAll(down.select(SEQ, WRITE)).withColumns({"a": F.lit(50).cast("long"), "b": F.lit(5).cast("long")})
    return log.select(SEQ, WRITE, merge.at_or_after((SEQ, WRITE), ("a", "b")).alias("ge"), merge.at_or_after((SEQ, WRITE), ("a", "b"), strict=True).alias("gt"))


_TIES = f"{_EVENTS} UNION ALL SELECT user_id, NULL, NULL, event_id, 0::BIGINT, epoch_us(ts), TRUE FROM events WHERE event_type <> 'error' AND event_id % 7 = 0"


@query("M3_tombstones", _resolved(_TIES))
def tombstones(spark, sf_dir):
    up, down = tie_log(spark, sf_dir)
    return merge.live(merge.shadowed(up, down, PK)).select(*_COLUMNS, SEQ)


@query("M4_two_arms", f"SELECT user_id, is_delete, commit_seq_num FROM ({_resolved(_MULTI, columns='*', keep='TRUE')}) t")
def two_arms(spark, sf_dir):
    """Hot form: log rows get their commit's figures from the commit log first."""
    up, down = multi_tx_log(spark, sf_dir)
    commits = up.select(SEQ, MICROS, "began_at_micros").unionByName(down.select(SEQ, MICROS, "began_at_micros")).groupBy(SEQ).agg(F.max(MICROS).alias(MICROS), F.min("began_at_micros").alias("began_at_micros"))
    commits = commits.withColumn(TX, F.concat(F.lit("tx"), F.col(SEQ)))
    hot = [x.withColumn(TX, F.concat(F.lit("tx"), F.col(SEQ))) for x in (up, down)]
    return merge.shadowed(*(merge.with_commits(x, commits) for x in hot), PK).select("user_id", "is_delete", SEQ)


@query("M5_cold_arms", f"SELECT user_id, is_delete, commit_seq_num FROM ({_resolved(_MULTI, 'commit_seq_num <= 60', columns='*', keep='TRUE')}) t")
def cold_arms(spark, sf_dir):
    """Cold form: commit figures are in the rows; the sequence bound goes first."""
    up, down = (merge.visible(x, Snapshot.as_of_seq(60)) for x in multi_tx_log(spark, sf_dir))
    return merge.shadowed(up, down, PK).select("user_id", "is_delete", SEQ)


@query("M6_one_pass", f"SELECT user_id, is_delete, commit_seq_num FROM ({_resolved(_TIES, columns='*', keep='TRUE')}) t")
def one_pass(spark, sf_dir):
    up, down = tie_log(spark, sf_dir)
    return merge.resolve(up, down, PK).select("user_id", "is_delete", SEQ)


@query("M7_cross_tier", f"SELECT user_id, is_delete, commit_seq_num FROM ({_resolved(_EVENTS, columns='*', keep='TRUE')}) t")
def cross_tier(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    tiers = [merge.resolve(up.filter(c), down.filter(c), PK) for c in (f"{SEQ} <= 600", f"{SEQ} > 600")]
    return merge.cross_tier(tiers, PK).select("user_id", "is_delete", SEQ)


@query("M8_exclusion_set", "SELECT DISTINCT user_id FROM events WHERE event_id > 900")
def exclusion_set(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return merge.touched(merge.resolve(up.filter(f"{SEQ} > 900"), down.filter(f"{SEQ} > 900"), PK), PK)


def _split(spark, sf_dir, at):
    up, down = events_log(spark, sf_dir)
    base = merge.live(merge.resolve(up, down, PK, Snapshot.as_of_seq(at))).select(*_COLUMNS)
    return base, up.filter(F.col(SEQ) > at), down.filter(F.col(SEQ) > at)


@query("M9_snapshot_anti_join", _resolved(_EVENTS, columns="user_id, event_type, value"))
def snapshot_anti_join(spark, sf_dir):
    base, up, down = _split(spark, sf_dir, 500)
    return merge.over_snapshot(base, merge.resolve(up, down, PK), PK)


@query("M10_snapshot_scan", f"SELECT user_id, event_type, value FROM ({_resolved(_EVENTS, 'commit_seq_num <= 500')}) t WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id > 500)")
def snapshot_scan(spark, sf_dir):
    """The part of a stored snapshot that stays as it is."""
    base, up, down = _split(spark, sf_dir, 500)
    return base.join(merge.touched(merge.resolve(up, down, PK), PK), PK, "left_anti")


@query("M11_live", _resolved(_EVENTS, "commit_seq_num > 500"))
def live(spark, sf_dir):
    _, up, down = _split(spark, sf_dir, 500)
    return merge.live(merge.resolve(up, down, PK)).select(*_COLUMNS, SEQ)


@query("M12_residual_filter", f"SELECT user_id, event_type, value FROM ({_resolved(_EVENTS)}) t WHERE value > 50 AND event_type <> 'view'")
def residual_filter(spark, sf_dir):
    """The filter comes after the merge over a stored snapshot, so no older version resurfaces."""
    base, up, down = _split(spark, sf_dir, 500)
    return merge.read(up, down, PK, base=base, where="value > 50 AND event_type <> 'view'", columns=_COLUMNS)


@query("M13_as_of_micros", _resolved(_EVENTS, "commit_micros <= (SELECT epoch_us(max(ts)) FROM events WHERE event_id <= 800)"))
def as_of_micros(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    at = table(spark, sf_dir, "events").filter("event_id <= 800").agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0]
    return merge.read(up, down, PK, snapshot=Snapshot.as_of_micros(at), columns=[*_COLUMNS, SEQ])


@query(
    "M14_own_writes",
    "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN own THEN 9223372036854775807 ELSE commit_seq_num END DESC, write_seq_num DESC, is_delete) AS rn FROM "
    "(SELECT user_id, event_type, value, event_id AS commit_seq_num, event_id AS write_seq_num, event_type = 'error' AS is_delete, event_id BETWEEN 100 AND 140 AS own FROM events) t WHERE commit_seq_num < 800 OR own) r WHERE rn = 1 AND NOT is_delete",
)
def own_writes(spark, sf_dir):
    """An open transaction sees what was committed before it began, and its own rows above all."""
    up, down = (x.withColumn(TX, F.when(F.col(SEQ).between(100, 140), "mine").otherwise("other")).withColumn(WRITE, F.col(SEQ)) for x in events_log(spark, sf_dir))
    return merge.read(up, down, PK, snapshot=Snapshot.open_tx(800, "mine"), columns=_COLUMNS)


@query("M15_parent_fold", _resolved(_EVENTS, "commit_seq_num <= 400 OR commit_seq_num % 2 = 1"))
def parent_fold(spark, sf_dir):
    """A branch forked at 400: its parent's log up to there and its own, the odd commits since."""
    up, down = events_log(spark, sf_dir)
    child = f"{SEQ} > 400 AND {SEQ} % 2 = 1"
    both = [merge.forked(x.filter(f"{SEQ} <= 400 OR {SEQ} % 2 = 0"), x.filter(child), 400) for x in (up, down)]
    return merge.read(*both, PK, columns=[*_COLUMNS, SEQ])


@query("M16_point_lookup", f"SELECT * FROM ({_resolved(_EVENTS)}) t WHERE user_id IN (3, 5, 7, 11, 100000)")
def point_lookup(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    ids = spark.createDataFrame([(i,) for i in (3, 5, 7, 11, 100000)], "user_id long").select(F.col("user_id").cast(up.schema["user_id"].dataType))
    return merge.read(up, down, PK, ids=merge.checked_ids(ids, up, PK), columns=[*_COLUMNS, SEQ])


@query("M17_ids_validation", "SELECT * FROM (VALUES ('columns', TRUE), ('empty', TRUE), ('null', TRUE), ('good', FALSE)) t(name, rejected)")
def ids_validation(spark, sf_dir):
    up, _ = events_log(spark, sf_dir)
    kind = up.schema["user_id"].dataType.simpleString()
    batches = {"columns": ([("a",)], "name string"), "empty": ([], f"user_id {kind}"), "null": ([(None,)], f"user_id {kind}"), "good": ([(1,)], f"user_id {kind}")}
    out = []
    for name, (rows, schema) in batches.items():
        try:
            merge.checked_ids(spark.createDataFrame(rows, schema), up, PK)
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, rejected boolean")


@query("M18_tier_dispatch", " UNION ALL ".join(f"SELECT '{name}' AS tiers, count(*) AS n, CAST(sum(commit_seq_num) AS BIGINT) AS s FROM ({_resolved(_EVENTS)}) t" for name in ("all_hot", "all_cold", "snapshot", "mixed")))
def tier_dispatch(spark, sf_dir):
    """The same rows whether the log is hot, cold, snapshotted in part or a mix."""
    up, down = events_log(spark, sf_dir)
    columns = [*_COLUMNS, SEQ]
    base = merge.live(merge.resolve(up, down, PK, Snapshot.as_of_seq(600))).select(*columns)
    late = [x.filter(f"{SEQ} > 600") for x in (up, down)]
    tiers = [merge.resolve(up.filter(c), down.filter(c), PK) for c in (f"{SEQ} <= 300", f"{SEQ} > 300")]
    states = {
        "all_hot": merge.read(up, down, PK, columns=columns), "all_cold": merge.live(merge.shadowed(up, down, PK)).select(*columns),
        "snapshot": merge.read(*late, PK, base=base, columns=columns), "mixed": merge.live(merge.cross_tier(tiers, PK)).select(*columns),
    }
    return merge.union([df.agg(F.lit(name).alias("tiers"), F.count("*").alias("n"), F.sum(SEQ).alias("s")) for name, df in states.items()])


@query("M19_branch_merge", f"SELECT user_id, event_type, value, is_delete, 5000::BIGINT AS commit_seq_num FROM (SELECT user_id, CASE WHEN is_delete THEN NULL ELSE event_type END AS event_type, CASE WHEN is_delete THEN NULL ELSE value END AS value, is_delete FROM ({_resolved(_EVENTS, 'commit_seq_num > 400', columns='*', keep='TRUE')}) t) u")
def branch_merge(spark, sf_dir):
    """A branch's changes since its fork as one commit of its parent."""
    up, down = events_log(spark, sf_dir)
    return merge.merged(up, down, PK, 400, 5000, 5_000_000).select(*_COLUMNS, "is_delete", SEQ)


@query("P11_key_seek", f"SELECT user_id, value FROM ({_resolved(_EVENTS)}) t WHERE user_id = 5")
def key_seek(spark, sf_dir):
    """A filter on the key reaches the scans below the merge."""
    up, down = events_log(spark, sf_dir)
    return merge.read(up, down, PK, where="user_id = 5", columns=["user_id", "value"])


@query("M6_composite_key", _resolved("SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey AS commit_seq_num, 0 AS write_seq_num, FALSE AS is_delete FROM orders", columns="o_custkey, o_orderstatus, o_totalprice", partition="o_custkey, o_orderstatus"))
def composite_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({SEQ: F.col("o_orderkey"), WRITE: F.lit(0)})
    return merge.read(o, None, ["o_custkey", "o_orderstatus"], columns=["o_custkey", "o_orderstatus", "o_totalprice"])


# --- history -----------------------------------------------------------------------------------------------


def commit_log(spark, sf_dir):
    up, down = multi_tx_log(spark, sf_dir)
    return up.select(SEQ).unionByName(down.select(SEQ)).distinct().withColumns({"author": F.concat(F.lit("u"), F.col(SEQ) % 5), "comment": F.concat(F.lit("c"), F.col(SEQ) % 3)})


@query("B8_time_travel", " UNION ALL ".join(f"SELECT {n}::BIGINT AS at, count(*) AS n, round(sum(value), 3) AS total FROM ({_resolved(_EVENTS, f'commit_seq_num <= {n}')}) t" for n in (0, 250, 500, 999)))
def time_travel(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return merge.union([merge.read(up, down, PK, snapshot=Snapshot.as_of_seq(n)).agg(F.lit(n).cast("long").alias("at"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")) for n in (0, 250, 500, 999)])


@query("B9_audit_upserts", f"SELECT user_id, event_type, value, commit_micros, write_seq_num, commit_seq_num, 'c' || commit_seq_num % 3 AS comment, 'u' || commit_seq_num % 5 AS author FROM ({_MULTI}) l WHERE NOT is_delete AND commit_seq_num >= 20 AND commit_seq_num < 60")
def audit_upserts(spark, sf_dir):
    up, _ = multi_tx_log(spark, sf_dir)
    return audit.history(up, commit_log(spark, sf_dir), _COLUMNS, window=audit.Range(low=20, high=60), metadata=True).drop("began_at_micros")


@query("J12_audit_metadata", f"SELECT commit_seq_num, write_seq_num, 'u' || commit_seq_num % 5 AS author FROM ({_MULTI}) l WHERE NOT is_delete")
def audit_metadata(spark, sf_dir):
    up, _ = multi_tx_log(spark, sf_dir)
    return audit.history(up, commit_log(spark, sf_dir), PK, metadata=True).select(SEQ, WRITE, "author")


@query("B10_audit_deletes", f"SELECT user_id, commit_micros, write_seq_num, commit_seq_num FROM ({_MULTI}) l WHERE is_delete")
def audit_deletes(spark, sf_dir):
    _, down = multi_tx_log(spark, sf_dir)
    return audit.history(down, None, PK).drop("began_at_micros")


@query("B11_audit_window", f"SELECT user_id, commit_seq_num FROM ({_EVENTS}) l WHERE NOT is_delete AND user_id BETWEEN 1 AND 20 AND commit_micros >= (SELECT epoch_us(ts) FROM events WHERE event_id = 100) AND commit_micros < (SELECT epoch_us(ts) FROM events WHERE event_id = 700)")
def audit_window(spark, sf_dir):
    up, _ = events_log(spark, sf_dir)
    low, high = (table(spark, sf_dir, "events").filter(F.col("event_id") == n).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] for n in (100, 700))
    ids = spark.range(1, 21).select(F.col("id").cast(up.schema["user_id"].dataType).alias("user_id"))
    return audit.history(up, None, PK, window=audit.Range(MICROS, low, high), ids=ids, pk=PK).select("user_id", SEQ)


@query("O5_audit_order", f"SELECT commit_seq_num, write_seq_num, user_id FROM ({_MULTI}) l WHERE NOT is_delete ORDER BY commit_seq_num, write_seq_num")
def audit_order(spark, sf_dir):
    up, _ = multi_tx_log(spark, sf_dir)
    return audit.ordered(audit.history(up, None, PK)).select(SEQ, WRITE, "user_id")


@query("B11_change_feed", "SELECT user_id, event_id AS commit_seq_num, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS change FROM events WHERE event_id > 800")
def change_feed(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return audit.changes_since(up, down, 800, PK).select("user_id", SEQ, "change")


@query("B12_max_commit_seq", "SELECT (SELECT coalesce(max(event_id), -1) FROM events) AS some, -1::BIGINT AS none")
def max_commit_seq(spark, sf_dir):
    commits = table(spark, sf_dir, "events").select(F.col("event_id").alias(SEQ))
    some, none = (audit.max_commit_seq(c).withColumnRenamed("max_commit_seq_num", n) for c, n in ((commits, "some"), (commits.filter("false"), "none")))
    return some.crossJoin(none)  # one row each


@query("B13_retention_floor", "SELECT * FROM (VALUES ('below', 'error', NULL), ('at', 'ok', 100), ('unbounded', 'ok', 100)) t(ask, outcome, low)")
def retention_floor(spark, sf_dir):
    out = []
    for name, asked in (("below", 50), ("at", 100), ("unbounded", None)):
        try:
            out.append((name, "ok", audit.check_floor(asked, 100)))
        except ValueError:
            out.append((name, "error", None))
    return spark.createDataFrame(out, "ask string, outcome string, low int")


# --- change statements -------------------------------------------------------------------------------------

_STATE = _resolved(_EVENTS, columns="user_id, event_type, value")


def _state(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    return merge.read(up, down, PK, columns=_COLUMNS)


@query("D1_insert", f"SELECT * FROM ({_STATE}) t UNION ALL SELECT user_id + 100000, event_type, value FROM ({_STATE}) t WHERE user_id < 20")
def insert(spark, sf_dir):
    now = _state(spark, sf_dir)
    kind = now.schema["user_id"].dataType
    new = now.filter("user_id < 20").withColumn("user_id", (F.col("user_id") + 100000).cast(kind))
    return dml.applied(now, PK, dml.insert(now, new, PK), None)


@query("D1_strict_collision", f"SELECT count(*) AS n FROM ({_STATE}) t WHERE user_id BETWEEN 10 AND 30")
def strict_collision(spark, sf_dir):
    now = _state(spark, sf_dir)
    return dml.collisions(now, now.filter("user_id BETWEEN 10 AND 30"), PK).agg(F.count("*").alias("n"))


@query("D2_upsert", f"SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE event_type END AS event_type, value FROM ({_STATE}) t")
def upsert(spark, sf_dir):
    now = _state(spark, sf_dir)
    new = now.filter("user_id % 2 = 0").withColumn("event_type", F.lit("new"))
    return dml.applied(now, PK, dml.insert(now, new, PK, on_conflict="update"), None)


@query("D5_update", f"SELECT user_id, event_type, CASE WHEN event_type = 'click' THEN value * 2 + 1 ELSE value END AS value FROM ({_STATE}) t")
def update(spark, sf_dir):
    now = _state(spark, sf_dir)
    _, up = dml.update(now, PK, "event_type = 'click'", {"value": "value * 2 + 1"})
    return dml.applied(now, PK, up, None)


@query("D6_update_key", f"SELECT CASE WHEN user_id BETWEEN 2 AND 50 THEN user_id - 1 ELSE user_id END AS user_id, event_type, value FROM ({_STATE}) t WHERE user_id <> 1 OR NOT EXISTS (SELECT 1)")
def update_key(spark, sf_dir):
    """All keys of a range move down by one, onto keys that the same statement vacates."""
    now = _state(spark, sf_dir).filter("user_id <> 1")
    gone, up = dml.update(now, PK, "user_id BETWEEN 2 AND 50", {"user_id": "user_id - 1"})
    return dml.applied(now, PK, up, gone)


@query("D7_delete", f"SELECT * FROM ({_STATE}) t WHERE NOT (value < 30)")
def delete(spark, sf_dir):
    now = _state(spark, sf_dir)
    return dml.applied(now, PK, None, dml.delete(now, PK, "value < 30"))


# --- branches and indexes ----------------------------------------------------------------------------------


@query("B5_fork_read", f"SELECT event_type, count(*) AS n FROM ({_resolved(_EVENTS, 'commit_seq_num <= 300 OR (commit_seq_num > 600 AND commit_seq_num % 3 = 0)')}) t GROUP BY event_type")
def fork_read(spark, sf_dir):
    up, down = events_log(spark, sf_dir)
    both = [merge.forked(x, x.filter(f"{SEQ} > 600 AND {SEQ} % 3 = 0"), 300) for x in (up, down)]
    return merge.read(*both, PK).groupBy("event_type").agg(F.count("*").alias("n"))


@query("B6_fast_forward", _resolved(_EVENTS, "commit_seq_num <= 400 OR commit_seq_num % 2 = 1", columns="user_id, event_type, value"))
def fast_forward(spark, sf_dir):
    """The parent after merging a branch that it didn't move past: the same rows the branch saw."""
    up, down = events_log(spark, sf_dir)
    odd = f"{SEQ} > 400 AND {SEQ} % 2 = 1"
    change = merge.merged(up.filter(odd), down.filter(odd), PK, 400, 401, 401)
    parent = [merge.capped(x, 400) for x in (up, down)]
    return merge.read(parent[0].unionByName(change.filter("not is_delete").drop("is_delete")), parent[1].unionByName(change.filter("is_delete").select(*parent[1].columns)), PK, columns=_COLUMNS)


@query("L12_index_build", f"SELECT event_type, value, user_id FROM ({_STATE}) t")
def index_build(spark, sf_dir):
    return index.build(_state(spark, sf_dir), ["event_type", "value"], PK, 4)


@query("L13_index_seek", f"SELECT user_id FROM ({_STATE}) t WHERE event_type IN ('click', 'view')")
def index_seek(spark, sf_dir):
    side = index.build(_state(spark, sf_dir), ["event_type", "value"], PK, 4)
    return index.seek(side, ["event_type", "value"], PK, {"event_type": ["click", "view"]})


@query("L13_index_intersect", f"SELECT user_id, event_type, value FROM ({_STATE}) t WHERE event_type = 'click' AND value < 40")
def index_intersect(spark, sf_dir):
    """Two indexes find keys, their intersection restricts the read, and the filter is applied again."""
    now = _state(spark, sf_dir)
    a = index.seek(index.build(now, ["event_type"], PK, 4), ["event_type"], PK, {"event_type": ["click"]})
    b = index.build(now, ["value"], PK, 4).filter("value < 40").select(*PK)
    return merge.restricted(now, index.intersect([a, b], PK), PK).filter("event_type = 'click' AND value < 40")


@query("L14_seek_validation", "SELECT * FROM (VALUES ('unknown column', TRUE), ('not leading', TRUE), ('too many', TRUE), ('good', FALSE)) t(name, rejected)")
def seek_validation(spark, sf_dir):
    asks = {"unknown column": {"x": [1]}, "not leading": {"value": [1.0]}, "too many": {"event_type": list(range(40)), "value": list(range(40))}, "good": {"event_type": ["click"]}}
    out = []
    for name, probe in asks.items():
        try:
            index.checked_probe(["event_type", "value"], probe)
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, rejected boolean")
