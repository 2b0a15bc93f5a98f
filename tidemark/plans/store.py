"""Queries that run through a stored engine: writes, transactions, catalog, branches, lifecycle and SQL sessions.

Each builds a small catalog in the scratch folder, loads events in three commits, and returns rows that SQL over the tables gives too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.plans.registry import query, scratch_root, table
from tidemark.plans.versioned import _EVENTS, _resolved, events_log
from tidemark.sources.engine import BadTransaction, Engine, Exists
from tidemark.sources.session import Session, Unsupported
from tidemark.streaming import feed

_STATE = _resolved(_EVENTS, columns="user_id, event_type, value")
_COLUMNS = [("user_id", "int64"), ("event_type", "utf8"), ("value", "float64")]


def _root(spark) -> str:
    return scratch_root(spark, "store")


def _engine(spark, **options) -> Engine:
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    e.create_schema("c", "app")
    e.create_table("c", "app", "ev", _COLUMNS, ["user_id"], **options)
    return e


def _load(e: Engine, spark, sf_dir, bounds=((0, 400), (400, 800), (800, 10**12)), branch="main") -> None:
    """Each range of events as one commit: its winners as upserts, its tombstones as deletes."""
    up, down = events_log(spark, sf_dir)
    for low, high in bounds:
        span = (F.col(merge.SEQ) >= low) & (F.col(merge.SEQ) < high)
        won = merge.resolve(up.filter(span), down.filter(span), ["user_id"])
        e.write_data("c", "app", "ev", upserts=won.filter("not is_delete").select("user_id", "event_type", "value"), deletes=won.filter("is_delete").select("user_id"), branch=branch)


def _key(e: Engine) -> str:
    return e.list_objects("c", "table").first()["uuid"]


def _read(e: Engine, **options):
    return e.read_data("c", "app", "ev", **options)


@query("S11_hot_scan", _STATE)
def hot_scan(spark, sf_dir):
    e = _engine(spark)
    _load(e, spark, sf_dir)
    return _read(e)


@query("S4_cold_scan", _STATE)
def cold_scan(spark, sf_dir):
    e = _engine(spark)
    _load(e, spark, sf_dir)
    e.persist("c", _key(e))
    return _read(e)


@query("S6_snapshot_scan", _STATE)
def snapshot_scan(spark, sf_dir):
    e = _engine(spark, clustering_keys=["event_type"])
    _load(e, spark, sf_dir)
    e.persist_and_snapshot_branch("c")
    return _read(e)


@query("M18_mixed_tiers", _STATE)
def mixed_tiers(spark, sf_dir):
    """A stored snapshot, persisted rows behind it and hot rows behind those."""
    e = _engine(spark)
    spans = ((0, 400), (400, 800), (800, 10**12))
    _load(e, spark, sf_dir, spans[:1])
    e.persist_and_snapshot_branch("c")
    _load(e, spark, sf_dir, spans[1:2])
    e.persist_branch("c")
    _load(e, spark, sf_dir, spans[2:])
    return _read(e)


@query("S7_parquet", "SELECT * FROM nation")
def parquet(spark, sf_dir):
    path = _root(spark)
    table(spark, sf_dir, "nation").write.parquet(path)
    return spark.read.parquet(path)


@query("S13_system_tables", "SELECT * FROM (VALUES ('schema', 'app'), ('table', 'ev'), ('index', 'by_type')) t(kind, name)")
def system_tables(spark, sf_dir):
    e = _engine(spark, indexes={"by_type": ["event_type"]})
    return merge.union([e.list_objects("c", kind).select(F.lit(kind).alias("kind"), "name") for kind in ("schema", "table", "index")])


@query("S14_paged_listing", "SELECT * FROM (VALUES ('t2'), ('t3')) t(name)")
def paged_listing(spark, sf_dir):
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    tx = e.begin("c")
    e.create_schema("c", "s", tx=tx)
    for i in range(5):
        e.create_table("c", "s", f"t{i}", [("k", "int64")], ["k"], tx=tx)
    e.commit("c", tx)
    return e.list_objects("c", "table", limit=2, offset=2).select("name")


@query("S14_page_tokens", "SELECT * FROM (VALUES (1, 't0'), (1, 't1'), (2, 't2'), (2, 't3'), (3, 't4')) t(page, name)")
def page_tokens(spark, sf_dir):
    """Pages by opaque tokens; a table made in between isn't in a listing that began before."""
    e, out = Engine(spark, _root(spark)), []
    e.create_catalog("c")
    tx = e.begin("c")
    e.create_schema("c", "s", tx=tx)
    for i in range(5):
        e.create_table("c", "s", f"t{i}", [("k", "int64")], ["k"], tx=tx)
    e.commit("c", tx)
    token, page = None, 0
    while token or not page:
        page += 1
        rows, token = e.list_page("c", "table", 2, token)
        out += [(page, r["name"]) for r in rows]
        if page == 1:
            e.create_table("c", "s", "t1a", [("k", "int64")], ["k"])
    return spark.createDataFrame(out, "page int, name string")


@query("S12_stored_count", f"SELECT 'hot' AS state, count(*) AS n FROM ({_STATE}) t UNION ALL SELECT 'before', count(*) FROM ({_resolved(_EVENTS, 'commit_seq_num < 800', columns='user_id')}) t")
def stored_count(spark, sf_dir):
    """COUNT(*) of a table in the hot tier, now and as of a commit, from keys alone."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    last = e.max_commit_seq("c")
    return spark.createDataFrame([("hot", e.count_data("c", "app", "ev")), ("before", e.count_data("c", "app", "ev", as_of_seq=last - 1))], "state string, n long")


@query("S18_metadata", "SELECT * FROM (VALUES ('c', 'app', 'ev', 'TABLE')) t(catalog_name, db_schema_name, table_name, table_type)")
def metadata(spark, sf_dir):
    return Session(_engine(spark), "c", schema="app").tables()


@query("S16_write_and_audit", "SELECT 3::BIGINT AS commits, count(*) AS users FROM (SELECT DISTINCT user_id FROM events WHERE event_type <> 'error' OR TRUE)")
def write_and_audit(spark, sf_dir):
    """Every key that was written is in the history, as upsert or delete, under one of three commits."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    up, down = (e.audit_data("c", "app", "ev", kind=k).select("user_id", "commit_seq_num") for k in ("upsert", "delete"))
    return up.union(down).agg(F.count_distinct("commit_seq_num").alias("commits"), F.count_distinct("user_id").alias("users"))


@query("D10_write_data", f"SELECT * FROM ({_STATE}) t WHERE user_id > 10 UNION ALL SELECT user_id, 'again', value FROM ({_STATE}) t WHERE user_id <= 5")
def write_data(spark, sf_dir):
    """One change that deletes keys and upserts some of them: its deletes go first."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    now = _read(e)
    e.write_data("c", "app", "ev", deletes=now.filter("user_id <= 10").select("user_id"), upserts=now.filter("user_id <= 5").withColumn("event_type", F.lit("again")))
    return _read(e)


@query("D11_transactions", f"SELECT 'inside' AS at, count(*) AS n FROM ({_STATE}) t WHERE user_id > 20 UNION ALL SELECT 'outside', count(*) FROM ({_STATE}) t UNION ALL SELECT 'rolled back', count(*) FROM ({_STATE}) t UNION ALL SELECT 'committed', count(*) FROM ({_STATE}) t WHERE user_id > 20")
def transactions(spark, sf_dir):
    """An open transaction sees its own writes; others see them once it commits."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    s, out = Session(e, "c", schema="app"), []
    count = lambda x: x.execute("SELECT count(*) AS n FROM ev").first()[0]
    s.execute("BEGIN")
    s.execute("DELETE FROM ev WHERE user_id <= 20")
    out += [("inside", count(s)), ("outside", count(Session(e, "c", schema="app")))]
    s.execute("ROLLBACK")
    out.append(("rolled back", count(s)))
    s.execute("BEGIN")
    s.execute("DELETE FROM ev WHERE user_id <= 20")
    s.execute("COMMIT")
    out.append(("committed", count(s)))
    return spark.createDataFrame(out, "at string, n long")


@query("D11_first_commit", f"SELECT state, user_id, event_type, value FROM (VALUES ('hot'), ('persisted'), ('snapshotted')) s(state), ({_STATE}) t")
def first_commit(spark, sf_dir):
    """Schema, table and rows in one transaction, the catalog's commit 0: read hot, persisted and from a snapshot."""
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    tx = e.begin("c")
    e.create_schema("c", "app", tx=tx)
    e.create_table("c", "app", "ev", _COLUMNS, ["user_id"], tx=tx)
    won = merge.resolve(*events_log(spark, sf_dir), ["user_id"])
    e.write_data("c", "app", "ev", upserts=won.filter("not is_delete").select("user_id", "event_type", "value"), tx=tx)
    if e.commit("c", tx) != 0:
        raise AssertionError("the first commit of a catalog is number 0")
    out = [_read(e).withColumn("state", F.lit("hot"))]
    for at, step in (("persisted", e.persist_branch), ("snapshotted", e.snapshot_branch)):
        step("c")
        out.append(_read(e).withColumn("state", F.lit(at)))
    return merge.union(out)


@query("D12_tx_lifecycle", "SELECT * FROM (VALUES ('commit', 'committed'), ('commit twice', 'error'), ('abort committed', 'error'), ('abort', 'aborted'), ('abort twice', 'aborted'), ('expired', 'expired'), ('commit expired', 'error')) t(step, outcome)")
def tx_lifecycle(spark, sf_dir):
    now = [1_000_000]
    e = Engine(spark, _root(spark), clock=lambda: now[0], tx_seconds=10)
    e.create_catalog("c")
    out = []

    def step(name, work):
        try:
            out.append((name, work()))
        except BadTransaction:
            out.append((name, "error"))

    tx = e.begin("c")
    step("commit", lambda: (e.commit("c", tx), e.tx_state("c", tx))[1])
    step("commit twice", lambda: e.commit("c", tx))
    step("abort committed", lambda: e.abort("c", tx))
    other = e.begin("c")
    step("abort", lambda: (e.abort("c", other), e.tx_state("c", other))[1])
    step("abort twice", lambda: (e.abort("c", other), e.tx_state("c", other))[1])
    late = e.begin("c")
    now[0] += 11_000_000
    step("expired", lambda: e.tx_state("c", late))
    step("commit expired", lambda: e.commit("c", late))
    return spark.createDataFrame(out, "step string, outcome string")


@query("D13_session_options", f"SELECT count(*) AS n FROM ({_STATE}) t")
def session_options(spark, sf_dir):
    e = _engine(spark)
    _load(e, spark, sf_dir)
    s = Session(e, "c")
    s.execute("SET search_path TO app")
    return s.execute("SELECT count(*) AS n FROM ev")


_REJECTED = (
    ("D3", "INSERT INTO ev VALUES (1, 'a', 1.0) ON CONFLICT DO NOTHING"), ("D4 columns", "INSERT INTO ev (user_id) VALUES (1)"), ("D4 returning", "INSERT INTO ev VALUES (-1, 'a', 1.0) RETURNING user_id"), ("D8 update from", "UPDATE ev SET value = 1 FROM ev e2"),
    ("D8 update limit", "UPDATE ev SET value = 1 WHERE value > 0 LIMIT 1"), ("D8 delete using", "DELETE FROM ev USING ev e2"), ("D8 delete order", "DELETE FROM ev WHERE value > 0 ORDER BY value"), ("B1", "CREATE SCHEMA IF NOT EXISTS x"), ("B2 ctas", "CREATE TABLE x AS SELECT 1"),
    ("B2 partition", "CREATE TABLE x (k BIGINT PRIMARY KEY) PARTITION BY (k)"), ("U7 explain", "EXPLAIN SELECT 1"), ("U7 drop", "DROP TABLE ev"), ("U7 merge", "MERGE INTO ev USING ev e2 ON 1 = 1"), ("S19 copy", "COPY ev TO 'x'"),
)


@query("D8_rejected_statements", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', TRUE)" for name, _ in _REJECTED) + ") t(name, rejected)")
def rejected_statements(spark, sf_dir):
    s, out = Session(_engine(spark), "c", schema="app"), []
    for name, text in _REJECTED:
        try:
            s.execute(text)
            out.append((name, False))
        except Unsupported:
            out.append((name, True))
        except NotImplementedError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, rejected boolean")


@query("D9_parameters", "SELECT * FROM (VALUES (1::BIGINT, 'it''s', 2.5::DOUBLE), (2, NULL, -1.0)) t(user_id, event_type, value)")
def parameters(spark, sf_dir):
    s = Session(_engine(spark), "c", schema="app")
    s.execute("INSERT INTO ev VALUES (?, ?, ?), (?, ?, ?)", [1, "it's", 2.5, 2, None, -1.0])
    return s.execute("SELECT * FROM ev")


@query("B1_B2_sql_ddl", "SELECT 7::BIGINT AS id, DATE '2024-05-06' AS d, CAST(1.25 AS DECIMAL(10,2)) AS dec, 3::SMALLINT AS s, TIMESTAMP '2024-05-06 07:08:09' AS ts")
def sql_ddl(spark, sf_dir):
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    s = Session(e, "c")
    s.execute("CREATE SCHEMA typed")
    s.execute("SET schema = typed")
    s.execute("CREATE TABLE t (id BIGINT, d DATE, dec DECIMAL(10, 2), s SMALLINT NOT NULL, ts TIMESTAMP, PRIMARY KEY (id))")
    s.execute("INSERT INTO t VALUES (7, DATE '2024-05-06', 1.25, 3, TIMESTAMP '2024-05-06 07:08:09')")
    return s.execute("SELECT * FROM t")


@query("B3_definitions_over_time", "SELECT * FROM (VALUES (1, 'ev', 3), (2, 'events', 3), (3, 'events', 4), (4, NULL, NULL)) t(seq, name, columns)")
def definitions_over_time(spark, sf_dir):
    """A table is created, renamed, given a column and dropped; each state stays readable by name as of its commit."""
    e = _engine(spark)
    e.update_table("c", "app", "ev", new_name="events")
    e.update_table("c", "app", "events", columns=[*_COLUMNS, ("note", "utf8")])
    e.delete_table("c", "app", "events")
    out = []
    for seq in (1, 2, 3, 4):
        found = e.list_objects("c", "table", as_of_seq=seq).collect()
        width = len(e.read_data("c", "app", found[0]["name"], as_of_seq=seq).columns) if found else None
        out.append((seq, found[0]["name"] if found else None, width))
    return spark.createDataFrame(out, "seq int, name string, columns int")


@query("B4_index_definitions", "SELECT * FROM (VALUES ('by_kind')) t(name)")
def index_definitions(spark, sf_dir):
    e = _engine(spark)
    e.create_index("c", "app", "ev", "by_type", ["event_type"])
    e.create_index("c", "app", "ev", "gone", ["value"])
    e.update_index("c", "app", "ev", "by_type", "by_kind")
    e.delete_index("c", "app", "ev", "gone")
    return e.list_objects("c", "index").select("name")


_BRANCHED = _resolved(_EVENTS, "commit_seq_num < 800", columns="user_id, event_type, value")


@query("B5_stored_branch", f"SELECT 'main' AS branch, count(*) AS n, round(sum(value), 3) AS total FROM ({_STATE}) t UNION ALL SELECT 'dev', count(*), round(sum(value), 3) FROM ({_BRANCHED}) t WHERE user_id % 2 = 0")
def stored_branch(spark, sf_dir):
    """A branch forked before the last load deletes inherited rows; main doesn't see it, nor it main's later rows."""
    e = _engine(spark)
    spans = ((0, 400), (400, 800), (800, 10**12))
    _load(e, spark, sf_dir, spans[:2])
    e.create_branch("c", "dev")
    _load(e, spark, sf_dir, spans[2:])
    Session(e, "c", branch="dev", schema="app").execute("DELETE FROM ev WHERE user_id % 2 = 1")
    return merge.union([_read(e, branch=b).agg(F.lit(b).alias("branch"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")) for b in ("main", "dev")])


@query("B6_stored_merge", f"SELECT user_id, event_type, value + 1 AS value FROM ({_STATE}) t")
def stored_merge(spark, sf_dir):
    e = _engine(spark)
    _load(e, spark, sf_dir)
    e.create_branch("c", "dev")
    Session(e, "c", branch="dev", schema="app").execute("UPDATE ev SET value = value + 1")
    e.merge_branch("c", "dev")
    return _read(e)


@query("B7_branch_rules", "SELECT * FROM (VALUES ('fork of a fork', TRUE), ('delete main', TRUE), ('same name', TRUE), ('merge behind', TRUE), ('rename', FALSE), ('delete', FALSE)) t(step, rejected)")
def branch_rules(spark, sf_dir):
    e, out = _engine(spark), []
    e.create_branch("c", "dev")
    e.create_schema("c", "later")
    for name, work in (
        ("fork of a fork", lambda: e.create_branch("c", "x", source="dev")), ("delete main", lambda: e.delete_branch("c", "main")), ("same name", lambda: e.create_branch("c", "dev")), ("merge behind", lambda: e.merge_branch("c", "dev")),
        ("rename", lambda: e.update_branch("c", "dev", "dev2")), ("delete", lambda: e.delete_branch("c", "dev2")),
    ):
        try:
            work()
            out.append((name, False))
        except (ValueError, Exists):
            out.append((name, True))
    return spark.createDataFrame(out, "step string, rejected boolean")


_LIFE = ("hot", "persisted", "snapshotted", "purged", "compacted", "swept")


@query("L1_lifecycle", " UNION ALL ".join(f"SELECT '{s}' AS step, count(*) AS n, round(sum(value), 3) AS total FROM ({_STATE}) t" for s in _LIFE))
def lifecycle(spark, sf_dir):
    """Persist, snapshot, purge, compact and sweep leave the rows as they are."""
    e, out = _engine(spark), []
    up = ((0, 400), (400, 800), (800, 10**12))
    note = lambda step: out.append((step, *_read(e).agg(F.count("*"), F.round(F.sum("value"), 3)).first()))
    _load(e, spark, sf_dir, up[:2])
    key = _key(e)
    e.persist("c", key)
    _load(e, spark, sf_dir, up[2:])
    note("hot")
    e.persist("c", key)
    note("persisted")
    e.snapshot("c", key)
    note("snapshotted")
    e.purge("c", key)
    note("purged")
    e.compact("c", key)
    note("compacted")
    e.sweep("c")
    e.purge_tx_log("c")
    note("swept")
    return spark.createDataFrame(out, "step string, n long, total double")


@query("L3_partitioned_snapshot", "SELECT c_nationkey, count(*) AS n, round(sum(CASE WHEN c_nationkey = 3 THEN c_acctbal + 1 ELSE c_acctbal END), 2) AS total FROM customer GROUP BY c_nationkey")
def partitioned_snapshot(spark, sf_dir):
    """L4: an update of one partition rewrites that one; the others are carried into the next snapshot."""
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    e.create_schema("c", "app")
    e.create_table("c", "app", "cust", [("c_nationkey", "int32"), ("c_custkey", "int64"), ("c_acctbal", "float64")], ["c_nationkey", "c_custkey"], partition_keys=["c_nationkey"], clustering_keys=["c_custkey"])
    e.write_data("c", "app", "cust", upserts=table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"))
    e.persist_and_snapshot_branch("c")
    Session(e, "c", schema="app").execute("UPDATE cust SET c_acctbal = c_acctbal + 1 WHERE c_nationkey = 3")
    e.persist_and_snapshot_branch("c")
    return e.read_data("c", "app", "cust").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def _counts(e: Engine) -> dict[str, int]:
    state = e._open("c")
    tiers = [x["tier"] for x in state["segments"]]
    return {"hot": tiers.count("hot"), "cold": tiers.count("cold"), "snapshots": len(state["snapshots"]), "retired": len(state["retired"]), "transactions": len(state["txs"])}


def _steps(spark, e: Engine, steps):
    """What each step returns, and the counts behind it, as rows."""
    out = []
    for name, work in steps:
        done = work()
        out.append((name, done, *_counts(e).values()))
    return spark.createDataFrame(out, "step string, done int, hot int, cold int, snapshots int, retired int, transactions int")


_COLUMNS_OF_STEPS = "t(step, done, hot, cold, snapshots, retired, transactions)"


@query("L2_persist_tx_log", "SELECT * FROM (VALUES (2::BIGINT, 'first', 'ann'), (3, 'second', NULL), (4, NULL, 'bob')) t(seq, comment, author)")
def persist_tx_log(spark, sf_dir):
    """The commits whose rows were persisted, as the cold commit log has them."""
    e = _engine(spark)
    for i, (comment, author) in enumerate((("first", "ann"), ("second", None), (None, "bob"))):
        tx = e.begin("c")
        e.write_data("c", "app", "ev", upserts=spark.createDataFrame([(i, "x", 1.0)], "user_id long, event_type string, value double"), tx=tx)
        e.commit("c", tx, comment=comment, author=author)
        e.persist_branch("c")
    log = spark.read.parquet(*[x["path"] for x in e._open("c")["tx_log"]])
    return log.select(F.col(merge.SEQ).alias("seq"), "comment", "author")


@query("L4_carry_forward", "SELECT CAST(count(DISTINCT c_nationkey) AS INT) AS parts, CAST(count(DISTINCT c_nationkey) - 1 AS INT) AS carried, CAST(1 AS INT) AS written FROM customer")
def carry_forward(spark, sf_dir):
    """A change of one partition: the next snapshot names the files of all others as they are, and new ones for that one."""
    e = Engine(spark, _root(spark))
    e.create_catalog("c")
    e.create_schema("c", "app")
    e.create_table("c", "app", "cust", [("c_nationkey", "int32"), ("c_custkey", "int64"), ("c_acctbal", "float64")], ["c_nationkey", "c_custkey"], partition_keys=["c_nationkey"])
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    e.write_data("c", "app", "cust", upserts=rows)
    e.persist_and_snapshot_branch("c")
    e.write_data("c", "app", "cust", deletes=rows.filter("c_nationkey = 3").orderBy("c_custkey").limit(1).select("c_nationkey", "c_custkey"))
    e.persist_and_snapshot_branch("c")
    before, after = ({p["path"] for p in s["parts"]} for s in e._open("c")["snapshots"])
    return spark.createDataFrame([(len(after), len(after & before), len(after - before))], "parts int, carried int, written int")


@query("L6_compact", f"SELECT * FROM (VALUES ('persisted', 0, 6, 6, 0, 0, 5), ('compacted', 6, 6, 2, 0, 6, 5)) {_COLUMNS_OF_STEPS}")
def compact(spark, sf_dir):
    """Six log segments, of deletes and upserts of three commits, become one of each kind."""
    e = _engine(spark)
    for span in ((0, 400), (400, 800), (800, 10**12)):
        _load(e, spark, sf_dir, (span,))
        e.persist("c", _key(e))
    return _steps(spark, e, (("persisted", lambda: 0), ("compacted", lambda: e.compact("c", _key(e)))))


@query("L7_purge", f"SELECT * FROM (VALUES ('persisted', 1, 6, 2, 0, 0, 5), ('purged early', 0, 6, 2, 0, 0, 5), ('snapshotted', 1, 6, 2, 1, 0, 5), ('purged', 6, 0, 2, 1, 6, 5)) {_COLUMNS_OF_STEPS}")
def purge(spark, sf_dir):
    """Hot files go once a stored snapshot covers them, and not before."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    purged = lambda: e.purge("c", _key(e))
    return _steps(spark, e, (("persisted", lambda: e.persist_branch("c")), ("purged early", purged), ("snapshotted", lambda: e.snapshot_branch("c")), ("purged", purged)))


@query("L8_purge_tx_log", f"SELECT * FROM (VALUES ('open', 0, 6, 0, 0, 0, 6), ('aborted', 1, 6, 0, 0, 0, 5), ('purged', 6, 0, 2, 1, 6, 5), ('transactions', 3, 0, 2, 1, 6, 2)) {_COLUMNS_OF_STEPS}")
def purge_tx_log(spark, sf_dir):
    """Transactions without effect go at once, those with rows when these are persisted and their hot files gone; definitions keep theirs."""
    e = _engine(spark)
    _load(e, spark, sf_dir)
    tx = e.begin("c")

    def aborted():
        e.abort("c", tx)
        return e.purge_tx_log("c")

    def purged():
        e.persist_and_snapshot_branch("c")
        return e.purge("c", _key(e))

    return _steps(spark, e, (("open", lambda: 0), ("aborted", aborted), ("purged", purged), ("transactions", lambda: e.purge_tx_log("c"))))


@query("L9_retire_and_sweep", f"SELECT * FROM (VALUES ('snapshotted', 3, 0, 6, 3, 6, 5), ('retired', 1, 0, 6, 2, 7, 5), ('within grace', 0, 0, 6, 2, 7, 5), ('swept', 7, 0, 6, 2, 0, 5)) {_COLUMNS_OF_STEPS}")
def retire_and_sweep(spark, sf_dir):
    """Of three snapshots within an hour the first is a rung and the last is the newest; the one between is retired, and its files are deleted."""
    e = _engine(spark, snapshot_density_seconds=3600)
    for span in ((0, 400), (400, 800), (800, 10**12)):
        _load(e, spark, sf_dir, (span,))
        e.persist_and_snapshot_branch("c")
        e.purge("c", _key(e))
    return _steps(spark, e, (("snapshotted", lambda: 3), ("retired", lambda: e.retire_snapshots("c", _key(e))), ("within grace", lambda: e.sweep("c", grace_seconds=3600)), ("swept", lambda: e.sweep("c"))))


@query("L11_tick_report", "SELECT * FROM (VALUES ('compacted', 0, 0, 6), ('persisted', 1, 1, 1), ('purged', 2, 2, 2), ('retired', 0, 0, 1), ('snapshotted', 1, 1, 1), ('swept', 2, 2, 9), ('transactions', 1, 1, 1)) t(what, first, second, third)")
def tick_report(spark, sf_dir):
    """What three rounds of the scheduler do, each behind a commit, with compaction from three segments on."""
    e, rounds = _engine(spark, snapshot_density_seconds=3600), []
    for span in ((0, 400), (400, 800), (800, 10**12)):
        _load(e, spark, sf_dir, (span,))
        rounds.append(e.tick("c", most_segments=2))
    return spark.createDataFrame([(what, *(r[what] for r in rounds)) for what in sorted(rounds[0])], "what string, first int, second int, third int")


@query("L5_durable_rungs", "SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, TRUE), (4, TRUE)) t(ask, durable)")
def durable_rungs(spark, sf_dir):
    asks = ((None, 100, 60), (0, 59_999_999, 60), (0, 60_000_000, 60), (5, 6, None))
    return spark.createDataFrame([(i + 1, Engine.is_durable(*a)) for i, a in enumerate(asks)], "ask int, durable boolean")


@query("L10_branch_wide", "SELECT 2 AS persisted, 2 AS snapshotted, 0 AS modified_after")
def branch_wide(spark, sf_dir):
    e = _engine(spark)
    e.create_table("c", "app", "more", [("k", "int64")], ["k"])
    _load(e, spark, sf_dir, ((0, 10**12),))
    e.write_data("c", "app", "more", upserts=spark.range(5).toDF("k"))
    persisted, snapshotted = e.persist_and_snapshot_branch("c")
    return spark.createDataFrame([(persisted, snapshotted, len(e.list_modified_tables("c")))], "persisted int, snapshotted int, modified_after int")


@query("L11_scheduler_tick", _STATE)
def scheduler_tick(spark, sf_dir):
    e = _engine(spark)
    for span in ((0, 400), (400, 800), (800, 10**12)):
        _load(e, spark, sf_dir, (span,))
        e.tick("c")
    return _read(e)


@query("L13_stored_index", f"SELECT user_id, event_type, value FROM ({_STATE}) t WHERE event_type IN ('click', 'view')")
def stored_index(spark, sf_dir):
    e = _engine(spark, indexes={"by_type": ["event_type", "value"]})
    _load(e, spark, sf_dir, ((0, 800),))
    e.persist_and_snapshot_branch("c")
    _load(e, spark, sf_dir, ((800, 10**12),))
    return _read(e, seek={"by_type": {"event_type": ["click", "view"]}})


@query("B11_streamed_feed", "SELECT count(*) AS n FROM events WHERE event_type <> 'error' AND event_id > 300")
def streamed_feed(spark, sf_dir):
    """The change feed as a stream over log files, delivered once and run to its end."""
    up, _ = events_log(spark, sf_dir)
    root = _root(spark)
    up.write.parquet(f"{root}/log")
    query_ = feed.deliver(feed.changes(spark, f"{root}/log", up.schema, since=300), f"{root}/state", lambda batch, _: batch.write.mode("append").parquet(f"{root}/out"))
    query_.awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count("*").alias("n"))
