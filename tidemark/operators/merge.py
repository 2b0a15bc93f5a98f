"""Merge-on-read: from upsert and delete logs to the visible rows of a versioned table.

All functions take and return DataFrames and do no I/O. A log row carries its primary key, `commit_seq_num`,
`write_seq_num` and, where it matters, `commit_micros` and `tx_uuid`. One total order, (commit_seq_num, write_seq_num,
upsert before delete), decides which version of a key is the latest.

The user's filter comes after the merge: Catalyst pushes it below the window only if it is on the primary key, where it can
neither hide a newer version nor change the set of touched keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ, WRITE, MICROS, TX = "commit_seq_num", "write_seq_num", "commit_micros", "tx_uuid"
DELETED = "is_delete"
#: The order of rows that an open transaction has written itself: after every commit.
OWN_SEQ = 2**63 - 1


@dataclass(frozen=True)
class Snapshot:
    """What a read may see: rows up to a time, up to a commit, or before a transaction began and its own."""

    micros: int | None = None
    seq: int | None = None
    began_seq: int | None = None
    tx_uuid: str | None = None

    @staticmethod
    def as_of_micros(micros: int) -> Snapshot:
        return Snapshot(micros=micros)

    @staticmethod
    def as_of_seq(seq: int) -> Snapshot:
        return Snapshot(seq=seq)

    @staticmethod
    def open_tx(began_seq: int, tx_uuid: str) -> Snapshot:
        return Snapshot(began_seq=began_seq, tx_uuid=tx_uuid)

    def clause(self) -> Column:
        if self.tx_uuid is not None:
            return (F.col(SEQ) < self.began_seq) | (F.col(TX) == self.tx_uuid)
        if self.micros is not None:
            return F.col(MICROS) <= self.micros
        return F.col(SEQ) <= self.seq


def visible(log: DataFrame, snapshot: Snapshot | None) -> DataFrame:
    """The log rows a snapshot sees. Rows of the open transaction itself get the highest commit number, so they win."""
    if snapshot is None:
        return log
    seen = log.filter(snapshot.clause())
    if snapshot.tx_uuid is not None:
        own = F.when(F.col(TX) == snapshot.tx_uuid, F.lit(OWN_SEQ)).otherwise(F.col(SEQ))
        seen = seen.withColumn(SEQ, own)
    return seen


def capped(log: DataFrame, ceiling: int) -> DataFrame:
    """The rows of a referenced source up to its ceiling, such as a parent's up to the fork."""
    return log.filter(F.col(SEQ) <= ceiling)


def with_commits(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Log rows of committed transactions with the commit's number and times (rows hold tx_uuid only)."""
    return log.drop(SEQ, MICROS, "began_at_micros").join(commits.select(TX, SEQ, MICROS, "began_at_micros"), TX)


def latest(log: DataFrame, pk: Sequence[str], order: Sequence[str] = (SEQ, WRITE)) -> DataFrame:
    """The last row of each key. row_number() = 1 lets Spark drop all but one row a key in each task before the shuffle."""
    w = Window.partitionBy(*pk).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def at_or_after(left: Sequence[str], right: Sequence[str], strict: bool = False) -> Column:
    """(left) >= (right) in lexicographic order; > if strict."""
    a, b = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(left))), F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(right)))
    return a > b if strict else a >= b


def shadowed(upserts: DataFrame, deletes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Two arms: the last upserts that no later delete of their key shadows (an upsert wins a tie), as live rows, and the
    deletes that win, as tombstones. The same rows as `resolve`, by three shuffles instead of one."""
    up, down = latest(upserts, pk), latest(deletes, pk).select(*pk, F.col(SEQ).alias("_ds"), F.col(WRITE).alias("_dw"))
    up = up.join(down, list(pk), "left").filter(F.col("_ds").isNull() | at_or_after((SEQ, WRITE), ("_ds", "_dw"))).drop("_ds", "_dw")
    last = latest(upserts, pk).select(*pk, F.col(SEQ).alias("_us"), F.col(WRITE).alias("_uw"))
    dead = latest(deletes, pk).join(last, list(pk), "left").filter(F.col("_us").isNull() | at_or_after((SEQ, WRITE), ("_us", "_uw"), strict=True)).drop("_us", "_uw")
    return up.withColumn(DELETED, F.lit(False)).unionByName(dead.withColumn(DELETED, F.lit(True)), allowMissingColumns=True)


def resolve(upserts: DataFrame, deletes: DataFrame | None, pk: Sequence[str], snapshot: Snapshot | None = None) -> DataFrame:
    """The winning row of every touched key, live (is_delete false) or a tombstone, in one shuffle."""
    log = visible(upserts, snapshot).withColumn(DELETED, F.lit(False))
    if deletes is not None:
        gone = visible(deletes, snapshot).withColumn(DELETED, F.lit(True))
        log = log.unionByName(gone, allowMissingColumns=True)
    w = Window.partitionBy(*pk).orderBy(F.col(SEQ).desc(), F.col(WRITE).desc(), F.col(DELETED).asc())
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def live(delta: DataFrame) -> DataFrame:
    return delta.filter(~F.col(DELETED)).drop(DELETED)


def cross_tier(tiers: Sequence[DataFrame], pk: Sequence[str]) -> DataFrame:
    """One winner a key over resolved tiers."""
    return latest(union(tiers), pk, (SEQ, WRITE))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def touched(delta: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Every key the delta decides, live or dead, whatever the user filters."""
    return delta.select(*pk)


def over_snapshot(base: DataFrame, delta: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Rows of a stored snapshot that the delta doesn't touch, and the delta's live rows."""
    kept = base.join(touched(delta, pk), list(pk), "left_anti")
    columns = base.columns
    return kept.unionByName(live(delta).select(*columns))


def restricted(source: DataFrame, ids: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The rows of a source with one of the given keys; goes below the merge, on every source."""
    return source.join(ids, list(pk), "left_semi")


def checked_ids(ids: DataFrame, table: DataFrame, pk: Sequence[str]) -> DataFrame:
    """A batch of primary keys for a point read: the key columns exactly, in order, of their types, some rows, no nulls."""
    want = [(c, table.schema[c].dataType) for c in pk]
    if [(f.name, f.dataType) for f in ids.schema.fields] != want:
        raise ValueError(f"ids must have the columns {[(n, t.simpleString()) for n, t in want]}, got {ids.dtypes}")
    nulls = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in pk))
    figures = ids.agg(F.count("*").alias("n"), F.count(F.when(nulls, 1)).alias("nulls")).first()
    if not figures["n"]:
        raise ValueError("ids has no rows")
    if figures["nulls"]:
        raise ValueError("ids holds a null key")
    return ids.distinct()


def read(
    upserts: DataFrame,
    deletes: DataFrame | None,
    pk: Sequence[str],
    *,
    snapshot: Snapshot | None = None,
    base: DataFrame | None = None,
    ids: DataFrame | None = None,
    where: str | Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Visible rows: logs resolved as of the snapshot, over a stored snapshot if there is one, then filtered and projected.

    columns: None for all, an empty list for rows without columns, or a list in the order wanted.
    """
    if ids is not None:
        upserts, deletes, base = (s if s is None else restricted(s, ids, pk) for s in (upserts, deletes, base))
    delta = resolve(upserts, deletes, pk, snapshot)
    out = live(delta) if base is None else over_snapshot(base, delta, pk)
    if where is not None:
        out = out.filter(where)
    return out if columns is None else out.select(*columns)


def forked(parent: DataFrame, child: DataFrame, fork_seq: int) -> DataFrame:
    """The log a branch sees: its parent's up to the fork, and its own."""
    return capped(parent, fork_seq).unionByName(child, allowMissingColumns=True)


def merged(upserts: DataFrame, deletes: DataFrame, pk: Sequence[str], fork_seq: int, seq: int, micros: int) -> DataFrame:
    """A branch's changes since its fork as the rows of one commit on its parent: one winner a key, numbered by key order of
    deletes before upserts."""
    since = F.col(SEQ) > fork_seq
    won = resolve(upserts.filter(since), deletes.filter(since), pk)
    return won.withColumn(SEQ, F.lit(seq).cast("long")).withColumn(MICROS, F.lit(micros).cast("long")).withColumn(WRITE, F.when(F.col(DELETED), F.lit(0)).otherwise(F.lit(1)).cast("long"))
