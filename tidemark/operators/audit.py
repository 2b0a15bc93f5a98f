"""The history of a table: every committed version, without deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import MICROS, SEQ, WRITE, restricted


@dataclass(frozen=True)
class Range:
    """A half-open range [low, high) of commit numbers or commit times; None leaves an end open."""

    axis: str = SEQ
    low: int | None = None
    high: int | None = None

    def __post_init__(self):
        if self.axis not in (SEQ, MICROS):
            raise ValueError(f"a range is over {SEQ} or {MICROS}, not {self.axis}")

    def of(self, log: DataFrame) -> DataFrame:
        if self.low is not None:
            log = log.filter(F.col(self.axis) >= self.low)
        if self.high is not None:
            log = log.filter(F.col(self.axis) < self.high)
        return log


def history(log: DataFrame, commits: DataFrame | None, columns: Sequence[str], *, window: Range = Range(), ids: DataFrame | None = None, pk: Sequence[str] = (), metadata: bool = False) -> DataFrame:
    """Rows of a log with the given columns and the figures of their commits; with comment and author if asked for.

    Author and comment are stored once a commit and joined by its number.
    """
    log = window.of(log)
    if ids is not None:
        log = restricted(log, ids, pk)
    out = log.select(*columns, "began_at_micros", MICROS, WRITE, SEQ)
    if metadata:
        own = commits.select(SEQ, "comment", "author")
        out = out.join(own, SEQ, "left").select(*columns, "began_at_micros", MICROS, WRITE, "comment", "author", SEQ)
    return out


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(SEQ, WRITE)


def changes_since(upserts: DataFrame, deletes: DataFrame, seq: int, pk: Sequence[str]) -> DataFrame:
    """The change feed behind a cursor: every later upsert and delete, in no order, with its kind."""
    later = Range(low=seq + 1)
    up = later.of(upserts).withColumn("change", F.lit("upsert"))
    down = later.of(deletes).withColumn("change", F.lit("delete"))
    return up.unionByName(down, allowMissingColumns=True)


def max_commit_seq(commits: DataFrame) -> DataFrame:
    """The newest commit's number; -1 where there is none."""
    return commits.agg(F.coalesce(F.max(SEQ), F.lit(-1)).cast("long").alias("max_commit_seq_num"))


def check_floor(asked: int | None, floor: int | None) -> int | None:
    """The lower end of a history read: an explicit one below the retention floor is an error, none means the floor."""
    if floor is None:
        return asked
    if asked is None:
        return floor
    if asked < floor:
        raise ValueError(f"{asked} lies below the retention floor {floor}")
    return asked
