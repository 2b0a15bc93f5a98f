"""INSERT, UPDATE and DELETE as log rows: from the visible rows of a table to the upserts and deletes of one change."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyCollision(ValueError):
    """An insert or a key-changing update meets an existing or a repeated primary key."""


def _column(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def repeated_keys(rows: DataFrame, pk: Sequence[str]) -> DataFrame:
    return rows.groupBy(*pk).agg(F.count("*").alias("n")).filter("n > 1").select(*pk)


def check_batch(rows: DataFrame, pk: Sequence[str]) -> None:
    """A batch of upserts or deletes has no null and no repeated key."""
    for c in pk:
        if rows.filter(F.col(c).isNull()).take(1):
            raise ValueError(f"primary key column {c} holds a null")
    if repeated_keys(rows, pk).take(1):
        raise KeyCollision(f"a batch repeats a primary key {list(pk)}")


def collisions(current: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The new rows whose key exists."""
    return new.join(current.select(*pk), list(pk), "left_semi")


def insert(current: DataFrame, new: DataFrame, pk: Sequence[str], *, on_conflict: str | None = None) -> DataFrame:
    """Upserts of an INSERT. on_conflict: None is strict, "update" overwrites whole rows; "nothing" isn't supported."""
    if on_conflict not in (None, "update"):
        raise NotImplementedError("ON CONFLICT DO NOTHING isn't supported")
    if set(new.columns) != set(current.columns):
        raise NotImplementedError("an INSERT names all columns of its table")
    new = new.select(*current.columns)
    check_batch(new, pk)
    if on_conflict is None and collisions(current, new, pk).take(1):
        raise KeyCollision(f"an inserted primary key {list(pk)} exists")
    return new


def update(current: DataFrame, pk: Sequence[str], where: str | Column | None, sets: Mapping[str, str | Column], *, check: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Deletes (where a key changes) and upserts of an UPDATE. All SET expressions see the rows as they were.

    Keys that the statement vacates are free for its own rows, so swaps and shifts are legal.
    """
    for c in sets:
        if c not in current.columns:
            raise ValueError(f"no column {c}")
    hit = current if where is None else current.filter(_column(where))
    new = hit.select(*(_column(sets[c]).cast(current.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in current.columns))
    if not set(pk) & set(sets):
        return None, new
    vacated = hit.select(*pk)
    if check:
        check_batch(new, pk)
        staying = current.join(vacated, list(pk), "left_anti")
        if collisions(staying, new, pk).take(1):
            raise KeyCollision(f"an updated primary key {list(pk)} exists")
    return vacated, new


def delete(current: DataFrame, pk: Sequence[str], where: str | Column | None) -> DataFrame:
    """Keys of the tombstones of a DELETE."""
    hit = current if where is None else current.filter(_column(where))
    return hit.select(*pk)


def applied(current: DataFrame, pk: Sequence[str], upserts: DataFrame | None, deletes: DataFrame | None) -> DataFrame:
    """The rows after a change: its deletes go first, so an upsert of the same key stays."""
    keys = [c.select(*pk) for c in (upserts, deletes) if c is not None]
    for k in keys:
        current = current.join(k, list(pk), "left_anti")
    return current if upserts is None else current.unionByName(upserts.select(*current.columns))
