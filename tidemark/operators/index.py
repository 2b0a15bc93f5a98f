"""Secondary indexes: sorted sidecars of a snapshot and seeks through them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probes that a seek over several columns may expand to.
MOST_PROBES = 1024


def build(snapshot: DataFrame, columns: Sequence[str], pk: Sequence[str], partitions: int | None = None) -> DataFrame:
    """The key columns of an index and the primary key, range-partitioned and sorted by the index, nulls last. Written as Parquet,
    its row groups hold narrow ranges, so a seek reads few of them."""
    order = [F.col(c).asc_nulls_last() for c in columns]
    rows = snapshot.select(*dict.fromkeys([*columns, *pk]))
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    return rows.sortWithinPartitions(*order, *pk)


def checked_probe(columns: Sequence[str], probe: Mapping[str, Sequence]) -> list[str]:
    """The leading columns that a probe names; any other column, or too many combinations, is an error."""
    for c in probe:
        if c not in columns:
            raise ValueError(f"{c} isn't a column of the index {list(columns)}")
    leading = []
    for c in columns:
        if c not in probe:
            break
        leading.append(c)
    if len(leading) != len(probe) or not leading:
        raise ValueError(f"a seek names leading columns of {list(columns)}, got {list(probe)}")
    size = reduce(lambda n, c: n * len(probe[c]), leading, 1)
    if size > MOST_PROBES:
        raise ValueError(f"a seek may expand to {MOST_PROBES} probes, this one to {size}")
    return leading


def probes(columns: Sequence[str], probe: Mapping[str, Sequence]) -> list[tuple]:
    leading = checked_probe(columns, probe)
    return list(product(*(probe[c] for c in leading)))


def seek(sidecar: DataFrame, columns: Sequence[str], pk: Sequence[str], probe: Mapping[str, Sequence]) -> DataFrame:
    """Primary keys of the rows that match an exact key or a leading prefix."""
    leading = checked_probe(columns, probe)
    match = reduce(lambda a, b: a & b, (F.col(c).isin(list(probe[c])) for c in leading))
    return sidecar.filter(match).select(*pk)


def intersect(found: Sequence[DataFrame], pk: Sequence[str]) -> DataFrame:
    """Keys that every one of several seeks has found."""
    return reduce(lambda a, b: a.join(b, list(pk), "left_semi"), found)
