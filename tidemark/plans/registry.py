"""The registered queries of the engine, one or more per inventory id, each with the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its inventory id; sql gives the same rows in DuckDB."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROOTS: list[str] = []


def scratch_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder of the cluster (spark.checkpoint.dir); in a temporary one only on a single machine
    where that is unset. It goes when the driver's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "tidemark-scratch")
    _ROOTS.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _ROOTS[-1]


@atexit.register
def _delete_roots() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for root in _ROOTS:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs SQL over the tables of a folder that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def sql_query(name: str, text: str, other: str | None = None) -> None:
    """Registers a query that is SQL text here too; `other` is DuckDB's wording where that differs."""
    query(name, text if other is None else other)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from tidemark.plans import functions, relational, store, versioned  # noqa: F401
