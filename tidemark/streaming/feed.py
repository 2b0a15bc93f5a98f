"""The change feed as a stream: log files of a table as they arrive.

Latest-wins needs no state here: every row carries its place in the order, so rows may arrive in any order and the merge of
what has arrived is always right.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import SEQ


def changes(spark: SparkSession, path: str, schema: T.StructType, *, since: int = -1, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the log rows in the files below path, behind a commit."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).filter(F.col(SEQ) > since)


def deliver(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch of what is there to a sink, remembering what it has delivered, and stops."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
