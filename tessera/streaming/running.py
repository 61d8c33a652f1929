"""Incremental aggregation: a streaming query whose state merges each batch, and the same by row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import AnalysisError
from ..functions.predicates import named
from ..operators import aggregate


def running_aggregate(stream: DataFrame, op: str, column: str, group: str | None, name: str) -> StreamingQuery:
    """Start a query that keeps one aggregate of a stream up to date in the in-memory table ``name``.

    The state is one partial aggregate a group; each micro-batch merges into it.
    """
    if not stream.isStreaming:
        raise AnalysisError("running_aggregate takes a stream; use aggregate for a table")
    return aggregate(stream, op, column, group).writeStream.outputMode("complete").format("memory").queryName(name).start()


def running_by_row(df: DataFrame, op: str, column: str, group: str, order: str) -> DataFrame:
    """Each row with the aggregate of its group over the rows up to it in the given order."""
    w = Window.partitionBy(named(group)).orderBy(named(order)).rowsBetween(Window.unboundedPreceding, 0)
    f = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "count": F.count}[op.lower()]
    value = f(named(column)).over(w)
    if op.lower() == "avg":
        value = value.cast("int")
    return df.withColumn(f"{op.lower()}({column})", value)
