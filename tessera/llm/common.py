"""Shared plumbing of the training-data operators: tables, shared work folder, text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from ..sources.scratch import new_folder

#: Rows that a Python kernel turns into Python strings at once.
SLICE_ROWS = 256
#: Bytes of text that a Python kernel turns into Python strings at once; a longer row comes alone.
SLICE_BYTES = 8 << 20
#: Keys with more than one row in so many are hot; by counting there are fewer than that of them.
HOT_PARTS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark itself so that any Hadoop store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The files are removed when the driver exits.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, per: DataFrame, key: str, spread: str, label: str) -> DataFrame:
    """rows joined with per, one row a key, whose column n counts the rows of the key (n stays).

    No task gets much more than one part in HOT_PARTS of the rows for a single key: the rows of a hot key are dealt by a
    hash of ``spread`` over as many parts as it needs, and its row of per is repeated for each, fewer than 2 * HOT_PARTS in all.
    """
    per = materialize(per, label)
    total = per.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("n") * HOT_PARTS / F.lit(max(1, total))).cast("long")
    hot = per.where(F.col("n") * HOT_PARTS > total).select(key, parts.alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")), F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    per = per.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1).cast("long")) - 1)))
    return rows.join(per, [key, "_part"]).drop("_part")


def byte_slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and bytes of strings; a longer row makes a slice of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        done = total[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(total, done + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list[list]], list[tuple]]],
    schema: T.StructType,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Run a batch kernel over df through Arrow.

    ``make`` is called once a task and returns the kernel; the kernel gets the input columns as lists
    (at most ``slice_rows`` rows and ``SLICE_BYTES`` bytes of strings, a longer row alone) and returns output rows as tuples in schema order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in byte_slices(batch, slice_rows):
                rows = kernel([c.to_pylist() for c in part.columns])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow_schema)], schema=arrow_schema
                    )

    return df.mapInArrow(run, schema)


def texts(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that clashing or extra columns never reach a kernel."""
    return df.select(*[F.col(c) for c in cols])
