"""Key-clustered tables: range-partitioned, sorted Parquet, so that key ranges skip files and row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import Op, Predicate, named


def write_sorted(df: DataFrame, path: str, key: str, files: int | None = None, rows_per_group: int | None = None) -> None:
    """Bulk-load df in key order; equal keys stay together."""
    by = named(key)
    parts = df.repartitionByRange(files, by) if files else df.repartitionByRange(by)
    writer = parts.sortWithinPartitions(by).write.mode("overwrite")
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    writer.parquet(path)


def index_scan(spark: SparkSession, path: str, key: str, op: Op | None = None, value: int | str | None = None, ordered: bool = False) -> DataFrame:
    """Rows in a key range (all without op); in key order if asked for.

    The predicate reaches the Parquet reader, whose statistics skip files and row groups outside the range.
    """
    df = spark.read.parquet(path)
    if op is not None:
        df = df.where(Predicate(key, op, value).on(dict(df.dtypes)[key]))
    return df.orderBy(named(key)) if ordered else df


def is_sorted(spark: SparkSession, path: str, key: str) -> bool:
    """The clustering invariant: rows ascend inside every file, and no two files overlap in keys (but for a shared border).

    Each task reads its rows in file order and reports runs (file, first row, ends, whether ascending); rows are not shuffled.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.read.parquet(path)
    kind = dict(df.dtypes)[key]

    def run(frames):
        import pandas as pd

        for t in frames:
            for f, own in t.groupby("f", sort=False):
                yield pd.DataFrame(
                    {"f": [f], "at": [own["at"].iloc[0]], "lo": [own["k"].iloc[0]], "hi": [own["k"].iloc[-1]], "up": [bool(own["k"].is_monotonic_increasing)]}
                )

    rows = df.where(named(key).isNotNull()).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("at"), named(key).alias("k"))
    runs = rows.mapInPandas(run, f"f string, at long, lo {kind}, hi {kind}, up boolean")
    runs = runs.withColumn("prev", F.lag("hi").over(Window.partitionBy("f").orderBy("at")))  # a row a batch
    ends = runs.groupBy("f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.col("up") & F.coalesce(F.col("prev") <= F.col("lo"), F.lit(True))).alias("up"))
    before = F.max("hi").over(Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    return ends.select("up", "lo", before.alias("prev")).where("not up or prev > lo").isEmpty()
