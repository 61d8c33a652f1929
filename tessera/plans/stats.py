"""Table statistics, equi-width histograms and selectivity estimates."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Op, named
from ..types import kind_of

BUCKETS = 100
IO_COST_PER_PAGE = 1000
PAGE_BYTES = 4096
#: Selectivity assumed of a substring match.
LIKE_SELECTIVITY = 0.1


@dataclass
class IntHistogram:
    """Equal-width buckets over [low, high] with their counts."""

    buckets: int
    low: int
    high: int
    counts: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.counts = self.counts or [0] * self.buckets
        self.width = max(1, math.ceil((self.high - self.low + 1) / self.buckets))

    @property
    def total(self) -> int:
        return sum(self.counts)

    def bucket(self, v: int) -> int:
        return min(self.buckets - 1, (v - self.low) // self.width)

    def add(self, v: int, n: int = 1) -> None:
        if not self.low <= v <= self.high:
            raise ValueError(f"{v} is outside [{self.low}, {self.high}]")
        self.counts[self.bucket(v)] += n

    def _span(self, b: int) -> tuple[int, int]:
        """First value and number of values of a bucket."""
        first = self.low + b * self.width
        return first, max(1, min(self.width, self.high - first + 1))

    def _below(self, v: int) -> float:
        if v <= self.low or not self.total:
            return 0.0
        if v > self.high:
            return 1.0
        b = self.bucket(v)
        first, width = self._span(b)
        return (sum(self.counts[:b]) + self.counts[b] * (v - first) / width) / self.total

    def _equal(self, v: int) -> float:
        if not self.low <= v <= self.high or not self.total:
            return 0.0
        b = self.bucket(v)
        return self.counts[b] / self._span(b)[1] / self.total

    def selectivity(self, op: Op, v: int) -> float:
        """Estimated share of rows for which ``value op v`` holds."""
        below, equal = self._below(v), self._equal(v)
        share = {
            Op.EQ: equal, Op.LIKE: equal, Op.NE: 1 - equal, Op.LT: below, Op.LE: below + equal,
            Op.GT: 1 - below - equal, Op.GE: 1 - below,
        }[op]
        return min(1.0, max(0.0, share))


def string_key(s: str) -> int:
    """The first four characters as one integer, within that of "zzzz"."""
    v = 0
    for k in range(4):
        v = v * 256 + (min(ord(s[k]), 255) if k < len(s) else 0)
    return min(v, _TOP)


_TOP = 0x7A7A7A7A


def string_key_column(name: str):
    """string_key as a column."""
    c = named(name)
    v = F.lit(0).cast("bigint")
    for k in range(4):
        one = F.substring(c, k + 1, 1)
        v = v * 256 + F.when(F.length(one) > 0, F.least(F.ascii(one), F.lit(255))).otherwise(0)
    return F.least(v, F.lit(_TOP).cast("bigint"))


@dataclass
class StringHistogram:
    """A histogram over string_key."""

    buckets: int
    inner: IntHistogram = None

    def __post_init__(self):
        self.inner = self.inner or IntHistogram(self.buckets, 0, _TOP)

    def add(self, s: str, n: int = 1) -> None:
        self.inner.add(string_key(s), n)

    def selectivity(self, op: Op, s: str) -> float:
        return LIKE_SELECTIVITY if op is Op.LIKE else self.inner.selectivity(op, string_key(s))


def histogram(df: DataFrame, column: str, buckets: int, low: int, high: int) -> DataFrame:
    """(bucket, n) of an integer column, counted by Spark: one combined aggregate, at most ``buckets`` rows."""
    width = max(1, math.ceil((high - low + 1) / buckets))
    b = F.least(F.floor((named(column) - low) / width), F.lit(buckets - 1)).cast("bigint")
    return df.where(named(column).isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


class TableStats:
    """Row count, size and a histogram of each integer and string column: two passes over the table."""

    def __init__(self, df: DataFrame, io_cost_per_page: int = IO_COST_PER_PAGE, buckets: int = BUCKETS, primary_key: str | None = None):
        self.io_cost_per_page, self.primary_key = io_cost_per_page, primary_key
        kinds = {f.name: kind_of(f.dataType) for f in df.schema}
        ints = [c for c, k in kinds.items() if k == "int"]
        strings = [c for c, k in kinds.items() if k == "string"]
        ends = [f(named(c)).alias(f"{n}_{i}") for i, c in enumerate(ints) for n, f in (("low", F.min), ("high", F.max))]
        sizes = [F.sum(F.octet_length(named(c))).alias(f"bytes_{i}") for i, c in enumerate(strings)]
        distinct = [F.approx_count_distinct(named(c)).alias(f"distinct_{i}") for i, c in enumerate(df.columns)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *ends, *sizes, *distinct).first()
        self.n_rows = row["n"]
        fixed = sum(8 if isinstance(f.dataType, (T.LongType, T.DoubleType)) else 4 for f in df.schema if kind_of(f.dataType) != "string")
        self.n_bytes = self.n_rows * fixed + sum(row[f"bytes_{i}"] or 0 for i in range(len(strings)))
        self.n_pages = math.ceil(self.n_bytes / PAGE_BYTES)
        self.distinct = {c: row[f"distinct_{i}"] for i, c in enumerate(df.columns)}
        self.low_high = {c: (row[f"low_{i}"], row[f"high_{i}"]) for i, c in enumerate(ints) if row[f"low_{i}"] is not None}
        self.histograms: dict[str, IntHistogram | StringHistogram] = {}
        # all columns' buckets in one pass: (column no., bucket) pairs
        bucketed = []
        for c, (low, high) in self.low_high.items():
            h = self.histograms[c] = IntHistogram(buckets, low, high)
            b = F.least(F.floor((named(c) - low) / h.width), F.lit(buckets - 1)).cast("bigint")
            bucketed.append(F.struct(F.lit(c).alias("c"), b.alias("b")))
        for c in strings:
            h = self.histograms[c] = StringHistogram(buckets)
            b = F.least(F.floor(string_key_column(c) / h.inner.width), F.lit(buckets - 1)).cast("bigint")
            bucketed.append(F.struct(F.lit(c).alias("c"), b.alias("b")))
        if bucketed and self.n_rows:
            counted = df.select(F.explode(F.array(*bucketed)).alias("x")).where("x.b is not null").groupBy("x.c", "x.b").count()
            for r in counted.collect():  # at most columns x buckets rows
                h = self.histograms[r["c"]]
                (h.inner if isinstance(h, StringHistogram) else h).counts[r["b"]] += r["count"]

    def scan_cost(self) -> float:
        return self.n_pages * self.io_cost_per_page

    def cardinality(self, selectivity: float) -> int:
        return int(self.n_rows * selectivity)

    def selectivity(self, column: str, op: Op, value: int | str) -> float:
        h = self.histograms.get(column)
        if op is Op.LIKE and isinstance(value, str):
            return LIKE_SELECTIVITY
        return h.selectivity(op, value) if h is not None and not isinstance(value, float) else 1.0

    def average_selectivity(self, column: str) -> float:
        """Expected selectivity of an equality with some value of the column."""
        return 1.0 / max(1, self.distinct.get(column, 1))
