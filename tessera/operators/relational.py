"""Scan, filter, project, join, aggregate and order, with the naming rules of the dialect.

Columns of a scan under an alias are called ``alias.column``; aggregates are called ``op(column)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions.predicates import JoinPredicate, Op, Predicate, named
from ..types import same_type_vector

#: Join strategies and the hint that asks Catalyst for them; None leaves the choice to it.
STRATEGIES = {
    "auto": None,
    "broadcast_hash": "broadcast",
    "hash": "shuffle_hash",
    "sort_merge": "merge",
    "nested_loop": "shuffle_replicate_nl",
}
AGGREGATES = ("min", "max", "sum", "avg", "count")


def scan(df: DataFrame, alias: str | None = None) -> DataFrame:
    """All rows of a table; with an alias, columns are called alias.column."""
    return df if alias is None else df.toDF(*[f"{alias}.{c}" for c in df.columns])


def relation(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """An in-memory relation; every row must have the schema's types."""
    rows = list(rows)
    for r in rows:
        if len(r) != len(schema):
            raise AnalysisError(f"{r!r} does not fit {schema.simpleString()}")
        for v, f in zip(r, schema):
            if v is not None and isinstance(v, str) != isinstance(f.dataType, T.StringType):
                raise AnalysisError(f"{v!r} is no {f.dataType.simpleString()}")
    return spark.createDataFrame(rows, schema)


def filter_rows(df: DataFrame, *predicates: Predicate) -> DataFrame:
    """Rows for which all predicates hold."""
    types = dict(df.dtypes)
    for p in predicates:
        if p.column not in types:
            raise AnalysisError(f"no field {p.column!r}")
        df = df.where(p.on(types[p.column]))
    return df


def project(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """The columns in this order; a column may be repeated (then give names to tell them apart)."""
    for c in columns:
        if c not in df.columns:
            raise AnalysisError(f"no field {c!r}")
    out = df.select(*[named(c) for c in columns])
    return out.toDF(*names) if names else out


def limit_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df under the names of a schema of the same type vector."""
    if not same_type_vector(df.schema, schema):
        raise AnalysisError(f"{df.schema.simpleString()} does not fit {schema.simpleString()}")
    return df.toDF(*schema.names)


def join(
    left: DataFrame, right: DataFrame, *predicates: JoinPredicate, strategy: str = "auto", extra: Column | None = None
) -> DataFrame:
    """Inner join on all predicates, equal or not; left columns, then right columns.

    Equality goes by hash or merge; a join without one is a nested loop, broadcast if Catalyst finds a side
    small enough and partitioned pairwise otherwise.
    """
    if not predicates:
        raise AnalysisError("a join needs a predicate")
    twice = set(left.columns) & set(right.columns)
    if twice:
        raise AnalysisError(f"both sides have {sorted(twice)}; scan them under aliases")
    lt, rt = dict(left.dtypes), dict(right.dtypes)
    cond: Column | None = None
    for p in predicates:
        if p.left not in lt or p.right not in rt:
            raise AnalysisError(f"no field {p.left!r} on the left or {p.right!r} on the right")
        if (lt[p.left] == "string") != (rt[p.right] == "string"):
            raise AnalysisError(f"{p.left} is {lt[p.left]}, {p.right} is {rt[p.right]}")
        c = p.on(lt[p.left] == "string")
        cond = c if cond is None else cond & c
    if extra is not None:
        cond = cond & extra
    hint = STRATEGIES[strategy]
    return left.join(right.hint(hint) if hint else right, cond, "inner")


def cross_checked_join(parts: Sequence[DataFrame], predicates: Sequence[JoinPredicate]) -> DataFrame:
    """N-way left-deep join in the given order; each table must be joined to an earlier one.

    Predicates between tables that are joined already become further conditions.
    """
    out, open_ = parts[0], list(predicates)
    for p in parts[1:]:
        here = []
        for q in list(open_):
            if q.left in out.columns and q.right in p.columns:
                here.append(q)
                open_.remove(q)
            elif q.right in out.columns and q.left in p.columns:
                here.append(JoinPredicate(q.right, q.op.mirror(), q.left))
                open_.remove(q)
        if not here:
            raise AnalysisError("Query does not include join expressions joining all nodes!")
        out = join(out, p, *here)
    if open_:
        raise AnalysisError(f"unknown columns in {open_}")
    return out


def subquery_join(left: DataFrame, column: str, op: Op, subquery: DataFrame, name: str = "subquery") -> DataFrame:
    """Join with the first column of a subquery, as an inner join: its duplicates multiply."""
    return join(left, scan(subquery, name), JoinPredicate(column, op, f"{name}.{subquery.columns[0]}"))


def aggregate(df: DataFrame, op: str, column: str, group: str | None = None, compat: bool = True) -> DataFrame:
    """One aggregate over a column, grouped by at most one.

    Sums and counts are 64-bit.  In compat mode an average of integers is cut towards zero to an int, and an
    average of nothing is null.  Strings can only be counted.  The result is called op(column).
    """
    op = op.lower()
    types = dict(df.dtypes)
    if op not in AGGREGATES:
        raise AnalysisError(f"unknown aggregate {op!r}")
    star = column == "*"
    if star and op != "count":
        raise AnalysisError(f"{op}(*) makes no sense")
    if not star and column not in types:
        raise AnalysisError(f"no field {column!r}")
    if group is not None and group not in types:
        raise AnalysisError(f"no field {group!r}")
    if not star and types[column] == "string" and op != "count":
        raise AnalysisError(f"strings can only be counted, not {op}")
    c = F.lit(1) if star else named(column)
    whole = not star and types[column] in ("tinyint", "smallint", "int", "bigint")
    value = {
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "sum": lambda: F.sum(c).cast("bigint") if whole else F.sum(c),
        "avg": lambda: F.avg(c).cast("int") if whole and compat else F.avg(c),
        "count": lambda: F.count(c).cast("bigint"),
    }[op]()
    value = value.alias(f"{op}({column})")
    return df.agg(value) if group is None else df.groupBy(named(group)).agg(value)


def partial_average(df: DataFrame, column: str, group: str, parts: Column, compat: bool = True) -> DataFrame:
    """A distributed average in the open: sum and count by (group, part), then combined by group."""
    c = named(column)
    part = df.groupBy(named(group), parts.alias("_part")).agg(F.sum(c).cast("bigint").alias("_sum"), F.count(c).alias("_count"))
    total = F.sum("_sum") / F.sum("_count")
    return part.groupBy(named(group)).agg((total.cast("int") if compat else total).alias(f"avg({column})"))


def order_by(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows in the order of one column."""
    if column not in df.columns:
        raise AnalysisError(f"no field {column!r}")
    return df.orderBy(named(column).asc() if ascending else named(column).desc())
