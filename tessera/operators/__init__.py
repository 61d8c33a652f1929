"""Relational operators: thin functions over DataFrames; Catalyst does the rest."""

from .relational import (
    STRATEGIES,
    aggregate,
    cross_checked_join,
    filter_rows,
    join,
    limit_columns,
    order_by,
    partial_average,
    project,
    relation,
    scan,
    subquery_join,
)

__all__ = [
    "STRATEGIES", "aggregate", "cross_checked_join", "filter_rows", "join", "limit_columns", "order_by", "partial_average",
    "project", "relation", "scan", "subquery_join",
]
