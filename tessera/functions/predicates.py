"""Comparison operators and predicates as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError, ParseError


class Op(Enum):
    EQ, NE, GT, GE, LT, LE, LIKE = "=", "<>", ">", ">=", "<", "<=", "LIKE"

    @classmethod
    def parse(cls, text: str) -> Op:
        """The operator of a token; != is <>, ~ is LIKE."""
        try:
            return _SPELLED[text.upper()]
        except KeyError:
            raise ParseError(f"unknown operator {text!r}") from None

    def mirror(self) -> Op:
        """The operator with its sides exchanged: 5 < x is x > 5."""
        return _MIRROR.get(self, self)

    def apply(self, left: Column, right: Column, textual: bool = True) -> Column:
        """LIKE holds if the left string contains the right one, case and all; between numbers it is equality."""
        if self is Op.LIKE:
            return left.contains(right) if textual else left == right
        return _APPLY[self](left, right)


_SPELLED = {o.value: o for o in Op} | {"!=": Op.NE, "~": Op.LIKE}
_MIRROR = {Op.GT: Op.LT, Op.LT: Op.GT, Op.GE: Op.LE, Op.LE: Op.GE}
_APPLY = {
    Op.EQ: lambda a, b: a == b,
    Op.NE: lambda a, b: a != b,
    Op.GT: lambda a, b: a > b,
    Op.GE: lambda a, b: a >= b,
    Op.LT: lambda a, b: a < b,
    Op.LE: lambda a, b: a <= b,
}


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Predicate:
    """column op constant."""

    column: str
    op: Op
    value: int | str | float

    def on(self, dtype: str | None = None) -> Column:
        """The condition; a string never meets a number (dtype is the column's type if known)."""
        textual = isinstance(self.value, str)
        if dtype is not None and (dtype == "string") != textual and dtype not in ("timestamp_ntz", "timestamp", "date"):
            raise AnalysisError(f"{self.column} is {dtype}; {self.value!r} is not")
        return self.op.apply(named(self.column), F.lit(self.value), textual)


@dataclass(frozen=True)
class JoinPredicate:
    """left column op right column."""

    left: str
    op: Op
    right: str

    def on(self, textual: bool = False) -> Column:
        return self.op.apply(named(self.left), named(self.right), textual)
