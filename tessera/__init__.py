"""tessera: a relational analytics engine expressed in PySpark DataFrames."""

from .session import Engine, show

__all__ = ["Engine", "show"]
