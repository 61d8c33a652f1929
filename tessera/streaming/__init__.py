"""Running aggregates: results that can be read after any prefix of the input."""

from .running import running_aggregate, running_by_row

__all__ = ["running_aggregate", "running_by_row"]
