"""Schema texts and the table catalog."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .errors import AnalysisError, SchemaError
from .types import schema_of

_LINE = re.compile(r"\s*(\w+)\s*\((.*)\)\s*$")


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: str | None = None


def parse_schema(text: str) -> list[TableSpec]:
    """Tables of a schema text: ``name (field type [pk], ...)`` a line; blank lines are skipped."""
    out = []
    for line in text.splitlines():
        if not line.strip():
            continue
        m = _LINE.match(line)
        if m is None:
            raise SchemaError(f"not a table: {line!r}")
        fields, key = [], None
        for part in m[2].split(","):
            words = part.split()
            if len(words) not in (2, 3) or len(words) == 3 and words[2].lower() != "pk":
                raise SchemaError(f"not a field: {part!r} in {line!r}")
            fields.append((words[0], words[1]))
            if len(words) == 3:
                key = words[0]
        out.append(TableSpec(m[1], schema_of(fields), key))
    return out


@dataclass
class _Entry:
    name: str
    load: Callable[[], DataFrame]
    primary_key: str | None
    schema: T.StructType | None  # looked up when it is asked for


class Catalog:
    """Tables by name; a name registered again means the latest."""

    def __init__(self):
        self._tables: dict[str, _Entry] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], primary_key: str | None = None, schema: T.StructType | None = None) -> None:
        self._tables[name] = _Entry(name, df if callable(df) else lambda: df, primary_key, schema)

    def _get(self, name: str | None) -> _Entry:
        try:
            return self._tables[name]
        except KeyError:
            raise AnalysisError(f"Unknown table {name}") from None

    def spec(self, name: str | None) -> TableSpec:
        e = self._get(name)
        if e.schema is None:
            e.schema = e.load().schema
        return TableSpec(e.name, e.schema, e.primary_key)

    def table(self, name: str | None) -> DataFrame:
        return self._get(name).load()

    def names(self) -> list[str]:
        return list(self._tables)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def clear(self) -> None:
        self._tables.clear()
