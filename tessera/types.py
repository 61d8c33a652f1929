"""The two-type row model: INT (32 bits) and STRING (at most 128 characters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import AnalysisError, SchemaError

STRING_LEN = 128
#: Bytes of a field on a heap page.
FIELD_BYTES = {"int": 4, "string": 4 + STRING_LEN}
_BY_NAME = {"int": T.IntegerType(), "string": T.StringType()}


def schema_of(fields: list[tuple[str, str]]) -> T.StructType:
    """Schema from (name, "int" | "string") pairs."""
    try:
        return T.StructType([T.StructField(n, _BY_NAME[k.lower()]) for n, k in fields])
    except KeyError as e:
        raise SchemaError(f"unknown type {e}") from None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    return t.simpleString()


def same_type_vector(a: T.StructType, b: T.StructType) -> bool:
    """Schemas are equal if their types are, in order; names do not count."""
    return [f.dataType for f in a] == [f.dataType for f in b]


def merge(a: T.StructType, b: T.StructType) -> T.StructType:
    """The fields of a, then those of b, duplicates kept."""
    return T.StructType([*a.fields, *b.fields])


def field_index(schema: T.StructType, name: str) -> int:
    """Position of the first field of exactly this name."""
    for k, f in enumerate(schema):
        if f.name == name:
            return k
    raise AnalysisError(f"no field {name!r}")


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row on a heap page."""
    return sum(FIELD_BYTES[kind_of(f.dataType)] for f in schema)


def truncate_strings(df: DataFrame) -> DataFrame:
    """Strings cut to 128 characters, as values entering a table are."""
    cut = {f.name: F.substring(F.col(f"`{f.name}`"), 1, STRING_LEN) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns(cut) if cut else df
