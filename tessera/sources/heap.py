"""Heap-page files: fixed-size pages of a slot bitmap and fixed-width rows, and their delimited-text form.

A page of P bytes for rows of R bytes has 8P // (8R + 1) slots; the bitmap takes one bit a slot, lowest bit
first, in whole bytes; rows follow.  An int is 4 bytes big-endian; a string is its length in 4 bytes and 128
bytes of text, filled with zeros.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import SchemaError
from ..ship import ship
from ..types import STRING_LEN, kind_of, row_bytes
from .fs import Store

PAGE_BYTES = 4096
#: Pages that one read task takes.
TASK_PAGES = 4096


def slots(schema: T.StructType, page_bytes: int = PAGE_BYTES) -> int:
    return page_bytes * 8 // (row_bytes(schema) * 8 + 1)


def _record(schema: T.StructType) -> np.dtype:
    fields = []
    for k, f in enumerate(schema):
        if kind_of(f.dataType) == "int":
            fields.append((f"f{k}", ">i4"))
        else:
            fields += [(f"n{k}", ">i4"), (f"f{k}", f"S{STRING_LEN}")]
    return np.dtype(fields)


def decode_pages(data: bytes, schema: T.StructType, page_bytes: int = PAGE_BYTES) -> pa.Table:
    """The used slots of whole pages, in page and slot order."""
    if len(data) % page_bytes:
        raise SchemaError("the file does not end at a page")
    n, kind = slots(schema, page_bytes), _record(schema)
    head = (n + 7) // 8
    pages = np.frombuffer(data, np.uint8).reshape(-1, page_bytes)
    used = np.unpackbits(pages[:, :head], axis=1, bitorder="little")[:, :n].astype(bool)
    body = np.ascontiguousarray(pages[:, head : head + n * kind.itemsize])
    rows = body.view(kind).reshape(len(pages), n)[used] if len(pages) else np.zeros(0, kind)
    out = {}
    for k, f in enumerate(schema):
        v = rows[f"f{k}"]
        if kind_of(f.dataType) == "int":
            out[f.name] = pa.array(v.astype(np.int64 if isinstance(f.dataType, T.LongType) else np.int32))
        else:
            out[f.name] = pa.array([x[:m].decode("utf-8", "replace") for x, m in zip(v.tolist(), rows[f"n{k}"].tolist())], pa.string())
    return pa.table(out)


def encode_pages(frame: pd.DataFrame, schema: T.StructType, page_bytes: int = PAGE_BYTES) -> bytes:
    """Rows packed into full pages, the last one as far as they go."""
    n, kind = slots(schema, page_bytes), _record(schema)
    if n < 1:
        raise SchemaError("a row does not fit a page")
    if not len(frame):
        return b""
    rows = np.zeros(len(frame), kind)
    for k, f in enumerate(schema):
        v = frame.iloc[:, k]
        if v.isna().any():
            raise SchemaError(f"{f.name} has a null; heap pages cannot hold one")
        if kind_of(f.dataType) == "int":
            wide = v.to_numpy(np.int64)
            if len(wide) and (wide.min() < -(1 << 31) or wide.max() >= 1 << 31):
                raise SchemaError(f"{f.name} has an integer of more than 32 bits; heap pages cannot hold one")
            rows[f"f{k}"] = wide.astype(np.int32)
        else:
            raw = [_cut(x) for x in v]
            rows[f"n{k}"] = [len(x) for x in raw]
            rows[f"f{k}"] = raw
    head, n_pages = (n + 7) // 8, -(-len(rows) // n)
    pages = np.zeros((n_pages, page_bytes), np.uint8)
    full = np.zeros((n_pages, n), kind)
    full.reshape(-1)[: len(rows)] = rows
    used = np.zeros((n_pages, head * 8), np.uint8)
    mark = np.arange(n_pages * n).reshape(n_pages, n) < len(rows)
    used[:, :n] = mark
    pages[:, :head] = np.packbits(used, axis=1, bitorder="little")
    pages[:, head : head + n * kind.itemsize] = full.view(np.uint8).reshape(n_pages, -1)
    return pages.tobytes()


def _cut(text: str) -> bytes:
    """At most 128 bytes of UTF-8, whole characters."""
    return text.encode()[:STRING_LEN].decode("utf-8", "ignore").encode()


class _Range(InputPartition):
    def __init__(self, path: str, start: int, length: int):
        self.path, self.start, self.length = path, start, length


def _open(path: str):
    from pyarrow import fs

    uri = path if "://" in path else path.replace("file:", "file://", 1)
    store, inner = fs.FileSystem.from_uri(uri)
    return store, inner


class HeapReader(DataSourceReader):
    def __init__(self, files: list, schema: T.StructType, page_bytes: int):
        self.files, self.schema, self.page_bytes = files, schema, page_bytes

    def partitions(self):
        step = TASK_PAGES * self.page_bytes
        out = [_Range(p, at, min(step, size - at)) for p, size in self.files for at in range(0, size, step)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range):
        if not part.length:
            return
        store, inner = _open(part.path)
        with store.open_input_file(inner) as src:
            src.seek(part.start)
            data = src.read(part.length)
        yield from decode_pages(data, self.schema, self.page_bytes).to_batches(max_chunksize=10_000)


class HeapSource(DataSource):
    """``spark.read.format("heap").schema(...).option("files", json of [path, bytes] pairs)``; see read_heap."""

    @classmethod
    def name(cls) -> str:
        return "heap"

    def schema(self):
        raise SchemaError("give a schema")

    def reader(self, schema: T.StructType) -> HeapReader:
        return HeapReader(json.loads(self.options["files"]), schema, int(self.options.get("pagebytes", PAGE_BYTES)))


def read_heap(spark: SparkSession, path: str, schema: T.StructType, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """A heap file, or a folder of them, read by page ranges in parallel."""
    ship(spark)
    store = Store(spark, path)
    files = store.files(path)
    spark.dataSource.register(HeapSource)
    return spark.read.format("heap").schema(schema).option("files", json.dumps(files)).option("pagebytes", page_bytes).load()


def write_heap(df: DataFrame, path: str, page_bytes: int = PAGE_BYTES) -> int:
    """Write df as a folder of heap files, one a task; returns the rows written.

    The tasks write through Arrow's file systems, so the store must be one that Arrow and all executors reach.
    """
    spark, schema = df.sparkSession, df.schema
    ship(spark)
    store = Store(spark, path)
    store.mkdirs(path)
    root = store._fs.makeQualified(store._path(path)).toString()

    def run(frames):
        import uuid

        n, out, held = 0, None, None  # held: the rows of a page that is not full yet
        per = max(1, slots(schema, page_bytes))
        try:
            for f in frames:
                if not len(f):
                    continue
                if out is None:
                    fs, inner = _open(f"{root}/part-{uuid.uuid4().hex}.dat")
                    out = fs.open_output_stream(inner)
                n += len(f)
                held = f if held is None else pd.concat([held, f])
                full = len(held) // per * per
                out.write(encode_pages(held.iloc[:full], schema, page_bytes))
                held = held.iloc[full:]
            if out is not None:
                out.write(encode_pages(held, schema, page_bytes))
        finally:
            if out is not None:
                out.close()
        if n:
            yield pd.DataFrame({"file": [inner.rsplit("/", 1)[1]], "n": [n]})

    done = df.mapInPandas(run, "file string, n long").collect()  # a row a task
    kept = {r["file"] for r in done}
    for p, _ in store.files(path):  # files of attempts that did not count
        if p.rsplit("/", 1)[1].startswith("part-") and p.rsplit("/", 1)[1] not in kept:
            store.delete(p)
    return sum(r["n"] for r in done)


def read_text(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text: blank lines are skipped, fields trimmed, a line with a bad number is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    n = len(schema)
    fit = F.when(F.size(parts) == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.col("value"))))
    return lines.select(fit.alias("p")).select(
        *[F.trim(F.col("p")[k]).cast(f.dataType).alias(f.name) for k, f in enumerate(schema)]
    )


def convert(spark: SparkSession, text_path: str, heap_path: str, schema: T.StructType, sep: str = ",", page_bytes: int = PAGE_BYTES) -> int:
    """Delimited text to heap files."""
    from ..types import truncate_strings

    return write_heap(truncate_strings(read_text(spark, text_path, schema, sep)), heap_path, page_bytes)
