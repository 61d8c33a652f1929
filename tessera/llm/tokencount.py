"""Token counts by separator scan over flat, unindexed token files.

A flat file is nothing but token ids of fixed width; documents end with a separator id.  Blocks cut a
file anywhere.  Each block is searched for separators with one vectorised comparison; documents that
cross blocks are stitched by prefix scans over block summaries: a running sum of tokens and separators
and a running maximum of the last document end, each in two levels, so that a file's blocks never meet
in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from . import wordbpe
from .common import byte_slices, map_rows, materialize, table

#: Tokens in a block (64 KiB: small objects for the JVM, small batches for a worker); blocks in a span of the two-level scans.
BLOCK_TOKENS, SPAN_BLOCKS = 1 << 15, 1 << 12
#: The public word BPE's end-of-text id, and its file's token width in bytes.
SEPARATOR, WIDTH = 49407, 2

BLOCKS = "file long, block long, data binary, first_doc long, doc_ids array<bigint>"


def write_flat(docs: DataFrame, tokenizer_path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenise documents into flat streams, one a task, kept in the shared folder as rows of raw block bytes.

    The columns first_doc and doc_ids note which documents began while a block was filled; the scan does
    not read them, they only name the documents it finds.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        bpe, file = wordbpe.load(tokenizer_path, special_as_text=True), TaskContext.get().partitionId()
        held, size, block, first, ids, n = [], 0, 0, 0, [], 0
        end = np.array([separator], f"<u{WIDTH}").tobytes()
        limit = block_tokens * WIDTH

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "data": [data], "first_doc": [first], "doc_ids": [ids]},
                schema=pa.schema([("file", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]),
            )

        for batch in batches:
            for part in byte_slices(batch):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = np.frombuffer(bpe.encode(text), "<u4")
                    if len(tokens) and int(tokens.max()) >> (8 * WIDTH):
                        raise ValueError(f"a token id does not fit {WIDTH} bytes")
                    own = tokens.astype(f"<u{WIDTH}").tobytes() + end
                    ids.append(i)
                    held.append(own)
                    size += len(own)
                    n += 1
                    if size >= limit:
                        data = b"".join(held)
                        while len(data) >= limit:
                            yield row(data[:limit])
                            data = data[limit:]
                            block, first, ids = block + 1, n, []
                        held, size = [data], len(data)
        if size or ids:
            yield row(b"".join(held))

    schema = T._parse_datatype_string(BLOCKS)
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    return materialize(made, "flat", compression="zstd")


def flat_blocks(spark: SparkSession, path: str, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, file, block, data) of raw token files under path, read by byte range, a task a block range.

    Sizes come from the file listing; the bytes are read through Arrow's file systems, which must know the
    store.  A last partial token is an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read
    size = block_tokens * width
    ranges = (
        files.where("length > 0").select("path", "length", F.xxhash64("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
        .repartition("file", "block")
    )

    def run(frames):
        from pyarrow import fs

        for f in frames:
            for r in f.itertuples():
                if r.length % width:
                    raise ValueError(f"{r.path} holds a partial token")
                store, inner = fs.FileSystem.from_uri(r.path if "://" in r.path else r.path.replace("file:", "file://", 1))
                with store.open_input_file(inner) as src:
                    src.seek(r.block * size)
                    yield pd.DataFrame({"path": [r.path], "file": [r.file], "block": [r.block], "data": [src.read(size)]})

    return ranges.mapInPandas(run, "path string, file long, block long, data binary")


SCANNED = "file long, block long, n_tokens long, ends array<int>"


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Per block: its tokens and the positions of its separators."""

    def make():
        def kernel(cols):
            out = []
            for file, block, data in zip(*cols):
                tokens = np.frombuffer(data or b"", f"<u{width}")
                out.append((file, block, len(tokens), np.flatnonzero(tokens == separator).tolist()))
            return out

        return kernel

    return map_rows(blocks.select("file", "block", "data"), make, T._parse_datatype_string(SCANNED), slice_rows=64)


def _scan_before(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """Exclusive prefix scans by file over blocks, in two levels; columns: name -> (aggregate, column, neutral value)."""
    local = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("span", F.floor(F.col("block") / SPAN_BLOCKS))
    spans = df.groupBy("file", "span").agg(*[f(c).alias(n) for n, (f, c, _) in columns.items()])
    spans = spans.select("file", "span", *[f(n).over(over).alias(f"{n}_span") for n, (f, _, _) in columns.items()])
    both = df.select("*", *[f(c).over(local).alias(f"{n}_own") for n, (f, c, _) in columns.items()]).join(spans, ["file", "span"])
    join = lambda n, f, zero: (
        F.coalesce(f"{n}_span", F.lit(zero)) + F.coalesce(f"{n}_own", F.lit(zero)) if f is F.sum else F.greatest(F.coalesce(f"{n}_span", F.lit(zero)), F.coalesce(f"{n}_own", F.lit(zero)))
    )
    return both.select(*[c for c in df.columns if c != "span"], *[join(n, f, z).alias(n) for n, (f, _, z) in columns.items()])


def documents(scanned: DataFrame) -> DataFrame:
    """(file, doc_no, start, n_tokens) of every document; start counts the file's tokens, separators included,
    n_tokens is without the separator.  Tokens after a file's last separator are a document as well."""
    sums = _scan_before(
        scanned.withColumn("n_docs", F.size("ends").cast("long")),
        {"at": (F.sum, F.col("n_tokens"), 0), "doc_base": (F.sum, F.col("n_docs"), 0)},
    )
    last = F.when(F.col("n_docs") > 0, F.col("at") + F.element_at("ends", -1) + 1)
    opened = _scan_before(sums.withColumn("last", last), {"open": (F.max, F.col("last"), 0)})
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: F.col("at") + e + 1))
    stops = F.transform("ends", lambda e: F.col("at") + e)
    done = opened.select("file", "doc_base", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("ends")).alias("s"), stops.alias("e"))).alias("k", "d"))
    done = done.select("file", (F.col("doc_base") + F.col("k")).alias("doc_no"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"))
    whole = scanned.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("ends")).alias("doc_no"))
    closed = sums.withColumn("last", last).groupBy("file").agg(F.coalesce(F.max("last"), F.lit(0)).alias("start"))
    rest = whole.join(closed, "file").where("n > start").select("file", "doc_no", "start", (F.col("n") - F.col("start")).alias("n_tokens"))
    return done.unionByName(rest)


def token_counts(docs: DataFrame, tokenizer_path: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, file, doc_no, start of every document row, counted in the flat files made of the documents.

    Null or empty text has 0 tokens; a null doc_id stays null; repeated rows each count; an empty table
    gives no rows; other columns are ignored.
    """
    flat = write_flat(docs, tokenizer_path, separator, block_tokens)
    found = documents(materialize(scan(flat, separator), "flat-scan"))
    names = flat.select("file", "first_doc", F.posexplode("doc_ids").alias("k", "doc_id")).select(
        "file", (F.col("first_doc") + F.col("k")).alias("doc_no"), "doc_id"
    )
    return names.join(found, ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "doc_no", "start")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat files of the public word BPE."""
    return token_counts(table(spark, sf_dir, "documents"), wordbpe.default_path())
