"""Best-fit packing by exact-complement hashing.

The pieces' lengths form a histogram of at most ``capacity`` counts, whatever the corpus size, so the
plan is made on counts: the largest length first, its gap filled exactly by one length, a pair or a
triple of lengths looked up among the available ones, each combination consumed as often as its
availability allows; what finds no exact partner goes by best fit, again count-wise.  Every step
exhausts a length or a group of equal sequences, so the plan has O(capacity) groups.  Best fit alone is planned as
well, and the plan with fewer sequences is taken.  Pieces then find
their place by (length, rank) - no shuffle by length, hence no hot length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordbpe
from .common import map_rows, materialize, table

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("rank", T.LongType()),
    ]
)


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity ids, with each piece's running rank among its task's pieces of that length."""

    def make():
        bpe, seen, part = wordbpe.load(tokenizer_path), defaultdict(int), TaskContext.get().partitionId()
        end = END_ID.to_bytes(4, "little")

        def kernel(cols):
            out = []
            for doc_id, text in zip(*cols):
                ids = bpe.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    out.append((doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            return out

        return kernel

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, PIECES)


class _Stock:
    """Available counts by length, with the searches for exact complements."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the largest member; equal members need a count of two."""
        low = np.arange(1, gap // 2 + 1)
        ok = (self.n[low] > 0) & (self.n[gap - low] > 0)
        if gap % 2 == 0 and gap and self.n[gap // 2] < 2:
            ok[-1:] = False
        hit = np.flatnonzero(ok)
        return (gap - int(low[hit[0]]), int(low[hit[0]])) if len(hit) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.n[: gap - 1])[::-1]:
            a = int(a)
            if 3 * a < gap:  # a is the largest of the three
                return None
            self.n[a] -= 1
            found = self.pair(gap - a)
            self.n[a] += 1
            if found:
                return (a, *found)
        return None

    def take(self, combo: list[int]) -> int:
        """Consume the combination as often as the counts allow."""
        need = defaultdict(int)
        for x in combo:
            need[x] += 1
        times = min(int(self.n[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.n[x] -= times * k
        return times


def best_fit(left: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Groups for (length, count) by falling length: each goes into the open sequences with the least room that suffices."""
    open_at: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    rooms: list[int] = []  # ascending, those of open_at that are not empty
    for length, count in left:
        while count:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, count)
                times = count // each
                room, inside, used = capacity, [], times
                count -= times * each
                put = [length] * each
            else:
                room = rooms[k]
                have, inside = open_at[room].pop()
                used, put = min(have, count), [length]
                if have > used:
                    open_at[room].append((have - used, inside))
                elif not open_at[room]:
                    rooms.pop(k)
                count -= used
            rest = room - length * len(put)
            if not open_at[rest]:
                bisect.insort(rooms, rest)
            open_at[rest].append((used, [*inside, *put]))
    return [g for at in sorted(open_at) for g in open_at[at]]


def plan_groups(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Groups (how many sequences, the lengths in each) that hold all counted pieces.

    Exact complements first and best fit for the rest; where best fit alone needs fewer sequences (very even
    lengths), its plan is taken.
    """
    plain = best_fit(sorted(((x, n) for x, n in counts.items() if n), reverse=True), capacity)
    exact = _complements(counts, capacity)
    total = lambda groups: sum(n for n, _ in groups)
    return exact if total(exact) <= total(plain) else plain


def _complements(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    stock, groups, left = _Stock(counts, capacity), [], []
    if stock.n[capacity]:
        groups.append((int(stock.n[capacity]), [capacity]))
        stock.n[capacity] = 0
    for length in range(capacity - 1, 0, -1):
        while stock.n[length]:
            gap = capacity - length
            stock.n[length] -= 1
            combo = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            stock.n[length] += 1
            if combo is None:
                left.append((length, int(stock.n[length])))
                stock.n[length] = 0
            else:
                groups.append((stock.take([length, *combo]), [length, *combo]))
    return groups + best_fit(left, capacity)


def _slots(groups: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, sequence base, offset), sorted: rank first + j sits in sequence base + j."""
    rows, rank, base = [], defaultdict(int), 0
    for times, lengths in groups:
        offset = 0
        for x in lengths:
            rows.append((x, rank[x], base, offset))
            rank[x] += times
            offset += x
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of at most ``capacity`` ids.

    A null text counts as empty (its piece is the end id alone); a null doc_id stays null; repeated rows
    are packed each; an empty table gives an empty result; other columns are ignored.  Only documents
    longer than the capacity are cut.  Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = materialize(cut(docs, tokenizer_path, capacity), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = _slots(plan_groups(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    return _place(ranked, slots)


def _place(ranked: DataFrame, slots: np.ndarray) -> DataFrame:
    spark, shift = ranked.sparkSession, 44
    held = spark.sparkContext.broadcast((slots[:, 0] * (1 << shift) + slots[:, 1], slots[:, 1:]))  # O(capacity) groups
    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frames):
        keys, slot = held.value
        for f in frames:
            at = np.searchsorted(keys, f["length"].to_numpy() * (1 << shift) + f["rank"].to_numpy(), "right") - 1
            f["sequence_id"] = slot[at, 1] + f.pop("rank").to_numpy() - slot[at, 0]
            f["offset"] = slot[at, 2]
            yield f

    return ranked.mapInPandas(run, schema)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 4096 ids of the public word BPE."""
    return pack(table(spark, sf_dir, "documents"), wordbpe.default_path())
