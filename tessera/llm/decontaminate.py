"""Benchmark decontamination by greedy string tiling.

Windows of a few words shared with a benchmark item seed a comparison of the document's seeded stretches
with that item: the longest common run of unmarked words is found by running Karp-Rabin hashes, all its
non-overlapping occurrences are marked in both, and so on down to the least length.  The share of the
item's words under tiles decides, so passages cut up and reordered are found as well.

The benchmark is the stated query set: it goes to the documents in blocks of bounded size, one pass a
block, so no text is shuffled however large either side is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .common import byte_slices, map_rows, table
from .words import powers, run_hashes

#: Words of a seed, which is the least tile; items with fewer words are seeds as a whole.
SEED = 5
#: Share of an item's words under tiles from which a document holds the item.
COVERAGE = 0.5
#: Words of the items in a broadcast block at most (one item alone may exceed it).
BLOCK_WORDS = 2_000_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(text: str | None) -> np.ndarray:
    """Hash of each run of ASCII letters, digits and non-ASCII bytes, lower-cased: case and punctuation never hide a passage."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    return run_hashes(raw, _WORD_BYTE[raw])[0]


class Rolling:
    """Karp-Rabin: hashes of all windows of any one length over a word sequence, from prefix sums."""

    def __init__(self, seq: np.ndarray):
        power, self._inverse = powers(len(seq) + 1)
        self._total = np.zeros(len(seq) + 1, np.uint64)
        np.cumsum(seq * power[: len(seq)], out=self._total[1:])

    def windows(self, k: int) -> np.ndarray:
        n = len(self._total) - k
        return (self._total[k:] - self._total[:n]) * self._inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def _free_windows(free: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(total[k:] == total[:-k]) if len(free) >= k else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int, free: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), longest first, earliest among equals.

    ``free`` marks the words of doc that may be tiled (all by default).
    """
    free_d = np.ones(len(doc), bool) if free is None else free.copy()
    free_i = np.ones(len(item), bool)
    roll_d, roll_i = Rolling(doc), Rolling(item)
    out: list[tuple[int, int, int]] = []

    def matches(k: int):
        at_i, at_d = _free_windows(free_i, k), _free_windows(free_d, k)
        if not len(at_i) or not len(at_d):
            return None
        h_i, h_d = roll_i.windows(k)[at_i], roll_d.windows(k)[at_d]
        order = np.argsort(h_i, kind="stable")
        h_i, at_i = h_i[order], at_i[order]
        lo, hi = np.searchsorted(h_i, h_d, "left"), np.searchsorted(h_i, h_d, "right")
        hit = hi > lo
        return (at_d[hit], lo[hit], hi[hit], at_i) if hit.any() else None

    top = min(len(doc), len(item))
    while top >= least:
        low, high, best = least, top, None
        while low <= high:  # a common run of k words holds one of k - 1
            mid = (low + high + 1) // 2 if best is not None else low
            m = matches(mid)
            if m is None:
                high = mid - 1
            else:
                best, low = (mid, m), mid + 1
        if best is None:
            break
        k, (at_d, lo, hi, at_i) = best
        for d, a, b in zip(at_d.tolist(), lo.tolist(), hi.tolist()):
            if not free_d[d : d + k].all():
                continue
            for i in at_i[a:b].tolist():
                if free_i[i : i + k].all():
                    free_d[d : d + k] = False
                    free_i[i : i + k] = False
                    out.append((d, i, k))
                    break
            if not free_i.any():
                return out
        top = k if matches(k) is not None else k - 1
    return out


class Block:
    """Benchmark items with an index of their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]], coverage: float = COVERAGE):
        self.coverage = coverage
        self.ids = [i for i, _ in items]
        self.items = [w for _, w in items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_len: dict[int, list[tuple[np.ndarray, int]]] = {}
        for no, w in enumerate(self.items):
            k = min(SEED, len(w))
            by_len.setdefault(k, []).append((np.unique(Rolling(w).windows(k)), no))
        for k, rows in by_len.items():
            h = np.concatenate([r for r, _ in rows])
            owner = np.repeat([no for _, no in rows], [len(r) for r, _ in rows])
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << 22, bool)
            maybe[(h >> np.uint64(42)).astype(np.int64)] = True
            self.seeds[k] = (h[order], owner[order], maybe)

    def held(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item id, coverage, tiles, longest tile) of each item that the text holds."""
        doc = words(text)
        if not len(doc):
            return []
        roll, out = Rolling(doc), {}
        for k, (known, owner, maybe) in self.seeds.items():
            h = roll.windows(k)
            at = np.flatnonzero(maybe[(h >> np.uint64(42)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(at):
                continue
            n = hi - lo
            nos = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            where = np.repeat(at, n)
            for no in np.unique(nos).tolist():
                item = self.items[no]
                starts = where[nos == no]
                span = np.zeros(len(doc) + 1, np.int64)
                np.add.at(span, starts, 1)
                np.add.at(span, starts + k, -1)
                seeded = np.cumsum(span)[:-1] > 0
                if seeded.sum() < self.coverage * len(item) and len(np.unique(h[starts])) + k - 1 < self.coverage * len(item):
                    continue  # even tiled whole, the seeded words do not suffice
                edges = np.diff(np.concatenate([[0], seeded.astype(np.int8), [0]]))
                pieces, free = [], []
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
                    pieces += [doc[a:b], np.zeros(1, np.uint64)]
                    free += [np.ones(b - a, bool), np.zeros(1, bool)]
                found = tiles(np.concatenate(pieces), item, k, np.concatenate(free))
                covered = sum(t[2] for t in found) / len(item)
                if covered >= self.coverage and covered > out.get(self.ids[no], (0.0,))[0]:
                    out[self.ids[no]] = (covered, len(found), max(t[2] for t in found))
        return [(i, *out[i]) for i in sorted(out, key=lambda i: (i is not None, i or 0))]


def blocks(benchmark: DataFrame) -> "list[list[tuple[int, np.ndarray]]]":
    """The items in blocks of at most BLOCK_WORDS words, read one after the other."""
    out: list[list[tuple[int, np.ndarray]]] = [[]]
    size = 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    for i, text in rows.toLocalIterator():
        w = words(text)
        if not len(w):
            continue
        if out[-1] and size + len(w) > BLOCK_WORDS:
            yield out.pop()
            out, size = [[]], 0
        out[-1].append((i, w))
        size += len(w)
    if out[-1]:
        yield out[-1]


LEAKS = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) of each document row and item it holds.

    Null or empty texts and items hold nothing; null ids of documents and of items stay null; repeated rows
    each report; of items that share an id, or have none, the best coverage counts; an empty table gives no
    rows; other columns are ignored.
    """
    spark, out = docs.sparkSession, None
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    schema = T._parse_datatype_string(LEAKS)
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def make(held=held):
            index = Block(held.value, coverage)
            return lambda cols: [(i, *hit) for i, text in zip(*cols) for hit in index.held(text)]

        found = map_rows(texts, make, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The document rows that hold no item, with or without an id, with all their columns; narrow, one filter pass a block."""
    spark = docs.sparkSession
    ship(spark)
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            index = Block(held.value, coverage)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                for part in byte_slices(batch):
                    yield part.filter(pa.array([not index.held(t) for t in part.column(at).to_pylist()]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it holds."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
