"""Suffix-array dedup: removal of byte strings of a fixed length that an earlier document holds.

Every 50-byte window is represented by its anchor, the smallest hash among the 19-byte strings inside it,
so equal windows have equal anchors and one byte in sixteen is an anchor.  An anchor's context is the run
of windows it represents.

1. Texts are dealt into chunks; a chunk sends each distinct (anchor, context) once with its smallest
   document, packed by anchor bucket, so neither a common passage nor a large group of copies makes a hot
   bucket: it counts once a chunk.
2. A bucket sorts them: documents above the smallest of an equal context are covered as a whole.  Where
   one anchor has several contexts (its surroundings differ), one copy of each is looked at further.
3. The chunks that hold these copies sort their suffixes into a suffix array; with common prefixes and the
   previous and next smaller documents in suffix order, the longest-previous-factor array tells which windows
   begin a match of full length with an earlier document of the chunk.  Each class of equal suffixes goes once,
   by fingerprint and smallest document, to a bucket of its own, which merges the classes of all chunks - so
   windows inside a passage that many documents share count once a chunk as well.
4. Chunks remove the covered bytes.

The chunked text is shuffled once; the three passes over it are branches of one plan and share that
exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .common import table
from .words import _VALUES, mix, powers

#: Bytes of a repeated string; bytes of an anchor; windows of anchors that one window holds.
LENGTH, GRAM = 50, 19
REACH = LENGTH - GRAM + 1  # 32: a power of two, and window masks fit 32 bits
#: Bytes of text in a chunk and chunks in a partition, on average; anchors in a bucket, on average.
CHUNK_BYTES, CHUNKS_A_PART, BUCKET_ANCHORS = 4 << 20, 4, 150_000

#: Corpus bytes from which fingerprints of windows are 96 bits, not 64.  About one window in twenty is fingerprinted,
#: so a chance pair is in 1 GiB once in ten thousand runs at 64 bits, and in 100 TB once in five thousand at 96.
TAG_FROM_BYTES = 1 << 30

_U = np.uint64


def anchors(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash (58 bits), context hash (40 bits), first and last window start, of each anchor in order, and the
    prefix sums of the text's polynomial hash."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * 2 + (np.zeros(n + 1, _U),)
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_VALUES[raw] * power[:n], out=total[1:])
    # the low six bits hold the anchor's distance, so a minimum keeps the leftmost of equal hashes
    key = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]) & ~_U(63)
    step = 1
    while step < REACH:
        key = np.minimum(key[:-step], key[step:] + _U(step))
        step *= 2
    at = np.arange(len(key)) + (key & _U(63)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(key)]]) - 1
    context = (total[last + LENGTH] - total[first]) * inverse[first]
    shape = ((at[first] - first) * 64 + last - first).astype(_U)
    h2 = mix(context + mix(shape + _U(1))) >> _U(24)
    # (a smallest hash is small: mixed again, so that buckets by its first bits are even)
    return mix(key[first] >> _U(6)) >> _U(6), h2, first, last, total


class Chunk:
    """The anchors of a chunk's rows, and each distinct (anchor, context)'s smallest document."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # the same chunk in every pass, whatever order rows came in
        self.ids = t["doc_id"].to_pylist()
        self.raw = [np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8) for x in t["text"].to_pylist()]
        found = [anchors(r if i is not None else r[:0]) for i, r in zip(self.ids, self.raw)]
        self.totals = [f[4] for f in found]
        self.row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        cat = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
        self.h1, self.h2, self.first, self.last = cat(0, _U), cat(1, _U), cat(2, np.int64), cat(3, np.int64)
        self.doc = np.array([i or 0 for i in self.ids], np.int64)[self.row] if len(self.row) else np.zeros(0, np.int64)
        order = np.lexsort((self.doc, self.h2, self.h1))
        h1, h2 = self.h1[order], self.h2[order]
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(order) else np.zeros(0, bool)
        self.head = order[new]  # an occurrence in the smallest document of each distinct one
        self.of = np.zeros(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.u1, self.u2, self.low = h1[new], h2[new], self.doc[self.head]

    def bucket_starts(self, buckets: np.ndarray, shift: int) -> np.ndarray:
        """Where each bucket begins among the distinct ones, which are sorted by anchor."""
        return np.searchsorted(self.u1 >> _U(shift), buckets.astype(np.uint64))


class Windows:
    """All windows of one occurrence (in the smallest document) of each of some distinct contexts."""

    def __init__(self, chunk: Chunk, at: np.ndarray, tag_mask: int):
        head = chunk.head[at]
        n = chunk.last[head] - chunk.first[head] + 1
        self.owner = np.repeat(np.arange(len(at)), n)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(n) - n, n)
        self.doc = chunk.doc[head][self.owner]
        start = chunk.first[head][self.owner] + self.offset
        row = chunk.row[head][self.owner]
        sizes = np.array([len(r) for r in chunk.raw], np.int64)
        self._raw, self._start = chunk.raw, (np.cumsum(sizes) - sizes)[row] + start
        sizes = np.array([len(x) for x in chunk.totals], np.int64)
        total = np.concatenate(chunk.totals) if chunk.totals else np.zeros(0, _U)
        base = (np.cumsum(sizes) - sizes)[row] + start
        _, inverse = powers(int(sizes.max(initial=1)))
        #: Fingerprint of each window: 64 bits of its bytes and, under tag_mask, bits of its anchor.
        self.print = mix((total[base + LENGTH] - total[base]) * inverse[start])
        self.tag = chunk.u1[at][self.owner] & _U(tag_mask)
        order = np.lexsort((self.doc, self.tag, self.print))
        p, g, d = self.print[order], self.tag[order], self.doc[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (g[1:] != g[:-1])]) if len(p) else np.zeros(0, bool)
        self.class_print, self.class_tag, self.class_low = p[new], g[new], d[new]
        self.of = np.zeros(len(p), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def earlier_here(self) -> np.ndarray:
        """Whether each window begins a match of full length with a smaller document of the chunk: the suffix
        array of the windows, and its longest-previous-factors."""
        raw = np.concatenate(self._raw) if self._raw else np.zeros(0, np.uint8)
        padded = np.zeros((len(self._start), 56), np.uint8)
        for k in range(LENGTH):
            padded[:, k] = raw[self._start + k]
        keys = padded.view(">u8").astype(np.uint64)  # seven big-endian words: their order is the byte order
        order = np.lexsort((self.doc, *keys.T[::-1]))
        keys = keys[order]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]).all(1)]) if len(keys) else np.zeros(0, bool)
        near = same | np.concatenate([same[1:], [False]]) if len(keys) else same  # the others have no match of full length
        hit = np.zeros(len(order), bool)
        hit[order[near]] = longest_previous(self.doc[order[near]], np.where(same[near], LENGTH, 0)) >= LENGTH
        return hit

    def masks(self, hit: np.ndarray, n: int) -> np.ndarray:
        """Window bits of each of the n contexts."""
        out = np.zeros(n, np.uint64)
        np.bitwise_or.at(out, self.owner[hit], _U(1) << self.offset[hit].astype(_U))
        return out


def encode(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, each in the least whole number of bytes that holds its values."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for c in columns:
        c = np.ascontiguousarray(c).view(np.uint64)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        out += [bytes([width]), c.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()]
    return b"".join(out)


def decode(blob: bytes, n_columns: int) -> tuple[list[np.ndarray], bytes]:
    """The columns, and what follows them."""
    n, at, out = int.from_bytes(blob[:4], "little"), 4, []
    for _ in range(n_columns):
        width = blob[at]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at + 1).reshape(n, width)
        out.append(wide.view(np.uint64).ravel())
        at += 1 + n * width
    return out, blob[at:]


def _top(v: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of 64-bit values."""
    return (v >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(v), np.int64)


def _deltas(v: np.ndarray) -> np.ndarray:
    """Differences of ascending values, the first as it is."""
    v = v.astype(np.uint64)
    return np.concatenate([v[:1], v[1:] - v[:-1]])


def _slices(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_keys)]))


#: To a bucket: a chunk's columns; inner is used by what only passes through a negative bucket, back to its chunk.
SENT = "bucket long, chunk long, inner long, blob binary"
#: To a chunk: kind 0 has (position in the chunk's bucket, smallest document, wanted), kind 1 positions of its classes
#: in the bucket with an earlier document elsewhere, kind 2 (position among all contexts, window mask).
REPLY = "chunk long, kind int, bucket long, blob binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _replies(bucket: int, kind: int, chunk: np.ndarray, pos: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.lexsort((pos, chunk))
    chunk, pos, columns = chunk[order], pos[order], [c[order] for c in columns]
    return _rows(
        REPLY,
        [(int(chunk[a]), kind, bucket, encode(_deltas(pos[a:b]), *[c[a:b] for c in columns])) for a, b in _slices(chunk)],
    )


def _reduce(key, t):
    """Step 2 in one bucket: what each chunk must know about its (anchor, context) pairs."""
    parts = [decode(b, 3)[0] for b in t["blob"].to_pylist()]
    sizes = [len(x[0]) for x in parts]
    chunk = np.repeat(t["chunk"].to_numpy(), sizes)
    pos = np.concatenate([np.arange(n) for n in sizes])
    h1 = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    h2 = np.concatenate([x[1] for x in parts])
    doc = np.concatenate([x[2] for x in parts]).view(np.int64)
    del parts
    order = np.lexsort((doc, h2, h1))
    h1, h2, doc, chunk, pos = h1[order], h2[order], doc[order], chunk[order], pos[order]
    new1 = np.concatenate([[True], h1[1:] != h1[:-1]])
    new2 = new1 | np.concatenate([[True], h2[1:] != h2[:-1]])
    g1, g2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
    low = doc[new2][g2]
    contexts = np.bincount(g1[new2])
    least = np.minimum.reduceat(doc, np.flatnonzero(new1))
    most = np.maximum.reduceat(np.where(new2, doc, np.iinfo(np.int64).min), np.flatnonzero(new1))
    wanted = new2 & (contexts > 1)[g1] & (least < most)[g1]
    tell = wanted | (low < doc)
    return _replies(key[0].as_py(), 0, chunk[tell], pos[tell], low[tell], wanted[tell].astype(np.uint64))


def longest_previous(docs: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor array by suffix order: docs[i] is the document of the i-th suffix, lcp[i] the
    common prefix of suffixes i - 1 and i.  The longest match of suffix i in a smaller document lies at the
    previous or the next suffix of a smaller document, at the least common prefix on the way there."""

    def sweep(d: list[int], l: list[int]) -> list[int]:
        out, stack = [0] * len(d), []  # the stack's documents ascend; each with the common prefix to the one below
        for i, x in enumerate(d):
            reach = l[i]
            while stack and stack[-1][0] >= x:
                reach = min(reach, stack.pop()[1])
            out[i] = reach if stack else 0
            stack.append((x, reach))
        return out

    d, l = docs.tolist(), lcp.tolist()
    before = sweep(d, l)
    after = sweep(d[::-1], [0, *l[:0:-1]])[::-1]
    return np.maximum(before, after)


def _merge(key, t):
    """Step 3 in one bucket of classes: which chunks' classes have an earlier document elsewhere."""
    bucket = key[0].as_py()
    if bucket < 0:
        return _rows(REPLY, [(c, 2 if i < 0 else 0, max(i, 0), b) for c, i, b in zip(*(t[n].to_pylist() for n in ("chunk", "inner", "blob")))])
    parts = [decode(b, 3)[0] for b in t["blob"].to_pylist()]
    sizes = [len(x[0]) for x in parts]
    chunk = np.repeat(t["chunk"].to_numpy(), sizes)
    pos = np.concatenate([np.arange(n) for n in sizes])
    print_ = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
    tag = np.concatenate([x[1] for x in parts])
    doc = np.concatenate([x[2] for x in parts]).view(np.int64)
    order = np.lexsort((doc, tag, print_))
    p, g = print_[order], tag[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (g[1:] != g[:-1])])
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
    return _replies(bucket, 1, chunk[later], pos[later])


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _read(t: pa.Table, kind: int, n_columns: int, starts) -> list[np.ndarray]:
    """Positions and the other columns of the replies of one kind; starts(buckets) is where each bucket begins."""
    own = t.filter(pa.compute.equal(t["kind"], kind)) if t.num_rows else t
    if not own.num_rows:
        return [np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (n_columns - 1)]
    parts = [decode(b, n_columns)[0] for b in own["blob"].to_pylist()]
    at = np.concatenate([np.cumsum(p[0]).astype(np.int64) + s for p, s in zip(parts, starts(own["bucket"].to_numpy()).tolist())])
    return [at, *[np.concatenate([p[k] for p in parts]) for k in range(1, n_columns)]]


def _wanted(chunk: Chunk, t: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of kind 0: positions, smallest documents, and the ascending positions that are looked at further."""
    at, least, wanted = _read(t, 0, 3, lambda b: chunk.bucket_starts(b, 58 - bits))
    return at, least.view(np.int64), np.sort(at[wanted > 0])


def _covered(chunk: Chunk, t: pa.Table, bits: int, tag_mask: int) -> list[list[tuple[int, int]]]:
    """Covered byte intervals of each row."""
    low, mask = chunk.low.copy(), np.zeros(len(chunk.low), np.uint64)
    at, least, wanted = _wanted(chunk, t, bits)
    low[at] = np.minimum(low[at], least)
    at, own = _read(t, 2, 2, np.zeros_like)
    mask[at] = own
    if len(wanted):
        w = Windows(chunk, wanted, tag_mask)
        later = np.zeros(len(w.class_print), bool)
        later[_read(t, 1, 1, lambda b: np.searchsorted(_top(w.class_print, bits), b))[0]] = True
        mask[wanted] |= w.masks(later[w.of], len(wanted))
    out: list[list[tuple[int, int]]] = [[] for _ in chunk.ids]
    whole = chunk.doc > low[chunk.of]
    for row, a, b in zip(chunk.row[whole].tolist(), chunk.first[whole].tolist(), chunk.last[whole].tolist()):
        out[row].append((a, b + LENGTH))
    for k in np.flatnonzero(~whole & (mask[chunk.of] > 0)).tolist():
        bits, a = int(mask[chunk.of[k]]), int(chunk.first[k])
        out[int(chunk.row[k])] += [(a + j, a + j + LENGTH) for j in range(REACH) if bits >> j & 1]
    return out


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte runs) of every document row.

    Bytes go that lie in a 50-byte string which also starts in a document with a smaller doc_id; strings are
    judged on the input.  Null text counts as empty; rows with a null doc_id neither lose bytes nor count as
    earlier; rows that share a doc_id do not count as earlier than each other; an empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    bits = max(0, (n_bytes // 16 // BUCKET_ANCHORS).bit_length())
    shift = 58 - bits
    tag_mask = 0xFFFFFFFF if n_bytes > TAG_FROM_BYTES else 0
    text = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))).repartition(max(1, -(-n_chunks // CHUNKS_A_PART)), "chunk")

    def emit(key, t):
        c, chunk = Chunk(t), key[0].as_py()
        bucket = (c.u1 >> _U(shift)).astype(np.int64)
        below = c.u1 & _U((1 << shift) - 1)
        return _rows(SENT, [(int(bucket[a]), chunk, 0, encode(_deltas(below[a:b]), c.u2[a:b], c.low[a:b])) for a, b in _slices(bucket)])

    def contexts(key, t, replies):
        c, chunk = Chunk(t), key[0].as_py()
        rows = [(-1 - chunk, chunk, i, b) for i, b in zip(replies["bucket"].to_pylist(), replies["blob"].to_pylist())]
        wanted = _wanted(c, replies, bits)[2]
        if len(wanted):
            w = Windows(c, wanted, tag_mask)
            mask = w.masks(w.earlier_here(), len(wanted))
            some = mask > 0
            rows.append((-1 - chunk, chunk, -1, encode(_deltas(wanted[some]), mask[some])))
            bucket = _top(w.class_print, bits)
            below = w.class_print & _U((1 << (64 - bits)) - 1)
            rows += [
                (int(bucket[a]), chunk, 0, encode(_deltas(below[a:b]), w.class_tag[a:b], w.class_low[a:b])) for a, b in _slices(bucket)
            ]
        return _rows(SENT, rows)

    def finish(key, t, replies):
        c = Chunk(t)
        spans = [_union(x) for x in _covered(c, replies, bits, tag_mask)]
        kept = []
        for raw, own in zip(c.raw, spans):
            h, at = hashlib.sha256(), 0
            for a, b in own:
                h.update(raw[at:a])
                at = b
            h.update(raw[at:])
            kept.append(h.hexdigest())
        return pa.table(
            {
                "doc_id": pa.array(c.ids, pa.int64()),
                "n_bytes": pa.array([len(r) for r in c.raw], pa.int64()),
                "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array(kept, pa.string()),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    sent = text.groupBy("chunk").applyInArrow(emit, SENT)
    first = sent.groupBy("bucket").applyInArrow(_reduce, REPLY)
    asked = text.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(contexts, SENT)
    replies = asked.groupBy("bucket").applyInArrow(_merge, REPLY)
    return text.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, OUT)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 50-byte repeats of earlier documents leave of every document."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
