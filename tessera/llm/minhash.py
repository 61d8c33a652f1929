"""MinHash near-dedup with min-max hashing.

Under each hash function both the smallest and the largest value are kept, so a signature of 2K
coordinates takes K evaluations.  Bands of the signature propose, sketches of one bit a coordinate
discard what the estimate rules out, full shingle sets decide; only verified links are ever closed.

Texts with equal sets form a class.  Classes that share a band key form a bucket (never its pairs):

1. Each member is compared with its bucket's first one, once for all buckets that pair them.
2. Verified links are closed into components.  Buckets whose members are all connected are done; in the
   others the members outside the component of another one are compared with that, for some rounds.
3. In what is left, members of different components are compared: first sketches, where a pair counts
   in the first of its common bands only; then, among members with a likely partner, full sets.

A bucket is dealt in blocks of bounded size; in one of several blocks, what is outside its largest
component meets all blocks, and no pair rows leave a block, only members or a spanning forest of links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, map_rows, materialize, table
from .graph import components
from .words import mix, shingle_set

SHINGLE = 5
#: Hash functions; each gives two coordinates.
FUNCTIONS = 160
#: Probability that a pair right at the threshold shares no band, at most; rows a band are as many as it allows, so
#: that pairs below the threshold seldom meet: 8 at 85 percent (40 bands, miss 3e-6), 7 at 80 (45 bands, 3e-5).
MISS = 5e-5
#: Standard deviations that a sketch's estimate may lie under the threshold (one-sided, 3e-7).
SURE = 5.0
#: Rounds of comparing each bucket's members with one of them; on check_h two more closed one bucket row in a hundred.
STAR_ROUNDS = 1
#: Link if 100 * intersection >= percent * union; this is the default.
PERCENT = 85
#: Classes of a comparison block on average; shingles of one.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000

_K = FUNCTIONS
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, _K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<bigint>, sketch array<bigint>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each hash function: 2K coordinates."""
    low = np.full(_K, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(_K, np.uint64)
    for at in range(0, len(shingles), 512):
        h = (shingles[at : at + 512, None] ^ _XOR) * _ODD
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.concatenate([low, high])


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The unbiased similarity estimate of two signatures."""
    return float((a == b).mean())


_ORDER = np.arange(2 * _K).reshape(2, _K).T.ravel()  # min and max of a function stand together, bands take neighbours


def banding(percent: int) -> tuple[int, int]:
    """Bands, and rows of a band, for a threshold."""
    rows = max(r for r in range(1, 2 * _K + 1) if r == 1 or (1 - (percent / 100) ** r) ** (2 * _K // r) <= MISS)
    return 2 * _K // rows, rows


def least_equal_bits(percent: int) -> int:
    """Equal bits of two sketches below which a pair at the threshold is SURE deviations off."""
    p = (1 + percent / 100) / 2
    return int(2 * _K * p - SURE * (2 * _K * p * (1 - p)) ** 0.5)


def bands(sig: np.ndarray, n: int, rows: int) -> np.ndarray:
    own = sig[_ORDER][: n * rows].reshape(n, rows)
    h = mix(np.arange(1, n + 1, dtype=np.uint64))
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
    return h.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, mixed."""
    return np.packbits((mix(sig.copy()) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, set size, a 128-bit digest of the set, band keys and sketch (none for an empty set)."""
    n, rows = banding(percent)

    def make():
        def kernel(cols):
            out = []
            for i, text in zip(*cols):
                s = shingle_set(text, SHINGLE)
                if len(s):
                    d = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).view(np.int64)
                    sig = signature(s)
                    out.append((i, len(s), int(d[0]), int(d[1]), bands(sig, n, rows).tolist(), sketch(sig).tolist()))
                else:
                    out.append((i, 0, None, None, [], []))
            return out

        return kernel

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, T._parse_datatype_string(SIGNATURE))


def _forest(ids: list[int], of: list[int], sets: list[np.ndarray], n_left: int, within: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components `of`; one end is among the first n_left sets, and
    the other behind them, or also among them if within."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    numbers = {c: k for k, c in enumerate(dict.fromkeys(of))}
    parent = list(range(len(numbers)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for u in range(n_left):
        lo, hi = np.searchsorted(every, sets[u], "left"), np.searchsorted(every, sets[u], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sets))
        for v in np.flatnonzero(100 * shared >= percent * (sizes + sizes[u] - shared)):
            a, b = root(numbers[of[u]]), root(numbers[of[v]])
            if a != b and (within or v >= n_left):
                parent[a] = b
                out.append((ids[u], ids[int(v)]))
    return out


LINKS = "a long, b long"


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links in each block (block columns..., left, c, comp, shingles) between its left and its other rows; among the
    left ones where there are no others."""
    import pyarrow as pa

    keys = [c for c in rows.columns if c not in ("left", "c", "comp", "shingles")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("left", "descending"), ("c", "ascending")])
        n_left = sum(t["left"].to_pylist())
        found: list[tuple[int, int]] = []
        if t.num_rows > 1 and n_left:
            sets = [np.asarray(s.values.to_numpy(zero_copy_only=False)) for s in t["shingles"]]
            found = _forest(t["c"].to_pylist(), t["comp"].to_pylist(), sets, n_left, n_left == t.num_rows, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, LINKS)


def _likely(rows: DataFrame, percent: int) -> DataFrame:
    """(key, c) of members with a likely partner in another component of their block: sizes and sketches allow a link,
    and the block's band is the first that both have in common.  Rows are (key, i, j, left, c, comp, n_shingles, bands, sketch)."""
    import pyarrow as pa

    least = least_equal_bits(percent)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("left", "descending"), ("c", "ascending")])
        n_left, n = sum(t["left"].to_pylist()), t.num_rows
        mark = np.zeros(n, bool)
        if n > 1 and n_left:
            key, comp, size = t["key"][0].as_py(), t["comp"].to_numpy(), t["n_shingles"].to_numpy()
            wide = lambda name: np.stack([np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in t[name]])
            keys, bits = wide("bands"), wide("sketch").view(np.uint64)
            band = np.argmax(keys[0] == key)  # keys are salted by band
            within = n_left == n
            for u in range(n_left):
                v = np.arange(u + 1, n) if within else np.arange(n_left, n)
                v = v[(comp[v] != comp[u]) & (100 * np.minimum(size[v], size[u]) >= percent * np.maximum(size[v], size[u]))]
                v = v[2 * _K - np.bitwise_count(bits[v] ^ bits[u]).sum(1, dtype=np.int64) >= least]
                v = v[~(keys[v, :band] == keys[u, :band]).any(1)]
                if len(v):
                    mark[u] = mark[v] = True
        return pa.table({"key": t["key"].filter(pa.array(mark)), "c": t["c"].filter(pa.array(mark))})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "key long, c long").distinct()


def _dealt(rows: DataFrame, weight) -> DataFrame:
    """Rows (key, c, comp, ...) of buckets in blocks (key, i, j, left, ...): a bucket of one block is compared within
    itself; of several, the members outside the largest component (left) with all."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).groupBy("key").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("n_largest"),
        F.ceil(F.greatest(F.sum("n") / BLOCK_DOCS, F.sum("w") / BLOCK_SHINGLES)).cast("long").alias("blocks"),
    ).where("n_largest < n")
    own = [x for x in rows.columns if x != "key"]
    rows = join_by_key(rows, per, "key", "c", "mh-blocks")
    zero = F.lit(0).cast("long")
    open_blocks = F.ceil((F.col("n") - F.col("n_largest")) / F.col("n") * F.col("blocks")).cast("long")
    block = lambda n, seed: F.pmod(F.xxhash64("c", F.lit(seed)), n)
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    left = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: place(block(open_blocks, 2), j, True))
    right = F.transform(F.sequence(zero, open_blocks - 1), lambda i: place(i, block(F.col("blocks"), 1), False))
    # (one list of places a row, so that the join above is evaluated once)
    places = F.when(F.col("blocks") <= 1, F.array(place(zero, zero, True))).when(F.col("comp") != F.col("largest"), F.concat(left, right)).otherwise(right)
    return rows.select("key", *own, F.explode(places).alias("at")).select("key", "at.i", "at.j", "at.left", *own)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted shingle hashes of the classes wanted (c, doc_id, n_shingles, d1, d2), each from one text that has them."""

    def make():
        def kernel(cols):
            out = []
            for c, n, d1, t in zip(*cols):
                s = shingle_set(t, SHINGLE)  # (a doc_id may have several texts)
                if len(s) == n and int(s.sum(dtype=np.uint64).view(np.int64)) == d1:
                    out.append((c, s.view(np.int64)))
            return out

        return kernel

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.select("c", "doc_id", "n_shingles", "d1"), "doc_id")
    rows = rows.select("c", "n_shingles", "d1", "text")
    return map_rows(rows, make, T._parse_datatype_string("c long, shingles array<bigint>")).dropDuplicates(["c"])


def near_links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Verified links (a, b) between classes that connect each near-duplicate component.

    reps are the classes: c, doc_id, n_shingles, d1, d2, bands, sketch.
    """
    keys = reps.select("c", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("c").alias("head"), F.max("c").alias("tail")).where("head <> tail").select("key", "head")
    keys = materialize(keys.join(shared, "key").select("key", "c", "head"), "mh-keys")

    # 1. members with the first of their bucket; then, in buckets with unconnected members, with another one
    links = None
    for k in range(STAR_ROUNDS):
        pairs = keys.where("c <> head").select("c", "head") if k == 0 else keys.where("comp <> head_comp").select("c", "head")
        found = _star_links(docs, reps, pairs.distinct(), percent, k)
        links = found if links is None else materialize(links.unionByName(found), f"mh-links-{k}")
        comp = components(links, f"mh-stars-{k}")
        placed = keys.select("key", "c").join(comp, F.col("c") == F.col("node"), "left").select("key", "c", F.coalesce("component", "c").alias("comp"))
        another = F.min_by(F.struct(F.col("c").alias("head"), F.col("comp").alias("head_comp")), F.xxhash64("c", F.lit(k)))
        split = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n"), another.alias("h"))
        split = split.where("x <> y and n > 2").select("key", "h.head", "h.head_comp")
        keys = materialize(placed.join(split, "key"), f"mh-open-{k}")
        if keys.isEmpty():
            return links

    # 2. members of different components: sketches, then sets
    open_ = keys.select("key", "c", "comp")
    rows = materialize(open_.join(reps.select("c", "n_shingles", "bands", "sketch"), "c"), "mh-open-rows")  # read several times
    likely = _likely(_dealt(rows, F.lit(0)), percent)
    likely = materialize(likely.join(open_, ["key", "c"]), "mh-likely")
    sets = materialize(_sets(docs, reps.join(likely.select("c").distinct(), "c", "left_semi")), "mh-last-sets")
    full = materialize(likely.join(sets, "c").select("key", "c", "comp", "shingles"), "mh-last-rows")
    return links.unionByName(materialize(_compare(_dealt(full, F.size("shingles")), percent), "mh-last-links"))


def _star_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """Verified links among pairs (c, head): sizes and sketches first, then full sets, a head with blocks of its members."""
    slim = reps.select("c", "n_shingles", "sketch")
    first = slim.select(*[F.col(x).alias(f"h_{x}") for x in slim.columns])
    stars = pairs.join(slim, "c").join(first, F.col("head") == F.col("h_c"))
    differ = sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(F.col("h_sketch")[k])) for k in range(2 * _K // 64)), F.lit(0))
    sizes = 100 * F.least("n_shingles", "h_n_shingles") >= percent * F.greatest("n_shingles", "h_n_shingles")
    stars = materialize(stars.where(sizes & (2 * _K - differ >= least_equal_bits(percent))).select("c", "head", "n_shingles"), f"mh-pairs-{k}")
    used = stars.select("c").union(stars.select("head")).distinct()
    sets = materialize(_sets(docs, reps.join(used, "c", "left_semi")), f"mh-sets-{k}")
    per = stars.groupBy("head").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    )
    members = stars.join(per, "head").select("head", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("block"), "c").join(sets, "c")
    heads = per.select("head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(
        sets.select(F.col("c").alias("head"), "shingles"), "head"
    )
    shape = lambda d, left, c: d.select("head", "block", F.lit(left).alias("left"), F.col(c).alias("c"), F.col(c).alias("comp"), "shingles")
    return materialize(_compare(shape(heads, True, "head").unionByName(shape(members, False, "c")), percent), f"mh-star-links-{k}")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row.

    Documents without words (null or empty text) have n_shingles 0 and are linked with nothing.  A row
    with null doc_id has a null component and is kept.  Rows with words that share a doc_id share a component,
    whatever their texts.  An empty table gives no rows; other columns are ignored.
    """
    sigs = materialize(signatures(docs, percent), "mh-signatures")
    digest = ["n_shingles", "d1", "d2"]
    reps = sigs.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    reps = materialize(reps.withColumn("c", F.monotonically_increasing_id()), "mh-classes")
    links = near_links(docs, reps, percent)
    members = materialize(sigs.select("doc_id", *digest).join(reps.select("c", *digest), digest, "left").select("doc_id", "n_shingles", "c"), "mh-members")
    named = members.where("c is not null and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("doc_id", "x")
    links = links.unionByName(named.join(several, "doc_id").where("c <> x").select(F.col("c").alias("a"), F.col("x").alias("b")))
    comp = reps.select("c", "doc_id").join(components(links, "mh-final"), F.col("c") == F.col("node"), "left")
    comp = materialize(comp.select("c", "doc_id", F.coalesce("component", "c").alias("root")), "mh-roots")
    first = comp.groupBy("root").agg(F.min("doc_id").alias("over"))
    out = members.join(comp.join(first, "root").select("c", "over"), "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("over", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that are the first of their component; of rows that share a doc_id, each stays."""
    gone = near_duplicates(docs, percent).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 85 percent, by full five-word shingle sets."""
    return near_duplicates(table(spark, sf_dir, "documents"))
