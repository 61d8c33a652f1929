"""Quality classifier: an interpolated modified Kneser-Ney model over characters.

Counts of the trusted text, continuation counts, discounts and back-off weights are DataFrames keyed by
n-gram, so every step of the fit is a combined aggregate or a join sharded by n-gram.  Scoring joins counts too:
texts are packed into chunks (one compressed byte a character), each chunk sends its distinct n-grams once, their log probabilities are found by joins
of the distinct n-grams of all chunks with the model, and come back to the chunks that hold them - so neither the
model nor a document's n-grams are ever in one place, and a common n-gram counts once a chunk.  A model of at most
HELD_NGRAMS n-grams is sent to the tasks instead, which shuffles no text and gives the same numbers.  Log probabilities
are whole multiples of 2**-24: their sums do not depend on any order.  A document's perplexity is compared with a high quantile over trusted documents of its language and length band;
text less likely than that is rejected.  The quantiles come from trusted documents that the model was
not fitted on, as seen ones look likelier than they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..ship import ship
from .common import byte_slices, map_rows, materialize, table

ORDER = 5
#: n-grams that are sent to the scoring tasks at most (24 bytes each); a larger model is joined by n-gram.  Both ways
#: give the same numbers to the last bit.
HELD_NGRAMS = 4_000_000
#: Characters of a chunk (a longer text is a chunk of its own); characters whose n-grams are held at once.
CHUNK_CHARS, PIECE_CHARS = 32 << 20, 1 << 20
#: Steps of a log probability to one.
STEPS = 1 << 24
#: Trusted ids that are broadcast at most; beyond, the trusted texts are found by a shuffled join.
BROADCAST_IDS = 1_000_000
#: One in so many trusted documents, by a hash of its id, is held out of the counts and sets the thresholds.
HELD_OUT = 5
#: Share of held-out trusted documents above the threshold; the threshold is raised by 1 % and, as a quantile of
#: n documents is only so sure, by FEW / sqrt(n).
TAIL, SLACK, FEW = 0.004, 1.01, 0.5
#: Trusted documents that a language's length band needs for thresholds of its own.
BAND_DOCS = 50

# Characters with a symbol of their own.
_OWN = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ \n.,-'\"!?:;()#*$%&|<>/_=+@"
_UPPER, _DIGIT, _LETTER, _OTHER = (len(_OWN) + k for k in range(1, 5))
#: Number base of n-gram keys; symbol 0 pads the beginning of a text.
BASE = 96
assert _OTHER < BASE


def _symbols() -> np.ndarray:
    lut = np.full(0x10000, _OTHER, np.uint8)
    for cp in range(0x10000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        if c.isupper():
            lut[cp] = _UPPER
        elif c.isdigit():
            lut[cp] = _DIGIT
        elif c.isalpha():
            lut[cp] = _LETTER
    for k, c in enumerate(_OWN):
        lut[ord(c)] = k + 1
    return lut


_LUT: list[np.ndarray] = []


def symbols_of(text: str) -> np.ndarray:
    """The symbol of each character."""
    if not _LUT:
        _LUT.append(_symbols())
    return _LUT[0][np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)]


def _keys(s: np.ndarray) -> np.ndarray:
    """The ORDER-gram key ending at each symbol but the first ORDER - 1."""
    s = s.astype(np.int64)
    out = s[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        out += s[ORDER - 1 - k : len(s) - k] * BASE**k
    return out


_PAD = np.zeros(ORDER - 1, np.uint8)


def keys_of(text: str) -> np.ndarray:
    """The ORDER-gram key ending at each character."""
    return _keys(np.concatenate([_PAD, symbols_of(text)]))


def pieces_of(symbols: np.ndarray):
    """(start, keys) of a stream of symbols of any length, some at a time; it begins with ORDER - 1 pads."""
    for at in range(ORDER - 1, len(symbols), PIECE_CHARS):
        yield at, _keys(symbols[at - ORDER + 1 : at + PIECE_CHARS])


def _joined(texts):
    """The keys of texts, of many short ones together."""
    short = [keys_of(t) for t in texts if t and len(t) <= PIECE_CHARS]
    if short:
        yield np.concatenate(short)
    for t in texts:
        if t and len(t) > PIECE_CHARS:
            yield from (keys for _, keys in pieces_of(np.concatenate([_PAD, symbols_of(t)])))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(key, n) of the ORDER-grams of all texts; each task sends a partial count once."""

    def run(batches):
        held, n_held = [], 0

        def reduce():
            nonlocal held, n_held
            keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            uniq, inverse = np.unique(keys, return_inverse=True)
            held = [(uniq, np.bincount(inverse, counts, len(uniq)).astype(np.int64))]
            n_held = len(uniq)

        for batch in batches:
            for part in byte_slices(batch, 128, PIECE_CHARS):
                for keys in _joined(part.column(0).to_pylist()):
                    held.append(np.unique(keys, return_counts=True))
                    n_held += len(held[-1][0])
                    if n_held > 3_000_000:
                        reduce()
                        if n_held > 2_000_000:  # too many distinct ones to hold: send them
                            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["key", "n"])
                            held, n_held = [], 0
        if held:
            reduce()
            yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["key", "n"])

    ship(docs.sparkSession)
    part = docs.select("text").mapInArrow(run, "key long, n long")
    return part.groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    n = {r["n"]: r["c"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # 4 rows at most
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def _steps(p):
    """The logarithm in whole steps."""
    return F.round(F.log(p) * STEPS).cast("long")


def fit(trusted: DataFrame) -> DataFrame:
    """The model: (len, key, logp, logb) with the log probability of each n-gram and, where the n-gram is a
    context, the log back-off weight (null if it is none), in whole steps.  Unigrams back off to a uniform distribution."""
    counts = [materialize(count_ngrams(trusted), "kn-counts")]  # for len ORDER; then continuation counts
    for k in range(ORDER - 1, 0, -1):
        shorter = counts[-1].groupBy((F.col("key") % BASE**k).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        counts.append(materialize(shorter, f"kn-continuations-{k}"))
    counts.reverse()
    prob: DataFrame | None = None
    levels, weights = [], []
    for k, c in enumerate(counts, 1):
        d1, d2, d3 = _discounts(c)
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        c = c.select("key", "n", d.alias("d"), (F.col("key") / BASE).cast("long").alias("h"), (F.col("key") % BASE ** (k - 1)).alias("low"))
        h = c.groupBy("h").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        gamma = F.col("mass") / F.col("total")
        c = c.join(h, "h").select("key", "low", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), gamma.alias("g"))
        if prob is None:
            c = c.select("key", (F.col("p") + F.col("g") / BASE).alias("p"))
        else:
            lower = prob.select(F.col("key").alias("low"), F.col("p").alias("q"))
            c = c.join(lower, "low").select("key", (F.col("p") + F.col("g") * F.col("q")).alias("p"))
        prob = materialize(c, f"kn-prob-{k}")
        levels.append(prob.select(F.lit(k).alias("len"), "key", _steps("p").alias("logp")))
        weights.append(h.select(F.lit(k - 1).alias("len"), F.col("h").alias("key"), _steps(gamma).alias("logb")))
    out = weights[0].select("len", "key", F.lit(None).cast("long").alias("logp"), "logb")
    for k in range(1, ORDER + 1):
        level = levels[k - 1]
        if k < ORDER:
            level = level.join(weights[k], ["len", "key"], "full")
        else:
            level = level.withColumn("logb", F.lit(None).cast("long"))
        out = out.unionByName(level.select("len", "key", "logp", "logb"))
    return materialize(out, "kn-model")


def backed_off(keys: DataFrame, model: DataFrame) -> DataFrame:
    """(key, logp) of distinct ORDER-grams: the log probability of the last symbol, backing off where an n-gram is unseen.

    One join a length; a shorter n-gram has at most BASE**2 of the keys, and n-grams of up to two symbols are so few that
    they are broadcast.
    """
    now = keys.select("key", F.lit(0).cast("long").alias("sum"), F.lit(False).alias("done"))
    few = lambda k, d: F.broadcast(d) if k <= 2 else d  # noqa: E731  (at most BASE**2 rows)
    for k in range(ORDER, 0, -1):
        own = few(k, model.where((F.col("len") == k) & F.col("logp").isNotNull()).select(F.col("key").alias("own"), "logp"))
        ctx = few(k - 1, model.where((F.col("len") == k - 1) & F.col("logb").isNotNull()).select(F.col("key").alias("ctx"), "logb"))
        tail = F.col("key") % BASE**k
        now = now.join(own, ~F.col("done") & (tail == F.col("own")), "left").join(
            ctx, ~F.col("done") & F.col("logp").isNull() & ((tail / BASE).cast("long") == F.col("ctx")), "left"
        )
        step = F.when(F.col("done"), 0).otherwise(F.coalesce("logp", F.coalesce("logb", F.lit(0))))
        now = now.select("key", (F.col("sum") + step).alias("sum"), (F.col("done") | F.col("logp").isNotNull()).alias("done"))
    rest = F.when(F.col("done"), 0).otherwise(round(-math.log(BASE) * STEPS))
    return now.select("key", (F.col("sum") + rest).alias("logp"))


PACKED = "chunk long, doc_id array<bigint>, lang array<string>, n array<bigint>, body binary"
SCORES = "doc_id long, lang string, n_symbols long, logp long"


def _pack(batches):
    """Rows (doc_id, lang, text) as chunks: the symbols of all texts, each behind ORDER - 1 pads, compressed."""
    from pyspark import TaskContext

    schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("body", pa.binary())])
    chunk = TaskContext.get().partitionId() << 32
    ids, langs, parts, size = [], [], [], 0

    def flush():
        body = np.concatenate([x for p in parts for x in (_PAD, p)])
        packed = len(body).to_bytes(8, "little") + pa.compress(body.tobytes(), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((chunk, ids, langs, [len(p) for p in parts], packed), schema)], schema=schema
        )

    for batch in batches:
        for part in byte_slices(batch):
            for i, lang, text in zip(*(c.to_pylist() for c in part.columns)):
                own = symbols_of(text or "")
                if parts and size + len(own) > CHUNK_CHARS:
                    yield flush()
                    ids, langs, parts, size, chunk = [], [], [], 0, chunk + 1
                ids.append(i)
                langs.append(lang)
                parts.append(own)
                size += len(own)
    if parts:
        yield flush()


def _unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True), np.uint8)


def _ngrams(batches):
    """Each chunk's distinct n-grams, a piece's first pass at a time."""
    for batch in batches:
        for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
            symbols, held, n_held = _unpack(body.as_py()), [], 0
            for at, keys in pieces_of(symbols):
                held.append(np.unique(keys[symbols[at : at + PIECE_CHARS] > 0]))
                n_held += len(held[-1])
                if n_held > 4 * PIECE_CHARS:
                    held, n_held = [np.unique(np.concatenate(held))], 0
            keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk, np.int64)), pa.array(keys)], names=["chunk", "key"])


def _sums(key, packed, told):
    """Scores of a chunk's texts from its n-grams' log probabilities."""
    known, logp = told["key"].to_numpy(), told["logp"].to_numpy()
    order = np.argsort(known)
    known, logp = known[order], logp[order]
    out = {"doc_id": [], "lang": [], "n_symbols": [], "logp": []}
    for row in packed.to_pylist():
        symbols = _unpack(row["body"])
        each = np.zeros(len(symbols), np.int32)  # (a log probability is above -100)
        for at, keys in pieces_of(symbols):
            real = np.flatnonzero(symbols[at : at + PIECE_CHARS])
            each[at + real] = logp[np.searchsorted(known, keys[real])]
        at = 0
        for n in row["n"]:
            at += ORDER - 1
            out["logp"].append(int(each[at : at + n].sum(dtype=np.int64)))
            at += n
        out["doc_id"] += row["doc_id"]
        out["lang"] += row["lang"]
        out["n_symbols"] += row["n"]
    kinds = {"lang": pa.string()}
    return pa.table({name: pa.array(v, kinds.get(name, pa.int64())) for name, v in out.items()})


class Scorer:
    """The model as sorted arrays by n-gram length."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, ...]]):
        self.tables = tables

    def _find(self, k: int, keys: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each n-gram of k symbols is known, and its value where it is."""
        known, value = self.tables[k][2 * column : 2 * column + 2]
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, value[at]

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log probability in steps of each ORDER-gram's last symbol, backing off where an n-gram is unseen."""
        out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            own = keys[open_] % BASE**k
            hit, p = self._find(k, own, 0)
            out[open_[hit]] += p[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
            some, b = self._find(k - 1, own[~hit] // BASE, 1)
            out[open_[some]] += b[some]
        out[open_] += round(-math.log(BASE) * STEPS)
        return out


def score_held(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The scores with the model in every task: no text is shuffled."""
    rows = model.toArrow()  # at most HELD_NGRAMS rows
    length, tables = rows["len"].to_numpy(), {}
    for k in range(ORDER + 1):
        part = []
        for name in ("logp", "logb"):
            own = rows.filter(pa.array(length == k))
            own = own.filter(own[name].is_valid())
            order = np.argsort(own["key"].to_numpy(), kind="stable")
            part += [own["key"].to_numpy()[order], own[name].to_numpy()[order]]
        tables[k] = tuple(part)
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def make():
        scorer = Scorer(held.value)

        def kernel(cols):
            out = []
            short = [k for k, t in enumerate(cols[2]) if len(t or "") <= PIECE_CHARS]
            keys = [keys_of(cols[2][k] or "") for k in short]
            every, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            total = np.concatenate([[0], np.cumsum(scorer.logp(every)[inverse])])
            ends = np.cumsum([0, *[len(x) for x in keys]])
            sums = dict(zip(short, np.diff(total[ends]).tolist()))
            for k, (i, lang, t) in enumerate(zip(*cols)):
                if k not in sums:
                    sums[k] = sum(int(scorer.logp(x).sum()) for _, x in pieces_of(np.concatenate([_PAD, symbols_of(t)])))
                out.append((i, lang, len(t or ""), sums[k]))
            return out

        return kernel

    return map_rows(docs.select(F.col("doc_id").cast("long"), "lang", "text"), make, _parse_datatype_string(SCORES), slice_rows=64)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, number of symbols and log probability in steps of every document row, by sharded joins."""
    ship(docs.sparkSession)
    packed = materialize(docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(_pack, PACKED), "kn-packed")
    grams = materialize(packed.select("chunk", "body").mapInArrow(_ngrams, "chunk long, key long"), "kn-grams")
    told = grams.join(backed_off(grams.select("key").distinct(), model), "key").select("chunk", "key", "logp")
    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_sums, SCORES)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose every label says good and not toxic (an unknown toxicity counts as not toxic)."""
    per = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")
    )
    return per.where("q = 1 and t = 0").select("doc_id")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept of every document row.

    The threshold is a quantile of the held-out trusted documents' perplexities by language and length band
    (a doubling of length); bands with few such documents use their language's, languages with few use all.
    Null or empty text has a null perplexity and is rejected; a null language is a language of its own;
    repeated rows are judged each; an empty table gives no rows; without held-out trusted documents every
    non-empty document is kept.  Other columns are ignored.
    """
    ids = materialize(trusted_ids(labels).withColumn("held_out", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "kn-trusted")
    one = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    trusted = docs.select(F.col("doc_id").cast("long"), "text").join(one.where("not held_out"), "doc_id", "left_semi")
    model = fit(trusted)
    scores = materialize((score_held if model.count() <= HELD_NGRAMS else score)(docs, model), "kn-scores")
    scores = scores.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "n_symbols",
        F.when(F.col("n_symbols") > 0, F.exp(-(F.col("logp") / STEPS) / F.col("n_symbols"))).alias("perplexity"),
        F.floor(F.log2(F.greatest("n_symbols", F.lit(1)))).cast("int").alias("band"),
    )
    good = scores.where("perplexity is not null").join(ids.where("held_out"), "doc_id", "left_semi")
    cube = good.groupingSets([["lang", "band"], ["lang"], []], "lang", "band").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        ((SLACK + FEW / F.sqrt(F.count(F.lit(1)))) * F.percentile_approx("perplexity", F.lit(1 - TAIL), 20_000)).alias("most"),
    )
    cube = materialize(cube.where(F.col("n") >= F.when(F.col("level") == 3, 1).otherwise(BAND_DOCS)), "kn-quantiles")
    by = lambda level, *on: cube.where(F.col("level") == level).select(*on, F.col("most").alias(f"m{level}"))
    out = scores.join(by(0, "lang", "band"), ["lang", "band"], "left").join(by(1, "lang"), "lang", "left").crossJoin(
        by(3).agg(F.first("m3").alias("m3"))  # one row
    )
    most = F.coalesce("m0", "m1", "m3")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= most, F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", most.alias("threshold"), keep.alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of the trusted text, its thresholds and verdict."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
