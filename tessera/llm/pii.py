"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Seed entities are the base hits and, as seeds of secrets, hexadecimal digests.  The words and marks around them
induce lexical patterns, whatever the shape of the value; Spark scores the graph of patterns and instances in
rounds - a pattern by how many of its instances are known, an instance by the patterns that extract it - and
confident patterns mark identifiers no base pattern finds.  A digest is reported only where a confident pattern
extracts it; one behind a word for checksums is no seed, so such contexts lose confidence.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, map_rows, materialize, table

# The kinds in the order of the report, the learned kind last.
KINDS = ["email", "ip", "card", "phone", "id"]
ROUNDS, MIN_SUPPORT, MIN_PATTERN, MIN_INSTANCE = 3, 5, 0.8, 0.8

_mail_tail = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").finditer
_mail_head = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digit = re.compile("[0-9]").search
_not_digit = re.compile("[^0-9]+")
#: What may be an identifier that the base misses: a run of letters and digits, hyphens, dots, slashes and underscores
#: inside, of six characters with three digits; 7 to 19 digits with spaces and brackets; a quoted run with letters and
#: digits; a name or host at an "@"; a digest.
_candidate = re.compile(r"[0-9A-Za-z](?:[.\x2d/_]?[0-9A-Za-z])*+").finditer
_spaced = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])*+(?![0-9A-Za-z])").finditer
_spacing = re.compile(r"[\x20()+]").search
_quoted = re.compile(r"""(?<=["'])[^\s"']{6,128}+(?=["'])""").finditer
_handle = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9_-]{2,}+").finditer
_digest = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])").finditer
_letter = re.compile("[A-Za-z]").search
# Words before a digest that is no secret.
CHECKSUMS = frozenset("checksum commit digest etag fingerprint hash md5 md revision rev sha".split())
#: Characters of a context from which its digest stands for it.
LONG_CONTEXT = 64
#: Confident patterns that are sent to the redacting tasks at most; beyond, spans are joined to the texts by row.
HELD_PATTERNS = 1_000_000

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
FOUND = (
    f"row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {SPAN}, "
    "edges array<struct<start:bigint,end:bigint,pattern:string,instance:binary,seed:boolean,base:boolean>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c)
        if k % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping by kind, sorted."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        for m in _mail_tail(text):
            at = m.start()
            while at > done and text[at - 1] in _mail_head:
                at -= 1
            if at < m.start():
                out.append((at, 0, m.end()))
                done = m.end()
    if _digit(text):
        for m in _ip(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone(text):
                if 10 <= len(_not_digit.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def render(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of possible identifiers that touch no base span, non-overlapping, sorted."""
    spans: list[tuple[int, int]] = []
    if '"' in text or "'" in text:
        spans += [m.span() for m in _quoted(text) if _digit(m[0]) and _letter(m[0])]
    spans += [m.span() for m in _digest(text)]
    if "@" in text:
        spans += [m.span() for m in _handle(text)]
    if _digit(text):
        for m in _spaced(text):
            if _spacing(m[0]) and 7 <= len(_not_digit.sub("", m[0])) <= 19:
                spans.append(m.span())
        spans += [m.span() for m in _candidate(text) if m.end() - m.start() >= 6 and len(_not_digit.sub("", m[0])) >= 3]
    spans.sort(key=lambda x: (x[0], -x[1]))
    taken = sorted((s, e) for s, _, e in base)
    out: list[tuple[int, int]] = []
    k = done = 0
    for s, e in spans:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= done and not any(a < e and s < b for a, b in taken[k : k + 4]):
            out.append((s, e))
            done = e
    return out


def _side(text: str, at: int, step: int) -> list[str]:
    """Up to two words of the line from text[at] on in the given direction, each with the marks before it, nearest first:
    [marks, word, marks, word].  A word is a run of letters in lower case or a run of digits, written 0; equal marks in a
    row count once, white space not at all; the line's edge is a word, ^ or $."""
    out, marks, n = [], "", len(text)
    while len(out) < 4:
        c = text[at] if 0 <= at < n else "\n"
        if c == "\n":
            return [*out, marks, "^" if step < 0 else "$"]
        if not c.isalnum():
            if not c.isspace() and marks[-1:] != c:
                marks += c
            at += step
            continue
        start, kind = at, c.isalpha()
        while 0 <= at < n and text[at].isalnum() and text[at].isalpha() == kind:
            at += step
        out += [marks, (text[start:at] if step > 0 else text[at + 1 : start + 1]).lower() if kind else "0"]
        marks = ""
    return out


def contexts(text: str, s: int, e: int) -> list[str]:
    """The lexical patterns around text[s:e]: two words before, two after, one on each side, and a label before.

    Words are of the value's own line and whole, however long; a single word on one side says too little unless a
    colon, an equals sign or a number sign makes it a label, and so do marks without any letter.
    """
    left, right = _side(text, s - 1, -1), _side(text, e, 1)
    out = []
    if len(left) > 2:
        out.append("<" + " ".join(reversed(left)))
    if len(right) > 2:
        out.append(">" + " ".join(right))
    if (left[1], right[1]) != ("^", "$"):
        out.append(f"|{left[1]} {left[0]} _ {right[0]} {right[1]}")
    if any(c in left[0] for c in ":=#"):
        out.append(":" + left[1])
    out = [p for p in out if any(map(str.isalpha, p))]
    return [p if len(p) <= LONG_CONTEXT else hashlib.md5(p.encode("utf-8", "surrogatepass")).hexdigest() for p in out]


def edges(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, bytes, bool, bool]]:
    """(start, end, pattern, instance, seed, base) for the contexts of each seed and candidate."""
    out = []
    digests = {m.span() for m in _digest(text) if _digit(m[0]) and _letter(m[0])}
    for s, e, is_base in [(s, e, True) for s, _, e in base] + [(s, e, False) for s, e in candidates(text, base)]:
        seed = is_base or (s, e) in digests and not CHECKSUMS.intersection(_side(text, s - 1, -1))
        instance = hashlib.md5(text[s:e].encode("utf-8", "surrogatepass")).digest()
        out += [(s, e, pattern, instance, seed, is_base) for pattern in contexts(text, s, e)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base counts and spans, and the edges of the pattern-instance graph.  Rows are numbered."""

    def make():
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40

        def kernel(cols):
            nonlocal row
            rows = []
            for i, text in zip(*cols):
                text = text or ""
                base = base_spans(text)
                n = [0] * 4
                for _, kind, _ in base:
                    n[kind] += 1
                named = lambda s, k, e: {"start": s, "kind": k, "end": e}
                names = ("start", "end", "pattern", "instance", "seed", "base")
                rows.append(
                    (
                        row, i, *n, hashlib.sha256(render(base).encode()).hexdigest(), [named(*x) for x in base],
                        [dict(zip(names, x)) for x in edges(text, base)],
                    )
                )
                row += 1
            return rows

        return kernel

    schema = T._parse_datatype_string(FOUND)
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, schema)


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The confident patterns (pattern, confidence) after the given rounds of scoring the graph.

    A pattern's confidence is the share of known ones among its distinct instances (with MIN_SUPPORT known
    ones at least); an instance becomes known when 1 - prod(1 - confidence) over its confident patterns
    reaches MIN_INSTANCE.  All counts are over all documents.
    """
    graph = materialize(
        found.select(F.explode("edges").alias("e")).groupBy(F.col("e.pattern").alias("pattern"), F.col("e.instance").alias("instance"))
        .agg(F.max("e.seed").alias("seed")), "pii-graph",
    )
    # a pattern with fewer instances than its support can never count
    frequent = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SUPPORT).select("pattern")
    graph = materialize(graph.join(frequent, "pattern", "left_semi"), "pii-frequent")
    known = graph.where("seed").select("instance").distinct()
    good = None
    for k in range(rounds):
        marked = graph.join(known.withColumn("known", F.lit(True)), "instance", "left")
        score = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"))
        good = score.where((F.col("n_known") >= MIN_SUPPORT) & (F.col("n_known") >= MIN_PATTERN * F.col("n"))).select(
            "pattern", (F.col("n_known") / F.col("n")).alias("confidence")
        )
        good = materialize(good, f"pii-patterns-{k}")
        if k + 1 < rounds:
            reached = graph.join(good, "pattern").groupBy("instance").agg(
                (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("belief")
            )
            more = reached.where(F.col("belief") >= MIN_INSTANCE).select("instance")
            known = materialize(known.union(more).distinct(), f"pii-known-{k}")
    return good


def _learned(found: DataFrame, good: DataFrame) -> DataFrame:
    """(row, learned): the spans that confident patterns mark."""
    return (
        found.select("row", F.explode("edges").alias("e")).where(~F.col("e.base")).select("row", "e.start", "e.end", "e.pattern")
        .join(good, "pattern").groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end"))).alias("learned"))
    )


def find(docs: DataFrame) -> DataFrame:
    """Base and learned spans of each document row: doc_id, counts, base_sha256, spans (array).

    Null text counts as empty; null doc_ids and repeated rows each give a row; an empty table gives none;
    other columns are ignored.  Learned spans have kind ``id`` and never touch base spans.
    """
    found = materialize(scan(docs), "pii-scan")
    spans = F.array_sort(F.concat("base", F.coalesce("learned", F.array().cast(SPAN))))
    return found.join(_learned(found, bootstrap(found)), "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans")
    )


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (start, kind, end) replaced by its kind; of overlapping ones by the first."""
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
            at = e
    return "".join([*out, text[at:]])


def _rewritten(part: pa.RecordBatch, change, drop=()) -> pa.RecordBatch:
    """The batch with the texts that change(text, row number) gives; n_chars follows where a text differs."""
    kinds = {f.name: f.type for f in part.schema}
    columns = {n: c for n, c in zip(part.schema.names, part.columns) if n not in drop}
    old = columns["text"].to_pylist()
    new = [t and change(t, k) for k, t in enumerate(old)]
    columns["text"] = pa.array(new, kinds["text"])
    if "n_chars" in columns:
        n = [len(b) if a != b else m for a, b, m in zip(old, new, columns["n_chars"].to_pylist())]
        columns["n_chars"] = pa.array(n, kinds["n_chars"])
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _redact_held(docs: DataFrame, patterns: list[str]) -> DataFrame:
    held, kind = docs.sparkSession.sparkContext.broadcast(frozenset(patterns)), KINDS.index("id")

    def run(batches):
        good = held.value

        def change(text: str, _: int) -> str:
            base = base_spans(text)
            ids = [(s, kind, e) for s, e in candidates(text, base) if not good.isdisjoint(contexts(text, s, e))] if good else []
            return redacted(text, base + ids)

        for batch in batches:
            for part in byte_slices(batch):
                yield _rewritten(part, change)

    return docs.mapInArrow(run, docs.schema)


def _redact_joined(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The same by joins: texts are numbered and written, so each row's spans find it again and no key is hot."""
    texts = materialize(docs.withColumn("_pii_row", F.monotonically_increasing_id()), "pii-texts")

    def make():
        return lambda cols: [
            (row, [dict(zip(("start", "kind", "end"), x)) for x in base], [{"start": s, "end": e, "pattern": p} for s, e, p, _, _, is_base in edges(t or "", base) if not is_base])
            for row, t in zip(*cols)
            for base in [base_spans(t or "")]
        ]

    schema = T._parse_datatype_string(f"row long, base {SPAN}, marks array<struct<start:bigint,end:bigint,pattern:string>>")
    found = materialize(map_rows(texts.select("_pii_row", "text"), make, schema), "pii-marks")
    learned = found.select("row", F.explode("marks").alias("e")).select("row", F.col("e.start").alias("start"), F.col("e.end").alias("end"), "e.pattern")
    learned = learned.join(good.select("pattern"), "pattern").groupBy("row").agg(
        F.collect_set(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("learned")
    )
    spans = found.join(learned, "row", "left").select(F.col("row").alias("_pii_row"), F.concat("base", F.coalesce("learned", F.array().cast(SPAN))).alias("_pii_spans"))
    out = texts.join(spans.where(F.size("_pii_spans") > 0), "_pii_row", "left")

    def put(batches):
        for batch in batches:
            for part in byte_slices(batch):
                spans = [[(x["start"], x["kind"], x["end"]) for x in v or []] for v in part.column("_pii_spans").to_pylist()]
                yield _rewritten(part, lambda t, k, spans=spans: redacted(t, spans[k]), drop=("_pii_row", "_pii_spans"))

    return out.mapInArrow(put, docs.schema)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in angle brackets; n_chars follows.

    Rows whose text holds none stay as they are.  Overlapping spans are replaced once, by the first.  The texts are
    read once more with the confident patterns at hand and go through no shuffle.
    """
    good = bootstrap(materialize(scan(docs), "pii-scan"))
    if good.count() <= HELD_PATTERNS:
        return _redact_held(docs, [r["pattern"] for r in good.select("pattern").collect()])
    return _redact_joined(docs, good)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base counts and digest, and all spans."""
    names = F.array(*map(F.lit, KINDS))
    told = F.transform(
        "spans",
        lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
    )
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(told, ",").alias("spans")
    )
