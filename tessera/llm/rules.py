"""Quality rules: text statistics and a learned decision list over them.

Sequential covering (grow on one part of the labelled rows, prune on the other) learns ordered
conjunctions of thresholds that reject documents; they become one chained Spark conditional.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, table

#: Labelled rows that the learner fits on at most (documented bound), chosen by a hash of doc_id.
FIT_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, CUTS = 24, 4, 32
#: A rule must reach this precision on the rows it was not grown on.
MIN_PRECISION = 0.9

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_distinct_words", "n_lines"]
STATS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_has_word = re.compile(r"[^\x20\x09-\x0D]").search
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def repeated_words(words: list[str]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and distinct words."""
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(seq) < 4:
        return 0, len(ids)
    pairs = seq[:-1] * len(ids) + seq[1:]
    if len(ids) > 1_000_000:  # keep the product within 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * len(ids) + seq[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(seq), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum()), len(ids)


def count_text(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of COUNTS; all 0 for null or empty text."""
    if not text:
        return (0,) * len(COUNTS)
    words = _words(text)
    n_repeat, n_distinct = repeated_words(words)
    seen: set[str] = set()
    dup = 0
    lines = text.split("\n")
    for line in lines:
        if line in seen:
            dup += 1
        elif _has_word(line):
            seen.add(line)
    by = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return (len(words), sum(map(len, words)), int(by[_SYMBOLS].sum()), dup, n_repeat, int(by[65:91].sum()), int(by[33]), n_distinct, len(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document; one pass, no shuffle."""

    def make():
        return lambda cols: [(i, *count_text(t)) for i, t in zip(*cols)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, STATS)


#: Ratios that rules may test besides the plain counts: name, numerator, denominator.
RATIOS = [
    ("mean_word", "word_chars", "n_words"),
    ("symbol_rate", "n_symbols", "n_words"),
    ("dup_line_rate", "n_dup_lines", "n_lines"),
    ("repeat_rate", "n_repeat_words", "n_words"),
    ("upper_rate", "n_upper", "word_chars"),
    ("bang_rate", "n_bangs", "n_words"),
    ("distinct_rate", "n_distinct_words", "n_words"),
    ("line_words", "n_words", "n_lines"),
]
FEATURES = [*COUNTS, *[r[0] for r in RATIOS]]


def feature_columns() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {c: F.col(c).cast("double") for c in COUNTS} | {n: ratio(a, b) for n, a, b in RATIOS}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, frame: pd.DataFrame) -> np.ndarray:
        x = frame[self.feature].to_numpy()
        return x >= self.value if self.at_least else x <= self.value

    def column(self, features: dict[str, Column]) -> Column:
        c = features[self.feature]
        return c >= F.lit(self.value) if self.at_least else c <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"


def _cover(rule: list[Condition], frame: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(frame), bool)
    for c in rule:
        out &= c.holds(frame)
    return out


def _grow(frame: pd.DataFrame, bad: np.ndarray) -> list[Condition]:
    """Add the condition of the highest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    covered = np.ones(len(frame), bool)
    while len(rule) < MAX_CONDITIONS:
        p0, n0 = int((covered & bad).sum()), int((covered & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f in FEATURES:
            x = frame[f].to_numpy()
            for v in np.unique(np.quantile(x[covered], np.linspace(0, 1, CUTS + 1), method="nearest")):
                for at_least in (True, False):
                    hit = covered & (x >= v if at_least else x <= v)
                    p = int((hit & bad).sum())
                    if p:
                        gain = p * (np.log2(p / int(hit.sum())) - base)
                        if gain > best[0]:
                            best = (gain, Condition(f, at_least, float(v)))
        if best[1] is None:
            break
        rule.append(best[1])
        covered &= best[1].holds(frame)
    return rule


def _prune(rule: list[Condition], frame: pd.DataFrame, bad: np.ndarray) -> tuple[list[Condition], float]:
    """The prefix of the rule that is worth most on rows it was not grown on, and its precision there."""
    best = (-2.0, rule, 0.0)
    for k in range(len(rule), 0, -1):
        hit = _cover(rule[:k], frame)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / (p + n) if p + n else 0.0)
    return best[1], best[2]


def learn(frame: pd.DataFrame, bad: np.ndarray, held_out: np.ndarray) -> list[list[Condition]]:
    """Rules in order: grow on the rows not held out, prune on the others, remove what is covered, repeat."""
    rules: list[list[Condition]] = []
    alive, aside = np.ones(len(frame), bool), np.zeros(len(frame), bool)
    for _ in range(2 * MAX_RULES):
        g, h = alive & ~held_out & ~aside, alive & held_out
        if len(rules) == MAX_RULES or not bad[g].any():
            break
        grown = _grow(frame[g], bad[g])
        if not grown:
            break
        rule, precision = _prune(grown, frame[h], bad[h])
        if precision < MIN_PRECISION:  # not to be trusted: set what it was grown for aside and look for others
            aside |= _cover(grown, frame) & bad
            continue
        rules.append(rule)
        alive &= ~_cover(rule, frame)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one ordered conditional: the first rule that holds rejects, else keep."""
    features = feature_columns()
    out: Column | None = None
    for rule in rules:
        cond = rule[0].column(features)
        for c in rule[1:]:
            cond = cond & c.column(features)
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learn from at most FIT_ROWS labelled rows that pass the base check; a document labelled more than once counts
    by its lowest quality.  A hash threshold picks the rows, so that no task sends more than its share."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, 0.95 * FIT_ROWS / max(1, one.count()))
    one = one.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = (
        stats.dropDuplicates(["doc_id"]).join(one, "doc_id").where(~base_failed())
        .select("quality", F.xxhash64("doc_id").alias("h"), "doc_id", *[c.alias(n) for n, c in feature_columns().items()])
        .orderBy("h", "doc_id").limit(FIT_ROWS).toPandas()
    )
    if rows.empty:
        return []
    return learn(rows[FEATURES], rows["quality"].to_numpy() == 0, rows["h"].to_numpy() % 3 == 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base check and learned verdict of each document.

    Null or empty text: all counts 0, base_failed.  Null doc_ids and repeated rows are judged like any
    row; an empty table gives an empty result; without labels every document that passes the base check
    is kept; other columns are ignored.
    """
    stats = materialize(statistics(docs), "rule-stats")
    rules = fit(stats, labels)
    failed = base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, judged by the base check and the decision list learned from `labels`."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
