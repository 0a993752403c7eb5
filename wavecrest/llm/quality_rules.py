"""Quality rules: a decision list learned from labelled statistics, as Spark conditional expressions.

Sequential covering: a conjunction of thresholds grows by information gain on two thirds of the
labelled rows and is pruned on the rest; the rows that it covers go, and the next rule is learned,
until a rule isn't precise enough on the pruning rows.  The list is emitted as ordered F.when
conditions over the statistics' columns.

Null text: no words.  Empty text, and any text of fewer than 20 words, fails the base rules.  A text
of any length is read whole.  Rows without a label take no part in learning; repeated rows count each,
of one id ROWS_PER_ID at most while learning.  The rows are put in order by their values first, so the
list doesn't depend on the order of the table; of thresholds that gain the same the first column's
lowest is taken.  Other columns are ignored.  With no usable labels the list is empty and the base
rules decide.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.llm.common import slices, table

#: At most so many labelled rows are used for learning, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: Rows of one labelled id that are used, so the sample is bounded in rows also if ids repeat.
ROWS_PER_ID = 2
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "mark_ratio"]
SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
UPPER, DIGITS, MARKS = bytes(range(65, 91)), b"0123456789", b"!?|"
ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) for k in range(8)]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words that stand in a window of words that is found twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        x = ids[k : k + n] + ODD[k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h + (x ^ (x >> np.uint64(27)))) * ODD[k]
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    edge = np.zeros(len(ids) + 1, np.int64)
    at = order[twice]
    edge[at] += 1
    np.subtract.at(edge, at + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base statistics and the ratios, in the order of BASE and RATIOS."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    repeat = repeated_words(ids)
    distinct = len(set(words))
    size = len(data) or 1
    upper, digit, mark = (size - len(data.translate(None, x)) if data else 0 for x in (UPPER, DIGITS, MARKS))
    base = n, chars, symbols, dup, repeat
    return *base, chars / n if n else 0.0, symbols / chars if chars else 0.0, dup / len(lines) if lines else 0.0, repeat / n if n else 0.0, distinct / n if n else 0.0, upper / size, digit / size, mark / size


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with all statistics, one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*(statistics(t.as_py()) for t in part.column(1)), strict=True))
                arrays = [part.column(0), *(pa.array(c, pa.int64() if k < len(BASE) else pa.float64()) for k, c in enumerate(cols))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *BASE, *RATIOS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool
    value: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.column)]
        return v > self.value if self.above else v <= self.value

    def expression(self) -> Column:
        return F.col(self.column) > self.value if self.above else F.col(self.column) <= self.value

    def __str__(self) -> str:
        return f"{self.column} {'>' if self.above else '<='} {self.value!r}"


def _covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        if not p or not n:
            break
        was = np.log2(p / (p + n))
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            v = x[inside, k]
            order = np.argsort(v, kind="stable")
            s, t = v[order], y[inside][order]
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            pos = np.cumsum(t)[cut]
            tot = cut + 1
            for above in (False, True):
                a, b = (p - pos, p + n - tot) if above else (pos, tot)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(a > 0, a * (np.log2(a / b) - was), 0.0)
                j = int(np.argmax(g))
                if g[j] > gain:
                    gain, best = float(g[j]), Condition(name, above, float((s[cut[j]] + s[cut[j] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, longest: int = 4, most: int = 12, seed: int = 3) -> list[list[Condition]]:
    """Ordered rules for bad rows; each reaches the precision on rows that it wasn't grown on."""
    turn = np.random.default_rng(seed).permutation(len(x)) % 3 < 2
    gx, gy, px, py = x[turn], bad[turn], x[~turn], bad[~turn]
    rules: list[list[Condition]] = []
    while len(rules) < most and gy.any():
        rule = _grow(gx, gy, names, longest)

        def worth(r: list[Condition], px=px, py=py) -> float:
            c = _covers(r, px, names)
            return (py[c].sum() + 0.0 - (~py[c]).sum()) / c.sum() if r and c.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covers(rule, px, names)
        if not rule or c.sum() < 3 or py[c].mean() < precision:
            break
        rules.append(rule)
        g = ~_covers(rule, gx, names)
        gx, gy, px, py = gx[g], gy[g], px[~c], py[~c]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: true keeps the row."""
    out = None
    for rule in rules:
        cond = rule[0].expression()
        for c in rule[1:]:
            cond = cond & c.expression()
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """At most that many labelled ids, spread by a hash; one row for an id."""
    rows = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sampled_rows(rows: DataFrame, sample: DataFrame, order: Column) -> DataFrame:
    """The sample's rows with their labels, ROWS_PER_ID of each id at most, the first ones in this order.

    The sample is bounded, so it may be broadcast; a window's rank limit is applied before its shuffle.
    """
    window = Window.partitionBy("doc_id").orderBy(order)
    return rows.join(F.broadcast(sample), "doc_id").withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= ROWS_PER_ID).drop("_rank")


def fit_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Rules for labels of quality 0, from the bounded sample, in an order of its own."""
    sample = labelled_sample(labels.where("quality is not null"))
    stats = text_statistics(docs.join(F.broadcast(sample), "doc_id", "left_semi"))
    names = [*RATIOS, "n_words"]
    rows = sampled_rows(stats, sample, F.xxhash64(*names)).collect()
    rows.sort(key=lambda r: (r["doc_id"], *(r[c] for c in names)))
    x = np.array([[float(r[c]) for c in names] for r in rows]).reshape(-1, len(names))
    bad = np.array([r["quality"] == 0 for r in rows], bool)
    return learn_rules(x, bad, names)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit_rules(docs, labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = text_statistics(docs).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *BASE, "base_failed", "kept")
