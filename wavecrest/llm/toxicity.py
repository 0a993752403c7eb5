"""Toxicity by a classifier chain over words.

Categories come one after the other; each has a linear model over the presence of words and the
probabilities of the earlier categories.  While training, those probabilities are out of fold, so a
later model sees them as good as they will be on new text.  The categories, from the labels: toxic
prose (of quality 1); toxic junk (of quality 0); toxic, the last one, which rests on both.  A text is
rejected if the end of the chain gives it at least the threshold.

Words get a model weight only if they are more frequent on one side beyond chance, counted once per
group of near copies in the sample, at a level controlled for the number of words tested; the models
behind out-of-fold probabilities choose their words without the fold's labels.  Null and empty texts: no words, never rejected by words.
Repeated rows are judged each; of an id with several texts the sample holds at most ROWS_PER_ID.  A text of any length
is read whole.  Words of equal evidence are taken in the order of their hashes.  Rows without a label take no part in
training; without both labels nothing is rejected.  Other columns are kept.  Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import give_back, slices, table
from wavecrest.llm.jaccard import mix, shingles
from wavecrest.llm.linear import fit_logistic, predict
from wavecrest.llm.quality_rules import labelled_sample, sampled_rows

#: At most so many labelled rows are used for training, and so many words get a weight.
MAX_LABELLED, MAX_WORDS = 5_000, 2_000
#: Lengths of word beginnings that are features too, for inflected forms.
PREFIXES = (4, 5, 6, 7)
#: Shrinkage of the weights.
L2 = 0.05
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None, known: set[str] | None = None) -> set[str]:
    """Distinct words and their beginnings of PREFIXES characters (marked with a star); or the known ones of them."""
    words = set(WORD.findall((text or "").lower()))
    starts = {w[:n] for w in words for n in PREFIXES if len(w) > n}
    out = words | {f"{x}*" for x in starts} if known is None else (words & known) | {f"{x}*" for x in starts if f"{x}*" in known}
    return out


@dataclass
class Chain:
    words: dict[str, int]
    models: list[np.ndarray]

    def probabilities(self, found: list[list[int]]) -> np.ndarray:
        """One row for each text (the numbers of its known words), one column for each category."""
        x = np.zeros((len(found), len(self.words)))
        for k, own in enumerate(found):
            x[k, own] = 1.0
        out = np.zeros((len(found), 0))
        for w in self.models:
            out = np.hstack([out, predict(w, np.hstack([x, out]))[:, None]])
        return out


def near_groups(texts: list[str | None], seeds: int = 4) -> np.ndarray:
    """One number for texts that share a least shingle hash under any of the seeds."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for seed in range(seeds):
        first: dict[int, int] = {}
        for k, s in enumerate(sets):
            if len(s):
                h = int(mix(s + np.uint64(seed)).min())
                a, b = find(k), find(first.setdefault(h, k))
                root[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(len(sets))], np.int64)


def _hashes(text: str | None) -> np.ndarray:
    return np.array(sorted(xxhash.xxh3_64_intdigest(w) for w in words_of(text)), np.uint64)


def _select(hashes: list[np.ndarray], y: np.ndarray, group: np.ndarray, rate: float = 0.05) -> np.ndarray:
    """Words (as hashes) on one side beyond chance: the tail of a binomial, by Chernoff's bound.

    Groups of near copies count once for each class.  The level is that of Benjamini and Hochberg: about
    this rate of the chosen words may be there by chance.  Words too rare to reach a level at all don't
    count as tested at it (Tarone), so the level follows the size of the sample.  If no word reaches it
    (labels that are copies of one text or two), those of most evidence are taken, and shrinkage has to do.
    """
    _, first = np.unique(np.stack([group, y.astype(np.int64)]), axis=1, return_index=True)
    words, n = np.unique(np.concatenate([hashes[k] for k in first]), return_counts=True)
    if not len(words):
        return words
    pos = np.zeros(len(words), np.int64)
    for k in first[y[first]]:
        pos[np.searchsorted(words, hashes[k])] += 1
    share = np.clip(y[first].mean(), 1e-9, 1 - 1e-9)
    q = pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = n * (np.where(q > 0, q * np.log(q / share), 0.0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0.0))
    order = np.argsort(-bits, kind="stable")
    bits = bits[order]
    most = np.sort(-n * np.log(min(share, 1 - share)))
    tested = len(n) - np.searchsorted(most, bits - 1e-9)
    passed = np.flatnonzero(np.log(tested) - bits <= np.log(rate * np.arange(1, len(n) + 1)))
    last = passed[-1] + 1 if len(passed) else np.count_nonzero(bits >= bits[0] - 1e-9)
    return words[order[: min(last, MAX_WORDS)]]


def fit_chain(texts: list[str | None], targets: np.ndarray, folds: int = 4) -> Chain | None:
    """targets: one column for each category, in the chain's order; the last one is the verdict's."""
    if not len(texts) or targets[:, -1].all() or not targets[:, -1].any():
        return None
    group = near_groups(texts)
    fold, hashes, last = group % folds, [_hashes(t) for t in texts], targets[:, -1]

    def chosen(rows: np.ndarray) -> set[int]:
        """Words by the labels of these rows alone."""
        y = last[rows]
        return set(_select([hashes[k] for k in np.flatnonzero(rows)], y, group[rows]).tolist()) if y.any() and not y.all() else set()

    # a fold's words are chosen without its labels, as its probabilities stand for those of new text
    words, parts = chosen(np.ones(len(texts), bool)), [chosen(fold != f) for f in range(folds)]
    every = words.union(*parts)
    rows = [{h: w for w in words_of(t) if (h := xxhash.xxh3_64_intdigest(w)) in every} for t in texts]

    def design(own: set[int]) -> tuple[dict[str, int], np.ndarray]:
        at = {w: k for k, w in enumerate(sorted({w for r in rows for h, w in r.items() if h in own}))}
        x = np.zeros((len(texts), len(at)))
        for k, r in enumerate(rows):
            x[k, [at[w] for h, w in r.items() if h in own]] = 1.0
        return at, x

    at, x = design(words)
    models, earlier = [], np.zeros((len(texts), 0))
    for c in range(targets.shape[1]):
        y = targets[:, c]
        models.append(fit_logistic(np.hstack([x, earlier]), y.astype(float), L2))
        out = np.full(len(y), y.mean())
        for f in range(folds):
            test = fold == f
            if test.any() and y[~test].any() and not y[~test].all():
                own = np.hstack([design(parts[f])[1], earlier])
                out[test] = predict(fit_logistic(own[~test], y[~test].astype(float), L2), own[test])
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(at, models)


def train(docs: DataFrame, labels: DataFrame) -> Chain | None:
    """From a bounded sample of labelled rows, which may be broadcast and collected."""
    sample = labelled_sample(labels.where("toxic is not null"), MAX_LABELLED)
    rows = sampled_rows(docs.select(F.col("doc_id").cast("long"), "text"), sample, F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    toxic = np.array([r.toxic == 1 for r in rows], bool)
    good = np.array([r.quality == 1 for r in rows], bool)
    texts = [r.text for r in rows]
    del rows
    chain = fit_chain(texts, np.stack([toxic & good, toxic & ~good, toxic], 1))
    del texts
    give_back()
    return chain


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """doc_id and p_<category> for each row."""
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(chain.words) if chain else set()
        for batch in batches:
            for part in slices(batch):
                found = [[chain.words[w] for w in sorted(words_of(t, known))] if t and known else [] for t in part.column(1).to_pylist()]
                p = chain.probabilities(found) if chain else np.zeros((len(found), len(CATEGORIES)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(CATEGORIES)))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names[1:]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the chain's probabilities and whether the row is rejected."""
    return score(docs, train(docs, labels)).withColumn("rejected", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that the chain doesn't reject, with all their columns."""
    chain, at = train(docs, labels), docs.columns.index("text")
    if chain is None:
        return docs
    known = set(chain.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [[chain.words[w] for w in sorted(words_of(t, known))] if t else [] for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(chain.probabilities(found)[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
