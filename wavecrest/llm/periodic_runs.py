"""Periodic runs of words, found with a suffix automaton, and texts with each run cut to one period.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends keeping period q.  The suffix automaton of the words has a state for each class
of stretches that end at the same places.  Going up its suffix links from the longest states, the ordered
sets of end positions are merged, the smaller into the larger.  When two positions e1 < e2 become
neighbours in a state whose length is at least e2 - e1, the words before e2 hold a square of that period,
and the state's length says how far it reaches to the left; to the right it is extended to the run.

All words of a run stand in three-word stretches that occur three times or more in the text, and a run
lies in one unbroken row of them, so the automaton is built over those rows only.  This leaves out no run:
with a period of two or more, each residue of the period has three starts of such a stretch, and six equal
words hold four.

Null text: no words.  Null doc_id: the text is taken as it is.  Repeated rows give repeated results; other
columns are ignored, whatever their names; an empty table gives an empty result.  A text of any length is
read whole; memory grows with its words (about 400 bytes for each word that the automaton holds).
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import slices, table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: So many elements are put into an ordered set one by one; more are merged by a sort of two ordered rows.
FEW = 8
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))

Run = tuple[int, int, int]


class SuffixAutomaton:
    """States of a row of numbers: length of the longest stretch, suffix link, and for states of a prefix its end."""

    def __init__(self, row: list[int]) -> None:
        self.row = row
        length, link, end, after = [0], [-1], [-1], [{}]
        last = 0
        for at, x in enumerate(row):
            new = len(length)
            length.append(length[last] + 1)
            end.append(at)
            after.append({})
            link.append(0)
            p = last
            while p >= 0 and x not in after[p]:
                after[p][x] = new
                p = link[p]
            if p >= 0:
                q = after[p][x]
                if length[p] + 1 != length[q]:
                    # the stretches of q that end here too become a state of their own
                    copy = len(length)
                    length.append(length[p] + 1)
                    end.append(-1)
                    after.append(dict(after[q]))
                    link.append(link[q])
                    while p >= 0 and after[p].get(x) == q:
                        after[p][x] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
        self.length, self.link, self.end = length, link, end

    def neighbours(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(e1, e2, length) for positions that become neighbours in a state of at least ``least`` words.

        Ordered sets hold the positions negated: a state's own end is below all that its children bring,
        so that it is added at the end of the list.
        """
        length, link, sets = self.length, self.link, {}
        by_length = np.argsort(-np.array(length), kind="stable")
        for state in by_length.tolist():
            if length[state] < least:
                return
            own = sets.pop(state, None)
            if self.end[state] >= 0:
                if own is None:
                    own = [-self.end[state]]
                else:
                    yield self.end[state], -own[-1], length[state]
                    own.append(-self.end[state])
            up = link[state]
            if length[up] < least:
                continue
            other = sets.get(up)
            if other is None:
                sets[up] = own
                continue
            small, large = (own, other) if len(own) < len(other) else (other, own)
            for e2, e1 in _meet(small, large):
                yield -e1, -e2, length[up]
            if len(small) <= FEW:
                for x in small:
                    large.insert(bisect_left(large, x), x)
            else:
                large += small
                large.sort()
            sets[up] = large


def _meet(small: list[int], large: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbours in the merged order, one from each set."""
    places = [bisect_left(large, x) for x in small]
    for k, (x, at) in enumerate(zip(small, places, strict=True)):
        if at and (not k or small[k - 1] < large[at - 1]):
            yield large[at - 1], x
        if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]):
            yield x, large[at]


def runs_of(row: list[int]) -> list[Run]:
    """(start, length, period) of the runs of a row of numbers, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    n = len(row)
    # a run of period q first meets in a state of (its length - q) words
    for e1, e2, size in SuffixAutomaton(row).neighbours(LEAST_WORDS - 1):
        period = e2 - e1
        if period > size:
            continue
        end = e2 + 1
        if end < n and row[end] == row[end - period]:
            # the seed at the run's last word finds the same run
            continue
        start = e1 - size + 1
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            # a multiple of the period can be met before it
            found[start, end] = min(period, found.get((start, end), period))
    return sorted((start, end - start, period) for (start, end), period in found.items())


def repeated_rows(ids: np.ndarray) -> list[tuple[int, int]]:
    """Unbroken rows [start, end) of words whose three-word stretches occur three times or more, of at least LEAST_WORDS."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    x = ids.astype(np.uint64)
    key = x[:-2] * MIX[0] + x[1:-1] * MIX[1] + x[2:] * MIX[2]
    # equal stretches share a slot; others that do only leave more rows than needed
    bits = (8 * n).bit_length()
    slot = ((key ^ key >> np.uint64(29)) * MIX[0] >> np.uint64(64 - bits)).astype(np.int64)
    often = np.bincount(slot, minlength=1 << bits)[slot] >= 3
    edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]])))
    # starts of stretches [a, b) cover the words [a, b + 2)
    return [(a, b + 2) for a, b in edges.reshape(-1, 2).tolist() if b + 2 - a >= LEAST_WORDS]


def word_runs(words: list) -> list[Run]:
    """The runs of a list of words."""
    if len(words) < LEAST_WORDS:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted((a + start, length, period) for a, b in repeated_rows(ids) for start, length, period in runs_of(ids[a:b].tolist()))


def repeat_words(words: list, doc_id: int | None) -> list:
    """One document in ten gets a periodic tail, by the checksum of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def collapse(words: list, runs: list[Run]) -> list:
    """Without the words that stand in some run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words) + 1, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=False) if k]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", damaged: bool = False, with_runs: bool = False) -> DataFrame:
    """Per row: the number of runs, the longest one, digests of all runs and of the collapsed text.

    damaged: repeat_words is applied first.  with_runs adds the runs and the collapsed text themselves.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    ddl = "key long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if with_runs:
        kinds += [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]
        names += ["runs", "collapsed"]
        ddl += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def row(doc_id: int | None, data: bytes | None) -> tuple:
        words = (data or b"").split()
        if damaged:
            words = repeat_words(words, doc_id)
        runs = word_runs(words)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = b" ".join(collapse(words, runs))
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        out = (doc_id, len(runs), *longest, 1000 * longest[1] // longest[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        return out + (([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left.decode()) if with_runs else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                # bytes.split() cuts at space and the characters 9 to 13 alone
                rows = [row(*x) for x in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", *names[1:]])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, ddl).withColumnRenamed("key", key)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), damaged=True)
