"""Sequences: labels, decoding, alignment and error statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label 0 is blank.
ALPHABET = "NACGT"


def ids_to_bases(ids: Column) -> Column:
    """Blank and unknown labels give nothing."""
    return F.array_join(F.transform(F.filter(ids, lambda x: x.between(1, 4)), lambda x: F.substring(F.lit(ALPHABET), x.cast("int") + 1, F.lit(1))), "")


def collapse(ids: Column) -> Column:
    """Repeats become one, then blanks go: a blank between equal labels keeps both."""
    return F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | (x != F.get(ids, i - 1)), x)), lambda x: x.isNotNull() & (x > 0))


def phred(q: Column) -> Column:
    return F.char(F.greatest(F.lit(0), F.least(q, F.lit(93))) + 33)


def parse_cigar(cigar: str) -> list[str]:
    """One operation per position; a missing count is one."""
    return [op for n, op in re.findall(r"(\d*)([=XIDMSHN])", cigar) for _ in range(int(n or 1))]


def accuracy(a: Column, ref_length: Column, balanced: bool = False, min_coverage: float = 0.0) -> Column:
    """Percent of matches over all operations; balanced: (= - I) / (= + X + D); low coverage gives 0."""
    up = a["n_match"] - a["n_ins"] if balanced else a["n_match"]
    down = a["n_match"] + a["n_mismatch"] + a["n_del"] + (F.lit(0) if balanced else a["n_ins"])
    covered = (a["ref_end"] - a["ref_start"]) / ref_length >= min_coverage
    return F.when((ref_length > 0) & (down > 0) & covered, 100.0 * up / down).otherwise(0.0)


def match_vector(cigar: str, length: int, start: int = 0) -> list[int]:
    """1 where a reference base matches; insertions and clips have no reference base."""
    out, at = [0] * length, start
    for op in parse_cigar(cigar):
        if op in "=XDM":
            if op == "=" and at < length:
                out[at] = 1
            at += 1
    return out


def beam_search(probs: np.ndarray, width: int = 5, cut: float = 1e-3) -> list[int]:
    """CTC prefix beam search over (T, C) probabilities, label 0 blank."""
    beams = {(): (1.0, 0.0)}
    for row in probs:
        new: dict[tuple, list[float]] = {}
        for prefix, (pb, pn) in beams.items():
            for c in np.flatnonzero(row >= cut).tolist():
                p = float(row[c])
                if c == 0:
                    new.setdefault(prefix, [0.0, 0.0])[0] += (pb + pn) * p
                    continue
                if prefix and prefix[-1] == c:
                    new.setdefault(prefix, [0.0, 0.0])[1] += pn * p
                new.setdefault((*prefix, c), [0.0, 0.0])[1] += (pb if prefix and prefix[-1] == c else pb + pn) * p
        beams = {k: tuple(v) for k, v in sorted(new.items(), key=lambda x: (-sum(x[1]), x[0]))[:width]} or beams
    return list(max(beams.items(), key=lambda x: sum(x[1]))[0])


def crf_states(n_classes: int, bases: int = 4) -> int:
    """State length s with n_classes = (bases + 1) * bases**s or bases**(s + 1)."""
    for s in range(12):
        if n_classes in ((bases + 1) * bases**s, bases ** (s + 1)):
            return s
    raise ValueError(f"no state length gives {n_classes} classes")


def crf_state_length(n_classes: Column, bases: int = 4) -> Column:
    """crf_states() of a column."""
    with_blank = F.round(F.log(float(bases), n_classes / (bases + 1)))
    without = F.round(F.log(float(bases), n_classes)) - 1
    fits = lambda k, n: (k >= 0) & (F.pow(F.lit(bases), k) * n == n_classes)
    wrong = F.raise_error(F.concat(F.lit("no state length gives "), n_classes.cast("string"))).cast("int")
    return F.when(fits(with_blank, bases + 1), with_blank.cast("int")).when(fits(without, bases), without.cast("int")).otherwise(wrong)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def viterbi_path(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The best path of states for (T, S) scores; the lowest state of equals."""
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        step = best[:, None] + transitions
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def collapse_path(path: list[int]) -> list[int]:
    """Labels of a path: a repeat is one label, a blank (0) ends it, so 1 0 1 are two."""
    out, before = [], 0
    for x in path:
        if x and x != before:
            out.append(x)
        before = x
    return out


def decode_rows(df: DataFrame, scores: str, steps: int, classes: int, decode: Callable[[np.ndarray], list[int]]) -> DataFrame:
    """The rows' other columns and their bases, decoded from the first steps * classes scores."""
    at = df.columns.index(scores)
    keep = [k for k in range(len(df.columns)) if k != at]
    schema = ", ".join(f"`{df.columns[k]}` {df.dtypes[k][1]}" for k in keep) + ", bases string"
    names = [*(df.columns[k] for k in keep), "bases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([v[: steps * classes] for v in b.column(at).to_pylist()], float).reshape(-1, steps, classes)
            bases = ["".join(ALPHABET[k] for k in decode(s) if 0 < k < len(ALPHABET)) for s in x]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(bases, pa.string())], names)

    return df.mapInArrow(run, schema)
