"""Personal data: base patterns, and a character BiLSTM with CRF for forms that they miss.

Base spans (email, ip, card, phone) are found by pattern in every whole text.  The tagger reads every
character of every text, in overlapping windows; a character's scores come from the window in which it
lies furthest from an edge, and the tags of the whole text are decoded together, so spans across windows
are whole.  Long texts are decoded up to the last position that is surely outside, so memory is bounded
but for a text that has no such position.  Tagged spans that overlap no base span are added if the value
can be one at all (an address with an at sign or its word, four numbers up to 255, a Luhn number, 7 to 15
digits).  The tagger is trained on spans that a seeded generator labels while writing them; it has no
access to the tables.

Null and empty texts: no spans.  Repeated rows are searched each.  Of spans of two kinds at one place
both stay if they are base ones.  Other columns are kept by redact and ignored by find.  Empty tables
give no rows.  Spans are [start, end) in code points.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import slices, table
from wavecrest.llm.tagger import KINDS, TAGS, Tagger, codes

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the look-behind changes no result; it follows the digit that is sought
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Characters of a window, of a training example, and what neighbouring windows share.
WINDOW, EXAMPLE, OVERLAP = 768, 96, 64
#: Windows that are run at once; characters of one text that wait for their decoding, about.
BATCH, HELD = 512, 1 << 18
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start; linear in the text."""
    out: list[Span] = []
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            before = found.end()
        at = text.find("@", max(at + 1, before))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# -- training ----------------------------------------------------------------------------------------


def _example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A text with labelled spans: base forms, other forms of the same data, and look-alikes without a label."""

    def pick(*of: str) -> str:
        return of[int(rng.integers(len(of)))]

    def number(n: int) -> str:
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def plain() -> str:
        return "".join(pick(*"eeaaoinrtshlducmfpgbvwy") for _ in range(int(rng.integers(2, 10))))

    def word() -> str:
        w = "".join(pick(*"eeaaoinrtshlducmfpgbvwyé") for _ in range(int(rng.integers(1, 11))))
        return w.capitalize() if rng.random() < 0.1 else w.upper() if rng.random() < 0.05 else w

    def card() -> str:
        n = number(int(rng.integers(15, 19)))
        return n + next(c for c in "0123456789" if luhn(n + c))

    def split(n: str, mark: str) -> str:
        return mark.join(n[k : k + 4] for k in range(0, len(n), 4))

    def data() -> tuple[str, str]:
        kind = pick(*KINDS, "none", "none")
        if kind == "email":
            name, host, end = plain() + pick("", ".", "_") + pick(plain(), number(2)), plain() + pick("", "", "-" + plain(), number(1)), pick("com", "org", "net", "de", "example.com", plain() + ".com")
            return kind, pick(f"{name}@{host}.{end}", f"{name}@{host}.{end}", f"{name} @ {host}.{end}", f"{name}@{host} . {end}", f"{name}[@]{host}.{end}", f"{name}(at){host}.{end}", f"{name} [at] {host} [dot] {end}", f"{name} (at) {host}.{end}")
        if kind == "ip":
            parts = [str(int(rng.integers(0, 256))) for _ in range(4)]
            return kind, pick(".", ".", "[.]", " . ", "(.)").join(parts)
        if kind == "card":
            return kind, split(card(), pick("", " ", "-", ".", "  ", "/"))
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            return kind, pick(f"+{number(1)} ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"+{number(2)} {number(2)} {number(4)}-{number(4)}", f"+{number(1)}{a}{b}{c}", f"+{number(1)} {a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{number(2)} {a} {b}{c}")
        hexes = "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(8, 41))))
        year = str(int(rng.integers(1900, 2100)))
        link = f"http://www.{plain()}.com/{plain()}/{number(2)}"
        return "none", pick(link, f"{plain()}.{plain()}", f"[{number(1)}]", f"({plain()})", f"{word()}({word()})", pick(*"#$|*&<>") * int(rng.integers(1, 5)), f"{plain()}_{plain()} = {number(2)};", f"{number(3)} - {number(3)}", f"{number(4)} {number(4)}", f"({plain()} {number(4)})", number(int(rng.integers(1, 8))), f"version {number(1)}.", f"{number(1)}.{number(1)}.", f"{number(1)}.{number(1)}.{number(1)}", f'token = "{hexes}"', hexes, year, f"{year}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{year}", f"{number(3)}.{number(2)}", f"{number(2)}:{number(2)}", f"({year})", f"{number(2)}%", f"[{number(2)}]", f"@{word()}", f"{number(1)},{number(3)},{number(3)}", f"{number(20)}", f"{word()}{number(3)}")

    text, spans = "", []
    mark = pick(" ", " ", " ", ", ", " | ", ".\n")
    while len(text) < EXAMPLE * 2:
        if rng.random() < 0.25:
            kind, value = data()
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += word()
        text += mark if rng.random() < 0.3 else " "
    return text, spans


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    rng = np.random.default_rng(seed)
    return [_example(rng) for _ in range(n)]


@lru_cache(maxsize=2)
def trained(n: int = 4000, epochs: int = 10, seed: int = 17) -> Tagger:
    """The same model in every process: seeded data, seeded weights."""
    x, y = np.zeros((n, EXAMPLE), np.int64), np.zeros((n, EXAMPLE), np.int64)
    for k, (text, spans) in enumerate(examples(n, seed)):
        at = (k * 7) % EXAMPLE
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
        own, label = codes(text)[at : at + EXAMPLE], tags[at : at + EXAMPLE]
        x[k, : len(own)], y[k, : len(own)] = own, label
    model = Tagger()
    model.fit(x, y, epochs)
    return model


# -- search ------------------------------------------------------------------------------------------


def possible(kind: str, value: str) -> bool:
    """Whether the value can be one of its kind, in whatever form."""
    d = digits_of(value)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", value)) and bool(re.search(r"\.|\bdot\b", value))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def _spans(tags: np.ndarray, starts: np.ndarray) -> Iterator[Span]:
    """Spans of decoded tags; none goes over one of these starts of texts."""
    if not len(tags):
        return
    kind = (tags + 1) // 2
    first = (tags % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]]))
    first[starts] = True
    ends = np.flatnonzero(first)
    own = np.flatnonzero(kind[ends])
    for k, s, t in zip(kind[ends[own]].tolist(), ends[own].tolist(), np.append(ends, len(tags))[own + 1].tolist(), strict=True):
        yield KINDS[k - 1], s, t


def windows(text: str) -> Iterator[tuple[np.ndarray, int, int]]:
    """Codes of each window, and the part of it whose scores count: up to the middle of what it shares with the next one."""
    own, step, half = codes(text), WINDOW - OVERLAP, OVERLAP // 2
    for s in range(0, max(1, len(own) - OVERLAP), step):
        part = own[s : s + WINDOW]
        yield part, half if s else 0, len(part) if s + WINDOW >= len(own) else len(part) - half


def tagged_spans(texts: list[str], model: Tagger) -> list[list[Span]]:
    """Spans by the tagger alone, for many texts at once; those that are long go one by one."""
    out: list[list[Span]] = [[] for _ in texts]
    rows: list[tuple[int, np.ndarray, int, int]] = []
    for k, text in enumerate(texts):
        if len(text) > HELD:
            out[k] = _long_spans(text, model)
        elif text:
            own = [(k, *w) for w in windows(text)]
            if rows and len(rows) + len(own) > BATCH:
                _run(rows, out, model)
                rows = []
            rows += own
    if rows:
        _run(rows, out, model)
    return [[x for s in found if (x := _trimmed(text, s))[1] < x[2]] for text, found in zip(texts, out, strict=True)]


def _run(rows: list[tuple[int, np.ndarray, int, int]], out: list[list[Span]], model: Tagger) -> None:
    """Spans of the texts whose windows these are, all decoded together, one behind the other."""
    e, gain, column = model.scores([r[1] for r in rows])
    owner, a, size = (np.array(v) for v in zip(*((k, a, b - a) for k, _, a, b in rows), strict=True))
    begin = np.cumsum(size) - size
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    starts = begin[first]
    edges = np.append(starts, size.sum())
    across = np.ascontiguousarray(gain.T)
    gains = np.concatenate([across[j, x : x + n] for j, x, n in zip(column.tolist(), a.tolist(), size.tolist(), strict=True)])
    # into a text's first tag there is no transition
    head = e[0][:, column[first]]
    gains[starts] = np.maximum(gains[starts], head[1:].max(0) - head[0])
    at = np.concatenate([s + np.flatnonzero(~model.sure(gains[s:t])) for s, t in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
    row = np.searchsorted(begin, at, "right") - 1
    tags = np.zeros(len(gains), np.int8)
    tags[at] = model.decode_open(e[at - begin[row] + a[row], :, column[row]], at, edges)
    for kind, s, t in _spans(tags, starts):
        j = bisect_right(starts, s) - 1
        out[owner[first[j]]].append((kind, int(s - starts[j]), int(t - starts[j])))


def _long_spans(text: str, model: Tagger) -> list[Span]:
    """Spans of one text, whose emissions are held only up to the last sure position."""
    out: list[Span] = []
    held, many, at = np.empty((0, TAGS), np.float32), [], 0
    parts = windows(text)
    while rows := list(islice(parts, BATCH)):
        for (_, a, b), e in zip(rows, model.emissions_of([r[0] for r in rows]), strict=True):
            many.append(e[a:b])
            last = at + len(held) + sum(map(len, many)) == len(text)
            # what stays held is not searched again before as much has come
            if last or sum(map(len, many)) > max(HELD - len(held), len(held)):
                held, many = np.concatenate([held, *many]), []
                end = len(held)
                if not last:
                    sure = np.flatnonzero(model.outside(held, False))
                    end = int(sure[-1]) + 1 if len(sure) else 0
                out.extend((kind, at + s, at + t) for kind, s, t in _spans(model.decode(held[:end]), np.array([0])))
                # the sure position stays, fixed, as the left neighbour of the rest
                end = max(0, end - 1)
                at, held = at + end, held[end:].copy()
                if end:
                    held[0, 1:] = -1e9
    return out


def _trimmed(text: str, span: Span) -> Span:
    kind, s, t = span
    while s < t and text[s] in " \t\n,;:|\"'":
        s += 1
    while t > s and text[t - 1] in " \t\n.,;:|\"'!?":
        t -= 1
    return kind, s, t


def find_spans(texts: list[str | None], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans and all spans, both by kind, then start."""
    plain = [t or "" for t in texts]
    out = []
    for text, found in zip(plain, tagged_spans(plain, model), strict=True):
        base = base_spans(text)
        taken: list[list[int]] = []
        for _, s, e in sorted(base, key=lambda x: x[1:]):
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(e, taken[-1][1])
            else:
                taken.append([s, e])
        starts, more = [s for s, _ in taken], list(base)
        for kind, a, b in found:
            k = bisect_left(starts, b) - 1
            if (k < 0 or taken[k][1] <= a) and possible(kind, text[a:b]):
                more.append((kind, a, b))
        out.append((base, sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of base spans, and all spans."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = find_spans(part.column(1).to_pylist(), model)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found]), pa.array([written(x) for _, x in found])], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with <KIND> in the place of each span of the text; null stays null."""
    at, model = docs.columns.index("text"), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                for k, (_, spans) in enumerate(find_spans(texts, model)):
                    end = None
                    for kind, a, b in sorted(spans, key=lambda x: (-x[1], -x[2])):
                        b = b if end is None else min(b, end)
                        if a < b:
                            texts[k] = f"{texts[k][:a]}<{kind.upper()}>{texts[k][b:]}"
                            end = a
                columns = [pa.array(texts, part.schema.field(at).type) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op8_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
