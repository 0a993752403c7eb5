"""Byte pair encoding as a bounded-lookahead streaming transducer.

A merge list has a *sufficient lookahead* L: in any string, a token that ends L or more bytes before
the end of what has been read is the same whatever follows.  When two strings share a prefix, the
rules applied in rank order can disagree only from some boundary on.  A rule (u, w) moves that
boundary to the left by |u|, and only if u ends at the boundary and w begins with the token that the
previous move consumed (that token is on the left spine of w's merge tree), with a higher rank than
the previous rule.  The longest such chain of left parts, found by one pass over the rules in rank
order, bounds L.  So a pre-token of any length is encoded in a window of a few L: merge the window,
emit what is stable, go on from the last stable boundary (no merge crosses it).
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The public pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = regex.compile(r"\s")
BIG = 1 << 62
#: A word of letters and the marks after it: two pieces in either pattern.
TAIL = re.compile(r"([^\W\d_]+)((?:[^\w\s]|_)*)")
#: A comma or full stop after a mark: one pre-token with it.
JOINED = re.compile(r"[.,](?<=(?:[^\w\s]|_).)")
#: No id, in a row of merge_batch; no rule has it.
NONE = (1 << 20) - 1
#: From so many words on, those of like length (up to these bytes) are merged together.
GROUPED, WIDTHS = 1000, np.array([5, 7, 9, 12, 16])
#: Parts behind a line break that are remembered.
PIECES = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def sufficient_lookahead(rules: list[tuple[int, int, int]], length: dict[int, int], left: dict[int, int]) -> int:
    """Longest chain of left parts (in bytes) over rules (u, w, new) in rank order."""
    best: dict[int, int] = {}
    most = 0
    for u, w, _ in rules:
        part: int | None = w
        reach = 0
        while part is not None:
            reach = max(reach, best.get(part, 0))
            part = left.get(part)
        reach += length[u]
        if reach > best.get(u, 0):
            best[u] = reach
            most = max(most, reach)
    return max(most, max(length.values(), default=1))


class Utf8Machine:
    """Bytes in, text out, as soon as each character is whole; at most three bytes are pending."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut -= back if need > back and byte < 0xF5 and self._begins(data[-back:]) else 0
                break
            if byte < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _begins(tail: bytes) -> bool:
        """Whether the bytes are a proper prefix of some well-formed character."""
        if tail[0] < 0xC2:
            return False
        if len(tail) > 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
            return low <= tail[1] <= high
        return True

    def close(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Run:
    """One pre-token whose bytes come in blocks: ids are given out once the lookahead has passed them."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held = bpe, bytearray()

    def push(self, block: bytes) -> list[int]:
        bpe, held, out = self.bpe, self.held, []
        for at in range(0, len(block), bpe.window):
            held += block[at : at + bpe.window]
            if len(held) > bpe.window + 1:
                # the last byte stays: it may carry the end-of-word mark
                stable, done = len(held) - 1 - bpe.lookahead, 0
                for x in bpe.merge([bpe.first[b] for b in held[:-1]]):
                    size = len(bpe.bytes_of[x])
                    if done + size > stable:
                        break
                    done += size
                    out.append(x)
                del held[:done]
        return out

    def close(self) -> list[int]:
        held, self.held = self.held, bytearray()
        return self.bpe.merge([*(self.bpe.first[b] for b in held[:-1]), self.bpe.last[held[-1]]]) if held else []


class Transducer:
    """State of one text that is read block by block (byte-level models).

    A step reads a block and gives the parts that no later input can change: text up to the last cut, a
    single space between two characters that aren't white space; without a cut, up to the last
    pre-token but two; and inside a pre-token longer than the window, ids that lie further back than the
    merge list's lookahead.  What is held is at most a block and a few windows, whatever the text.
    """

    CLASSES = tuple(regex.compile(c) for c in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.held = bpe, ""
        self.longest = max(map(len, bpe.special), default=1)
        self.run: Run | None = None
        self.kind = self.CLASSES[0]

    def feed(self, block: str, last: bool = False) -> list[str | list[int]]:
        """Stable parts in order: texts that are encoded by themselves, and ids."""
        out: list[str | list[int]] = []
        text = self.held + block
        while True:
            if self.run is not None:
                text = self._in_run(text, last, out)
                if self.run is not None:
                    break
            if last:
                if text:
                    out.append(text)
                text = ""
                break
            at = self._cut(text)
            if at:
                out.append(text[:at])
                text = text[at:]
            elif len(text) > 4 * self.bpe.window:
                found = list(self.bpe.pattern.finditer(text))
                before = [m.start() for m in found[:-2] if m.start() < len(text) - self.longest]
                special = self._last_special(text)
                if special:
                    out.append(text[:special])
                    text = text[special:]
                elif before and before[-1]:
                    out.append(text[: before[-1]])
                    text = text[before[-1] :]
                if len(text) > 4 * self.bpe.window and not self._last_special(text):
                    # nearly all of it is one pre-token
                    m = max(self.bpe.pattern.finditer(text), key=lambda x: x.end() - x.start())
                    if m.end() - m.start() > self.bpe.window:
                        if m.start():
                            out.append(text[: m.start()])
                            text = text[m.start() :]
                        self.run = Run(self.bpe)
                        self.kind = next(c for c in self.CLASSES if c.match(text[1]))
                        if not self.kind.match(text[0]):
                            out.append(self.run.push(text[0].encode()))
                            text = text[1:]
                        continue
            break
        self.held = text
        return out

    def _in_run(self, text: str, last: bool, out: list) -> str:
        """Push what belongs to the pre-token; what is returned doesn't, or may not."""
        found = self.bpe.splitter.search(text) if self.bpe.splitter else None
        end = found.start() if found else len(text)
        m = self.kind.match(text[:end])
        k = m.end() if m else 0
        space = self.kind is self.CLASSES[2]
        if not last and found is None and k > len(text) - self.longest:
            # the run may go on, or a special string may begin in it
            k = max(0, len(text) - self.longest)
            out.append(self.run.push(text[:k].encode()))
            return text[k:]
        if space and k < end:
            # the last white space of a run belongs to what follows
            k -= 1
        out.append(self.run.push(text[: max(0, k)].encode()))
        out.append(self.run.close())
        self.run = None
        return text[max(0, k) :]

    @staticmethod
    def _cut(text: str) -> int:
        at = text.rfind(" ", 0, -1)
        while at > 0:
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                return at
            at = text.rfind(" ", 0, at)
        return 0

    def _last_special(self, text: str) -> int:
        if self.bpe.splitter is None or "<|" not in text:
            return 0
        return max((m.end() for m in self.bpe.splitter.finditer(text)), default=0)


class Bpe:
    """The model of one tokenizer file: merges, special strings, pre-token pattern."""

    def __init__(self, path: str, cache: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec.get("normalizer"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.vocab: dict[str, int] = model["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.first = [self.vocab.get(chars[b], -1) for b in range(256)]
        self.last = [self.vocab.get(chars[b] + self.suffix, -1) for b in range(256)]
        plain = {i: t for t, i in self.vocab.items()}
        self.bytes_of: dict[int, bytes] = {}
        for i, t in plain.items():
            t = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.bytes_of[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rules, left = [], {}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            u, w, new = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rules.append((u, w, new))
            left[new] = u
        self.merges: dict[int, int] = {}
        for rank, (u, w, new) in enumerate(self.rules):
            self.merges.setdefault(u << 20 | w, rank << 20 | new)
        length = {i: len(b) or 1 for i, b in self.bytes_of.items()}
        self.lookahead = sufficient_lookahead(self.rules, length, left)
        self.window = 4 * self.lookahead
        self.pattern = regex.compile(WORD_PATTERN if self.suffix else BYTE_PATTERN)
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.size = cache
        #: Packed ids by a part between spaces, the space before it included in byte-level models.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Of a part behind a line break, the break included.
        self.behind: dict[str, bytes] = {}
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.code = "H" if max(self.bytes_of) < 65536 else "I"
        self.kind = "<u2" if self.code == "H" else "<u4"
        self.marks = {m: self._pack(self.piece(m)) for m in ",." if m in self.vocab}

    # -- merging ---------------------------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the rules by rank, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(u << 20 | w, BIG) for u, w in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == BIG:
                break
            at = ranks.index(best)
            ids[at] = best & 0xFFFFF
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | ids[at], BIG)
            if at < len(ranks):
                ranks[at] = get(ids[at] << 20 | ids[at + 1], BIG)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        ids, get = list(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := get(ids[k] << 20 | ids[k + 1])) is not None]
        heap = [(f >> 20, k, f & 0xFFFFF, a, b) for f, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            m = after[k]
            if ids[k] != a or m >= n or ids[m] != b:
                continue
            ids[k], ids[m] = new, -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (f := get(ids[i] << 20 | ids[j])) is not None:
                    heapq.heappush(heap, (f >> 20, i, f & 0xFFFFF, ids[i], ids[j]))
        return [x for x in ids if x >= 0]

    def pieces(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in blocks of bytes; memory is a few lookaheads."""
        run = Run(self)
        for block in data:
            yield from run.push(block)
        yield from run.close()

    def piece(self, pre_token: str) -> list[int]:
        data = pre_token.encode()
        if len(data) <= self.window:
            ids = list(map(self.first.__getitem__, data))
            ids[-1] = self.last[data[-1]]
            return self.merge(ids)
        return list(self.pieces([data]))

    # -- texts -----------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        """Lower case and composed, for files that ask for it; white space stays, as no piece holds any."""
        if not self.lower:
            return text
        import unicodedata

        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # the library lower-cases character by character, without the rule for a final sigma
        return text.lower() if "Σ" not in text and "İ" not in text else "".join(c.lower() for c in text)

    def segments(self, text: str) -> Iterator[tuple[int | None, str]]:
        """Special strings with their ids, and the texts between them."""
        if self.splitter is None or "<|" not in text:
            yield None, text
            return
        for part in self.splitter.split(text):
            if part:
                yield self.special.get(part), part

    def _ids(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for special, part in self.segments(text):
            if special is not None:
                out.append(special)
                continue
            for x in self.pattern.findall(self.normal(part)):
                out += self.piece(x)
        return tuple(out)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _remember(self, part: str) -> bytes | None:
        """Ids of a part that stands between two spaces; None if it can't be encoded by itself."""
        found = self.old.get(part)
        if found is None:
            if not part or part[0].isspace() or part[-1].isspace():
                return None
            if part[-1] in self.marks and part[:-1].isalpha():
                found = (self.young.get(part[:-1]) or self._remember(part[:-1])) + self.marks[part[-1]]
            else:
                found = self._pack(self._ids(part if self.suffix else " " + part))
        if len(part) <= 64:
            self._keep(part, found)
        return found

    def _keep(self, part: str, found: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[part] = found

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """Merge all new words of a few hundred texts at once."""
        old, young, tails = self.old.get, self.young, {}
        words, found = [], {}
        for p in missing:
            if (x := old(p)) is not None:
                found[p] = x
            elif len(p) < 25 and p.isalpha():
                words.append(p)
            elif len(p) < 40 and (m := TAIL.fullmatch(p)) and m[1].isalpha():
                core, tail = m.groups()
                if tail:
                    tails[p] = core, tail
                if core not in young and old(core) is None:
                    words.append(core)
        words = list(dict.fromkeys(words))
        lead = b"" if self.suffix else b" "
        made = dict(zip(words, self.merge_batch([lead + w.encode() for w in words]), strict=True))
        ends = {t: self._pack(self.piece(t)) for t in {t for _, t in tails.values()}}
        for p, (core, tail) in tails.items():
            found[p] = (made.get(core) or young.get(core) or old(core)) + ends[tail]
        return found | made

    # -- many words at once ------------------------------------------------------------------------

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressed table of the rules: key u << 20 | w, value rank << 20 | new."""
        bits = max(4, (4 * len(self.merges)).bit_length())
        keys, values = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, BIG, np.int64)
        self.shift, self.reach = np.uint64(64 - bits), 1
        slot = (np.fromiter(self.merges, np.int64).view(np.uint64) * MIX >> self.shift).astype(np.int64)
        for at, (k, v) in zip(slot.tolist(), self.merges.items(), strict=True):
            n = 1
            while keys[at] >= 0:
                at += 1
                n += 1
            keys[at], values[at] = k, v
            self.reach = max(self.reach, n)
        return keys, values

    def _ranks(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = self._table()
        keys, values = self.table
        key = u << 20 | w
        at = (key.view(np.uint64) * MIX >> self.shift).view(np.int64)
        out = np.where(keys[at] == key, values[at], BIG)
        open_ = np.flatnonzero((keys[at] != key) & (keys[at] >= 0))
        for k in range(1, self.reach):
            if not len(open_):
                break
            now, want = at[open_] + k, key[open_]
            hit = keys[now] == want
            out[open_[hit]] = values[now[hit]]
            open_ = open_[~hit & (keys[now] >= 0)]
        return out

    def merge_batch(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens: in each step every word applies its best rule."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        if len(words) >= GROUPED:
            # words of like length together, as rows are as wide as their longest word
            out, group = [b""] * len(words), np.searchsorted(WIDTHS, size)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                for k, x in zip(own.tolist(), self._merge_rows([words[k] for k in own.tolist()], size[own]), strict=True):
                    out[k] = x
            return out
        return self._merge_rows(words, size)

    def _merge_rows(self, words: list[bytes], size: np.ndarray) -> list[bytes]:
        width = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.array(self.first, np.int64)[raw]
        rows = np.arange(len(words))
        ids[rows, size - 1] = np.array(self.last, np.int64)[raw[rows, size - 1]]
        ids[np.arange(width) >= size[:, None]] = NONE
        rank = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1) if width > 1 else np.empty((len(words), 0), np.int64)
        out: list[bytes] = [b""] * len(words)
        kind, step = self.kind, int(self.kind[-1])
        while True:
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            here = np.arange(len(rows))
            best = rank[here, at] if rank.shape[1] else np.full(len(rows), BIG)
            done = best == BIG
            if done.any():
                own = ids[done]
                blob, stride, n = own.astype(kind).tobytes(), own.shape[1] * step, ((own != NONE).sum(1) * step).tolist()
                for k, r in enumerate(rows[done].tolist()):
                    out[r] = blob[k * stride : k * stride + n[k]]
                ids, rank, rows, at, best = (x[~done] for x in (ids, rank, rows, at, best))
                here = np.arange(len(rows))
            if not len(rows):
                return out
            ids[here, at] = best & 0xFFFFF
            keep = np.ones(ids.shape, bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[here, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            if rank.shape[1]:
                k = np.flatnonzero(at > 0)
                rank[k, at[k] - 1] = self._ranks(ids[k, at[k] - 1], ids[k, at[k]])
                k = np.flatnonzero(at < rank.shape[1])
                rank[k, at[k]] = self._ranks(ids[k, at[k]], ids[k, at[k] + 1])

    # -- texts, continued --------------------------------------------------------------------------

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that can be encoded by themselves.

        A cut lies before a single space between two characters that aren't white space: no
        pre-token, special string or run of white space crosses it.
        """
        if self.suffix:
            return text.split() if not regex.search("[\x1c-\x1f]", text) else [text]
        parts = text.split(" ")
        out = [parts[0]] if parts[0] else []
        whole = bool(parts[0]) and not parts[0][-1].isspace()
        for p in parts[1:]:
            if p and whole and not p[0].isspace():
                out.append(" " + p)
            elif out:
                out[-1] += " " + p
            else:
                out.append(" " + p)
            whole = bool(p) and not p[-1].isspace()
        return out

    def encode_many(self, texts: list[str | None], inner: bool = False) -> list[bytes]:
        """Ids of whole texts as little-endian numbers, of 16 bits if the vocabulary allows it.

        inner: texts are parts as a transducer gives them, which may begin at a cut.
        """
        out: list = []
        missing: set[str] = set()
        get = self.young.get
        for text in texts:
            text = text or ""
            if self.suffix and ("<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
                out.append(self._pack(self._ids(text)))
                continue
            after = inner and len(text) > 1 and text[0] == " " and not text[1].isspace()
            if self.suffix:
                plain = self.normal(text)
                # commas and full stops after a letter or digit begin a pre-token: words are looked up without them
                parts = (plain if JOINED.search(plain) else plain.replace(",", " ,").replace(".", " .")).split()
            else:
                parts = text[after:].split(" ")
            found = list(map(get, parts))
            if None in found:
                gaps = [k for k, x in enumerate(found) if x is None]
                missing.update([parts[k] for k in gaps])
                out.append((text, parts, found, gaps, after))
            else:
                out.append((text, parts, found, (), after))
        new = self._learn(missing)
        if len(self.young) + len(new) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(new)
        return [x if isinstance(x, bytes) else self._whole(*x, new) for x in out]

    def _whole(self, text: str, parts: list[str], found: list, gaps: list[int], after: bool, new: dict[str, bytes]) -> bytes:
        if not self.suffix:
            if not after:
                # the first part has no space before it
                found[0] = self._pack(self._ids(parts[0]))
            if not parts[0] or parts[0][-1].isspace():
                return b"".join(self._pack(self._ids(key)) for key in self.chunks(text))
        for k in gaps:
            if k or self.suffix or after:
                x = new.get(parts[k])
                if x is None and (x := self.young.get(parts[k])) is None and (x := self._remember(parts[k])) is None:
                    return b"".join(self._pack(self._ids(key)) for key in self.chunks(text))
                found[k] = x
        return b"".join(found)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts in one row, and the place where each text's end (byte-level models; null: empty).

        Parts between single spaces and line breaks are numbered by Arrow, so that each distinct one is looked
        up once and the ids of all are gathered by number.  A break between two characters that aren't white
        space is a pre-token of its own; it stays with the part behind it.  A text with other white space
        beside a space or break is encoded by itself.
        """
        texts = pc.fill_null(texts, "")
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        n = pc.list_value_length(words).to_numpy()
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        found: list = list(map(self.young.get, parts))
        gaps = [k for k, x in enumerate(found) if x is None]
        for k in gaps:
            if parts[k][:1] == "\n":
                found[k] = self.behind.get(parts[k])
        gaps = [k for k in gaps if found[k] is None]
        odd = np.zeros(len(parts), bool)
        odd[[k for k in gaps if not (p := parts[k].removeprefix("\n")) or p[0].isspace() or p[-1].isspace()]] = True
        apart = np.zeros(len(n), bool)
        apart[owner[odd[codes]]] = True
        lines = [k for k in gaps if parts[k][:1] == "\n" and not odd[k]]
        new, breaks = self._learn({parts[k] for k in gaps if parts[k][:1] != "\n" and not odd[k]}), self._learn_lines([parts[k] for k in lines])
        if len(self.young) + len(new) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(new)
        if len(self.behind) + len(breaks) > PIECES:
            self.behind = {}
        self.behind.update(breaks)
        for k in gaps:
            p = parts[k]
            found[k] = b"" if odd[k] else breaks[p] if p[:1] == "\n" else new.get(p) or self.young.get(p) or self._remember(p)
        # the first part has no space before it; a text apart is its own first part
        found += self.encode_many([texts[k].as_py() if x else parts[codes[first[k]]] for k, x in enumerate(apart.tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found)) // int(self.kind[-1])
        ids, at = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        codes[first] = len(parts) + np.arange(len(n))
        keep = ~apart[owner]
        keep[first] = True
        codes, owner = codes[keep], owner[keep]
        taken = size[codes]
        begin = np.cumsum(taken) - taken
        out = ids[np.repeat(at[codes] - begin, taken) + np.arange(int(taken.sum()))]
        return out, np.cumsum(np.bincount(owner, taken, len(n)).astype(np.int64))

    def _learn_lines(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that follow a line break, the break included; plain words are merged together."""
        plain, found = {}, {}
        for p in parts:
            m = TAIL.fullmatch(p, 1)
            if m and len(p) < 40 and m[1].isalpha():
                plain[p] = m.groups()
            else:
                found[p] = self._pack(self._ids(p))
        cores, ends = dict.fromkeys(c for c, _ in plain.values()), {t: self._pack(self.piece(t)) if t else b"" for t in {t for _, t in plain.values()}}
        made = dict(zip(cores, self.merge_batch([c.encode() for c in cores]), strict=True))
        line = self._pack(self.piece("\n"))
        return found | {p: line + made[c] + ends[t] for p, (c, t) in plain.items()}

    def encode_packed(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), self.kind).tolist()

    def encode_stream(self, texts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in blocks, given out once stable.

        Byte-level models: by a Transducer.  Others: blocks are held until a cut as in chunks().
        """
        if not self.suffix:
            state = Transducer(self)
            for block in texts:
                yield from self._part_ids(state.feed(block))
            yield from self._part_ids(state.feed("", True))
            return
        held = ""
        for block in texts:
            held += block
            done = self.chunks(held)
            if len(done) > 1:
                for key in done[:-1]:
                    yield from self._ids(key)
                held = held[held.rindex(done[-1]) :]
        if held:
            yield from self._ids(held)

    def _part_ids(self, parts: list[str | list[int]]) -> Iterator[int]:
        for x in parts:
            yield from self._ids(x) if isinstance(x, str) else x

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for x in ids:
            if text := machine.feed(self.bytes_of.get(x, b"")):
                yield text
        if text := machine.close():
            yield text

    def decode(self, ids: list[int]) -> str:
        machine = Utf8Machine()
        get = self.bytes_of.__getitem__
        return "".join(machine.feed(b"".join(map(get, ids[at : at + 4096]))) for at in range(0, len(ids), 4096)) + machine.close()


@lru_cache(maxsize=4)
def load(name: str) -> Bpe:
    """One model for each file and Python worker."""
    return Bpe(tokenizer_path(name))


def release(name: str) -> None:
    """Forget what a worker's model has cached of words; its rules stay."""
    model = load(name)
    model.young, model.old, model.behind = {}, {}, {}
