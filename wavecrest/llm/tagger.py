"""A character-level bidirectional LSTM with CRF transitions, in numpy, with its training."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, and for each kind a tag for its first character and one for the others.
TAGS = 1 + 2 * len(KINDS)
#: Character codes: 0 padding, 1 white space, 2 letters beyond ASCII, 3 other, 4.. printable ASCII.
CODES = 4 + 95
#: Codes of the characters up to U+00A0; those beyond have the last one's.
CODE_OF = np.array([p - 28 if 32 < p < 127 else 2 if p >= 0xA0 else 1 if 9 <= p <= 32 else 3 for p in range(0xA1)], np.uint8)
#: Gates are steady beyond this, and the product of two exponentials is finite up to it.
STEEP = 43.0


def codes(text: str) -> np.ndarray:
    return CODE_OF[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0xA0)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, dim: int = 10, hidden: int = 10, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden

        def glorot(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"E": glorot(CODES, dim), "O": glorot(2 * hidden, TAGS), "bo": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": glorot(dim, 4 * hidden), f"U{d}": glorot(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0

    # -- forward ---------------------------------------------------------------------------------

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (B, L, H) of one direction; a padded position leaves the state as it is."""
        n, length = x.shape
        h, c = np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
        out = np.zeros((n, length, self.hidden), np.float32)
        wide = self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"]
        k = self.hidden
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = wide[x[:, t]] + h @ self.p[f"U{d}"]
            s = _sigmoid(z[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 3 * k :])
            live = (x[:, t] > 0)[:, None]
            c2 = np.where(live, f * c + i * g, c)
            y = np.tanh(c2)
            h2 = np.where(live, o * y, h)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, y, live))
            h, c = h2, c2
            out[:, t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, "f"), self._run(x, "b")], 2) @ self.p["O"] + self.p["bo"]

    def scores(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions (position, TAGS, column) and gains (position, column) of sequences of any lengths, and each one's column.

        Columns stand by length, the longest first, so that each step has live columns only; what
        stands beyond a column's end means nothing.
        """
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        size = np.array([len(parts[k]) for k in order])
        length, n, k = int(size[0]), len(parts), self.hidden
        live = np.searchsorted(-size, -np.arange(length), "left").tolist()
        # columns that have ended are left out by sixteenths, a step late
        wide = [n]
        for m in live[:-1]:
            wide.append(m if m <= wide[-1] - wide[-1] // 16 - 1 else wide[-1])
        x = np.zeros((n, length), np.uint8)
        for j, i in enumerate(order):
            x[j, : size[j]] = parts[i]
        x = x.T.astype(np.intp, "C")
        letters = np.ascontiguousarray(self.p["E"].T, np.float32)
        # sigmoid(z) = 1 / (1 + exp(-z)) and tanh(z) = 2 / (1 + exp(-2 z)) - 1: one exp for all gates
        turn = -np.where(np.arange(4 * k) < 3 * k, 1.0, 2.0)
        e = np.zeros((length, TAGS, n), np.float32)
        for d in "fb":
            w = np.concatenate([self.p[f"U{d}"], self.p[f"W{d}"], self.p[f"c{d}"][None]]) * turn
            steep = (np.abs(w[:k]).sum(0) + np.abs(self.p["E"] @ w[k:-1] + w[-1]).max(0)).max() > STEEP
            # one product a step, of the state before it, the letter, and a one; it also gives what that state adds to the emissions
            last = np.zeros((len(w), TAGS))
            last[:k] = self.p["O"][:k] if d == "f" else self.p["O"][k:]
            last[-1] = self.p["bo"] if d == "f" else 0
            w = np.ascontiguousarray(np.concatenate([w, last], 1).T, np.float32)
            before, m = -1, -1
            given, c = np.zeros((w.shape[1], 0), np.float32), np.zeros((k, 0), np.float32)
            for t in [*range(length), -1] if d == "f" else [*range(length - 1, -1, -1), -1]:
                if t >= 0 and wide[t] != m:
                    # columns go in one direction and come in the other, each with a state of zeros
                    kept, m = given.shape[1], wide[t]
                    given, c = (np.concatenate([v[:, :m], np.zeros((len(v), max(0, m - kept)), np.float32)], 1) for v in (given, c))
                    given[-1] = 1
                    z, product = np.empty((len(w), m), np.float32), np.empty((k, m), np.float32)
                    h, letter, gates, g, adds = given[:k], given[k:-1], z[: 4 * k], z[3 * k : 4 * k], z[4 * k :]
                if d == "b" and t >= 0 and (came := live[t + 1] if t + 1 < length else 0) < live[t]:
                    given[:k, came:], c[:, came:] = 0, 0
                if t >= 0:
                    letters.take(x[t, :m], 1, letter, "clip")
                np.matmul(w, given, out=z)
                if before >= 0:
                    e[before, :, :m] += adds
                before = t
                if t < 0:
                    break
                if steep:
                    np.minimum(gates, STEEP, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.subtract(2, g, out=product)
                g *= z[:k]
                product /= g
                c /= z[k : 2 * k]
                c += product
                np.tanh(c, out=product)
                np.divide(product, z[2 * k : 3 * k], out=h)
        gain = np.empty((length, n), np.float32)
        # some positions at a time, which stay in the cache
        for t in range(0, length, 16):
            gain[t : t + 16] = self.gains(e[t : t + 16])
        column = np.empty(n, np.int64)
        column[order] = np.arange(n)
        return e, gain, column

    def emissions_of(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Emissions (L, TAGS) of sequences of any lengths."""
        e, _, column = self.scores(parts)
        return [e[: len(p), :, j].copy() for p, j in zip(parts, column.tolist(), strict=True)]

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence of emissions (L, TAGS)."""
        best, back = e[0].astype(float), []
        for t in range(1, len(e)):
            s = best[:, None] + self.p["T"]
            back.append(s.argmax(0))
            best = s.max(0) + e[t]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])

    def gains(self, e: np.ndarray) -> np.ndarray:
        """At each position of emissions (..., TAGS, positions), the most that another tag and the transition into it gain over outside."""
        tr = self.p["T"].astype(float)
        into = (tr.max(0)[1:] - tr[0, 0]).astype(np.float32)
        return (e[..., 1:, :] + into[:, None]).max(-2) - e[..., 0, :]

    def sure(self, gain: np.ndarray, last: bool = True) -> np.ndarray:
        """Positions that the best path has outside (if more follow: whatever these are), by a text's gains.

        A stretch of other tags between two outsides gains at most, at each position, the best of
        emission and transition into it over those of outside, and loses the transition back.  In
        the best path no stretch loses, so a position is open only if the best sum around it doesn't.
        """
        tr = self.p["T"].astype(float)
        total = np.zeros(len(gain) + 1)
        np.cumsum(gain, dtype=float, out=total[1:])
        low = np.minimum.accumulate(total[:-1])
        inner = np.maximum.accumulate(total[:0:-1])[::-1] + (tr[1:, 0].max() - tr[0, 0])
        # at the end there is no way back; before more emissions a stretch may be cut where it loses
        end = total[-1] + (0.0 if last else float((tr[1:, 1:] - tr[:1, 1:]).max()))
        np.maximum(inner, end, out=inner)
        inner -= low
        return inner < -1e-3

    def outside(self, e: np.ndarray, last: bool = True) -> np.ndarray:
        """Positions of one sequence of emissions (L, TAGS) that are surely outside."""
        gain = self.gains(e.T)
        gain[0] = max(gain[0], (e[0, 1:] - e[0, 0]).max())
        return self.sure(gain, last)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence, as viterbi(): between sure positions, all stretches at once."""
        tags = np.zeros(len(e), np.int64)
        if len(e):
            at = np.flatnonzero(~self.outside(e))
            tags[at] = self.decode_open(e[at], at, np.array([0, len(e)]))
        return tags

    def decode_open(self, e: np.ndarray, at: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Best tags of the open positions `at` of sequences that follow each other and begin at `edges` (the last: their end)."""
        tags = np.zeros(len(at), np.int64)
        if not len(at):
            return tags
        opens = np.isin(at, edges)
        start = np.flatnonzero(opens | (np.diff(at, prepend=-2) > 1))
        size = np.diff(start, append=len(at))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        tr = self.p["T"].astype(float)
        live = np.searchsorted(-size, -np.arange(size[0]), "left").tolist()
        best = e[start] + np.where(opens[start][:, None], 0.0, tr[0])
        # of each step only what is live, so that one long stretch doesn't widen the others
        back = [np.zeros((0, TAGS), np.int8)]
        for t in range(1, int(size[0])):
            m = live[t]
            s = best[:m, None, :] + tr.T
            back.append(s.argmax(2).astype(np.int8))
            best[:m] = s.max(2) + e[start[:m] + t]
        best += np.where(np.isin(at[start + size - 1] + 1, edges)[:, None], 0.0, tr[:, 0])
        now = best.argmax(1)
        rows = np.arange(len(start))
        for t in range(int(size[0]) - 1, -1, -1):
            m = live[t]
            tags[start[:m] + t] = now[:m]
            if t:
                now[:m] = back[t][rows[:m], now[:m]]
        return tags

    # -- training --------------------------------------------------------------------------------

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the mean negative log likelihood by emissions and transitions."""
        n, length, _ = e.shape
        tr = self.p["T"]

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(v - m).sum(axis))

        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, length):
            a[:, t] = e[:, t] + lse(a[:, t - 1, :, None] + tr, 1)
        for t in range(length - 2, -1, -1):
            b[:, t] = lse(tr + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
        z = lse(a[:, -1], 1)
        de = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + tr + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        rows = np.arange(n)[:, None]
        de[rows, np.arange(length), y] -= 1
        return de / n, pair / n

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], 2)
        de, dt = self._crf(h @ self.p["O"] + self.p["bo"], y)
        g = {"O": np.einsum("blh,blk->hk", h, de), "bo": de.sum((0, 1)), "T": dt, "E": np.zeros_like(self.p["E"])}
        dh_all = de @ self.p["O"].T
        k = self.hidden
        for n, d in enumerate("fb"):
            dh_d = dh_all[:, :, n * k : (n + 1) * k]
            w, u = self.p[f"W{d}"], self.p[f"U{d}"]
            gu, gwide = np.zeros_like(u), np.zeros((CODES, 4 * k), np.float32)
            dh, dc = np.zeros_like(dh_d[:, 0]), np.zeros_like(dh_d[:, 0])
            for t, h0, c0, i, f, o, gg, yy, live in reversed(kept[d]):
                dh = dh + dh_d[:, t]
                own, ownc = np.where(live, dh, 0), np.where(live, dc, 0)
                do = own * yy
                dcc = ownc + own * o * (1 - yy * yy)
                dz = np.concatenate([dcc * gg * i * (1 - i), dcc * c0 * f * (1 - f), do * o * (1 - o), dcc * i * (1 - gg * gg)], 1)
                gu += h0.T @ dz
                np.add.at(gwide, x[:, t], dz)
                dh = np.where(live, dz @ u.T, dh)
                dc = np.where(live, dcc * f, dc)
            g |= {f"U{d}": gu, f"W{d}": self.p["E"].T @ gwide, f"c{d}": gwide.sum(0)}
            g["E"] += gwide @ w.T
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 13) -> None:
        """Adam with clipped gradients and a falling rate."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                g = self.gradients(x[own], y[own])
                norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / total)
                for k, w in g.items():
                    w = w / max(1.0, norm / 5)
                    m[k] = 0.9 * m[k] + 0.1 * w
                    v[k] = 0.99 * v[k] + 0.01 * w * w
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
