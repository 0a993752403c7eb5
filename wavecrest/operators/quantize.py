"""Vector quantisation: nearest codes, residual levels, k-means, token text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.sources.scratch import dense_index

#: A codebook is broadcast to all tasks; larger ones are refused.
MAX_CODEBOOK_BYTES = 512 << 20


def load_codebook(codes: DataFrame, code: str, centroid: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes in ascending order and their centroids; a codebook is bounded by definition."""
    n = codes.count()
    first = codes.select(F.size(centroid)).first()
    if n * (first[0] if first else 0) * 8 > MAX_CODEBOOK_BYTES:
        raise ValueError("the codebook is too large to broadcast")
    rows = codes.select(F.col(code).cast("long"), centroid).orderBy(code).toArrow().combine_chunks()
    return rows.column(0).to_numpy(), vectors(rows.column(1))


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    sizes = pc.list_value_length(column)
    if not n or column.null_count or pc.any(pc.not_equal(sizes, sizes[0])).as_py():
        return np.array(column.to_pylist(), float).reshape(n, -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row numbers of the nearest centroids by rounded squared distance, the first of equals; blocks bound the memory."""
    step = max(1, 8_000_000 // max(1, len(c)))
    return np.concatenate([np.round(((x[a : a + step] ** 2).sum(1)[:, None] - 2 * x[a : a + step] @ c.T + (c**2).sum(1)), 9).argmin(1) for a in range(0, len(x), step)]) if len(x) else np.empty(0, np.int64)


#: From so many codes on, a search leaves out groups of codes that are too far away.
INDEXED_CODES = 1024
#: Where the groups leave out less than the rest, all distances are computed at once instead; the codes are the same.
MOST_SHARE = 0.5
#: The same for the tree, whose distances are computed pair by pair.
MOST_OF_TREE = 0.1
#: Up to this width the codes stand in a tree of boxes; wider vectors have groups around centres.
TREE_WIDTH = 8
#: Codes of a leaf at most, rows searched together, and pairs of a row and a node that are looked at together.
LEAF, ROWS, PAIRS = 16, 8192, 1 << 17


class CodeTree:
    """Different centroids in halves by their widest coordinate, each half with the box around it.

    A row goes down to the nearest leaf and takes its best code; then it looks, from the root, at the nodes whose
    box is no further away than the best so far, with a margin for the rounding by which equals are told.  What a
    row looks at grows with the logarithm of the codes where rows lie near them.
    """

    def __init__(self, centroids: np.ndarray) -> None:
        # of equal centroids the first, as no other can be an answer
        order = np.lexsort(centroids.T[::-1])
        new = np.concatenate([[True], (centroids[order[1:]] != centroids[order[:-1]]).any(1)])
        order = order[new]
        c, n = centroids[order], len(order)
        self.depth = max(0, int(np.ceil(np.log2(n / LEAF))))
        cuts, at = np.array([0, n]), np.arange(n)
        low, high = [np.empty((0, c.shape[1]))], [np.empty((0, c.shape[1]))]
        for level in range(self.depth + 1):
            low.append(np.minimum.reduceat(c[at], cuts[:-1]))
            high.append(np.maximum.reduceat(c[at], cuts[:-1]))
            if level < self.depth:
                node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                widest = (high[-1] - low[-1]).argmax(1)
                at = at[np.lexsort((c[at, widest[node]], node))]
                cuts = np.sort(np.concatenate([cuts, (cuts[:-1] + cuts[1:]) // 2]))
        # node k has the halves 2k and 2k + 1; node 0 is none
        none = np.zeros((1, c.shape[1]))
        self.low, self.high = (np.ascontiguousarray(np.concatenate([none, *v]).T) for v in (low, high))
        at = at[np.lexsort((order[at], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))))]
        # leaves have one size, or one less: the last code stands twice then
        place = np.minimum(cuts[:-1, None] + np.arange(np.diff(cuts).max()), cuts[1:, None] - 1)
        self.codes = order[at[place]]
        self.leaves = np.ascontiguousarray(c[at[place]].transpose(2, 0, 1))

    def _gap(self, x: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the boxes of nodes."""
        total = np.zeros(len(rows))
        for v, low, high in zip(x, self.low, self.high, strict=True):
            v = v[rows]
            d = np.maximum(np.maximum(low[nodes] - v, v - high[nodes]), 0)
            total += d * d
        return total

    def _leaf(self, x: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(rows), self.codes.shape[1]))
        for v, c in zip(x, self.leaves, strict=True):
            d = v[rows][:, None] - c[leaves]
            total += d * d
        total = np.round(total, 9)
        at, k = total.argmin(1), np.arange(len(rows))
        return total[k, at], self.codes[leaves, at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Row numbers of the nearest centroids, and how many distances were computed; x has finite values."""
        x, n = np.ascontiguousarray(x.T), len(x)
        every, own, computed = np.arange(n), np.ones(n, np.int64), 0
        for _ in range(self.depth):
            own = 2 * own + (self._gap(x, every, 2 * own + 1) < self._gap(x, every, 2 * own))
            computed += 2 * n
        first = 1 << self.depth
        best, code = self._leaf(x, every, own - first)
        computed += n * self.codes.shape[1]
        waiting = [(every, np.ones(n, np.int64), 0)] if self.depth else []
        while waiting:
            rows, nodes, level = waiting.pop()
            if len(rows) > PAIRS:
                half = len(rows) // 2
                waiting += [(rows[half:], nodes[half:], level), (rows[:half], nodes[:half], level)]
                continue
            if level < self.depth:
                rows, nodes, level = np.repeat(rows, 2), (2 * nodes[:, None] + np.array([0, 1])).ravel(), level + 1
                near = self._gap(x, rows, nodes) <= best[rows] * (1 + 1e-9) + 1e-8
                computed += len(rows)
                if level == self.depth:
                    near &= nodes != own[rows]
                if near.any():
                    waiting.append((rows[near], nodes[near], level))
                continue
            near = self._gap(x, rows, nodes) <= best[rows] * (1 + 1e-9) + 1e-8
            rows, nodes = rows[near], nodes[near]
            d, k = self._leaf(x, rows, nodes - first)
            computed += len(near) + d.size * self.codes.shape[1]
            order = np.lexsort((k, d, rows))
            rows, d, k = rows[order], d[order], k[order]
            one = np.concatenate([[True], rows[1:] != rows[:-1]])[: len(rows)]
            rows, d, k = rows[one], d[one], k[one]
            better = (d < best[rows]) | ((d == best[rows]) & (k < code[rows]))
            best[rows[better]], code[rows[better]] = d[better], k[better]
        return code, computed


class CodeIndex:
    """Nearest centroids, exactly, with distances to few of them computed.

    Narrow vectors are searched in a tree of boxes.  Wider centroids are dealt to about sqrt(K) groups around
    centres of their own, each with a radius.  A vector
    looks at its nearest group first; then a group is left out for all vectors whose distance to its centre,
    less the radius, exceeds the best distance so far (the triangle inequality), with a margin for the
    rounding by which equals are told.  ``share`` is the part of all distances that were computed.
    """

    def __init__(self, centroids: np.ndarray, rounds: int = 4) -> None:
        self.c, k = centroids, len(centroids)
        self.computed = self.total = 0
        self.groups = self.tree = None
        if k < INDEXED_CODES:
            return
        if centroids.shape[1] <= TREE_WIDTH and np.isfinite(centroids).all():
            self.tree = CodeTree(centroids)
            return
        centres = centroids[np.linspace(0, k - 1, int(np.sqrt(k))).astype(int)].copy()
        for _ in range(rounds):
            own = _nearest(centroids, centres)
            n = np.bincount(own, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, own, centroids)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        own = _nearest(centroids, centres)
        self.groups = [g for j in range(len(centres)) if len(g := np.flatnonzero(own == j))]
        self.centres = np.array([centroids[g].mean(0) for g in self.groups])
        self.radius = np.array([np.sqrt(((centroids[g] - m) ** 2).sum(1).max()) for g, m in zip(self.groups, self.centres, strict=True)])

    @property
    def share(self) -> float:
        return self.computed / max(1, self.total)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Row numbers of the nearest centroids by rounded squared distance, the first of equals."""
        self.total += len(x) * len(self.c)
        if self.tree is not None and len(x) and not (self.computed and self.share > MOST_OF_TREE):
            # without numbers all codes are equally far, and the first is the answer
            out, real = np.zeros(len(x), np.int64), np.flatnonzero(np.isfinite(x).all(1))
            for a in range(0, len(real), ROWS):
                out[real[a : a + ROWS]], n = self.tree.nearest(x[real[a : a + ROWS]])
                self.computed += n
            return out
        if not self.groups or not len(x) or (self.computed and self.share > MOST_SHARE):
            self.computed += len(x) * len(self.c)
            return _nearest(x, self.c)
        step = max(1, 8_000_000 // len(self.c))
        return np.concatenate([self._block(x[a : a + step]) for a in range(0, len(x), step)])

    def _block(self, x: np.ndarray) -> np.ndarray:
        squares = (x**2).sum(1)
        far = np.sqrt(np.maximum(squares[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1), 0))
        self.computed += far.size
        first = far.argmin(1)
        best, code = np.full(len(x), np.inf), np.zeros(len(x), np.int64)

        def look(rows: np.ndarray, g: int) -> None:
            own = self.groups[g]
            c = self.c[own]
            d = np.round(squares[rows][:, None] - 2 * x[rows] @ c.T + (c**2).sum(1), 9)
            self.computed += d.size
            at = d.argmin(1)
            d, at = d[np.arange(len(rows)), at], own[at]
            better = (d < best[rows]) | ((d == best[rows]) & (at < code[rows]))
            best[rows[better]], code[rows[better]] = d[better], at[better]

        for g in np.unique(first):
            look(np.flatnonzero(first == g), g)
        for g in range(len(self.groups)):
            reach = np.sqrt(np.maximum(best, 0) + 1e-8) * (1 + 1e-9)
            rows = np.flatnonzero((far[:, g] - self.radius[g] <= reach + 1e-9) & (first != g))
            if len(rows):
                look(rows, g)
        return code


def nearest_codes(df: DataFrame, vector: str, codes: np.ndarray, centroids: np.ndarray, levels: int = 1) -> DataFrame:
    """The rows with ``codes``: one code per level, each level on the residual of the former."""
    shared = df.sparkSession.sparkContext.broadcast((codes, CodeIndex(centroids)))
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index = shared.value
        for b in batches:
            x = vectors(b.column(at))
            found = []
            for level in range(levels if b.num_rows else 0):
                k = index.nearest(x)
                found.append(codes[k])
                if level + 1 < levels:
                    x = x - index.c[k]
            out = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * levels, pa.int32()), pa.array(np.stack(found, 1).ravel() if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "codes"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", codes array<bigint>")


def kmeans(df: DataFrame, vector: str, start: np.ndarray, iterations: int) -> np.ndarray:
    """Lloyd's iterations from given centroids; each task sends one sum per centroid."""
    c = start.copy()
    for _ in range(iterations):
        shared = df.sparkSession.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                x = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
                k = _nearest(x, c)
                np.add.at(total, k, x)
                n += np.bincount(k, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int64()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "n", "s"])

        parts = df.select(vector).mapInArrow(run, "k long, n long, s array<double>").where("n > 0")
        # one row of sums for each centroid
        sums = parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[d]) for d in range(c.shape[1]))).alias("s")).collect()
        c = c.copy()
        for r in sums:
            c[r.k] = np.array(r.s) / r.n
    return c


def fit_kmeans(df: DataFrame, key: str, vector: str, k: int, iterations: int, redo: int = 1, most_per_code: int | None = None, seed: int = 42) -> np.ndarray:
    """Centroids of the best of several runs, by the sum of squared distances over the rows used.

    most_per_code bounds the rows used to k times that many, by a hash of the key; starts are rows in the
    order of another hash for each run.  Fewer rows than k are an error.
    """
    n = df.count()
    if n < k:
        raise ValueError(f"{n} rows for {k} codes")
    rows = df.select(key, vector)
    if most_per_code is not None and n > k * most_per_code:
        share = k * most_per_code / n
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    rows = rows.cache()
    best, least = None, np.inf
    for turn in range(redo):
        first = rows.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1 + turn)), key).limit(k).collect()
        c = kmeans(rows, vector, np.array([r[vector] for r in first], float), iterations)
        cost = assign(rows, key, vector, c).agg(F.sum("distance")).first()[0]
        if cost < least:
            best, least = c, cost
    rows.unpersist()
    return best


def assign(df: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """key, cluster and squared distance of every row."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            k = _nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k), pa.array(((x - c[k]) ** 2).sum(1) if len(x) else np.empty(0))], [key, "cluster", "distance"])

    return df.select(key, vector).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, cluster long, distance double")


#: Rows of a block at least, blocks of a table, bytes of a block's doubles at most, and rows that are multiplied together.
BLOCK_ROWS, BLOCKS, BLOCK_BYTES, TILE = 2048, 24, 128 << 20, 512


def pair_cosines(df: DataFrame, code: str, vector: str, block: int = BLOCK_ROWS) -> DataFrame:
    """One row of sums over the cosines of all ordered pairs of different codes: n, total, total_abs, squares, mx, mn,
    b1 .. b9 (absolute value below 0.1 .. 0.9) and a9 (above 0.9).

    Codes are dealt to blocks by their order and each pair of blocks is one task's, so a codebook of any size
    is compared and none is held whole; only counts leave a task.  A row is sent once for each block: blocks grow
    with the table while their number stays, so what is shuffled grows as the table does, until a block has BLOCK_BYTES.
    """
    names = ["n", *(f"b{k}" for k in range(1, 10)), "a9", "total", "total_abs", "squares", "mx", "mn"]
    at = dense_index(df.select(F.col(code).cast("long").alias("code"), F.col(vector).alias("v")), "code", F.xxhash64("v"), name="at")
    last, width = at.agg(F.max("at"), F.max(F.size("v"))).first()
    rows = max(block, min(-(-((last or 0) + 1) // BLOCKS), BLOCK_BYTES // (8 * max(1, width or 1))))
    pair = F.transform(F.sequence(F.lit(0), F.lit((last or 0) // rows)), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    at = at.withColumn("b", F.floor(F.col("at") / rows).cast("long"))
    dealt = at.select("code", "v", "b", F.explode(pair).alias("p")).select("p.i", "p.j", "b", "code", "v")

    def compare(rows: pa.Table) -> pa.Table:
        i, j, b = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["b"].to_numpy()
        code, x = rows["code"].to_numpy(), vectors(rows["v"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        (left, u), (right, v) = ((code[b == k], x[b == k]) for k in (i, j))
        counts, sums, ends = np.zeros(11, np.int64), np.zeros(3), []
        for p in range(0, len(u), TILE):
            for q in range(p if i == j else 0, len(v), TILE):
                s, own, other = u[p : p + TILE] @ v[q : q + TILE].T, left[p : p + TILE], right[q : q + TILE]
                if len(np.intersect1d(own, other)):
                    s = s[own[:, None] != other]
                if not s.size:
                    continue
                # two tiles stand for both orders
                times, size = 1 if i == j and p == q else 2, np.abs(s)
                counts += times * np.array([s.size, *(np.count_nonzero(size < k / 10) for k in range(1, 10)), np.count_nonzero(size > 0.9)])
                sums += times * np.array([s.sum(), size.sum(), np.vdot(s, s)])
                ends += [s.max(), s.min()]
        row = [*counts.tolist(), *sums.tolist(), *([np.max(ends), np.min(ends)] if ends else [None, None])]
        return pa.Table.from_arrays([pa.array([v], pa.int64() if k < 11 else pa.float64()) for k, v in enumerate(row)], names)

    parts = dealt.groupBy("i", "j").applyInArrow(compare, ", ".join(f"{n} {'long' if k < 11 else 'double'}" for k, n in enumerate(names)))
    return parts.agg(*((F.max if n == "mx" else F.min if n == "mn" else F.sum)(n).alias(n) for n in names))


def format_tokens(ids: Column, prefix: str = "tok", offset: int = 0) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit(f"<|{prefix}:"), (x + offset).cast("string"), F.lit("|>"))), "")


def parse_tokens(text: Column, prefix: str = "tok", offset: int = 0) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<\|{prefix}:(\d+)\|>"), F.lit(1)), lambda x: x.cast("long") - offset)


def split_tokens(text: Column, prefix: str = "tok") -> Column:
    """The tokens themselves, whatever they name; what stands between them is left out."""
    return F.regexp_extract_all(text, F.lit(rf"<\|{prefix}:[^|>]+\|>"), F.lit(0))


def code_counts(df: DataFrame, code: str, size: int) -> DataFrame:
    """code and n for each code of the book; ids outside it, and null, are left out."""
    inside = df.where(F.col(code).between(0, size - 1)).groupBy(F.col(code).cast("long").alias("code")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(size).withColumnRenamed("id", "code").join(inside, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


def select_levels(codes: Column, level: int, n_levels: int) -> Column:
    """The first levels of interleaved residual codes, position by position."""
    if not 1 <= level <= n_levels:
        raise ValueError(f"level {level} of {n_levels}")
    return F.slice(codes, 1, level)


def level_text(codes: Column, level: int, n_levels: int, prefix: str = "tok") -> Column:
    """Residual codes, one array for each level, as interleaved token text of the first levels, each with its number."""
    if not 1 <= level <= n_levels:
        raise ValueError(f"level {level} of {n_levels}")
    at = F.sequence(F.lit(0), F.size(codes[0]) - 1)
    tokens = F.transform(at, lambda i: F.concat(*[F.concat(F.lit(f"<|{prefix}:L{k + 1}_"), F.get(codes[k], i).cast("string"), F.lit("|>")) for k in range(level)]))
    return F.when(F.size(codes[0]) > 0, F.array_join(tokens, "")).otherwise("")


def decode_codes(df: DataFrame, key: str, codes: str, book: DataFrame, code: str, vector: str, target: int) -> DataFrame:
    """Vectors of the codes one after the other, cut or filled with zeros to the target; an unknown code is an error."""
    rows = df.select(key, F.posexplode_outer(codes).alias("_i", "_code"))
    found = rows.join(book.select(F.col(code).alias("_code"), F.col(vector).alias("_v")), "_code", "left")
    v = F.when(F.col("_code").isNotNull() & F.col("_v").isNull(), F.raise_error(F.concat(F.lit("no code "), F.col("_code").cast("string")))).otherwise(F.col("_v"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("_code").isNotNull(), F.struct(F.col("_i"), v.alias("v"))))), lambda x: x.v))
    out = found.groupBy(key).agg(flat.alias("signal"))
    zeros = F.transform(F.array_repeat(F.lit(0), F.greatest(F.lit(target) - F.size("signal"), F.lit(0))), lambda x: x.cast("float"))
    return out.withColumn("signal", F.concat(F.slice(F.col("signal"), 1, target), zeros))
