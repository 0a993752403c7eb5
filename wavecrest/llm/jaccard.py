"""Self join of word-shingle sets by Jaccard similarity, size-aware (heavy and light sets).

Sets are distinct w-word shingles, as 64-bit hashes.  Equal sets are one node.  All sets are ordered
by one global order, rare shingles first: two sets that reach the threshold share at least k of their
n - c + k first shingles, c being the overlap that a set of n needs at least.  A light set (n up to a
boundary) posts every pair (k = 2) from its prefix, a subset that few others have; a heavy set posts
single shingles (k = 1) and meets others in inverted lists; light sets near the boundary are in the
lists too, so that no pair is lost between the kinds.  Entries that no other set has are dropped before,
so light sets post pairs of shared entries only.  The boundary is the size at which the cost of all sets
is least, by the actual lengths of the lists: subsets and meetings of the light ones, entries and
meetings of the heavy ones.

Of two sets the smaller one needs only the shorter prefix of n - c' + 1 shingles, c' being the overlap
with a partner of its own size or more: entries beyond it meet only smaller partners.

A list of up to LIST members is paired out, LIST / 2 pairs a member at most.  A longer list (near
copies) is scanned in tiles: each member goes to a tile of its longest list and size class, tiles that
have a list in common are compared by one product of 0/1 matrices, and only stars of linked members
leave the tile.  Lists that spread over many tiles have tiles of their own.  Where a list needs several
tiles, members meet a few central ones first; tiles wholly within one component aren't compared.  So
no link between different components is missed and no list is cut.

Null and empty texts: empty sets, linked with nothing.  Rows with a null doc_id: linked with nothing.
Rows that repeat a doc_id are one node.  A text of any length is one set.  Equal counts are ordered by
hash.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.llm.common import materialize, shared_dir, slices, table
from wavecrest.llm.graph import components, stars

#: Up to so many ids (8 bytes each) are broadcast for a filter; more are joined.
BROADCAST_IDS = 1_000_000
#: Sets of candidates are broadcast up to so many bytes, and joined beyond.
BROADCAST_BYTES = 8 << 20
SLICE = 1 << 14
#: Lists of up to so many members are paired out, longer ones compared in tiles.
LIST = 16
#: Shingles of the sets of a tile, about; documents of a block within it; central members a list is met with first.
TILE, BLOCK, PIVOTS = 1 << 19, 256, 8
#: What a meeting in a list costs (the pair and its check), in rows posted.
MEETING = 4
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a public 64-bit generator (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes; fewer words than asked for make one shingle."""
    # bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0D only
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = np.full(len(parts) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out + h[k : k + len(out)]) * ODD
    return np.unique(mix(out))


def _least(n: np.ndarray | int, num: int, den: int):
    """Overlap that a set of n needs with any partner: ceil(n * num / den)."""
    return (n * num + den - 1) // den


def fingerprints(docs: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, f1, f2), and a sketch of 2**bits shingle counts in slices; one pass over the texts."""
    schema = "doc_id long, n int, f1 long, f2 long, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            for part in slices(batch):
                n, f1, f2 = [], [], []
                for t in part.column(1):
                    h = shingles(t.as_py(), words)
                    np.add.at(total, h >> shift, 1)
                    d = xxhash.xxh3_128_intdigest(h.tobytes())
                    n.append(len(h))
                    f1.append((d >> 64) - (1 << 63))
                    f2.append((d & ((1 << 64) - 1)) - (1 << 63))
                k = len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "n", "f1", "f2", "slice", "counts"])
        parts = [zlib.compress(total[a : a + SLICE].tobytes(), 1) for a in range(0, len(total), SLICE)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "n", "f1", "f2", "slice", "counts"])

    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return rows.where("slice is null").select("doc_id", "n", "f1", "f2"), rows.where("slice is not null").select("slice", "counts")


def sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The summed counts: 4 * 2**bits bytes, at most 64 MB."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
                total[s] = total[s] + now if s in total else now.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["slice", "counts"])

    # summed within each reading task first, then by slice
    out = np.zeros(1 << bits, np.uint32)
    for r in parts.mapInArrow(add, "slice int, counts binary").repartition(8, "slice").mapInArrow(add, "slice int, counts binary").collect():
        own = np.frombuffer(zlib.decompress(r.counts), np.uint32)
        out[r.slice * SLICE : r.slice * SLICE + len(own)] = own
    return out


def prefixes(docs: DataFrame, words: int, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """doc_id, n and first: the rest + 2 rarest shingles, rest being what a set of n may lack."""
    bits = int(len(counts)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = shared.value, np.uint64(64 - bits)
        for batch in batches:
            for part in slices(batch):
                n, first = [], []
                for t in part.column(1):
                    h = shingles(t.as_py(), words)
                    n.append(len(h))
                    first.append(h[np.argsort(counts[h >> shift], kind="stable")[: len(h) - _least(len(h), num, den) + 2]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), _lists(first)], ["doc_id", "n", "first"])

    return docs.mapInArrow(run, "doc_id long, n int, first array<long>").where("n > 0")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns of batches sorted by the first one, cut between keys: (False, whole lists), or (True, a part of a list above LIST)."""
    held: list[np.ndarray] | None = None
    over: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        held = None
        if over is not None:
            k = int(np.searchsorted(rows[0], over, "right"))
            if k:
                yield True, [x[:k] for x in rows]
            rows = [x[k:] for x in rows]
            if not len(rows[0]):
                continue
            over = None
        # the last list may go on in the next batch
        k = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if k:
            yield False, [x[:k] for x in rows]
        held = [x[k:] for x in rows]
        if len(held[0]) > LIST:
            yield True, held
            held, over = None, int(rows[0][-1])
    if held is not None:
        yield False, held


def _members(key: np.ndarray) -> np.ndarray:
    """For each row the number of rows of its key; keys are sorted."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.concatenate([start, [len(key)]]))
    return np.repeat(length, length)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id, n, pos) sorted by key, those whose key another row has too, with m, the list's length up to LIST + 1."""
    for long, rows in _by_key(batches):
        m = np.full(len(rows[0]), LIST + 1) if long else np.minimum(_members(rows[0]), LIST + 1)
        keep = m > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in rows), pa.array(m[keep].astype(np.int32))], ["key", "doc_id", "n", "pos", "m"])


def shared_prefixes(first: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, n, and own: the entries (pos, key, m) of the prefix that others have too, by rank, and what
    the set costs as a light one and as a heavy one, in rows posted.

    A pair of entries is met by no more sets than the rarer of both is.
    """
    n_parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = first.select(F.posexplode("first").alias("pos", "key"), "doc_id", "n").select("key", "doc_id", "n", "pos")
    rows = rows.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(_shared, "key long, doc_id long, n int, pos int, m int")
    own = rows.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "m"))).alias("own"))
    light = f"""aggregate(transform(array_sort(transform(own, x -> x.m)), (m, i) -> (size(own) - 1 - i) * (1D + {MEETING} * (m - 1))), 0D, (a, x) -> a + x)"""
    heavy = f"""aggregate(filter(own, x -> x.pos <= n - ceil(n * {num} / {den})), 0D, (a, x) -> a + 1 + {MEETING} * (x.m - 1))"""
    return own.withColumn("light", F.expr(light)).withColumn("heavy", F.expr(heavy))


def boundary(sizes: list[tuple[int, float, float]], num: int, den: int) -> int:
    """The size up to which sets are light, at the least total cost; 1: none is.

    sizes: (size, cost of its sets as light ones, as heavy ones).  Light sets that may have a heavy
    partner (from num / den of the boundary) cost both.
    """
    if not sizes:
        return 1
    n, light, heavy = (np.array(x, float) for x in zip(*sorted(sizes), strict=True))
    light = np.cumsum(light)
    after = np.concatenate([np.cumsum(heavy[::-1])[::-1], [0.0]])
    best, least = 1, float(heavy.sum())
    for k in np.flatnonzero(n > 1):
        # as far as it changes no kind
        edge = int(n[k + 1]) - 1 if k + 1 < len(n) else (int(n[k]) + 1) * den
        cost = float(light[k]) + float(after[np.searchsorted(n, edge * num // den)])
        if cost < least:
            best, least = edge, cost
    return best


def postings(rows: DataFrame, edge: int, num: int, den: int) -> DataFrame:
    """doc_id, n and the keys under which a set meets its partners; the first ``short`` of them if it is the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = edge * num // den
        for batch in batches:
            keys, short = [], []
            for n, pos, key in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                pos, key, own = pos.values.to_numpy(), key.values.to_numpy().view(np.uint64), []
                if 1 < n <= edge:
                    i, j = np.triu_indices(len(key), 1)
                    own.append(mix(key[i] * ODD + key[j]))
                short.append(sum(map(len, own)) + int((pos <= n - _least(n, 2 * num, num + den)).sum()))
                if n >= low or n == 1:
                    own.append(key[pos <= n - _least(n, num, den)])
                keys.append(np.concatenate(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(keys), pa.array(short, pa.int32())], ["doc_id", "n", "keys", "short"])

    return rows.selectExpr("doc_id", "n", "own.pos as pos", "own.key as key").mapInArrow(run, "doc_id long, n int, keys array<long>, short int")


def _meet(num: int, den: int):
    """From rows (key, doc_id, n, first) sorted by key: pairs (a, b) of short lists, and the rows (key, a, n) of long ones."""
    names = ["a", "b", "key", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, (key, doc, n, first) in _by_key(batches):
            members = np.full(len(key), LIST + 1) if long else _members(key)
            over = members > LIST
            k = int(over.sum())
            if k:
                yield pa.RecordBatch.from_arrays([pa.array(doc[over]), pa.nulls(k, pa.int64()), pa.array(key[over]), pa.array(n[over].astype(np.int64))], names)
            a, b = [], []
            for lag in range(1, int(members[~over].max()) if k < len(key) else 1):
                i = np.flatnonzero((key[lag:] == key[:-lag]) & ~over[lag:])
                j = i + lag
                less, more = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
                needed = (n[i] >= n[j]) & first[j] | (n[j] >= n[i]) & first[i]
                ok = (doc[i] != doc[j]) & (less * den >= more * num) & needed
                a.append(np.minimum(doc[i[ok]], doc[j[ok]]))
                b.append(np.maximum(doc[i[ok]], doc[j[ok]]))
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            if len(a):
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                k = int(new.sum())
                yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names)

    return run


#: Sets of up to so many shingles are compared by 16 bits of each hash first, larger ones by 32.
SHORT = 2500


def leading(h: np.ndarray) -> bytes:
    """The leading bits of each hash, for an upper bound of an overlap at a fraction of the bytes."""
    return (h >> np.uint64(48)).astype("<u2").tobytes() if len(h) <= SHORT else (h >> np.uint64(32)).astype("<u4").tobytes()


def sets_of(docs: DataFrame, ids: DataFrame, words: int, whole: bool) -> DataFrame:
    """doc_id, size and the set (whole, or its leading bits), for the given ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([h.tobytes() if whole else leading(h) for h in sets], pa.binary())], ["doc_id", "n", "set"])

    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return rows.mapInArrow(run, "doc_id long, n int, set binary")


def _reaching(num: int, den: int, whole: bool):
    """Of pairs with their sets, those that reach num / den, or may reach it by their leading bits."""

    def read(data: pa.Scalar, n: int) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), "<u8" if whole else "<u2" if n <= SHORT else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = read(x, m), read(y, n)
                if x.dtype != y.dtype:
                    x, y = (v if v.itemsize == 2 else v >> 16 for v in (x, y))
                    x, y = x.astype("<u4"), y.astype("<u4")
                # both are sorted; whole hashes are distinct, so that the count is the overlap itself
                at = np.searchsorted(y, x)
                o = int((y[np.minimum(at, n - 1)] == x).sum()) if n else 0
                keep.append(o > 0 and den * o >= num * (m + n - o))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b), those that reach num / den by their whole sets.

    The leading bits give an upper bound of the overlap; pairs that pass it are compared in full.
    """
    for whole in (False, True):
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        sets = materialize(sets_of(docs, ids, words, whole))
        left = sets.selectExpr("doc_id as a", "n as m", "set as x")
        right = sets.selectExpr("doc_id as b", "n", "set as y")
        if (sets.agg(F.sum(F.octet_length("set"))).first()[0] or 0) <= BROADCAST_BYTES:
            left, right = F.broadcast(left), F.broadcast(right)
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y")
        pairs = materialize(both.mapInArrow(_reaching(num, den, whole), "a long, b long"))
    return pairs


def linked_stars(ids: np.ndarray, sets: list[np.ndarray], left: int | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links among sets; with ``left``, of links between the first so many and the others only.

    Overlaps are products of 0/1 matrices, block by block, over the shingles that two sets have.
    """
    n = np.array([len(s) for s in sets], np.int64)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[code] > 1
    owner, code = np.repeat(np.arange(len(sets)), n)[keep], code[keep]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    column = np.full(len(often), -1, np.int64)
    out = (np.empty(0, np.int64), np.empty(0, np.int64))

    def matrix(at: int, to: int, low: int, high: int) -> np.ndarray:
        rows, cols = owner[bounds[at] : bounds[to]] - at, column[code[bounds[at] : bounds[to]]]
        own = (cols >= low) & (cols < high)
        x = np.zeros((to - at, high - low), np.float32)
        x[rows[own], cols[own] - low] = 1
        return x

    for i in range(0, len(sets) if left is None else left, BLOCK):
        i_to = min(i + BLOCK, len(sets) if left is None else left)
        used = np.unique(code[bounds[i] : bounds[i_to]])
        column[used] = np.arange(len(used))
        for j in range(i if left is None else left, len(sets), BLOCK):
            j_to = min(j + BLOCK, len(sets))
            both = np.zeros((i_to - i, j_to - j), np.float32)
            for low in range(0, len(used), 4096):
                high = min(low + 4096, len(used))
                both += matrix(i, i_to, low, high) @ matrix(j, j_to, low, high).T
            both = both.astype(np.int64)
            a, b = np.nonzero((both > 0) & (den * both >= num * (n[i:i_to, None] + n[None, j:j_to] - both)))
            a, b = ids[i + a], ids[j + b]
            if len(a):
                out = stars(np.concatenate([out[0], a]), np.concatenate([out[1], b]))
        column[used] = -1
    return out


def _compare(num: int, den: int):
    """From rows (u, v, side, doc_id, set) sorted by (u, v, side): stars of the links in each unit (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []
        left = 0

        def finish() -> Iterator[pa.RecordBatch]:
            alone = now is not None and now[0] == now[1]
            if len(sets) > 1 and (alone or 0 < left < len(sets)):
                a, b = linked_stars(np.array(ids, np.int64), sets, None if alone else left, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for u, v, side, doc, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (u, v) != now:
                    yield from finish()
                    now, ids, sets, left = (u, v), [], [], 0
                ids.append(doc)
                sets.append(np.frombuffer(data, np.uint64))
                left += side == 0
        yield from finish()

    return run


def tile_links(units: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links, as stars, within units: rows (u, v, side, doc_id)."""
    rows = units.join(sets.select("doc_id", "set"), "doc_id").select("u", "v", "side", "doc_id", "set")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartition(n, "u", "v").sortWithinPartitions("u", "v", "side").mapInArrow(_compare(num, den), "a long, b long"))


def _tiles(members: DataFrame, *group: str) -> DataFrame:
    """Adds tile: the group, cut by a hash of the document into parts of about TILE shingles."""
    weight = members.groupBy(*group).agg(F.ceil(F.sum("n") / TILE).alias("parts"))
    same = [F.col(f"m.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group]
    cut = members.alias("m").join(weight.alias("w"), same).select("m.*", "w.parts")
    return cut.withColumn("tile", F.xxhash64(*group, F.pmod(F.xxhash64("doc_id", F.lit(1)), "parts")))


def long_list_links(entries: DataFrame, docs: DataFrame, known: DataFrame, words: int, num: int, den: int) -> list[DataFrame]:
    """Links, as stars, between members (key, doc_id, n) of long lists; known: links found so far."""
    lists = entries.groupBy("key").agg(F.count("*").alias("m")).checkpoint()
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).alias("size_class")
    top = entries.join(lists, "key").groupBy("doc_id").agg(F.max(F.struct("m", "key")).alias("top"), F.max("n").alias("n"), F.count("*").alias("keys"))
    home = _tiles(top.select("doc_id", "n", "keys", F.col("top.key").alias("home"), size_class), "home", "size_class").checkpoint()
    sets = materialize(sets_of(docs, home.select("doc_id"), words, True))
    links = [known]
    split = home.where("parts > 1")
    if split.limit(1).count():
        order = Window.partitionBy("home", "size_class").orderBy(F.desc("keys"), "doc_id")
        pivots = split.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PIVOTS).select("home", "size_class", F.col("doc_id").alias("pivot"))
        tiles = split.select("home", "size_class", F.col("tile").alias("u")).distinct()
        first = tiles.join(pivots, ["home", "size_class"]).select("u", F.col("u").alias("v"), F.lit(0).alias("side"), F.col("pivot").alias("doc_id"))
        links.append(tile_links(first.union(split.selectExpr("tile", "tile", "0", "doc_id")).distinct(), sets, num, den))
    groups = components(_all(links)).withColumnRenamed("id", "doc_id")
    # a component that is large in its list has tiles of its own, which aren't compared with each other
    placed = home.select("doc_id", "n", "home", "size_class").join(groups, "doc_id", "left")
    large = placed.where("component is not null").groupBy("home", "size_class", "component").agg(F.sum("n").alias("w")).where(F.col("w") >= TILE // 2).drop("w").withColumn("label", F.col("component"))
    placed = _tiles(placed.join(large, ["home", "size_class", "component"], "left").drop("component"), "home", "size_class", "label")
    placed = placed.withColumn("kind", F.when(F.col("label").isNull(), F.col("tile")).otherwise(F.xxhash64("home", "size_class", "label"))).checkpoint()
    kinds = placed.groupBy("kind", "size_class", "label").agg(F.count("*").alias("docs"))
    at = entries.select("key", "doc_id").join(placed.select("doc_id", "kind"), "doc_id").select("key", "kind").distinct().join(kinds, "kind")
    spread = at.groupBy("key").agg(F.count("*").alias("k"), F.sum("docs").alias("docs")).join(lists, "key").where("docs > 4 * m or k * k > 4 * m").select("key").checkpoint()
    # each of these is read several times below: its plan would be in every one of them
    at = at.join(spread, "key", "left_anti").checkpoint()
    x, y = at.alias("x"), at.alias("y")
    near = F.expr("x.key = y.key and x.kind <= y.kind and abs(x.size_class - y.size_class) <= 1 and not (x.label <=> y.label and x.label is not null)")
    met = x.join(y, near).selectExpr("x.kind as left_kind", "y.kind as right_kind").distinct()
    tiles = placed.select("kind", "tile").distinct()
    pairs = met.join(tiles.selectExpr("kind as left_kind", "tile as u"), "left_kind").join(tiles.selectExpr("kind as right_kind", "tile as v"), "right_kind").select("u", "v").checkpoint()
    # lists that spread over many tiles, by themselves
    alone = _tiles(entries.join(spread, "key").join(placed.select("doc_id", "size_class"), "doc_id"), "key", "size_class").checkpoint()
    own = alone.select("key", "size_class", "tile").distinct()
    own = own.alias("x").join(own.alias("y"), F.expr("x.key = y.key and (x.size_class = y.size_class and x.tile <= y.tile or x.size_class = y.size_class - 1)")).selectExpr("x.tile as u", "y.tile as v").checkpoint()
    for pair, rows in ((pairs, placed), (own, alone)):
        rows = rows.select("tile", "doc_id").distinct()
        sides = [pair.join(rows.withColumnRenamed("tile", s), s).select("u", "v", F.lit(k).alias("side"), "doc_id") for k, s in enumerate("uv")]
        links.append(tile_links(sides[0].union(sides[1].where("u <> v")), sets, num, den))
    return links


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.union(x)
    return out


def near_classes(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity num / den)."""
    spark = docs.sparkSession
    shared_dir(spark)
    n_docs = docs.count()
    bits = min(24, max(16, int(4 * n_docs).bit_length() - 1))
    prints, parts = fingerprints(docs, words, bits)
    counts = sketch(parts, bits)
    classes = prints.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("f1", "f2", "rep").checkpoint()
    own = prints.join(classes, ["f1", "f2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")).checkpoint()
    per_id = own.groupBy("doc_id").agg(F.expr("bool_and(doc_id <> rep)").alias("copy"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    copies = per_id.where("copy").select("doc_id").checkpoint()
    few = copies.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    if few:  # beyond that, the texts don't go through a shuffle for it: copies leave after the pass
        texts = texts.join(F.broadcast(copies), "doc_id", "left_anti")
    first = prefixes(texts, words, counts, num, den)
    own_keys = materialize(shared_prefixes(first if few else first.join(copies, "doc_id", "left_anti"), num, den))
    # one row for each size, beyond 1,024 for each hundredth
    size = F.when(F.col("n") <= 1024, F.col("n").cast("double")).otherwise(F.floor(F.pow(F.lit(1.01), F.floor(F.log("n") / float(np.log(1.01))))))
    sizes = [(int(r[0]), r[1], r[2]) for r in own_keys.groupBy(size).agg(F.sum("light"), F.sum("heavy")).collect()]
    edge = boundary(sizes, num, den)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = postings(own_keys, edge, num, den).select(F.posexplode("keys").alias("pos", "key"), "doc_id", "n", "short").select("key", "doc_id", "n", (F.col("pos") < F.col("short")).alias("first"))
    met = materialize(posted.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(_meet(num, den), "a long, b long, key long, n long"))
    links = [verify(met.where("key is null").select("a", "b").distinct().checkpoint(), docs, words, num, den)]
    # an id that has several texts links the classes of all of them
    links.append(own.join(per_id.where("a <> b").select("doc_id"), "doc_id").selectExpr("doc_id as a", "rep as b"))
    entries = met.where("key is not null").select("key", F.col("a").alias("doc_id"), "n").distinct()
    if entries.limit(1).count():
        links = long_list_links(entries, docs, _all(links).checkpoint(), words, num, den)
    groups = components(_all(links)).withColumnRenamed("id", "rep")
    return own.join(groups, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
