"""Near duplicates among embeddings by a random-projection tree forest with spill.

Equal vectors of a label are one node with a multiplicity.  Each tree splits by a random direction
per level at a threshold (the median of the sample rows in that node), and a vector within the margin
of the threshold goes to both sides, so that close vectors seldom part; several trees make a pair
that parted in one meet in another.  Vectors of one label and length in one leaf are compared; a leaf above
LEAF_ROWS is compared block by block, every block against every other, so none is cut.  A pair counts
in the first leaf that both are in; what leaves a block are its rows' numbers of links, and stars of
linked rows, so a group of many alike gives no rows for its pairs.  Stars are united over the table.

The thresholds come from at most SAMPLE_ROWS rows of the commonest length (a documented bound); every
row is indexed, others by the components that they have in common with it.  Null labels, null or zero
vectors, and vectors with null or non-finite components: linked with nothing.  Equal rows are links of
each other.  Rows that repeat an id are rows of their own with one id.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import materialize, shared_dir, table
from wavecrest.llm.graph import components, stars

SAMPLE_ROWS = 20_000
LEAF_ROWS, BLOCK_ROWS = 768, 384
#: Levels with a threshold for each node; deeper ones have one threshold for each level.
NODE_LEVELS = 13


class Forest:
    def __init__(self, sample: np.ndarray, depth: int, trees: int, margin: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        way = rng.standard_normal((trees, depth, d))
        self.way = way / np.linalg.norm(way, axis=2, keepdims=True)
        self.depth, self.margin = depth, margin
        self.nodes, self.level = [], np.zeros((trees, depth))
        for t in range(trees):
            shot = sample @ self.way[t].T
            own = np.zeros(1 << min(depth, NODE_LEVELS))
            at = np.ones(len(sample), np.int64)
            for k in range(depth):
                self.level[t, k] = np.median(shot[:, k]) if len(shot) else 0.0
                if k < NODE_LEVELS:
                    own[1 << k : 2 << k] = self.level[t, k]
                    order = np.argsort(at, kind="stable")
                    ids, starts = np.unique(at[order], return_index=True)
                    for node, part in zip(ids.tolist(), np.split(order, starts[1:]), strict=True):
                        if len(part) >= 8:
                            own[node] = np.median(shot[part, k])
                    at = at * 2 + (shot[:, k] > own[at])
            self.nodes.append(own)

    def leaves(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tree: row numbers and leaves; a row in the margin of a split is in both sides."""
        d = min(unit.shape[1], self.way.shape[2])
        for t, own in enumerate(self.nodes):
            shot = unit[:, :d] @ self.way[t, :, :d].T
            row, at = np.arange(len(unit)), np.ones(len(unit), np.int64)
            for k in range(self.depth):
                cut = own[at] if k < NODE_LEVELS else self.level[t, k]
                gap = shot[row, k] - cut
                low, high = gap <= self.margin, gap > -self.margin
                row, at = np.concatenate([row[low], row[high]]), np.concatenate([at[low] * 2, at[high] * 2 + 1])
            yield t, row, at


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, size, unit vector (doubles) and digest of the raw one; null where it links with nothing."""
    for batch in batches:
        unit, f1, f2 = [], [], []
        for x, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            v = np.array([], float) if x is None or label is None or None in x else np.array(x, float)
            norm = float(np.linalg.norm(v)) if len(v) and np.isfinite(v).all() else 0.0
            if not norm or not np.isfinite(norm):
                unit.append(None), f1.append(None), f2.append(None)
                continue
            d = xxhash.xxh3_128_intdigest((v + 0.0).tobytes())
            unit.append((v / norm).tobytes())
            f1.append((d >> 64) - (1 << 63)), f2.append((d & ((1 << 64) - 1)) - (1 << 63))
        size = pa.array([None if u is None else len(u) // 8 for u in unit], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), size, pa.array(unit, pa.binary()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["vec_id", "label", "size", "unit", "f1", "f2"])


#: A leaf of a tree as one number: tree << LEAF_BITS | leaf.
LEAF_BITS = 48
KEYS = ["label", "size", "leaf", "bi", "bj"]


def first_met(codes: list[np.ndarray], i: np.ndarray, j: np.ndarray, leaf: int) -> np.ndarray:
    """Whether this leaf is the first one that both rows of a pair are in; codes: each row's leaves, ascending."""
    width = max(map(len, codes))
    table = np.full((len(codes), width), -1, np.int64)
    for k, c in enumerate(codes):
        table[k, : len(c)] = c
    out = np.empty(len(i), bool)
    step = max(1, 4_000_000 // (width * width))
    for a in range(0, len(i), step):
        x, y = table[i[a : a + step]], table[j[a : a + step]]
        common = (x[:, :, None] == y[:, None, :]).any(2) & (x >= 0)
        out[a : a + step] = x[np.arange(len(x)), common.argmax(1)] == leaf
    return out


def _compare(cosine: float):
    """Rows sorted by KEYS: links within each group, or between its blocks, as numbers of links (vec_id, d) and stars (a, b)."""
    names = ["vec_id", "d", "a", "b"]

    def links(unit: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if side.any():
            a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            i, j = np.nonzero(unit[a] @ unit[b].T >= cosine)
            return a[i], b[j]
        return np.nonzero(np.triu(unit @ unit.T >= cosine, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(held)
            unit = np.frombuffer(b"".join(rows.column("unit").to_pylist()), float).reshape(rows.num_rows, -1)
            i, j = links(unit, rows.column("side").to_numpy())
            if not len(i):
                return
            codes = [c.values.to_numpy() for c in rows.column("codes")]
            keep = first_met(codes, i, j, now[2])
            i, j = i[keep], j[keep]
            if not len(i):
                return
            ids, m = rows.column("vec_id").to_numpy(), rows.column("m").to_numpy()
            d = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
            some = np.flatnonzero(d)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(d[some].astype(np.int64)), none, none], names)
            a, b = stars(ids[i], ids[j])
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(a), pa.array(b)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(5)]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and now != tuple(key[:, s].tolist()):
                    yield from flush()
                    held = []
                now = tuple(key[:, s].tolist())
                held.append(batch.slice(s, e - s))
        if held:
            yield from flush()

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.98, trees: int = 5, leaf: int = 96, margin: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    margin: in units of the mean projected distance of two vectors at the threshold.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long")).mapInArrow(_vectors, "vec_id long, label long, size long, unit binary, f1 long, f2 long").checkpoint()
    good = own.where("unit is not null and vec_id is not null")
    usual = good.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    node = ["label", "size", "f1", "f2"]
    # numbers of their own, in the order of the least id: different vectors may share one
    nodes = good.groupBy(*node).agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    nodes = nodes.repartitionByRange(n_parts, "rep", *node).sortWithinPartitions("rep", *node).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    reps = good.join(nodes, node).where("vec_id = rep").dropDuplicates(["id"]).select(F.col("id").alias("vec_id"), "label", "size", "m", "unit").checkpoint()
    # at most SAMPLE_ROWS vectors come to the driver
    n = reps.count()
    labels = max(1, reps.select("label").distinct().count())
    sample = reps.where(F.col("size") == usual["size"]).orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE_ROWS).select("unit").collect()
    x = np.frombuffer(b"".join(bytes(r.unit) for r in sample), float).reshape(len(sample), -1)
    depth = max(0, int(np.ceil(np.log2(max(1.0, n / labels / leaf)))))
    gap = np.sqrt(2 - 2 * cosine) / np.sqrt(x.shape[1])
    forest = spark.sparkContext.broadcast(Forest(x, depth, trees, margin * gap))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """codes: the leaves of each row in all trees."""
        for batch in batches:
            size = batch.column(2).to_numpy()
            for s in np.unique(size).tolist():
                part = batch.take(pa.array(np.flatnonzero(size == s)))
                unit = np.frombuffer(b"".join(part.column(4).to_pylist()), float).reshape(-1, s)
                found = [(row, (t << LEAF_BITS) | at) for t, row, at in forest.value.leaves(unit)]
                row, code = (np.concatenate(v) for v in zip(*found, strict=True))
                order = np.lexsort((code, row))
                starts = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                codes = pa.ListArray.from_arrays(pa.array(starts), pa.array(code[order]))
                yield pa.RecordBatch.from_arrays([*part.columns, codes], ["vec_id", "label", "size", "m", "unit", "codes"])

    placed = reps.mapInArrow(index, "vec_id long, label long, size long, m long, unit binary, codes array<long>")
    placed = placed.withColumn("leaf", F.explode("codes")).checkpoint()
    large = placed.groupBy("label", "size", "leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > LEAF_ROWS).withColumn("nb", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")).drop("rows").checkpoint()
    # large leaves by pairs of blocks: side 1 against side 2, side 0 within a block
    block = placed.join(large, ["label", "size", "leaf"], "left").withColumn("b", F.when(F.col("nb").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int")))
    pairs = F.when(F.col("nb").isNull(), F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(F.col("b"), o).alias("bi"), F.greatest(F.col("b"), o).alias("bj"), F.when(o == F.col("b"), 0).when(F.col("b") < o, 1).otherwise(2).alias("side")))
    )
    dealt = block.select("label", "size", "leaf", "vec_id", "m", "unit", "codes", F.explode(pairs).alias("p")).select("label", "size", "leaf", "p.bi", "p.bj", "p.side", "vec_id", "m", "unit", "codes")
    found = materialize(dealt.repartition(n_parts, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_compare(cosine), "vec_id long, d long, a long, b long"))
    degree = found.where("vec_id is not null").groupBy(F.col("vec_id").alias("id")).agg(F.sum("d").alias("d"))
    groups = components(found.where("a is not null").select("a", "b"))
    per_class = nodes.join(degree, "id", "left").join(groups, "id", "left").withColumn("least", F.coalesce("component", "id"))
    per_class = per_class.join(nodes.select(F.col("id").alias("least"), F.col("rep").alias("c")), "least")
    per_class = per_class.select(*node, (F.col("m") - 1 + F.coalesce("d", F.lit(0))).alias("n"), "c").checkpoint()
    out = own.join(per_class, node, "left")
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("c")), F.col("vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.col("n"))
    return out.select("vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op6_rp_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
