"""Connected components of links, distributed: no task or driver holds all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.llm.common import shared_dir


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From links: a star (member, least member) for each of their components; no connection is lost."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    u, w = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[u], root[w])
        now = root.copy()
        np.minimum.at(now, root[u], low)
        np.minimum.at(now, root[w], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    while (root[root] != root).any():
        root = root[root]
    k = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[k], nodes[root[k]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of each batch by a star for each of its components."""
    for batch in batches:
        if batch.num_rows:
            a, b = stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): id and component (its smallest reachable id) for every id that is in a link.

    Alternating large and small stars until nothing changes, so O(log n) rounds; each round is
    checkpointed to the shared folder.  Self links and repeated links do no harm.
    """
    shared_dir(links.sparkSession)
    stars = links.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct().checkpoint()
    before = None
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v as a", "m as b").distinct()
        # small star: towards the least of the smaller neighbours
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(low, "a").selectExpr("case when b = m then a else b end as a", "m as b").where("a <> b").distinct().checkpoint()
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(stars.selectExpr("b", "b").distinct())
