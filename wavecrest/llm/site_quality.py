"""Quality classifier with hierarchical empirical Bayes over sites.

A linear model over text statistics, fitted on a bounded labelled sample, gives each document its
evidence.  Expected counts of good documents are summed by path (source and language) and by host
(source).  The host's share of good documents is shrunk towards the global one, the path's towards
its host's; the strength of each prior comes from how much shares vary between sites beyond chance
(method of moments).  A document's posterior adds its path's prior log-odds, less the global ones, to
its own; its own evidence is left out of its priors, so that it counts once.  Sums are partial aggregates, so a source with a third of all rows is no hot task.

Null and empty texts: a document without words, judged by its statistics.  A text of any length is
read whole.  Null source or language: a site of its own.  Repeated rows count each; of one id the
sample holds a bounded number of rows.  A posterior at the threshold keeps.  Rows without a label take no part in fitting; without
both labels all are kept.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import materialize, slices, table
from wavecrest.llm.linear import fit_logistic, predict
from wavecrest.llm.quality_rules import BASE, RATIOS, labelled_sample, sampled_rows, statistics

#: At most so many labelled rows are used for fitting.
MAX_LABELLED = 20_000
#: A site's prior counts as no fewer and no more documents than this.
LEAST, MOST = 2.0, 1000.0


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios, and steps of them, so that a linear model can follow a threshold."""
    ratios = stats[:, len(BASE) :]
    n = np.log1p(stats[:, :1])
    symbol, repeat, distinct, upper, mark = (ratios[:, [RATIOS.index(c)]] for c in ("symbol_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio"))
    steps = [n < np.log1p(20), symbol > 0.02, symbol > 0.05, repeat > 0.1, repeat > 0.3, distinct < 0.3, distinct < 0.5, upper > 0.3, mark > 0.03]
    return np.hstack([n, ratios, *(s.astype(float) for s in steps)])


class Evidence:
    def __init__(self, stats: np.ndarray, good: np.ndarray) -> None:
        x = features(stats)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = fit_logistic((x - self.mean) / self.scale, good.astype(float))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(predict(self.w, np.clip((features(stats) - self.mean) / self.scale, -8, 8)), 1e-6, 1 - 1e-6)


def fit_evidence(docs: DataFrame, labels: DataFrame) -> Evidence | None:
    sample = labelled_sample(labels.where("quality is not null"), MAX_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [[float(v) for v in statistics(t.as_py())] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["good", "stats"])

    chosen = sampled_rows(docs.select(F.col("doc_id").cast("long"), "text"), sample, F.xxhash64("text"))
    rows = chosen.selectExpr("cast(quality as int) as good", "text").mapInArrow(run, "good int, stats array<double>").collect()
    good = np.array([r.good == 1 for r in rows], bool)
    if not len(rows) or good.all() or not good.any():
        return None
    order = sorted(range(len(rows)), key=lambda k: (rows[k].stats, rows[k].good))
    return Evidence(np.array([rows[k].stats for k in order]), good[order])


def document_evidence(docs: DataFrame, model: Evidence | None) -> DataFrame:
    """doc_id, host, path and p_doc, the probability by the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = model(np.array([statistics(t.as_py()) for t in part.column(3)], float)) if model else np.ones(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(p)], ["doc_id", "host", "path", "p_doc"])

    host, path = _sites()
    return docs.select(F.col("doc_id").cast("long"), host.alias("host"), path.alias("path"), "text").mapInArrow(run, "doc_id long, host string, path string, p_doc double")


def _strength(n_sites, var_between, mean):
    """Documents that a prior is worth: mean (1 - mean) / variance between sites, within bounds."""
    raw = mean * (1 - mean) / F.greatest(var_between, F.lit(1e-9)) - 1
    return F.when(n_sites < 2, F.lit(LEAST)).otherwise(F.least(F.greatest(raw, F.lit(LEAST)), F.lit(MOST)))


#: What a site's prior is made of: the evidence of its path and host with their numbers of documents, the share of all, and the priors' strength.
SUMS = ["n", "s", "hn", "hs", "mean", "kappa"]


def site_sums(evidence: DataFrame) -> DataFrame:
    """host, path and SUMS, from grouped sums of the evidence."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    # the variance between sites, less what chance gives
    share = F.col("hs") / F.col("hn")
    world = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.count("*").alias("sites"), F.var_pop(share).alias("v"), F.avg(1 / F.col("hn")).alias("c")).withColumn("mean", F.greatest(F.least(F.col("gs") / F.col("gn"), F.lit(1 - 1e-6)), F.lit(1e-6)))
    world = world.withColumn("kappa", _strength(F.col("sites"), F.col("v") - F.col("c") * F.col("mean") * (1 - F.col("mean")), F.col("mean"))).select("mean", "kappa")
    # one row
    hosts = hosts.join(F.broadcast(world))
    return paths.join(hosts, "host").select("host", "path", *SUMS)


def site_priors(evidence: DataFrame) -> DataFrame:
    """host, path, mean, prior_host and prior_path, by all documents of a site: what a new document there is given."""
    host = (F.col("hs") + F.col("kappa") * F.col("mean")) / (F.col("hn") + F.col("kappa"))
    path = (F.col("s") + F.col("kappa") * host) / (F.col("n") + F.col("kappa"))
    return site_sums(evidence).select("host", "path", "mean", host.alias("prior_host"), path.alias("prior_path"))


def priors_without(p, n, s, hn, hs, mean, kappa) -> tuple:
    """The priors of a document's host and path by all their other documents, as columns or arrays."""
    host = (hs - p + kappa * mean) / (hn - 1 + kappa)
    return host, (s - p + kappa * host) / (n - 1 + kappa)


#: Sites that are broadcast; rows of more sites are joined, salted in so many parts, as one path may hold a third of them.
BROADCAST_SITES, SALTS = 100_000, 32


def odds(c: str):
    p = F.greatest(F.least(F.col(c), F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def with_priors(rows: DataFrame, priors: DataFrame, host: str, path: str, spread) -> DataFrame:
    """Rows with their site's priors; spread is a column that deals a hot path's rows out."""
    if priors.count() <= BROADCAST_SITES:
        return rows.join(F.broadcast(priors), [rows[host] == priors["host"], rows[path] == priors["path"]]).drop(priors["host"]).drop(priors["path"])
    salted = priors.withColumn("_salt_right", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt_left", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    on = [rows[host] == salted["host"], rows[path] == salted["path"], rows["_salt_left"] == salted["_salt_right"]]
    return rows.join(salted, on).drop(salted["host"]).drop(salted["path"]).drop("_salt_left", "_salt_right")


def _sites() -> tuple:
    host = F.coalesce(F.col("source"), F.lit(""))
    return host, F.concat_ws("/", host, F.coalesce(F.col("lang"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_doc, prior_host, prior_path, posterior, kept for each row."""
    evidence = materialize(document_evidence(docs, fit_evidence(docs, labels)))
    sums = materialize(site_sums(evidence))
    out = with_priors(evidence, sums, "host", "path", F.struct("doc_id", "p_doc"))
    host, path = priors_without(*(F.col(c) for c in ("p_doc", *SUMS)))
    out = out.withColumn("prior_host", host).withColumn("prior_path", path)
    out = out.withColumn("posterior", 1 / (1 + F.exp(-(odds("p_doc") + odds("prior_path") - odds("mean")))))
    return out.select("doc_id", "p_doc", "prior_host", "prior_path", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that classify() keeps, with all their columns, each by its own text.

    The texts are read twice rather than joined with their verdicts, so they aren't shuffled.
    """
    model = fit_evidence(docs, labels)
    sums = materialize(site_sums(materialize(document_evidence(docs, model))))
    names = ["_site_host", "_site_path", *(f"_site_{c}" for c in SUMS)]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    host, path = _sites()
    rows = with_priors(docs.withColumn(names[0], host).withColumn(names[1], path), sums.select("host", "path", *(F.col(c).alias(n) for c, n in zip(SUMS, names[2:], strict=True))), names[0], names[1], F.col("text"))
    columns, at, least = docs.columns, docs.columns.index("text"), float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = model(np.array([statistics(t.as_py()) for t in part.column(at)], float)) if model else np.ones(part.num_rows)
                sums = [part.column(k).to_numpy().astype(float) for k in range(len(columns), part.num_columns)]
                prior = priors_without(p, *sums)[1]
                own, site, mean = (np.log(x / (1 - x)) for x in (np.clip(y, 1e-6, 1 - 1e-6) for y in (p, prior, sums[4])))
                yield pa.RecordBatch.from_arrays(part.columns[: len(columns)], columns).filter(pa.array(own + site - mean >= least))

    return rows.select(*columns, *names[2:]).mapInArrow(run, docs.schema)


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
