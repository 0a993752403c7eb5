"""The corpus pipeline: documents to packed training sequences, stage by stage.

Stages filter or rewrite documents and keep their columns; the last one returns the pieces of
sequences.  Null and empty texts pass the filters by their statistics (an empty text is no near
duplicate and has no personal data).  Each row is judged by its own text: rows that share an id, or
have none, are apart unless their texts are near duplicates.  Of a group the row of the smallest id
stays (where ids repeat or are null, the first row of the table).  Long texts are read whole, extra
columns are carried along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.common import materialize, table
from wavecrest.llm.jaccard import BROADCAST_IDS, near_classes
from wavecrest.llm.packing import pack_documents
from wavecrest.llm.pii import redact
from wavecrest.llm.site_quality import keep_good
from wavecrest.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, rows = "doc_id", docs
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        # rows get keys of their own, fixed by writing them
        key = "_key"
        while key in docs.columns:
            key = f"_{key}"
        rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    classes = near_classes(rows.select(F.col(key).alias("doc_id"), "text"))
    copies = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct())
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    return rows.join(copies, key, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No stage has an SQL form (learned models, components, tokenizers).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
