"""Queries over files: written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.sources import dense, files, scratch, writers
from wavecrest.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("jsonl_roundtrip", "select doc_id::varchar as read_id, source, md5(text) as digest from documents where text <> ''")
def jsonl_roundtrip(spark, sf_dir):
    """Half of the rows carry their name in id only, as the fallback of the reader expects."""
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    path = scratch.folder(spark, "jsonl")
    writers.write_jsonl(d.select(F.when(F.col("doc_id") % 2 == 0, name).when(F.col("doc_id") % 4 == 1, "").alias("read_id"), name.alias("id"), "source", "text"), path)
    rows = files.read_jsonl(spark, path, "read_id string, id string, source string, text string")
    return rows.select("read_id", "source", F.md5("text").alias("digest"))


@query("jsonl_strict", "select doc_id, source, md5(text) as digest from documents")
def jsonl_strict(spark, sf_dir):
    """Every line must be an object of the schema; nothing is dropped."""
    path = scratch.folder(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    return files.read_jsonl(spark, path, "doc_id long, source string, text string", strict=True).select("doc_id", "source", F.md5("text").alias("digest"))


@query("concatenated_json", "select doc_id, quality, toxic from labels")
def concatenated_json(spark, sf_dir):
    """Ten objects to a line, without a break between them."""
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 10).alias("g"), F.to_json(F.struct("doc_id", "quality", "toxic")).alias("j"))
    path = scratch.folder(spark, "concatenated")
    rows.groupBy("g").agg(F.array_join(F.collect_list("j"), "").alias("value")).select("value").write.text(path)
    return files.read_concatenated_json(spark, path, "doc_id long, quality int, toxic int")


@query("csv_checked", "select o_orderkey, o_totalprice, 'reads_1' as source from orders")
def csv_checked(spark, sf_dir):
    path = scratch.folder(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit("reads_1").alias("source")).write.option("header", True).csv(path)
    return files.read_csv_checked(spark, path, "o_orderkey long, o_totalprice double, source string", "source", "reads_1")


@query("npy_roundtrip", "select count(*) as n, round(sum(list_sum(embedding::double[])), 4) as total, round(max(list_max(embedding))::double, 6) as mx from embeddings")
def npy_roundtrip(spark, sf_dir):
    path = scratch.folder(spark, "npy")
    dense.write_dense(table(spark, sf_dir, "embeddings"), path, "embedding", 64)
    x = F.transform("data", lambda v: v.cast("double"))
    out = dense.read_dense(spark, path, exact=64).agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)), 4).alias("total"), F.round(F.max(F.array_max(x)), 6).alias("mx"))
    return out.where(F.col("n") == dense.read_manifest(spark, path).agg(F.sum("rows")).first()[0])


def _ordered_shards(spark, sf_dir) -> str:
    """Embeddings in the order of vec_id, in shards of at most 100 rows."""
    path = scratch.folder(spark, "dense")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    dense.write_dense(rows, path, "embedding", 64, shard_rows=100)
    return path


_RANKED = "with e as (select row_number() over (order by vec_id) - 1 as gid, embedding from embeddings)"


def _total(data: str) -> Column:
    return F.round(F.aggregate(F.transform(data, lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v), 6).alias("total")


@query("dense_ranges", _RANKED + " select gid, embedding[1]::double as first, round(list_sum(embedding::double[]), 6) as total from e")
def dense_ranges(spark, sf_dir):
    """Shards read in ranges of 4 kB, each a task of its own."""
    rows = dense.read_dense(spark, _ordered_shards(spark, sf_dir), rangeBytes=4096)
    return rows.select(F.col("index").alias("gid"), F.col("data")[0].cast("double").alias("first"), _total("data"))


@query(
    "dense_lookup",
    _RANKED + ", w as (select event_id, (event_id * 7919 + 42) % ((select count(*) from embeddings) + 5) as gid from events) select event_id, w.gid, e.embedding[1]::double as first, round(list_sum(e.embedding::double[]), 6) as total from w left join e on w.gid = e.gid",
)
def dense_lookup(spark, sf_dir):
    """For each event the vector at an index, by reads of those rows alone; some indices are past the end."""
    path = _ordered_shards(spark, sf_dir)
    n = dense.read_manifest(spark, path).agg(F.sum("rows")).first()[0]
    wanted = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 7919 + 42) % F.lit(n + 5)).alias("gid"))
    return dense.rows_at(wanted, "gid", path).select("event_id", "gid", F.col("data")[0].cast("double").alias("first"), _total("data"))


@query("dense_manifest", "select count(*) as total, 64::bigint as width, true as within, true as gapless from embeddings")
def dense_manifest(spark, sf_dir):
    """The manifest of the shards against their files: rows in all, at most 100 in one, each starting where the one before ends."""
    path = _ordered_shards(spark, sf_dir)
    m = dense.read_manifest(spark, path)
    found = dense.read_dense(spark, path).groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("shard")).agg(F.min("index").alias("least"), F.max("index").alias("most"), F.count("*").alias("n"))
    fits = (F.col("least") == F.col("start")) & (F.col("most") + 1 == F.col("start") + F.col("rows")) & (F.col("n") == F.col("rows"))
    return m.join(found, "shard", "full").agg(F.sum("rows").alias("total"), F.max("width").alias("width"), (F.max("rows") <= 100).alias("within"), F.every(F.coalesce(fits, F.lit(False))).alias("gapless"))


@query("feature_budget", "select vec_id, row_number() over (order by vec_id) - 1 as gid, embedding[1]::double as first from embeddings order by vec_id limit 300")
def feature_budget(spark, sf_dir):
    """Vectors in order up to the budget, which is the reader's parameter, with dense ids."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("first")).orderBy("vec_id").limit(300)
    return scratch.dense_index(rows, "vec_id", name="gid")


_NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("discover_tables", f"select unnest({_NAMES}) as name, 1::bigint as n")
def discover_tables(spark, sf_dir):
    found = files.discover(spark, ",".join(f"{sf_dir}/{n}.parquet" for n in _NAMES) + f",{sf_dir}/nation.parquet", ".parquet")
    return found.select(F.regexp_extract("path", r"/([a-z]+)\.parquet(/[^/]*)?$", 1).alias("name")).groupBy("name").agg(F.countDistinct("name").alias("n"))


@query("paired_files", "select vec_id::varchar || '.npy' as key, 's/tokens_' || vec_id || '.npy' as \"left\", 's/reference_' || vec_id || '.npy' as \"right\" from embeddings")
def paired_files(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("v"))
    listing = v.select(F.concat(F.lit("s/tokens_"), "v", F.lit(".npy")).alias("path")).union(v.select(F.concat(F.lit("s/reference_"), "v", F.lit(".npy"))))
    return files.pair_files(listing)


_PA = "select user_id as read, event_id as pos, round((1400.0 / 8192 * (floor(value) + {0}))::float::double, 3) + 0.0 as y from events"


@query("pa_scale", _PA.format("trunc(user_id / 4.0 - 3)"))
def pa_scale(spark, sf_dir):
    """Raw integers to picoampere with the offset cut to an integer."""
    y = files.to_picoampere(F.floor("value"), F.col("user_id") / 4.0 - 3, F.lit(1400.0), F.lit(8192), True)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("event_id").alias("pos"), (F.round(y.cast("double"), 3) + 0.0).alias("y"))


@query("pa_scale_exact", _PA.format("(user_id / 4.0 - 3)"))
def pa_scale_exact(spark, sf_dir):
    y = files.to_picoampere(F.floor("value"), F.col("user_id") / 4.0 - 3, F.lit(1400.0), F.lit(8192), False)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("event_id").alias("pos"), (F.round(y.cast("double"), 3) + 0.0).alias("y"))


@query("rebatch_chunks", "select batch, count(*) as n, min(event_id) as first, max(event_id) as last from (select event_id, printf('chunk_batch_%06d', (row_number() over (order by event_id) - 1) // 256) as batch from events) group by batch")
def rebatch_chunks(spark, sf_dir):
    rows = writers.rebatch(table(spark, sf_dir, "events").select("event_id"), 256, "event_id")
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("part_files", "select count(*) as n, sum(user_id)::bigint as total, true as within from events")
def part_files(spark, sf_dir):
    """Part files of at most 500 rows, read back and counted by file."""
    path = scratch.folder(spark, "parts")
    writers.write_parts(table(spark, sf_dir, "events").select("event_id", "user_id"), path, 500)
    per = spark.read.schema("event_id long, user_id long").parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))
    return per.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.max("n") <= 500).alias("within"))


@query("feature_shards", "select (g // 128)::bigint as shard, ((g // 128) * 128)::bigint as start_index, count(*) as n, min(vec_id) as first from (select vec_id, row_number() over (order by vec_id) - 1 as g from embeddings) group by 1, 2")
def feature_shards(spark, sf_dir):
    rows = writers.feature_shards(table(spark, sf_dir, "embeddings").select("vec_id"), 128, "vec_id")
    return rows.groupBy("shard", "start_index").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


_FASTQ = "translate(regexp_replace(lower(text), '[^acgt]', '', 'g'), 'acgt', 'ACGT')"


@query("fastq_format", f"select item_id, md5('@' || item_id || chr(10) || {_FASTQ} || chr(10) || '+' || chr(10) || repeat(chr((least(item_id, 93) + 33)::int), length({_FASTQ}))) as record from benchmark")
def fastq_format(spark, sf_dir):
    bases = F.translate(F.regexp_replace(F.lower("text"), "[^acgt]", ""), "acgt", "ACGT")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(writers.fastq(F.col("item_id").cast("string"), bases, F.col("item_id"))).alias("record"))


@query("fastq_write", f"select line, count(*) as n from (select unnest(['@' || item_id, {_FASTQ}, '+', repeat('+', length({_FASTQ}))]) as line from benchmark) group by line")
def fastq_write(spark, sf_dir):
    """The file's lines, written with quality 10 and read back."""
    bases = F.translate(F.regexp_replace(F.lower("text"), "[^acgt]", ""), "acgt", "ACGT")
    path = scratch.folder(spark, "fastq")
    writers.write_fastq(table(spark, sf_dir, "benchmark").select("item_id", bases.alias("bases")), path, "item_id", "bases", 10)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("shard_totals", "select sum(n)::bigint as total, max(n) as mx, min(n) as mn, count(*) as shards from (select source, count(*) as n from documents group by source)")
def shard_totals(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.max("n").alias("mx"), F.min("n").alias("mn"), F.count("*").alias("shards"))
