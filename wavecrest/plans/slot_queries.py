"""Queries with exchangeable parts: an encoder from a weights file, an indexed codebook, table functions, and files that may be broken."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.functions import tables
from wavecrest.functions.encoder import encode_signals
from wavecrest.operators import quantize as V
from wavecrest.sources import dense, scratch, tensors
from wavecrest.sources.tables import signals, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_W1, _B1 = [[0.5, 1.0, -0.25], [-1.0, 0.5, 0.75]], [0.125, -0.25]
_W2, _B2 = [[[0.5, 0.0, -0.5], [0.25, 1.0, 0.0]], [[1.0, -0.5, 0.25], [0.0, 0.5, -1.0]]], [0.25, 0.5]
_BOOK = [[k % 4 * 0.75 - 0.5, k // 4 * 1.5 - 0.75] for k in range(8)]


def _first(c: int) -> str:
    return f"greatest(0.0, {_B1[c]} + " + " + ".join(f"{w} * x[2 * t + {j + 1}]" for j, w in enumerate(_W1[c])) + ")"


def _second(c: int) -> str:
    return f"{_B2[c]} + " + " + ".join(f"{w} * {h}[t + {j + 1}]" for h, row in zip("uv", _W2[c], strict=True) for j, w in enumerate(row))


@query(
    "encoder_codes",
    f"""with a as (select user_id as read, list(value / 64.0 order by event_id) as d, count(*) as n from events group by 1),
p as (select read, (n - 1) // 2 + 1 as m, [0.0::double] || d || [0.0::double, 0.0::double] as x from a),
h as (select read, m, list_transform(range(0, m), lambda t: {_first(0)}) as u, list_transform(range(0, m), lambda t: {_first(1)}) as v from p),
q as (select read, [0.0::double] || u || [0.0::double] as u, [0.0::double] || v || [0.0::double] as v, unnest(range(0, m)) as t from h),
z as (select read, t, {_second(0)} as y0, {_second(1)} as y1 from q),
n as (select read, t, arg_min(code, (round((y0 - c0) * (y0 - c0) + (y1 - c1) * (y1 - c1), 9), code)) as code from z, (values {", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_BOOK))}) c(code, c0, c1) group by read, t)
select read, count(*) as n, md5(string_agg(code::varchar, ',' order by t)) as digest from n group by read""",
)
def encoder_codes(spark, sf_dir):
    """Two convolutions, the first with a stride of two, and a codebook, all from a weights file; the codes of whole signals."""
    folder = scratch.folder(spark, "weights")
    weights = {"encoder.0.weight": np.array(_W1, np.float32)[:, None], "encoder.0.bias": np.array(_B1, np.float32), "encoder.2.weight": np.array(_W2, np.float32), "encoder.2.bias": np.array(_B2, np.float32), "codebook": np.array([_BOOK], np.float32)}
    tensors.write_tensors(f"{folder}/model.safetensors", weights, {"layers": '[["conv", "encoder.0", 2, 1], "relu", ["conv", "encoder.2", 1, 1]]'})
    scaled = signals(spark, sf_dir).withColumn("signal", F.transform("signal", lambda x: x / 64.0))
    out = encode_signals(scaled, "signal", tensors.find_weights(folder))
    return out.select("read", F.size("codes").cast("long").alias("n"), F.md5(F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")).alias("digest"))


@query(
    "nearest_code_indexed",
    """with o as (select o_orderkey, o_totalprice / 1e5 as a, (o_custkey % 100) / 25.0::double as b, (o_orderkey % 7) / 7.0::double as c from orders),
p as (select p_partkey as code, p_retailprice / 1e3 as a, p_size / 12.0::double as b, (p_partkey % 7) / 7.0::double as c from part)
select o_orderkey, arg_min(code, (round((o.a - p.a) * (o.a - p.a) + (o.b - p.b) * (o.b - p.b) + (o.c - p.c) * (o.c - p.c), 9), code)) as code from o, p group by o_orderkey""",
)
def nearest_code_indexed(spark, sf_dir):
    """Orders to the nearest of the parts as codes, found in a tree of boxes; of equal codes the least stands for all."""
    book = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.array(F.col("p_retailprice") / 1e3, F.col("p_size") / 12.0, (F.col("p_partkey") % 7) / 7.0).alias("v"))
    book = book.groupBy("v").agg(F.min("code").alias("code"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 100) / 25.0, (F.col("o_orderkey") % 7) / 7.0).alias("v"))
    return V.nearest_codes(rows, "v", *V.load_codebook(book, "code", "v")).select("o_orderkey", F.col("codes")[0].alias("code"))


@query(
    "file_histograms",
    """with v as (select unnest(embedding)::double as x from embeddings), h as (select least(floor((x + 0.5) / 0.05), 19)::int as bin, count(*) as n from v where x between -0.5 and 0.5 group by 1),
b as (select unnest(range(0, 20))::int as bin)
select 'success' as status, bin, coalesce(n, 0)::bigint as n, (select count(*) from v) as total from b left join h using (bin) union all select 'error', bin, 0, 0 from b""",
)
def file_histograms(spark, sf_dir):
    """Histograms of the files of a folder, one of which is broken: it has an error and zeros, the others are whole."""
    path = scratch.folder(spark, "histograms")
    dense.write_dense(table(spark, sf_dir, "embeddings"), path, "embedding", 64, shard_rows=200)
    store, root = dense.open_store(path)
    with store.open_output_stream(f"{root}/broken.npy") as out:
        out.write(b"\x93NUMPY\x01\x00 no header")
    files = dense.file_histograms(spark, path, -0.5, 0.5, 20, range_bytes=8192)
    # one histogram for each status; totals of files, not of their bins
    bins = files.select("status", "total", F.posexplode("counts").alias("bin", "n"))
    return bins.groupBy("status", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("table_function_chunks", "with a as (select user_id as read, list(value order by event_id) as d, count(*)::int as n from events group by 1) select read, s as start, s + 16 as stop, round(list_sum(d[s + 1:s + 16]), 4) + 0.0 as total from (select read, d, unnest(generate_series(0, n - 16, 8))::int as s from a where n >= 16)")
def table_function_chunks(spark, sf_dir):
    """Chunks of signals in SQL."""
    tables.register(spark)
    return spark.sql("select read, start, stop, round(aggregate(chunk, 0d, (a, x) -> a + x), 4) + 0.0d as total from {s} s, lateral chunk_signal(s.signal, 16, 8)", s=signals(spark, sf_dir))


@query("table_function_tokens", "select token, count(*) as n, count(distinct read)::bigint as reads from (select user_id as read, floor(value / 10)::bigint as token from events) group by token")
def table_function_tokens(spark, sf_dir):
    """Tokens of signals in SQL by a named strategy, counted."""
    tables.register(spark)
    return spark.sql("select token, count(*) as n, count(distinct read) as reads from {s} s, lateral tokenize_signal(s.signal, 'tens') group by token", s=signals(spark, sf_dir))


@query(
    "table_function_windows",
    "with t as (select conv_id, turn, list_transform(range(0, length(text) // 40 + 1), lambda k: '<|tok:' || ((turn * 31 + k * 7) % 50)::varchar || '|>') as t from conversations where text is not null) select conv_id, turn, k::int as number, (k * 6)::int as start, array_to_string(t[k * 6 + 1:k * 6 + 8], '') as text from (select *, unnest(range(0, case when len(t) > 2 then (len(t) - 3) // 6 + 1 else 1 end)) as k from t)",
)
def table_function_windows(spark, sf_dir):
    """Windows of eight tokens that share two, from token texts, in SQL."""
    tables.register(spark)
    c = table(spark, sf_dir, "conversations").where("text is not null")
    tokens = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 40).cast("int")), lambda k: F.concat(F.lit("<|tok:"), ((F.col("turn") * 31 + k * 7) % 50).cast("string"), F.lit("|>")))
    return spark.sql("select conv_id, turn, number, start, w.text from {c} c, lateral token_windows(c.text, 8, 2) w", c=c.select("conv_id", "turn", F.array_join(tokens, "").alias("text")))
