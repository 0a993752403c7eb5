"""Token corpus, quantisation, decoding, join and sampling queries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import labels as L
from wavecrest.functions import pairwise as A
from wavecrest.functions import sequence as Q
from wavecrest.operators import joins as J
from wavecrest.operators import quantize as V
from wavecrest.operators import sampling as P
from wavecrest.operators import windows as W
from wavecrest.sources.scratch import total_before
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


# -- quantisation --------------------------------------------------------------------------------------

_CODES = "with c as (select vec_id as code, embedding::double[] as v from embeddings where vec_id < 16), x as (select vec_id, embedding::double[] as v from embeddings)"
_DIST = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_NEAR = _CODES + f", n as (select x.vec_id, arg_min(c.code, (round({_DIST}, 9), c.code)) as code from x, c group by x.vec_id)"


def _codebook(spark, sf_dir) -> tuple[np.ndarray, np.ndarray]:
    return V.load_codebook(table(spark, sf_dir, "embeddings").where("vec_id < 16"), "vec_id", "embedding")


def _coded(spark, sf_dir, levels: int = 1) -> DataFrame:
    return V.nearest_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", *_codebook(spark, sf_dir), levels)


@query("nearest_code", _NEAR + " select vec_id, code from n")
def nearest_code(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", F.col("codes")[0].alias("code"))


_USE = ", u as (select g.code, count(n.code) as n from (select unnest(generate_series(0, 31)) as code) g left join n using (code) group by g.code)"


def _usage(spark, sf_dir, k: int = 32) -> DataFrame:
    counts = _coded(spark, sf_dir).groupBy(F.col("codes")[0].alias("code")).agg(F.count("*").alias("n"))
    return spark.range(k).withColumnRenamed("id", "code").join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"))


@query("code_usage", _NEAR + _USE + " select sum(n)::bigint as total, count(*) filter (where n > 0) as used, count(*) filter (where n = 0) as unused, arg_max(code, (n, -code)) as max_code, max(n) as max_n, min(case when n > 0 then n end) as least_n from u")
def code_usage(spark, sf_dir):
    u = _usage(spark, sf_dir)
    return u.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("used"), F.count_if(F.col("n") == 0).alias("unused"), F.max_by("code", F.struct("n", -F.col("code"))).alias("max_code"), F.max("n").alias("max_n"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least_n"))


@query(
    "codebook_metrics",
    _NEAR
    + _USE
    + """, h as (select code, sum(case when vec_id % 2 = 0 then 1 else 0 end) as a, sum(case when vec_id % 2 = 1 then 1 else 0 end) as b from n group by code),
d as (select u.code, u.n, u.n / (sum(u.n) over ())::double as p, row_number() over (order by u.n desc, u.code) as k, coalesce(h.a, 0) / (sum(coalesce(h.a, 0)) over ())::double as pa, coalesce(h.b, 0) / (sum(coalesce(h.b, 0)) over ())::double as pb from u left join h using (code))
select round(sum(case when p > 0 then -p * log2(p) else 0 end), 6) as entropy, round(max(case when k = 1 then p end) * 32, 6) as top1, round(max(case when k = 3 then p end) * 32, 6) as top3, round(max(case when k = 5 then p end) * 32, 6) as top5, round(max(case when k = 7 then p end) * 32, 6) as top7, round(max(case when k = 9 then p end) * 32, 6) as top9, round(sum(case when k <= 10 then p else 0 end) * 32, 6) as top10, round(sum((pb + 1e-10) * ln((pb + 1e-10) / (pa + 1e-10))), 6) as kl, count(*) filter (where n > 0) / 32.0::double as usage from d""",
)
def codebook_metrics(spark, sf_dir):
    """A codebook has a bounded number of codes, so its counts may be ranked in one task."""
    coded = _coded(spark, sf_dir).select("vec_id", F.col("codes")[0].alias("code"))
    per = coded.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 2 == 0).alias("a"), F.count_if(F.col("vec_id") % 2 == 1).alias("b"))
    u = spark.range(32).withColumnRenamed("id", "code").join(per, "code", "left").na.fill(0)
    everything = Window.partitionBy()
    d = u.select("code", "n", (F.col("n") / F.sum("n").over(everything)).alias("p"), F.row_number().over(Window.orderBy(F.desc("n"), "code")).alias("k"), (F.col("a") / F.sum("a").over(everything)).alias("pa"), (F.col("b") / F.sum("b").over(everything)).alias("pb"))
    tops = [F.round(F.max(F.when(F.col("k") == k, F.col("p"))) * 32, 6).alias(f"top{k}") for k in (1, 3, 5, 7, 9)]
    kl = (F.col("pb") + 1e-10) * F.log((F.col("pb") + 1e-10) / (F.col("pa") + 1e-10))
    return d.agg(F.round(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)), 6).alias("entropy"), *tops, F.round(F.sum(F.when(F.col("k") <= 10, F.col("p")).otherwise(0.0)) * 32, 6).alias("top10"), F.round(F.sum(kl), 6).alias("kl"), (F.count_if(F.col("n") > 0) / 32.0).alias("usage"))


_ORTHO = "with c as (select vec_id, embedding::double[] as v from embeddings), s as (select list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))) as s from c a, c b where a.vec_id <> b.vec_id), "


@query(
    "codebook_orthogonality",
    _ORTHO
    + "t as (select count(*) as n, avg(abs(s)) as m, max(s) as mx, min(s) as mn, stddev_pop(s) as sd, "
    + ", ".join(f"count(*) filter (where abs(s) < 0.{k}) as b{k}" for k in range(1, 10))
    + ", count(*) filter (where abs(s) > 0.9) as a9 from s) select n, round(m, 6) as mean_abs, round(mx, 6) as mx, round(mn, 6) as mn, round(sd, 6) as sd, "
    + ", ".join(f"round(b{k} / n, 6) as below_0{k}" for k in range(1, 10))
    + ", round(a9 / n, 6) as above_09, case when m < 0.05 then 'excellent' when m < 0.1 then 'good' when m < 0.2 then 'fair' else 'poor' end as grade from t",
)
def codebook_orthogonality(spark, sf_dir):
    """All pairs of a codebook, the whole table here, compared block by block."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = V.pair_cosines(e, "vec_id", "embedding", 512)
    m = F.col("total_abs") / F.col("n")
    mean = F.col("total") / F.col("n")
    share = [F.round(F.col(f"b{k}") / F.col("n"), 6).alias(f"below_0{k}") for k in range(1, 10)]
    grade = F.when(m < 0.05, "excellent").when(m < 0.1, "good").when(m < 0.2, "fair").otherwise("poor")
    return s.select("n", F.round(m, 6).alias("mean_abs"), F.round("mx", 6).alias("mx"), F.round("mn", 6).alias("mn"), F.round(F.sqrt(F.col("squares") / F.col("n") - mean * mean), 6).alias("sd"), *share, F.round(F.col("a9") / F.col("n"), 6).alias("above_09"), grade.alias("grade"))


_RES = _NEAR + f", y as (select x.vec_id, n.code as l1, list_transform(list_zip(x.v, c.v), lambda p: p[1] - p[2]) as v from x join n using (vec_id) join c on c.code = n.code) select x.vec_id, any_value(x.l1) as level1, arg_min(c.code, (round({_DIST}, 9), c.code)) as level2 from y x, c group by x.vec_id"


@query("residual_codes", _RES)
def residual_codes(spark, sf_dir):
    return _coded(spark, sf_dir, 2).select("vec_id", F.col("codes")[0].alias("level1"), F.col("codes")[1].alias("level2"))


def _lloyd(rounds: int) -> str:
    sql = "with x as (select vec_id, embedding::double[] as v from embeddings), c0 as (select vec_id as code, v from x where vec_id < 4)"
    for k in range(rounds):
        sql += f", n{k} as (select x.vec_id, arg_min(c.code, (round({_DIST}, 9), c.code)) as code from x, c{k} c group by x.vec_id), m{k} as (select n.code, d.d, avg(x.v[d.d]) as m from x join n{k} n using (vec_id), (select unnest(generate_series(1, 64)) as d) d group by n.code, d.d), c{k + 1} as (select code, list(m order by d) as v from m{k} group by code)"
    return sql + f" select n.code, count(*) as n from (select x.vec_id, arg_min(c.code, (round({_DIST}, 9), c.code)) as code from x, c{rounds} c group by x.vec_id) n group by n.code"


@query("kmeans_lloyd", _lloyd(3))
def kmeans_lloyd(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    codes, start = V.load_codebook(e.where("vec_id < 4"), "vec_id", "embedding")
    c = V.kmeans(e, "embedding", start, 3)
    return V.nearest_codes(e, "embedding", codes, c).groupBy(F.col("codes")[0].alias("code")).agg(F.count("*").alias("n"))


_TEXT = "'<|tok:' || (vec_id % 97)::varchar || '|><|tok:' || (vec_id % 13 + 128)::varchar || '|>'"


@query("token_roundtrip", f"select vec_id, {_TEXT} as text, vec_id % 97 as first, vec_id % 13 as second, 2::bigint as n from embeddings")
def token_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.format_tokens(F.array(F.col("vec_id") % 97, F.col("vec_id") % 13 + 128)).alias("text"))
    ids = V.parse_tokens(F.col("text"))
    return e.select("vec_id", "text", ids[0].alias("first"), (ids[1] - 128).alias("second"), F.size(ids).cast("long").alias("n"))


_MIXED = "(select vec_id, label, '<|tok:' || (vec_id % 97) || '|> x <|tok:L1_' || (vec_id % 13) || '|><|tok:|><|other:3|>' || case when vec_id % 3 = 0 then '' else '<|tok:7|>' end as text from embeddings)"


def _mixed(spark, sf_dir) -> DataFrame:
    """Token texts with other text, empty and foreign tokens between; every third lacks its last token."""
    text = F.concat(F.lit("<|tok:"), (F.col("vec_id") % 97).cast("string"), F.lit("|> x <|tok:L1_"), (F.col("vec_id") % 13).cast("string"), F.lit("|><|tok:|><|other:3|>"), F.when(F.col("vec_id") % 3 == 0, "").otherwise("<|tok:7|>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", text.alias("text"))


@query("token_split", f"select vec_id, len(t)::int as n, array_to_string(t, ' ') as tokens from (select vec_id, regexp_extract_all(text, '<\\|tok:[^|>]+\\|>') as t from {_MIXED})")
def token_split(spark, sf_dir):
    tokens = V.split_tokens(F.col("text"))
    return _mixed(spark, sf_dir).select("vec_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query("token_count_check", f"select vec_id from {_MIXED} where len(regexp_extract_all(text, '<\\|tok:[^|>]+\\|>')) = 2 + label % 2")
def token_count_check(spark, sf_dir):
    """Chunks whose token count isn't the expected one are dropped."""
    return _mixed(spark, sf_dir).where(F.size(V.split_tokens(F.col("text"))) == 2 + F.col("label") % 2).select("vec_id")


@query("code_range", "with c as (select l_partkey - 100 as code from lineitem) select k.code::bigint as code, count(c.code) as n from (select unnest(range(0, 1000)) as code) k left join c on c.code = k.code group by k.code")
def code_range(spark, sf_dir):
    """Usage of a book of a thousand codes; ids outside it don't count."""
    return V.code_counts(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - 100).alias("code")), "code", 1000)


@query("joined_roles", "select conv_id, string_agg(role, '' order by turn) as joined, '' as nothing from conversations where role is not null group by conv_id")
def joined_roles(spark, sf_dir):
    """A list of tokens as one text; no list is the empty text."""
    c = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("t"))
    return c.select("conv_id", L.join_tokens(F.col("t")).alias("joined"), L.join_tokens(F.lit(None).cast("array<string>")).alias("nothing"))


# -- token corpus ------------------------------------------------------------------------------------

_WORDS = "with w as (select doc_id, source, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') as t from documents), k as (select doc_id, source, t, len(t)::int as n from w)"


def _words(spark, sf_dir) -> DataFrame:
    t = F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", "source", t.alias("t")).withColumn("n", F.size("t"))


_WIN = _WORDS + ", s as (select *, case when n <= 64 then [0] else generate_series(0, (ceil((n - 64) / 48.0) * 48)::int, 48) end as ss from k where n is not null), x as (select doc_id, source, unnest(ss)::int as s, t, n from s), y as (select doc_id, source, s, t[s + 1:s + 64] as win from x)"


def _windows(spark, sf_dir) -> DataFrame:
    w = _words(spark, sf_dir).where("n is not null").withColumn("s", F.explode(W.token_starts(F.col("n"), 64, 16)))
    return w.select("doc_id", "source", "s", F.slice("t", F.col("s") + 1, F.lit(64)).alias("win"))


@query("token_windows", _WIN + " select doc_id, s as start, len(win)::int as n, md5(array_to_string(win, ' ')) as digest from y")
def token_windows(spark, sf_dir):
    return _windows(spark, sf_dir).select("doc_id", F.col("s").alias("start"), F.size("win").alias("n"), F.md5(F.array_join("win", " ")).alias("digest"))


@query("token_window_filter", _WIN + " select doc_id, s as start, printf('%d_%05d', doc_id, row_number() over (partition by doc_id order by s) - 1) as id from y where len(win) >= 32")
def token_window_filter(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("s")) - 1
    return _windows(spark, sf_dir).where(F.size("win") >= 32).select("doc_id", F.col("s").alias("start"), F.format_string("%d_%05d", "doc_id", k).alias("id"))


@query("split_accounting", _WIN + " select source, count(*) as windows, count(*) filter (where len(win) >= 32) as kept, count(*) filter (where len(win) < 32) as discarded, sum(len(win))::bigint as tokens, sum(case when len(win) >= 32 then len(win) else 0 end)::bigint as kept_tokens from y group by source")
def split_accounting(spark, sf_dir):
    n = F.size("win")
    return _windows(spark, sf_dir).groupBy("source").agg(F.count("*").alias("windows"), F.count_if(n >= 32).alias("kept"), F.count_if(n < 32).alias("discarded"), F.sum(n).alias("tokens"), F.sum(F.when(n >= 32, n).otherwise(0)).alias("kept_tokens"))


@query("token_infer_chunks", _WORDS + " select doc_id, s as start, least(64, n - s)::int as n from (select doc_id, n, unnest(generate_series(0, n - 1, 56))::int as s from k where n > 0)")
def token_infer_chunks(spark, sf_dir):
    w = _words(spark, sf_dir).where("n > 0").withColumn("s", F.explode(W.inference_starts(F.col("n"), 64, 8)))
    return w.select("doc_id", F.col("s").alias("start"), F.least(F.lit(64), F.col("n") - F.col("s")).alias("n"))


@query("token_count_dist", _WORDS + " select source, count(*) as n_docs, min(n) as mn, max(n) as mx, round(avg(n), 6) as mean, median(n)::double as med, round(quantile_cont(n, 0.95), 6) as p95 from k group by source")
def token_count_dist(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_docs"), F.min("n").alias("mn"), F.max("n").alias("mx"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("med"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


_COUNTS = _WORDS + ", z as (select word, count(*) as n from (select unnest(t) as word from k) group by word)"


def _word_counts(spark, sf_dir) -> DataFrame:
    return _words(spark, sf_dir).select(F.explode("t").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("top_codes", _COUNTS + " select word, n, row_number() over (order by n desc, word) as rank from z order by n desc, word limit 10")
def top_codes(spark, sf_dir):
    top = _word_counts(spark, sf_dir).orderBy(F.desc("n"), "word").limit(10)
    return top.select("word", "n", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long").alias("rank"))


_BYN = ", b as (select n, count(*) as m from z group by n), r as (select n, m, sum(m) over (order by n desc)::bigint as hi, sum(n * m) over (order by n desc)::bigint as cum, sum(n * m) over ()::bigint as total, sum(m) over ()::bigint as k from b)"


def _by_count(spark, sf_dir) -> DataFrame:
    """Words by their count: one row for each distinct count, so ranks need no sort of all words."""
    b = _word_counts(spark, sf_dir).groupBy("n").agg(F.count("*").alias("m"))
    down, everything = Window.orderBy(F.desc("n")), Window.partitionBy()
    return b.select("n", "m", F.sum("m").over(down).alias("hi"), F.sum(F.col("n") * F.col("m")).over(down).alias("cum"), F.sum(F.col("n") * F.col("m")).over(everything).alias("total"), F.sum("m").over(everything).alias("k"))


@query("cumulative_share", _COUNTS + _BYN + ", p as (select unnest([1, 5, 10, 20, 50, 90]) as p) select p.p::bigint as p, round(min((r.cum - r.n * (r.hi - greatest(1, r.k * p.p // 100))) / r.total::double), 9) as share from p, r where r.hi >= greatest(1, r.k * p.p // 100) and r.hi - r.m < greatest(1, r.k * p.p // 100) group by p.p")
def cumulative_share(spark, sf_dir):
    """Share of all occurrences that the first p percent of words have."""
    p = F.broadcast(spark.createDataFrame([(x,) for x in (1, 5, 10, 20, 50, 90)], "p long"))
    rank = F.greatest(F.lit(1), F.floor(F.col("k") * F.col("p") / 100))
    r = _by_count(spark, sf_dir).join(p, (F.col("hi") >= rank) & (F.col("hi") - F.col("m") < rank))
    return r.groupBy("p").agg(F.round(F.min((F.col("cum") - F.col("n") * (F.col("hi") - rank)) / F.col("total")), 9).alias("share"))


@query("zipf_fit", _COUNTS + ", h as (select sum(n)::bigint as total, count(*) as k from z), c as (select total / (select sum(1.0::double / i) from generate_series(1, (select k from h)) t(i)) as c, total, k from h) select total, k, round(c, 4) as c, round(c / 10, 4) as expected_10 from c")
def zipf_fit(spark, sf_dir):
    """Constant of count = c / rank that keeps the total; the harmonic number over a distributed range."""
    h = _word_counts(spark, sf_dir).agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    total, k = h.first()
    harmonic = spark.range(1, k + 1).agg(F.sum(1.0 / F.col("id")).alias("s"))
    c = F.lit(float(total)) / F.col("s")
    return harmonic.select(F.lit(total).cast("long").alias("total"), F.lit(k).cast("long").alias("k"), F.round(c, 4).alias("c"), F.round(c / 10, 4).alias("expected_10"))


_EDGES = [0, 50, 100, 200, 400, 800, 1200, 2000, 3000, 5000, 10000]


@query("length_hist", f"with b as (select unnest(generate_series(1, 11)) as b), l as (select case when n_chars >= 10000 or n_chars < 0 then 11 else list_count(list_filter({_EDGES}, lambda x: x <= n_chars)) end as b from documents) select b.b::bigint as bin, count(l.b) as n from b left join l using (b) group by b.b")
def length_hist(spark, sf_dir):
    c = F.col("n_chars")
    b = F.when((c >= 10000) | (c < 0), 11).otherwise(F.size(F.filter(F.array(*map(F.lit, _EDGES)), lambda x: x <= c)))
    n = table(spark, sf_dir, "documents").groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(1, 12).withColumnRenamed("id", "bin").join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("position_hist", _WORDS + ", p as (select floor(10.0 * (i - 1) / n)::bigint as bin from (select n, unnest(generate_series(1, n)) as i, unnest(t) as word from k) where word like '%.') select bin, count(*) as n from p where bin < 10 group by bin")
def position_hist(spark, sf_dir):
    """Relative positions of words that end a sentence."""
    w = _words(spark, sf_dir).select("n", F.posexplode("t").alias("i", "word")).where(F.col("word").endswith("."))
    return w.groupBy(F.floor(F.lit(10.0) * F.col("i") / F.col("n")).alias("bin")).agg(F.count("*").alias("n")).where("bin < 10")


# -- samples and splits ----------------------------------------------------------------------------------

_HASH = "(doc_id * 7919 + 42) % 1000003"


@query(
    "group_split",
    f"with g as (select source, min({_HASH}) as h from documents group by source), r as (select source, row_number() over (order by h, source) as k, count(*) over () as n from g), s as (select source, k, greatest(1, round(n * 0.8))::bigint as a, n, round(n * 0.1)::bigint as v from r) select source, case when k <= a then 'train' when k <= a + least(v, n - a) then 'val' else 'test' end as part from s",
)
def group_split(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(P.spread(F.col("doc_id"))).alias("h"))
    return P.group_split(groups, "source", F.col("h"), (0.8, 0.1, 0.1)).select("source", "part")


@query("dir_sample", f"select source, doc_id from (select source, doc_id, row_number() over (partition by source order by {_HASH}, doc_id) as k, count(*) over (partition by source) as n from documents) where k <= floor(n * 0.3)")
def dir_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return P.sample_per_group(d, "source", [P.spread(F.col("doc_id")), F.col("doc_id")], 0.3)


@query("shard_sample", f"select doc_id from documents where {_HASH} < 1000003 * 0.25")
def shard_sample(spark, sf_dir):
    return P.bernoulli(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25)


@query("shard_selection", f"with k as (select l_suppkey as shard, count(*) as n from lineitem where (l_suppkey * 7919 + 42) % 1000003 < 1000003 * 0.4 group by 1) select shard, n, (select sum(n) from k)::bigint as total, (select count(*) from k) as shards from k")
def shard_selection(spark, sf_dir):
    """Shards of a manifest kept by a hash, with the totals of those that stay."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count("*").alias("n"))
    kept, totals = P.select_shards(n, "shard", "n", 0.4)
    return kept.select("shard", "n", F.lit(totals["rows"]).cast("long").alias("total"), F.lit(totals["shards"]).cast("long").alias("shards"))


_DAY = "date_trunc('day', ts)::date"


@query("event_rollup", f"select event_type, {_DAY} as day, count(*) as n, count(distinct user_id) as users, grouping(event_type, {_DAY})::bigint as level from events group by rollup (event_type, {_DAY})")
def event_rollup(spark, sf_dir):
    """Counts by type and day, by type, and of all."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.grouping_id().alias("level"))


@query("line_cube", "select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as quantity, grouping(l_returnflag, l_linestatus)::bigint as level from lineitem group by cube (l_returnflag, l_linestatus)")
def line_cube(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level"))


# -- joins -------------------------------------------------------------------------------------------


@query("annot_join_chunks", _WORDS + " select l.doc_id, l.quality, k.n, md5(array_to_string(k.t[11:20], ' ')) as digest from labels l join k on k.doc_id = l.doc_id and 20 <= k.n")
def annot_join_chunks(spark, sf_dir):
    k = _words(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    return labels.join(k, (k.doc_id == labels.doc_id) & (k.n >= 20)).select(labels.doc_id, "quality", "n", F.md5(F.array_join(F.slice("t", 11, 10), " ")).alias("digest"))


@query("semi_anti_files", "select 'semi' as kind, o_orderkey as id from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49) union all select 'anti', c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def semi_anti_files(spark, sf_dir):
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    semi = o.join(l.where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.lit("semi").alias("kind"), F.col("o_orderkey").alias("id"))
    anti = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("anti").alias("kind"), F.col("c_custkey").alias("id"))
    return semi.union(anti)


@query("left_default_zero", "select c_custkey, coalesce(n, 0)::bigint as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def left_default_zero(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


_OFF = "with s as (select source, sum(n) over (order by source) - n as lo, sum(n) over (order by source) as hi from (select source, count(*) as n from documents group by source)), i as (select row_number() over (order by doc_id) - 1 as g from documents)"


@query("range_locate", _OFF + " select i.g::bigint as g, s.source, (i.g - s.lo)::bigint as local from i join s on s.lo <= i.g and i.g < s.hi")
def range_locate(spark, sf_dir):
    """Global indices to shard and local index."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    manifest = total_before(n, "n", "source", name="lo").select("source", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    total = n.agg(F.sum("n")).first()[0]
    found = J.locate(spark.range(0, total or 0).withColumnRenamed("id", "g"), "g", manifest)
    return found.select("g", "source", (F.col("g") - F.col("lo")).alias("local"))


@query("shard_manifest", "select source, count(*) as num_samples, sum(n_chars)::bigint as total_chars from documents group by source order by num_samples desc, source")
def shard_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("num_samples"), F.sum("n_chars").alias("total_chars")).orderBy(F.desc("num_samples"), "source")


@query("zip_join", "with a as (select conv_id, list(text order by turn) as t, list(role order by turn) as r from conversations group by conv_id) select conv_id, (i - 1)::int as pos, r[i] as role, md5(t[i]) as digest from (select conv_id, t, r, unnest(generate_series(1, len(t))) as i from a)")
def zip_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    both = J.zip_rows(c.select("conv_id", "turn", "role"), c.select("conv_id", "turn", F.md5("text").alias("digest")), "conv_id", ["turn", "role"], ["turn", "digest"])
    return both.select("conv_id", F.col("pos").cast("int").alias("pos"), "role", "digest")


# -- sequences -----------------------------------------------------------------------------------------


def _aligned(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    return b.select("item_id", "ref", F.concat(F.substring("ref", 4, 20), F.lit("x"), F.substring("ref", F.lit(25), F.length("ref"))).alias("query"))


@query("align_accuracy")
def align_accuracy(spark, sf_dir):
    a = _aligned(spark, sf_dir).withColumn("a", A.align("query", "ref"))
    return a.select("item_id", F.col("a.cigar").alias("cigar"), F.round(Q.accuracy(F.col("a"), F.length("ref")), 6).alias("accuracy"), F.round(Q.accuracy(F.col("a"), F.length("ref"), True), 6).alias("balanced"))


@query("align_errors")
def align_errors(spark, sf_dir):
    a = _aligned(spark, sf_dir).select(A.align("query", "ref").alias("a")).select("a.*")
    s = a.agg(*(F.sum(c).alias(c) for c in ("n_match", "n_mismatch", "n_ins", "n_del")))
    total = F.col("n_match") + F.col("n_mismatch") + F.col("n_ins") + F.col("n_del")
    return s.withColumn("match_ratio", F.coalesce(F.try_divide(F.col("n_match"), total), F.lit(0.0)))


@query("indel_align")
def indel_align(spark, sf_dir):
    a = _aligned(spark, sf_dir).withColumn("x", A.indel_align("query", "ref"))
    return a.select("item_id", F.col("x.query").alias("query"), F.col("x.ref").alias("ref"))
