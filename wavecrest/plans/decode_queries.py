"""Decoding, alignment measures, stitching, code levels, samples and smaller operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import alignment as A
from wavecrest.functions import labels as L
from wavecrest.functions import sequence as Q
from wavecrest.functions.crf import decode_crf
from wavecrest.operators import quantize as V
from wavecrest.operators import sampling as P
from wavecrest.operators import windows as W
from wavecrest.operators.quantiles import exact_quantiles
from wavecrest.plans.token_queries import _CODES, _DIST, _RES, _coded
from wavecrest.sources import scratch
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


# -- alignment measures --------------------------------------------------------------------------------

_CIGAR = "select l_orderkey as read, l_linenumber as line, l_linenumber::int as s, l_quantity::int as m, (l_suppkey % 4)::int as x, (l_partkey % 3)::int as i, (l_orderkey % 5)::int as d from lineitem"


def _cigars(spark, sf_dir) -> DataFrame:
    """Soft clip, matches, mismatches, insertion, deletion, one match without a count."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    parts = [F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_suppkey") % 4, F.col("l_partkey") % 3, F.col("l_orderkey") % 5]
    text = [F.concat(p.cast("string"), F.lit(op)) for p, op in zip(parts, "S=XID", strict=True)]
    return l.select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("line"), F.concat(*text, F.lit("=")).alias("cigar"))


@query("cigar_errors", f"with c as ({_CIGAR}) select read, line, (m + 1)::bigint as n_match, x::bigint as n_mismatch, i::bigint as n_ins, d::bigint as n_del, round(100.0::double * (m + 1) / (m + 1 + x + i + d), 6) as accuracy, round(100.0::double * (m + 1 - i) / (m + 1 + x + d), 6) as balanced from c")
def cigar_errors(spark, sf_dir):
    plain, balanced = A.accuracies()
    rows = A.error_counts(_cigars(spark, sf_dir), "cigar")
    return rows.select("read", "line", "n_match", "n_mismatch", "n_ins", "n_del", F.round(plain, 6).alias("accuracy"), F.round(balanced, 6).alias("balanced"))


@query(
    "error_ratios",
    f"with c as ({_CIGAR}), t as (select sum(m + 1)::bigint as n_match, sum(x)::bigint as n_mismatch, sum(i)::bigint as n_ins, sum(d)::bigint as n_del from c) select *, " + ", ".join(f"round({c} / (n_match + n_mismatch + n_ins + n_del)::double, 9) as {c}_ratio" for c in ("n_match", "n_mismatch", "n_ins", "n_del")) + " from t",
)
def error_ratios(spark, sf_dir):
    names = ("n_match", "n_mismatch", "n_ins", "n_del")
    s = A.error_counts(_cigars(spark, sf_dir), "cigar").agg(*(F.sum(c).alias(c) for c in names))
    total = F.col("n_match") + F.col("n_mismatch") + F.col("n_ins") + F.col("n_del")
    return s.select("*", *(F.round(F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)), 9).alias(f"{c}_ratio") for c in names))


@query(
    "guarded_accuracy",
    f"with c as ({_CIGAR}), g as (select *, (m + 1 + x + d) / (m + 1 + x + d + line % 3 * 20)::double as covered from c) select read, line, round(covered, 9) as covered, round(case when covered >= 0.5 then 100.0::double * (m + 1) / (m + 1 + x + i + d) else 0.0 end, 6) as accuracy, round(case when covered >= 0.5 then 100.0::double * (m + 1 - i) / (m + 1 + x + d) else 0.0 end, 6) as balanced from g",
)
def guarded_accuracy(spark, sf_dir):
    """Accuracies that are 0 where less than half of the reference is aligned."""
    plain, balanced = A.accuracies()
    rows = A.error_counts(_cigars(spark, sf_dir), "cigar")
    aligned = F.col("n_match") + F.col("n_mismatch") + F.col("n_del")
    covered = aligned / (aligned + F.col("line") % 3 * 20)
    return rows.select("read", "line", F.round(covered, 9).alias("covered"), F.round(A.guarded(plain, covered, 0.5), 6).alias("accuracy"), F.round(A.guarded(balanced, covered, 0.5), 6).alias("balanced"))


@query("accuracy_means", f"with c as ({_CIGAR}), a as (select read, 100.0::double * (m + 1) / (m + 1 + x + i + d) as a from c), b as (select read % 16 as batch, avg(a) as m from a group by 1) select round((select avg(m) from b), 6) as batch_mean, round(avg(a), 6) as read_mean, round(avg(case when a = 100 then 1.0 else 0.0 end)::double, 6) as exact_rate from a")
def accuracy_means(spark, sf_dir):
    """Mean of batch means, mean of reads and the share of exact ones."""
    rows = A.error_counts(_cigars(spark, sf_dir), "cigar").select((F.col("read") % 16).alias("batch"), A.accuracies()[0].alias("a"))
    per = rows.groupBy("batch").agg(F.avg("a").alias("m"), F.sum("a").alias("s"), F.count("*").alias("n"), F.count_if(F.col("a") == 100).alias("e"))
    return per.agg(F.round(F.avg("m"), 6).alias("batch_mean"), F.round(F.sum("s") / F.sum("n"), 6).alias("read_mean"), F.round(F.sum("e") / F.sum("n"), 6).alias("exact_rate"))


@query("match_vector", f"with c as ({_CIGAR}) select read, line, repeat('1', m) || repeat('0', x) || repeat('0', d) || '1' as hits from c")
def match_vector(spark, sf_dir):
    return _cigars(spark, sf_dir).select("read", "line", F.array_join(F.transform(A.match_vector(F.col("cigar")), lambda x: x.cast("string")), "").alias("hits"))


_PAIR = "with t as (select item_id, text, unnest(generate_series(1, length(text)))::int as i from benchmark), c as (select item_id, i, substr('ATGCN-', (ascii(substr(text, i, 1)) % 6)::int + 1, 1) as r, substr('ATGC-N', ((ascii(substr(text, i, 1)) * 7 + i) % 6)::int + 1, 1) as q from t)"


def _pairs(spark, sf_dir) -> DataFrame:
    """Pairs of aligned strings, one for each benchmark text, of its whole length."""
    code = lambda x: F.ascii(x)
    chars = F.filter(F.split("text", ""), lambda x: x != "")
    ref = F.array_join(F.transform(chars, lambda x: F.substring(F.lit("ATGCN-"), code(x) % 6 + 1, F.lit(1))), "")
    query_ = F.array_join(F.transform(chars, lambda x, i: F.substring(F.lit("ATGC-N"), (code(x) * 7 + i + 1) % 6 + 1, F.lit(1))), "")
    return table(spark, sf_dir, "benchmark").select("item_id", query_.alias("query"), ref.alias("ref"))


def _columns(spark, sf_dir) -> DataFrame:
    return A.aligned_columns(_pairs(spark, sf_dir), "item_id", "query", "ref")


@query("confusion_counts", _PAIR + " select case when q = '-' then 'deletion' when r = '-' then 'insertion' else 'mismatch' end as kind, r as ref, q as query, count(*) as n from c where r <> q group by all")
def confusion_counts(spark, sf_dir):
    return A.confusion(_columns(spark, sf_dir))


_DEL = _PAIR + ", p as (select item_id, i, q, r, sum(case when r <> '-' then 1 else 0 end) over (partition by item_id order by i) as k, sum(case when r <> '-' then 1 else 0 end) over (partition by item_id) as n from c), d as (select item_id, (k - 1) / n::double as position from p where q = '-' and r <> '-')"


@query("deletion_positions", _DEL + " select item_id, count(*) as n, round(avg(position), 6) as mean, round(min(position), 6) as first from d group by item_id")
def deletion_positions(spark, sf_dir):
    d = A.deletion_positions(_columns(spark, sf_dir), "item_id")
    return d.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("position"), 6).alias("mean"), F.round(F.min("position"), 6).alias("first"))


@query("deletion_position_hist", _DEL + " select floor(position * 10)::bigint as bin, count(*) as n from d where position * 10 < 10 group by 1")
def deletion_position_hist(spark, sf_dir):
    """Ten bins; exactly 1.0 would be dropped."""
    d = A.deletion_positions(_columns(spark, sf_dir), "item_id")
    return d.groupBy(F.floor(F.col("position") * 10).alias("bin")).agg(F.count("*").alias("n")).where("bin < 10")


@query("coverage_blank", "with x as (select doc_id, n_chars, least(doc_id % 50, doc_id % 40) as decoded, doc_id % 40 as steps from documents) select doc_id, round(decoded / greatest(n_chars, 1)::double, 6) as coverage, round((1 - case when steps = 0 then 0.0 else decoded / steps::double end)::double, 6) as blank from x")
def coverage_blank(spark, sf_dir):
    c, b = L.coverage(F.col("doc_id") % 50, F.col("doc_id") % 40, F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(c, 6).alias("coverage"), F.round(b, 6).alias("blank"))


# -- decoding --------------------------------------------------------------------------------------------

_POST = "with p as (select vec_id, i, embedding[i * 5 + 1:i * 5 + 5] as v from (select vec_id, embedding, unnest(generate_series(0, 11)) as i from embeddings)), l as (select vec_id, i, list_position(v, list_max(v)) - 1 as c from p), k as (select *, lag(c) over (partition by vec_id order by i) as b from l)"


@query("ctc_greedy", _POST + " select vec_id, string_agg(substr('NACGT', c::int + 1, 1), '' order by i) as bases from k where c > 0 and (b is null or b <> c) group by vec_id")
def ctc_greedy(spark, sf_dir):
    """Twelve steps of five scores in each vector: the best class of each step, repeats collapsed, blanks dropped."""
    step = lambda i: F.slice("embedding", i * 5 + 1, F.lit(5))
    best = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.array_position(step(i), F.array_max(step(i))) - 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", Q.ids_to_bases(Q.collapse(best)).alias("bases")).where("bases <> ''")


@query("ctc_beam")
def ctc_beam(spark, sf_dir):
    """Prefix beam search over the same steps, as softmax probabilities; tests hold it against all paths."""
    return Q.decode_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 12, 5, lambda s: Q.beam_search(Q.softmax(s), 16, 0.0))


@query("crf_viterbi")
def crf_viterbi(spark, sf_dir):
    """Best path of a CRF over 12 steps of five states with fixed transitions, then collapsed; a blank resets."""
    bonus = np.where(np.eye(5, dtype=bool), 0.1, 0.0)
    return Q.decode_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 12, 5, lambda s: Q.collapse_path(Q.viterbi_path(s, bonus)))


def _crf_reads(spark, sf_dir) -> DataFrame:
    """A read is twenty vectors by their ids, a vector one step: moves into 16 states of two bases, and none for staying."""
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("read"), F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double") * 16).alias("m")).alias("step"))
    return v.groupBy("read").agg(F.flatten(F.transform(F.array_sort(F.collect_list("step")), lambda s: s.m)).alias("scores"))


_STEPS = "e as (select vec_id // 20 as read, row_number() over (partition by vec_id // 20 order by vec_id) as t, list_transform(embedding, lambda x: x::double * 16) as m from embeddings)"
_INTO = ["f.a[s + 1] + 2.0", *(f"f.a[{j * 4} + s // 4 + 1] + e.m[s * 4 + {j + 1}]" for j in range(4))]
_FIRST = " ".join(f"when {_INTO[j]} >= greatest({', '.join(_INTO)}) then {j}" for j in range(4))
_BASES = "p as (select *, lag(label) over (partition by read order by t) as before from l) select read, string_agg(label::varchar, '' order by t) as labels, coalesce(string_agg(substr('NACGT', label + 1, 1), '' order by t) filter (label > 0 and (before is null or label <> before)), '') as bases from p group by read"


@query(
    "crf_kmer_viterbi",
    f"""with recursive {_STEPS},
f as (select distinct read, 0::bigint as t, list_transform(range(0, 16), lambda s: 0.0::double) as a, list_transform(range(0, 16), lambda s: 0) as b from e
  union all select e.read, e.t, list_transform(range(0, 16), lambda s: greatest({', '.join(_INTO)})), list_transform(range(0, 16), lambda s: case {_FIRST} else 4 end) from f join e on e.read = f.read and e.t = f.t + 1),
w as (select read, t, list_position(a, list_max(a)) - 1 as state from f where t = (select max(t) from e where e.read = f.read)
  union all select w.read, w.t - 1, case f.b[w.state + 1] when 0 then w.state else (f.b[w.state + 1] - 1) * 4 + w.state // 4 end from w join f on f.read = w.read and f.t = w.t where w.t > 0),
l as (select w.read, w.t, case f.b[w.state + 1] when 0 then 0 else (1 + w.state % 4)::int end as label from w join f on f.read = w.read and f.t = w.t where w.t > 0),
{_BASES}""",
)
def crf_kmer_viterbi(spark, sf_dir):
    """The best path through states of two bases."""
    return _crf_bases(decode_crf(_crf_reads(spark, sf_dir), "scores", 64))


_LOG = "list_max({0}) + ln(list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"


@query(
    "crf_kmer_posterior",
    f"""with recursive {_STEPS},
f as (select distinct read, 0::bigint as t, list_transform(range(0, 16), lambda s: 0.0::double) as a from e
  union all select e.read, e.t, list_transform(list_transform(range(0, 16), lambda s: [{', '.join(_INTO)}]), lambda x: {_LOG.format('x')}) from f join e on e.read = f.read and e.t = f.t + 1),
g as (select read, max(t) as t, list_transform(range(0, 16), lambda s: 0.0::double) as b from e group by read
  union all select e.read, e.t - 1, list_transform(list_transform(range(0, 16), lambda s: [g.b[s + 1] + 2.0, {', '.join(f"g.b[s % 4 * 4 + {c + 1}] + e.m[(s % 4 * 4 + {c}) * 4 + s // 4 + 1]" for c in range(4))}]), lambda x: {_LOG.format('x')}) from g join e on e.read = g.read and e.t = g.t where g.t > 0),
q as (select e.read, e.t, flatten(list_transform(range(0, 16), lambda s: list_transform([{', '.join(_INTO)}], lambda x: x + g.b[s + 1]))) as x from e join f on f.read = e.read and f.t = e.t - 1 join g on g.read = e.read and g.t = e.t),
l as (select read, t, case when k % 5 = 0 then 0 else (1 + k // 5 % 4)::int end as label from (select read, t, list_position(x, list_max(x)) - 1 as k from q)),
{_BASES}""",
)
def crf_kmer_posterior(spark, sf_dir):
    """The most probable move of each step, by forward and backward totals."""
    return _crf_bases(decode_crf(_crf_reads(spark, sf_dir), "scores", 64, posterior=True))


def _crf_bases(df: DataFrame) -> DataFrame:
    return df.select("read", F.array_join(F.transform("labels", lambda x: x.cast("string")), "").alias("labels"), "bases")


@query("crf_states", "select p_partkey, p_size::bigint as p_size, n_classes, case n_classes when 5 then 0 when 20 then 1 when 80 then 2 when 320 then 3 when 1280 then 4 when 4 then 0 when 16 then 1 when 64 then 2 when 256 then 3 when 1024 then 4 end::int as states from (select p_partkey, p_size, case when p_partkey % 2 = 0 then 5 * (4 ** (p_size % 5))::bigint else (4 ** (p_size % 5 + 1))::bigint end as n_classes from part)")
def crf_states(spark, sf_dir):
    """Widths of score rows, made from the sizes of parts, to lengths of states."""
    k = F.col("p_size") % 5
    p = table(spark, sf_dir, "part").withColumn("n_classes", F.when(F.col("p_partkey") % 2 == 0, 5 * F.pow(F.lit(4), k)).otherwise(F.pow(F.lit(4), k + 1)).cast("long"))
    return p.select("p_partkey", F.col("p_size").cast("long").alias("p_size"), "n_classes", Q.crf_state_length(F.col("n_classes")).alias("states"))


# -- windows and stitching ---------------------------------------------------------------------------------

_SIG = "with a as (select user_id as read, list(floor(value)::bigint order by event_id) as d, count(*)::int as n from events group by 1)"


@query(
    "margin_stitch",
    _SIG + ", w as (select read, d, n, unnest(generate_series(0, ceil(n / 2.0)::int - 1)) as t from a) select read, count(*)::int as n_tokens, md5(string_agg(((coalesce(d[t * 2 + 1], 0) + coalesce(d[t * 2 + 2], 0)) % 7)::varchar, ',' order by t)) as digest from w group by read",
)
def margin_stitch(spark, sf_dir):
    """Windows of 16 tokens of two samples with margins of two; a token's code is a function of its samples, so
    the joined windows must equal one pass over the whole signal."""
    w = W.margin_windows(signals(spark, sf_dir), "signal", 16, 2, 2)
    pair = lambda i: F.floor(F.get("chunk", i * 2)) + F.floor(F.get("chunk", i * 2 + 1))
    coded = w.withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: pair(i) % 7))
    out = W.stitch_windows(coded, ["read"], "codes", 2)
    return out.select("read", F.size("codes").alias("n_tokens"), F.md5(F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")).alias("digest"))


@query(
    "residual_stitch",
    _SIG
    + """, w as (select *, unnest(generate_series(0, cnt - 1)) as k from (select *, case when n <= 32 then 1 else ceil(n / 24.0)::int end as cnt from a)),
v as (select *, ceil(least(32, n - 24 * k) / 2.0)::int as valid from w),
r as (select *, case when k = 0 then 0 else 2 end as lo, case when cnt = 1 then valid when k = 0 then least(14, valid) when k = cnt - 1 then greatest(2, valid) else greatest(2, valid - 2) end as hi from v),
t as (select read, n, k, t, coalesce(d[24 * k + 2 * t + 1], 0) + coalesce(d[24 * k + 2 * t + 2], 0) as x from (select *, unnest(generate_series(lo, hi - 1)) as t from r)),
o as (select *, row_number() over (partition by read order by k, t) as pos, ceil(n / 2.0)::int as m from t)
select read, m as n_tokens, md5(string_agg((x % 7)::varchar || ',' || (x % 5)::varchar, ',' order by pos) || repeat(',0,0', cast(m - count(*) as int))) as digest from o where pos <= m group by read, m""",
)
def residual_stitch(spark, sf_dir):
    """Two levels of codes for each token, from windows of 16 tokens with margins of two, joined by the real tokens of each."""
    w = W.residual_windows(signals(spark, sf_dir), "signal", 16, 2, 2)
    pair = lambda i: F.floor(F.get("chunk", i * 2)) + F.floor(F.get("chunk", i * 2 + 1))
    coded = w.withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array(pair(i) % 7, pair(i) % 5)))
    out = W.stitch_levels(coded, ["read"], "codes", 2, 2)
    return out.select("read", "n_tokens", F.md5(F.array_join(F.transform("codes", lambda x: x.cast("string")), ",")).alias("digest"))


@query(
    "stitch_chunks",
    """with c as (select conv_id, turn, text, length(text) as n, 8 + (length(text) % 5) as tok, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as m, (max(turn + 8 + (length(text) % 5)) over (partition by conv_id) - 4) % 8 as stub from conversations where text is not null),
p as (select *, case when k = 1 then 0 else round_even(2 * n / tok::double, 0)::int end as a, case when k = m then n else round_even((case when k = 1 and stub > 0 then stub + 2 else 10 end) * n / tok::double, 0)::int end as b from c)
select conv_id, md5(string_agg(substr(text, (a + 1)::int, greatest(b - a, 0)::int), '' order by k)) as digest, any_value(stub)::bigint as stub from p group by conv_id""",
)
def stitch_chunks(spark, sf_dir):
    """Turns as called pieces: the overlap of four tokens is cut by the pieces' own bases for a token."""
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumn("tok", (F.length("text") % 5 + 8).cast("long"))
    out = W.stitch_by_tokens(c, ["conv_id"], "turn", "text", "tok", 12, 4)
    return out.select("conv_id", F.md5("bases").alias("digest"), "stub")


@query("overlap_plans", "select p_partkey, c as chunk_size, t as target, (round_even(t / 50.0, 0) * 50)::bigint as overlap, (c - round_even(t / 50.0, 0) * 50)::bigint as stride, (c // 50)::bigint as tokens from (select p_partkey, 1000 * (1 + p_size % 6)::bigint as c, (p_partkey * 37 % 500)::bigint as t from part)")
def overlap_plans(spark, sf_dir):
    """Chunk sizes and wished overlaps, made from parts, to overlaps of whole windows."""
    p = table(spark, sf_dir, "part").select("p_partkey", (1000 * (1 + F.col("p_size") % 6)).cast("long").alias("chunk_size"), (F.col("p_partkey") * 37 % 500).alias("target"))
    overlap, stride, tokens = W.overlap_plans(F.col("chunk_size"), 50, F.col("target"))
    return p.select("*", overlap.alias("overlap"), stride.alias("stride"), tokens.alias("tokens"))


@query("micro_batches", _SIG + " select read, (k // 3)::bigint as batch, count(*) as n from (select read, unnest(generate_series(0, (n - 16) // 8)) as k from a where n >= 16) group by all")
def micro_batches(spark, sf_dir):
    rows = W.chunk(signals(spark, sf_dir), "signal", 16, 8).withColumn("k", F.floor(F.col("chunk_start") / 8))
    return rows.groupBy("read", W.micro_batches(F.col("k"), 3).alias("batch")).agg(F.count("*").alias("n"))


@query("logic_whole", _SIG + " select read, (s + j * 8)::int as start from (select read, unnest(generate_series(0, n - 40, 40)) as s from a where n >= 40), (select unnest(generate_series(0, 4)) as j)")
def logic_whole(spark, sf_dir):
    """Sub-windows without overlap, which must fill their chunk."""
    k = W.logic_chunks_whole(40, 8)
    return W.chunk(signals(spark, sf_dir), "signal", 40, 40).select("read", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.col("chunk_start") + j * 8)).alias("start"))


# -- codes -----------------------------------------------------------------------------------------------

_BOOK = "c as (select i as code, list_transform(generate_series(0, 7), lambda j: ((i * 37 + j * 11) % 100)::double) as v from (select unnest(generate_series(0, 15)) as i))"


@query(
    "kmeans_tokens",
    "with a as (select user_id as read, list(value order by event_id) as d, count(*)::int as n from events group by 1), x as (select read, s, d[s + 1:s + 8] as v from (select read, d, unnest(generate_series(0, n - 8, 4))::int as s from a where n >= 8)), "
    + _BOOK
    + f", n as (select read, s, arg_min(c.code, (round({_DIST}, 9), c.code)) as code from x, c group by read, s) select read, count(*) as n, string_agg('<|tok:' || code || '|>', '' order by s) as text from n group by read",
)
def kmeans_tokens(spark, sf_dir):
    """Windows of a signal to their nearest centroids to token text; a read shorter than a window gives nothing."""
    book = np.array([[(i * 37 + j * 11) % 100 for j in range(8)] for i in range(16)], float)
    coded = V.nearest_codes(W.chunk(signals(spark, sf_dir), "signal", 8, 4).select("read", "chunk_start", "chunk"), "chunk", np.arange(16), book)
    per = coded.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("chunk_start", F.col("codes")[0].alias("code")))).alias("s"))
    return per.select("read", F.size("s").cast("long").alias("n"), V.format_tokens(F.transform("s", lambda x: x.code)).alias("text"))


@query("code_distances", _CODES + f" select vec_id, cluster, round(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as distance from (select x.vec_id, any_value(x.v) as v, arg_min(c.code, (round({_DIST}, 9), c.code)) as cluster, arg_min(c.v, (round({_DIST}, 9), c.code)) as w from x, c group by x.vec_id)")
def code_distances(spark, sf_dir):
    """Identity, cluster and squared distance of every vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    _, c = V.load_codebook(e.where("vec_id < 16"), "vec_id", "embedding")
    return V.assign(e, "vec_id", "embedding", c).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("level_text", f"select vec_id, '<|tok:L1_' || level1 || '|><|tok:L2_' || level2 || '|>' as text from ({_RES})")
def level_text(spark, sf_dir):
    return _coded(spark, sf_dir, 2).select("vec_id", V.level_text(F.transform("codes", lambda x: F.array(x)), 2, 2).alias("text"))


@query(
    "level_metrics",
    f"with r as (select vec_id, unnest([1, 2]) as level, unnest([level1, level2]) as code from ({_RES})), k as (select level, code, count(*) as n from r group by all) select level::bigint as level, count(*) as used, round(-sum(n / t::double * log2(n / t::double)), 6) as entropy, round(max(n) / any_value(t)::double, 6) as top, round(-sum(n / t::double * log2(n / t::double)) / 4, 6) as of_most from (select *, sum(n) over (partition by level) as t from k) group by level",
)
def level_metrics(spark, sf_dir):
    """Usage, entropy and the share of the most used code for each residual level; at most log2 of 16 bits."""
    k = _coded(spark, sf_dir, 2).select(F.posexplode("codes").alias("l", "code")).groupBy((F.col("l") + 1).cast("long").alias("level"), "code").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("level"))
    g = k.withColumn("p", p).groupBy("level").agg(F.count("*").alias("used"), F.sum(-F.col("p") * F.log2("p")).alias("h"), F.max("p").alias("top"))
    return g.select("level", "used", F.round("h", 6).alias("entropy"), F.round("top", 6).alias("top"), F.round(F.col("h") / 4, 6).alias("of_most"))


@query("code_decode", _CODES + ", s as (select vec_id, unnest([vec_id % 16, vec_id % 7]) as k, unnest([1, 2]) as i from embeddings), f as (select s.vec_id, flatten(list(c.v order by s.i)) as w from s join c on c.code = s.k group by s.vec_id) select vec_id, len(w[1:100])::bigint as n, round(list_sum(w[1:100]), 4) as total from f")
def code_decode(spark, sf_dir):
    """Two codes to 128 values, cut to 100."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", F.array(F.col("vec_id") % 16, F.col("vec_id") % 7).alias("codes"))
    out = V.decode_codes(rows, "vec_id", "codes", e.where("vec_id < 16").select(F.col("vec_id").alias("code"), "embedding"), "code", "embedding", 100)
    return out.select("vec_id", F.size("signal").cast("long").alias("n"), F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# -- rows, labels, lengths -----------------------------------------------------------------------------------


@query("parse_labels", "select doc_id, md5(array_to_string(case when doc_id % 3 = 0 then list_transform(string_split(n_chars::varchar, ''), lambda x: x::int) when doc_id % 3 = 1 then list_transform(string_split(lang, ''), lambda x: case lower(x) when 'a' then 1 when 'c' then 2 when 'g' then 3 when 't' then 4 else 0 end) else []::int[] end, ',')) as labels from documents")
def parse_labels(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.transform(L.parse_labels(text), lambda x: x.cast("string")), ",")).alias("labels"))


@query("resolve_length", "select doc_id, least(case doc_id % 3 when 0 then n_chars when 1 then 1 + (doc_id % 2) else 50 end, 50)::bigint as n from documents")
def resolve_length(spark, sf_dir):
    k = F.col("doc_id") % 3
    mask = F.when(k == 1, F.array(F.lit(1).cast("long"), F.col("doc_id") % 2))
    return table(spark, sf_dir, "documents").select("doc_id", L.resolve_length(F.when(k == 0, F.col("n_chars")), mask, F.lit(50).cast("long")).alias("n"))


@query("missing_fields", "select doc_id, length(text)::int as n from documents left join labels using (doc_id) where text <> '' and quality is not null and length(text) % 64 <> 0")
def missing_fields(spark, sf_dir):
    """Rows without a text or a label go, and those whose count isn't the expected one."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.where((F.col("text") != "") & F.col("quality").isNotNull() & (F.length("text") % 64 != 0)).select("doc_id", F.length("text").alias("n"))


@query("two_level_join", "select l_orderkey, l_linenumber, c_custkey from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey and c_nationkey % 5 = l_linenumber % 5")
def two_level_join(spark, sf_dir):
    """First the file, then the read within it."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", F.col("l_linenumber") % 5)
    return rows.join(c.withColumn("j", F.col("c_nationkey") % 5), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("k") == F.col("j"))).select("l_orderkey", "l_linenumber", "c_custkey")


@query("key_sets", "(select 'both' as kind, c_custkey as id from customer intersect select 'both', o_custkey from orders) union all (select 'only', c_custkey from customer except all select 'only', o_custkey from orders)")
def key_sets(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return c.intersect(o).select(F.lit("both").alias("kind"), "id").union(c.exceptAll(o).select(F.lit("only").alias("kind"), "id"))


@query("props_map", "select event_type, (props->>'$.k')::int % 10 as k, count(*) as n from events group by all")
def props_map(spark, sf_dir):
    """JSON into a map, and one of its values."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").groupBy("event_type", (F.element_at(m, "k").cast("int") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("props_counters", "select user_id, (select string_agg(t || '=' || n, ',' order by t) from (select event_type as t, count(*) as n from events e2 where e2.user_id = e.user_id group by 1)) as counters from (select distinct user_id from events) e")
def props_counters(spark, sf_dir):
    """Counters of a read as a map, written in key order."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), ",").alias("counters"))


# -- samples and statistics ------------------------------------------------------------------------------------

_HASH = "(doc_id * 7919 + 42) % 1000003"


@query("half_sample", f"select doc_id from (select doc_id, row_number() over (order by {_HASH}, doc_id) - 1 as k, count(*) over () as n from documents) where k < n // 2")
def half_sample(spark, sf_dir):
    return P.fixed_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.5)


@query("validation_subset", f"select doc_id from (select doc_id, row_number() over (order by {_HASH}, doc_id) - 1 as k, count(*) over () as n from documents) where k < greatest(1, floor(n * 0.0001))")
def validation_subset(spark, sf_dir):
    return P.fixed_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.0001, least=1)


@query("point_budget", "with r as (select user_id, event_id, (event_id * 7919 + 42) % 1000003 as h from events), k as (select *, row_number() over (partition by user_id order by h, event_id) as k from r) select user_id, count(*) as n, sum(event_id)::bigint as ids from k where k <= 50 group by user_id")
def point_budget(spark, sf_dir):
    """At most 50 points of each read, by a hash: the rank limit is applied before the shuffle."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(P.spread(F.col("event_id")), "event_id"))
    return e.withColumn("k", k).where("k <= 50").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("token_count_hist", "select n, count(*) as docs from (select len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))::int as n from documents where text is not null) group by n")
def token_count_hist(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != ""))
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(n.alias("n")).agg(F.count("*").alias("docs"))


@query("outliers_5sigma", "with g as (select avg(value) as m, stddev_pop(value) as s, quantile_cont(value, 0.001) as lo, quantile_cont(value, 0.999) as hi from events) select count(*) as n, count(*) filter (where abs(value - m) > 5 * s) as outliers, round(count(*) filter (where abs(value - m) > 5 * s) / count(*)::double, 9) as ratio, count(*) filter (where value between lo and hi) as trimmed, round(avg(case when value between lo and hi then value end), 6) as trimmed_mean from events, g")
def outliers_5sigma(spark, sf_dir):
    """Five sigmas, and the mean of what lies between the 0.1 and 99.9 percentiles, which are exact at any size."""
    v = table(spark, sf_dir, "events").select("value")
    lo, hi = exact_quantiles(v, "value", [0.001, 0.999])
    g = F.broadcast(v.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")))
    far, inner = F.abs(F.col("value") - F.col("m")) > 5 * F.col("s"), F.col("value").between(F.lit(lo), F.lit(hi))
    return v.join(g).agg(F.count("*").alias("n"), F.count_if(far).alias("outliers"), F.round(F.count_if(far) / F.count("*"), 9).alias("ratio"), F.count_if(inner).alias("trimmed"), F.round(F.avg(F.when(inner, F.col("value"))), 6).alias("trimmed_mean"))


_AT = (0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0)


@query("exact_quantiles", " union all ".join(f"select {f}::double as fraction, round(quantile_cont(l_extendedprice, {f}), 6) as price, round(quantile_cont(l_quantity, {f}), 6) as quantity from lineitem" for f in _AT))
def exact_quantiles_of_lines(spark, sf_dir):
    """Quantiles of a column with nearly as many values as rows and of one with few; intervals are fetched from 200 rows on."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    price, quantity = (exact_quantiles(rows, c, list(_AT), few=200) for c in rows.columns)
    return spark.createDataFrame([(f, round(p, 6), round(q, 6)) for f, p, q in zip(_AT, price, quantity, strict=True)], "fraction double, price double, quantity double")


@query("sliding_events", "select time_bucket(interval 30 minute, ts) - k * interval 30 minute as start, event_type, count(*) as n from events, (select unnest([0, 1]) as k) group by all")
def sliding_events(spark, sf_dir):
    from wavecrest.streaming.windows import sliding

    return sliding(table(spark, sf_dir, "events"), "1 hour", "30 minutes").select("start", "event_type", "n")


@query("dense_events", "select event_id, row_number() over (order by value, event_id) - 1 as rank from events")
def dense_events(spark, sf_dir):
    """Global ranks without a window over all rows."""
    return scratch.dense_index(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", name="rank").select("event_id", "rank")
