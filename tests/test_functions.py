"""Golden vectors and properties of the array, window and sequence functions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavecrest.functions import arrays as A
from wavecrest.functions import pairwise
from wavecrest.functions import sequence as Q
from wavecrest.functions import signal as S
from wavecrest.operators import quantize as V
from wavecrest.operators import windows as W

numbers = st.lists(st.floats(-500, 500).map(lambda x: round(x, 3)), min_size=1, max_size=40)


@settings(max_examples=100, deadline=None)
@given(numbers, st.integers(2, 9))
def test_running_median(x, size):
    n = len(x)
    padded = [x[m] if m < n else x[2 * n - 1 - m] for m in ((i % (2 * n)) for i in range(-(size // 2), n + size))]
    want = [sorted(padded[i : i + size])[size // 2] for i in range(n)]
    assert A.running_median(np.array(x), size).tolist() == want


@settings(max_examples=100, deadline=None)
@given(numbers)
def test_repair_is_idempotent(x):
    once = A.repair(np.array(x), 1.0, 220.0)
    assert ((once >= 1) & (once <= 220)).all()
    assert A.repair(once, 1.0, 220.0).tolist() == once.tolist()


def test_constant_signal_has_scale_one():
    assert A.normalize(np.full(5, 7.0)).tolist() == [0.0] * 5
    with pytest.raises(ValueError):
        A.process(np.ones(3), "no such")


@pytest.mark.parametrize("strategy", ["stone", "apple", "lemon", "tango", "mongo"])
def test_long_form_equals_arrays(spark, strategy):
    rng = np.random.default_rng(2)
    reads = {1: rng.normal(90, 40, 50), 2: rng.normal(90, 80, 3), 3: np.array([300.0])}
    df = spark.createDataFrame([(r, k, float(v)) for r, x in reads.items() for k, v in enumerate(x)], "read long, pos long, value double")
    got = {(r.read, r.pos): r.y for r in S.process(df, strategy, 6).collect()}
    for r, x in reads.items():
        assert np.allclose([got[r, k] for k in range(len(x))], A.process(x, strategy, 6))


@pytest.mark.parametrize("n", [0, 3, 4, 5, 9, 10, 11, 16])
def test_chunks(spark, n):
    df = spark.createDataFrame([(list(map(float, range(n))),)], "signal array<double>")
    strict = W.chunk(df, "signal", 4, 3).orderBy("chunk_start").collect()
    assert [r.chunk_start for r in strict] == list(range(0, n - 3, 3))
    assert all(r.chunk == list(range(r.chunk_start, r.chunk_start + 4)) for r in strict)
    for tail in (1, 2):
        rows = W.chunk(df, "signal", 4, 3, tail=tail).orderBy("chunk_start").collect()
        left = n - (strict[-1].chunk_end if strict else n)
        assert len(rows) == len(strict) + (left >= tail and left > 0)
        if len(rows) > len(strict):
            assert rows[-1].chunk == list(range(n - 4, n)) and rows[-1].chunk_end == n


def test_bad_windows():
    with pytest.raises(ValueError):
        W.inference_starts(F, 4, 4)
    with pytest.raises(ValueError):
        W.overlap_plan(100, 10, 200)


def test_collapse_and_tokens(spark):
    df = spark.createDataFrame([([1, 1, 0, 1],), ([0, 0],), ([2, 9, 2],)], "ids array<int>")
    assert [r.b for r in df.select(Q.ids_to_bases(Q.collapse(F.col("ids"))).alias("b")).collect()] == ["AA", "", "CC"]
    back = df.select("ids", V.parse_tokens(V.format_tokens(F.col("ids"), "t", 128), "t", 128).alias("x")).collect()
    assert all(r.ids == r.x for r in back)


def test_alignment():
    same = pairwise.local_alignment("ACGTACGT", "ACGTACGT")
    assert same["cigar"] == "8=" and same["n_match"] == 8
    assert pairwise.local_alignment("", "ACG")["n_match"] == 0
    gap = pairwise.local_alignment("ACGTACGTTTACGGACGT", "ACGTACGTTACGGACGT")
    assert gap["n_ins"] == 1 and gap["n_match"] == 17
    assert Q.match_vector("2=1X1I1=", 4) == [1, 1, 0, 1]
    assert Q.parse_cigar("=2D") == ["=", "D", "D"]


def test_beam_and_states():
    probs = np.array([[0.1, 0.9, 0], [0.1, 0.9, 0], [0.9, 0.1, 0], [0.1, 0.9, 0]])
    assert Q.beam_search(probs) == [1, 1]
    assert Q.crf_states(5 * 4**3) == 3 and Q.crf_states(4**5) == 4
    with pytest.raises(ValueError):
        Q.crf_states(7)


def test_plans_and_states_of_columns(spark):
    sizes = [5 * 4**k for k in range(9)] + [4 ** (k + 1) for k in range(9)]
    out = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", Q.crf_state_length(F.col("n")).alias("k")).collect()
    assert all(r.k == Q.crf_states(r.n) for r in out)
    with pytest.raises(Exception, match="no state length"):
        spark.createDataFrame([(7,)], "n long").select(Q.crf_state_length(F.col("n"))).collect()
    rows = spark.createDataFrame([(1000, t) for t in range(-100, 900, 25)], "c long, t long").select("t", *W.overlap_plans(F.col("c"), 50, F.col("t"))).collect()
    assert all(list(W.overlap_plan(1000, 50, r.t).values())[2:] == list(r)[1:] for r in rows)
    with pytest.raises(Exception, match="smaller than the chunk"):
        spark.createDataFrame([(100, 200)], "c long, t long").select(*W.overlap_plans(F.col("c"), 10, F.col("t"))).collect()


def test_codebook_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((37, 5))
    codes = [*range(35), 3, 3]
    df = spark.createDataFrame([(c, v.tolist()) for c, v in zip(codes, x, strict=True)], "c int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u @ u.T)[np.array(codes)[:, None] != np.array(codes)]
    for block in (4, 10, 1000):
        r = V.pair_cosines(df, "c", "v", block).first()
        assert r.n == len(s) and r.b3 == (abs(s) < 0.3).sum() and r.a9 == (abs(s) > 0.9).sum()
        assert np.allclose([r.total, r.total_abs, r.squares, r.mx, r.mn], [s.sum(), abs(s).sum(), (s * s).sum(), s.max(), s.min()])


def test_codebook_blocks_grow_with_the_table(spark, monkeypatch):
    """Four times the rows are sent four times as often, not sixteen times, and the sums are those of all pairs."""
    rng = np.random.default_rng(5)
    sent, deal = [], F.explode
    for n in (300, 1200):
        x = rng.standard_normal((n, 4)).astype(np.float32)
        codes = np.arange(n) // 2 * (np.arange(n) < 40) + np.arange(n) * (np.arange(n) >= 40)
        df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(codes, x, strict=True)], "c long, v array<float>")
        seen = spark.sparkContext.accumulator(0)

        def explode(pairs, seen=seen):
            def count(v):
                seen.add(len(v))
                return v

            return deal(F.udf(count, "array<struct<i: long, j: long>>")(pairs))

        monkeypatch.setattr(F, "explode", explode)
        for tile in (7, 512):
            monkeypatch.setattr(V, "TILE", tile)
            seen.value = 0
            r = V.pair_cosines(df, "c", "v", 10).first()
            u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
            s = (u @ u.T)[codes[:, None] != codes]
            assert r.n == len(s) and all(r[f"b{k}"] == (abs(s) < k / 10).sum() for k in range(1, 10)) and r.a9 == (abs(s) > 0.9).sum()
            assert np.allclose([r.total, r.total_abs, r.squares, r.mx, r.mn], [s.sum(), abs(s).sum(), (s * s).sum(), s.max(), s.min()])
        sent.append(seen.value)
    assert sent[1] < 5 * sent[0]


def test_selected_shards(spark):
    from wavecrest.operators.sampling import select_shards, spread

    m = spark.range(100).select("id", (F.col("id") * 2).alias("n"))
    kept, totals = select_shards(m, "id", "n", 0.3)
    ids = [r.id for r in m.where(spread(F.col("id")) < 300000.9).collect()]
    assert sorted(r.id for r in kept.collect()) == ids and totals == {"shards": len(ids), "rows": 2 * sum(ids)}
    with pytest.raises(ValueError):
        select_shards(m, "id", "n", 0.0)


def test_stream_repair(spark, tmp_path):
    from wavecrest.streaming.windows import repair_stream

    spark.createDataFrame([(1, 1, 500.0), (1, 2, 50.0), (1, 3, -9.0), (2, 1, 7.0)], "read long, pos long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read long, pos long, value double").parquet(str(tmp_path / "in"))
    q = repair_stream(stream, 1.0, 220.0).writeStream.format("memory").queryName("repaired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("repaired").collect()) == [(1, 1, 220.0), (1, 2, 50.0), (1, 3, 50.0), (2, 1, 7.0)]


def test_whole_texts_are_aligned(spark):
    from tests.conftest import SMALL
    from wavecrest.plans.registry import QUERIES

    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    assert min(map(len, texts.values())) > 60
    found = {r.item_id: r.ref for r in QUERIES["indel_align"](spark, SMALL).collect()}
    assert {k: v.replace("-", "") for k, v in found.items()} == {k: v.replace("-", "") for k, v in texts.items()}
    for r in QUERIES["align_accuracy"](spark, SMALL).collect():
        assert sum(op in "=XIS" for op in Q.parse_cigar(r.cigar)) == len(texts[r.item_id]) - 3
    e = QUERIES["align_errors"](spark, SMALL).first()
    assert e.n_match + e.n_mismatch + e.n_del == sum(map(len, texts.values())) - 3 * len(texts)
