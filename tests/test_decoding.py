"""Decoders, alignments, filters and stitching against brute force and golden vectors."""

import difflib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.functions import alignment, arrays, crf, labels, pairwise, sequence, signal, weights
from wavecrest.operators import quantize as V
from wavecrest.operators import windows as W
from wavecrest.operators.joins import zip_rows


def test_beam_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(20):
        p = sequence.softmax(rng.standard_normal((5, 4)) * 2)
        total = {}
        for path in itertools.product(range(4), repeat=5):
            key = tuple(sequence.collapse_path(list(path)))
            total[key] = total.get(key, 0.0) + np.prod([p[t, c] for t, c in enumerate(path)])
        assert tuple(sequence.beam_search(p, 2000, 0.0)) == max(total, key=total.get)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s, tr = rng.standard_normal((6, 3)), rng.standard_normal((3, 3))
        paths = list(itertools.product(range(3), repeat=6))
        value = [sum(s[t, c] for t, c in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:])) for p in paths]
        assert tuple(sequence.viterbi_path(s, tr)) == paths[int(np.argmax(value))]
    assert sequence.collapse_path([1, 1, 0, 1, 2, 2, 0]) == [1, 1, 2]
    assert sequence.collapse_path([0, 0]) == []


def all_crf_paths(m, k, b=4):
    """(total, labels, moves) of every path of one read."""
    before = crf.predecessors(k, b)
    for first in range(b**k):
        for choice in itertools.product(range(1 + b), repeat=m.shape[0]):
            # a move from a state is fixed by where it leads
            s, total, edges = first, 0.0, []
            for t, c in enumerate(choice):
                to = s if not c else s % b ** (k - 1) * b + c - 1
                j = 0 if not c else 1 + s // b ** (k - 1)
                assert before[to, j] == s
                total += m[t, to, j]
                edges.append((to, j))
                s = to
            yield total, [1 + to % b if j else 0 for to, j in edges], edges


@pytest.mark.parametrize(("k", "steps"), [(1, 1), (1, 4), (2, 3)])
def test_crf_against_all_paths(k, steps):
    rng = np.random.default_rng(k + steps)
    for classes in (4 ** (k + 1), 5 * 4**k):
        m = crf.moves(rng.standard_normal((3, steps, classes)) * 2, stay=0.5)
        z, p, best, single = crf.log_partition(m, k), crf.posteriors(m, k), crf.viterbi(m, k), crf.posterior_path(m, k)
        for r in range(3):
            paths = list(all_crf_paths(m[r], k))
            totals = np.array([x for x, _, _ in paths])
            assert np.isclose(z[r], np.log(np.exp(totals).sum()))
            assert best[r].tolist() == paths[int(totals.argmax())][1]
            want = np.zeros(m[r].shape)
            for x, _, edges in paths:
                for t, e in enumerate(edges):
                    want[(t, *e)] += np.exp(x - z[r])
            assert np.allclose(p[r], want) and np.allclose(want.sum((1, 2)), 1)
            assert single[r].tolist() == [1 + x // 5 % 4 if x % 5 else 0 for x in want.reshape(steps, -1).argmax(1)]
            assert np.isclose(crf.forward(m, k, log=False)[r, -1].max(), totals.max()) and np.isclose(crf.backward(m, k, log=False)[r, 0].max(), totals.max())


def test_crf_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(1, rng.standard_normal(64).tolist(), "x"), (2, rng.standard_normal(192).tolist(), None), (3, [], "y"), (4, None, "z"), (5, rng.standard_normal(64).tolist(), "x")]
    df = spark.createDataFrame(rows, "id long, scores array<double>, labels0 string")
    for posterior in (False, True):
        out = {r.id: r for r in crf.decode_crf(df, "scores", 16, 0.3, posterior).collect()}
        for i, x, other in rows:
            m = crf.moves(np.array(x or [], float).reshape(1, -1, 16), stay=0.3)
            path = (crf.posterior_path if posterior else crf.viterbi)(m, 1)[0].tolist() if x else []
            assert out[i].labels == path and out[i].bases == "".join("NACGT"[b] for b in sequence.collapse_path(path)) and out[i].labels0 == other
    with pytest.raises(Exception, match="whole steps"):
        crf.decode_crf(df, "scores", 80).collect()
    assert crf.state_length(5 * 4**5) == (5, True) and crf.state_length(64) == (2, False)
    for n in (4, 5, 7):
        with pytest.raises(ValueError):
            crf.state_length(n)


def brute_score(q, r, match=5, mismatch=-4, opening=8, extend=4):
    """Best local score by recursion over states."""
    from functools import lru_cache

    @lru_cache(None)
    def h(i, j):
        if not i or not j:
            return 0
        s = match if q[i - 1] == r[j - 1] else mismatch
        gaps = [h(i - k, j) - opening - extend * (k - 1) for k in range(1, i + 1)] + [h(i, j - k) - opening - extend * (k - 1) for k in range(1, j + 1)]
        return max(0, h(i - 1, j - 1) + s, *gaps)

    return max((h(i, j) for i in range(len(q) + 1) for j in range(len(r) + 1)), default=0)


def edited(rnd, text, n, letters):
    out = list(text)
    for _ in range(n):
        k = rnd.randrange(len(out) + 1)
        if rnd.random() < 0.5 and k < len(out):
            del out[k]
        else:
            out.insert(k, rnd.choice(letters))
    return "".join(out)


def test_alignment_in_blocks():
    """However few rows are held, the alignment is the same, and its score that of the recursion."""
    rnd = random.Random(5)
    for _ in range(150):
        letters = rnd.choice(["AC", "ACGT", "ABCDEFG"])
        q = "".join(rnd.choice(letters) for _ in range(rnd.randrange(50)))
        r = edited(rnd, q, rnd.randrange(10), letters)
        whole = pairwise.local_alignment(q, r)
        assert all(pairwise.local_alignment(q, r, cells=c) == whole for c in (1, 60, 400))


def test_long_alignment_in_bounded_memory():
    import tracemalloc

    rnd = random.Random(6)
    q = "".join(rnd.choice("ACGT") for _ in range(20_000))
    r = edited(rnd, q, 1500, "ACGT")
    tracemalloc.start()
    a = pairwise.local_alignment(q, r)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and a["n_match"] > 18_500
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([=XIDS])", a["cigar"])]
    assert sum(n for n, op in ops if op in "=XIS") == len(q) and sum(n for n, op in ops if op in "=XD") == a["ref_end"] - a["ref_start"]
    i, j = 0, a["ref_start"]
    for n, op in ops:
        assert op != "=" or q[i : i + n] == r[j : j + n]
        i, j = i + n * (op in "=XIS"), j + n * (op in "=XD")


def test_blocks_against_difflib():
    rnd = random.Random(7)
    for _ in range(300):
        letters = rnd.choice(["AC", "ACGT", "ABCDEFG"])
        q = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        r = edited(rnd, q, rnd.randrange(15), letters)
        x, y = [], []
        for _, a, b, c, d in difflib.SequenceMatcher(None, q, r, autojunk=False).get_opcodes():
            n = max(b - a, d - c)
            x.append(q[a:b].ljust(n, "-"))
            y.append(r[c:d].ljust(n, "-"))
        assert pairwise.gapped(q, r) == ("".join(x), "".join(y))


def test_alignment_columns(spark):
    rows = [(1, "ACGT", "ACGT"), (2, None, "ACGT"), (3, "AC", None), (4, "", ""), (5, "TTACGTACGTAA", "ACGTACGT")]
    df = spark.createDataFrame(rows, "id long, q string, r string").select("id", pairwise.align("q", "r").alias("a"), pairwise.indel_align("q", "r").alias("g"))
    out = {r.id: r for r in df.collect()}
    for i, q, r in rows:
        assert out[i].a.asDict() == pairwise.local_alignment(q or "", r or "") and tuple(out[i].g) == pairwise.gapped(q or "", r or "")


def test_alignment_scores():
    rng = np.random.default_rng(3)
    for _ in range(60):
        q, r = ("".join(rng.choice(list("ACG"), rng.integers(0, 12))) for _ in range(2))
        a = pairwise.local_alignment(q, r)
        score, before = 0, ""
        ops = [op for op in sequence.parse_cigar(a["cigar"]) if op != "S"]
        for op in ops:
            score += {"=": 5, "X": -4}.get(op, -4 if op == before else -8)
            before = op
        assert score == brute_score(q, r), (q, r, a)
    assert pairwise.local_alignment("ACGT", "ACGT")["cigar"] == "4="
    assert pairwise.local_alignment("", "ACGT")["n_match"] == 0
    assert pairwise.local_alignment("TTACGTACGTAA", "ACGTACGT")["cigar"] == "2S8=2S"


def test_repair_with_nan(spark):
    nan, low, high = float("nan"), 1.0, 220.0
    reads = {1: [nan, 5.0, 6.0], 2: [nan, 5.0, 300.0], 3: [400.0, nan, 7.0], 4: [0.5, 7.0, nan], 5: [nan, nan, -1.0], 6: [3.0, 4.0]}
    rows = spark.createDataFrame([(k, p, v) for k, x in reads.items() for p, v in enumerate(x)], "read long, pos long, value double")
    got = {}
    for r in signal.repair(rows, low, high).orderBy("read", "pos").collect():
        got.setdefault(r.read, []).append(r.y)
    for k, x in reads.items():
        assert np.array_equal(np.array(got[k]), arrays.repair(np.array(x), low, high), equal_nan=True), k
    assert got[2] == [1.0, 5.0, 5.0] and got[3] == [220.0, 220.0, 7.0]


def test_running_median_moves():
    rng = np.random.default_rng(4)
    for n, size in ((1, 70), (3, 100), (500, 65), (500, 101), (300, 6000)):
        x = rng.integers(0, 50, n).astype(float)
        at = np.mod(np.arange(-(size // 2), n + size - 1 - size // 2), 2 * n)
        padded = x[np.where(at < n, at, 2 * n - 1 - at)]
        want = [np.sort(padded[k : k + size])[size // 2] for k in range(n)]
        assert arrays.running_median(x, size).tolist() == want


def test_low_pass():
    """Gain 1 at 0, half the power of each pass at the cutoff, no shift, constants as they are."""
    rate, cutoff = 5000.0, 1000.0
    t = np.arange(4000) / rate
    b, a = arrays.butterworth(cutoff, rate, 6)
    for f, gain in ((0.0, 1.0), (cutoff, 0.5**0.5)):
        z = np.exp(-2j * np.pi * f / rate * np.arange(7))
        assert abs(abs((b * z).sum() / (a * z).sum()) - gain) < 1e-9
    assert np.allclose(arrays.low_pass(np.full(50, 3.0), cutoff, rate), 3.0)
    slow = np.sin(2 * np.pi * 50 * t)
    assert np.abs(arrays.low_pass(slow + np.sin(2 * np.pi * 2200 * t), cutoff, rate) - slow)[100:-100].max() < 1e-3
    assert arrays.low_pass(np.array([2.0]), cutoff, rate).tolist() == [2.0]


def test_weights_within_bounds():
    low, high = np.array([0.1, 0.1, 0.2]), np.array([0.5, 0.4, 0.9])
    rng = np.random.default_rng(5)
    raw = rng.dirichlet([0.3, 0.3, 0.3], 200)
    w = weights.project(raw, low, high)
    assert np.allclose(w.sum(1), 1, atol=1e-4)
    inside = (raw >= low).all(1) & (raw <= high).all(1)
    assert np.allclose(w[inside], raw[inside])


def test_labels_and_lengths(spark):
    df = spark.createDataFrame([("12",), (None,), ("",), ("ACGTNx",)], "t string").select(labels.parse_labels(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [[1, 2], [], [], [1, 2, 3, 4, 0, 0]]
    df = spark.createDataFrame([(3, None), (None, [1, 1, 0]), (None, None), (90, None)], "n long, m array<long>")
    assert [r.x for r in df.select(labels.resolve_length(F.col("n"), F.col("m"), F.lit(10).cast("long")).alias("x")).collect()] == [3, 2, 10, 10]
    with pytest.raises(Exception):
        spark.createDataFrame([(-1, None)], "n long, m array<long>").select(labels.resolve_length(F.col("n"), F.col("m"), F.lit(10).cast("long"))).collect()
    joined = spark.createDataFrame([(["a", "b"],), (None,)], "t array<string>").select(labels.join_tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in joined] == ["ab", ""]


def test_margin_windows(spark):
    for n in (1, 11, 40, 41, 63, 64, 65, 200):
        df = spark.createDataFrame([(1, [float(k) for k in range(n)])], "read long, s array<double>")
        w = W.margin_windows(df, "s", 16, 2, 2).withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("chunk", i * 2).cast("long")))
        got = W.stitch_windows(w, ["read"], "codes", 2).first()
        assert got.codes == [2 * k for k in range(-(-n // 2))], n
    assert W.margin_windows(df, "s", 16, 2, 2, receptive=500).count() == 0
    with pytest.raises(ValueError):
        W.margin_windows(df, "s", 4, 2, 2)
    with pytest.raises(ValueError):
        W.logic_chunks_whole(10, 3)


def test_codes_out_of_range(spark):
    book = spark.createDataFrame([(0, [1.0, 2.0])], "code long, v array<float>")
    rows = spark.createDataFrame([(1, [0, 0]), (2, [])], "k long, codes array<long>")
    out = {r.k: r.signal for r in V.decode_codes(rows, "k", "codes", book, "code", "v", 5).collect()}
    assert out == {1: [1, 2, 1, 2, 0], 2: [0, 0, 0, 0, 0]}
    with pytest.raises(Exception):
        V.decode_codes(spark.createDataFrame([(1, [7])], "k long, codes array<long>"), "k", "codes", book, "code", "v", 5).collect()
    with pytest.raises(ValueError):
        V.level_text(F.array(), 3, 2)


def test_kmeans_redo(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.1, (40, 2)) for m in ((0, 0), (5, 5), (0, 9))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    c = V.fit_kmeans(df, "id", "v", 3, 8, redo=6)
    out = V.assign(df, "id", "v", c).orderBy("id").collect()
    assert len({(r.id // 40, r.cluster) for r in out}) == 3
    assert np.allclose([r.distance for r in out], ((x - c[[r.cluster for r in out]]) ** 2).sum(1))
    few = V.fit_kmeans(df, "id", "v", 3, 2, most_per_code=10)
    assert few.shape == (3, 2)
    with pytest.raises(ValueError):
        V.fit_kmeans(df, "id", "v", 500, 1)


def test_stitching_by_tokens(spark):
    rnd = random.Random(8)
    size, overlap, rows, want = 12, 4, [], []
    for key in range(60):
        pieces = [("".join(rnd.choice("ACGT") for _ in range(rnd.randrange(40))), rnd.randrange(13)) for _ in range(rnd.randrange(1, 6))]
        starts = [8 * k for k in range(len(pieces))]
        total = max(s + t for s, (_, t) in zip(starts, pieces, strict=True))
        stub = (total - overlap) % (size - overlap)
        joined = ""
        for k, (bases, tokens) in enumerate(pieces):
            at = lambda t, n=len(bases), tokens=tokens: round(t * n / tokens) if tokens and n else 0
            begin = 0 if k == 0 else at(overlap // 2)
            end = len(bases) if k == len(pieces) - 1 else at(stub + overlap // 2 if k == 0 and stub else size - overlap // 2)
            joined += bases[begin:end]
            rows.append((key, starts[k], bases, tokens))
        want.append((key, joined, stub))
    df = spark.createDataFrame(rows, "key long, start long, bases string, tokens long")
    got = W.stitch_by_tokens(df, ["key"], "start", "bases", "tokens", size, overlap)
    assert sorted(map(tuple, got.select("key", "bases", "stub").collect())) == want
    whole = {r.key: r.bases for r in W.stitch_by_tokens(df, ["key"], "start", "bases", "tokens", size, 0).collect()}
    assert whole[0] == "".join(b for k, _, b, _ in rows if k == 0)
    with pytest.raises(ValueError):
        W.stitch_by_tokens(df, ["key"], "start", "bases", "tokens", 4, 4)


def test_zip_rows(spark):
    left = spark.createDataFrame([(k, i, f"l{k}{i}") for k in (1, 2, None) for i in range(3)], "key long, i int, a string")
    right = spark.createDataFrame([(k, i * i, f"r{k}{i}") for k in (1, 2, None) for i in range(3)], "key long, j int, b string")
    got = {(r.key, r.pos, r.a, r.b) for r in zip_rows(left, right, "key", ["i"], ["j"]).collect()}
    assert got == {(k, i, f"l{k}{i}", f"r{k}{i}") for k in (1, 2, None) for i in range(3)}
    for a, b in ((left, right.where("b <> 'r12'")), (left.where("key = 1"), right)):
        with pytest.raises(Exception, match="lengths differ"):
            zip_rows(a, b, "key", ["i"], ["j"]).collect()
    assert zip_rows(left.limit(0), right.limit(0), "key", ["i"], ["j"]).count() == 0


def test_coverage(spark):
    df = spark.createDataFrame([(5, 10, 20), (15, 10, 20), (5, 0, 20), (5, -1, 20), (3, 4, 0), (0, 4, 8)], "decoded int, steps int, ref int")
    got = df.select(*labels.coverage(F.col("decoded"), F.col("steps"), F.col("ref"))).collect()
    assert list(map(tuple, got)) == [(0.25, 0.5), (0.5, 0.0), (0.0, 1.0), (0.0, 1.0), (3.0, 0.25), (0.0, 1.0)]


def test_confusion_of_odd_letters(spark):
    df = spark.createDataFrame([(1, "aCx-G-*T", "ACRT-*-n")], "id long, q string, r string")
    got = alignment.confusion(alignment.aligned_columns(df, "id", "q", "r")).collect()
    assert sorted(map(tuple, got)) == [("deletion", "N", "-", 1), ("deletion", "T", "-", 1), ("insertion", "-", "G", 1), ("insertion", "-", "N", 1), ("mismatch", "N", "T", 1)]


def test_match_vector_of_operations(spark):
    df = spark.createDataFrame([("2S3=1X2I2D1=",), ("",)], "c string")
    assert [r.v for r in df.select(alignment.match_vector(F.col("c")).alias("v")).collect()] == [[1, 1, 1, 0, 0, 0, 1], []]


def plain_residual(signal, tokens, stride, margin, code):
    """Windows and margins one after the other."""
    n, size, step = len(signal), tokens * stride, (tokens - 2 * margin) * stride
    want = -(-n // stride)
    if n <= size:
        return code(signal + [0.0] * (size - n))[:want]
    out, start = [], 0
    while start < n:
        real = min(size, n - start)
        own, valid = code(signal[start : start + real] + [0.0] * (size - real)), -(-real // stride)
        if start == 0:
            out += own[: min(tokens - margin, valid)]
        elif start + step >= n:
            out += own[margin : max(margin, valid)]
        else:
            out += own[margin : max(margin, valid - margin)]
        start += step
    return (out + [[0, 0]] * want)[:want]


@pytest.mark.parametrize(("tokens", "stride", "margin"), [(8, 2, 1), (6, 3, 2), (4, 1, 0)])
def test_residual_windows(spark, tokens, stride, margin):
    rnd = random.Random(tokens)
    signals = [[float(rnd.randrange(1, 50)) for _ in range(n)] for n in [*range(60), 200]]
    df = spark.createDataFrame(list(enumerate(signals)), "read int, signal array<double>")
    w = W.residual_windows(df, "signal", tokens, stride, margin)
    total = lambda i: F.aggregate(F.slice("chunk", i * stride + 1, F.lit(stride)), F.lit(0.0), lambda a, x: a + x).cast("long")
    coded = w.withColumn("codes", F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.array(total(i) % 7, total(i) % 5)))
    got = {r.read: r.codes for r in W.stitch_levels(coded, ["read"], "codes", 2, margin).collect()}
    code = lambda x: [[int(sum(x[t * stride : (t + 1) * stride])) % m for m in (7, 5)] for t in range(tokens)]
    for k, x in enumerate(signals):
        assert got.get(k, []) == [v for t in (plain_residual(x, tokens, stride, margin, code) if x else []) for v in t], len(x)
