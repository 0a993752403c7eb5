"""Weights files, encoders, code index, broken files and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.functions import encoder, tables
from wavecrest.operators import quantize as V
from wavecrest.sources import dense, tensors


def test_tensor_files(tmp_path):
    x = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "b": np.array([], np.int64), "c": np.array(2.5), "d": np.array([[True]]), "e": np.arange(4, dtype=">i2")}
    path = f"file://{tmp_path}/sub/m.safetensors"
    tensors.write_tensors(path, x, {"k": "v"})
    f = tensors.TensorFile(path)
    assert f.metadata == {"k": "v"} and "a" in f and "z" not in f and all((f[k] == v).all() and f[k].shape == v.shape for k, v in x.items())
    assert tensors.find_weights(f"file://{tmp_path}/sub") == path
    data = (tmp_path / "sub" / "m.safetensors").read_bytes()
    assert (int.from_bytes(data[:8], "little") + 8) % 8 == 0
    for bad in (b"", b"\xff" * 20, data[:-1], data[:8] + data[8:].replace(b"F32", b"Q32"), data.replace(b'"shape": [2, 3]', b'"shape": [2, 4]')):
        (tmp_path / "bad.safetensors").write_bytes(bad)
        with pytest.raises(ValueError):
            tensors.TensorFile(f"file://{tmp_path}/bad.safetensors")
    tensors.write_tensors(f"file://{tmp_path}/sub/n.safetensors", x)
    with pytest.raises(FileNotFoundError):
        tensors.find_weights(f"file://{tmp_path}/sub")


def plain_conv(x, w, b, stride, padding):
    x = np.pad(x, ((0, 0), (padding, padding)))
    n = (x.shape[1] - w.shape[2]) // stride + 1
    return np.array([[(w[o] * x[:, t * stride : t * stride + w.shape[2]]).sum() + (0 if b is None else b[o]) for t in range(max(0, n))] for o in range(len(w))]).reshape(len(w), -1)


def test_encoder_layers(tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    w = {"c1.weight": rng.standard_normal((4, 1, 5)), "c2.weight": rng.standard_normal((3, 4, 7)), "c2.bias": rng.standard_normal(3)}
    w |= {f"n.{k}": np.abs(rng.standard_normal(4)) + 0.1 for k in ("weight", "bias", "running_mean", "running_var")}
    path = f"file://{tmp_path}/w.safetensors"
    tensors.write_tensors(path, w)
    model = encoder.Encoder(path, [["conv", "c1", 1, 2], ["norm", "n"], "silu", ["conv", "c2", 5, 3], "tanh"])
    monkeypatch.setattr(encoder, "BLOCK", 60)
    assert model.stride == 5 and model.codes is None
    for n in (0, 1, 4, 33, 200):
        x = rng.standard_normal((1, n))
        y = plain_conv(x, w["c1.weight"], None, 1, 2)
        y = (y - w["n.running_mean"][:, None]) / np.sqrt(w["n.running_var"] + 1e-5)[:, None] * w["n.weight"][:, None] + w["n.bias"][:, None]
        y = np.tanh(plain_conv(y / (1 + np.exp(-y)), w["c2.weight"], w["c2.bias"], 5, 3))
        assert model.latent(x[0]).shape == y.T.shape and np.allclose(model.latent(x[0]), y.T)


def test_encoder_rows(spark, tmp_path):
    path = f"file://{tmp_path}/w.safetensors"
    tensors.write_tensors(path, {"c.weight": np.ones((1, 1, 2), np.float32), "codebook": np.array([[0.0], [3.0], [7.0]])})
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], "x"), (2, [], None), (3, None, "y"), (4, [5.0], "z")], "id long, s array<double>, codes0 string")
    out = encoder.encode_signals(df, "s", path, [["conv", "c", 2, 0]])
    assert sorted((r.id, r.codes, r.codes0) for r in out.collect()) == [(1, [1, 2], "x"), (2, [], None), (3, [], "y"), (4, [], "z")]


@pytest.mark.parametrize(("k", "width", "spread"), [(1024, 3, 1.0), (4000, 16, 0.05), (2000, 32, 1.0), (50, 4, 1.0)])
def test_code_index(k, width, spread):
    rng = np.random.default_rng(k)
    base = rng.standard_normal((40, width))
    c = base[rng.integers(0, 40, k)] + spread * rng.standard_normal((k, width))
    c[7] = c[3]
    x = np.concatenate([base[rng.integers(0, 40, 700)] + spread * rng.standard_normal((700, width)), c[:20], np.zeros((1, width)), 1e3 * c[:5]])
    index = V.CodeIndex(c)
    assert (index.nearest(x) == V._nearest(x, c)).all() and (index.nearest(x[:0]) == V._nearest(x[:0], c)).all()
    # where codes lie in clusters, few distances are computed
    assert index.share < 0.1 if spread < 0.1 else index.share <= 1.1


def test_code_index_of_the_full_size():
    """K = 65,536: the codes of brute force at a few hundredths of its distances."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 8)) * 3
    c = base[rng.integers(0, 300, 65_536)] + 0.1 * rng.standard_normal((65_536, 8))
    x = base[rng.integers(0, 300, 400)] + 0.1 * rng.standard_normal((400, 8))
    index = V.CodeIndex(c)
    assert (index.nearest(x) == V._nearest(x, c)).all() and index.share < 0.05


def test_code_index_grows_with_the_logarithm(spark):
    """Sixteen times the codes: less than twice the distances for a row; ties, copies, rows far off and without numbers as by brute force."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random((2000, 3)), 5 * rng.random((50, 3)), np.full((1, 3), np.nan), rng.integers(0, 9, (100, 3)) / 16])
    x[-200, 1] = np.inf
    work = []
    for k in (4000, 64_000):
        c = np.concatenate([rng.random((k, 3)), rng.integers(0, 5, (500, 3)) / 8])[rng.permutation(k + 500)]
        index = V.CodeIndex(c)
        real = x[np.isfinite(x).all(1)]
        brute = np.concatenate([np.round(((real[a : a + 50, None] - c) ** 2).sum(2), 9).argmin(1) for a in range(0, len(real), 50)])
        assert (index.nearest(real) == brute).all()
        work.append(index.computed / len(real))
        assert (index.nearest(x)[~np.isfinite(x).all(1)] == 0).all()
    assert work[1] < 2 * work[0] and work[1] < 1000
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(real)], "id long, v array<double>")
    got = {r.id: r.codes for r in V.nearest_codes(rows, "v", np.arange(len(c)) * 2, c).collect()}
    assert got == {k: [2 * b] for k, b in enumerate(brute.tolist())}
    assert V.nearest_codes(rows.limit(0), "v", np.arange(len(c)), c).count() == 0


def test_histograms_of_broken_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 8)).astype(np.float32)
    x[3, 3], x[4, 4] = np.nan, np.inf
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "b.npy", np.zeros((0, 8)))
    np.save(tmp_path / "c.npy", np.ones((2, 2, 2)))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "cut.npy").write_bytes(whole[:-5])
    (tmp_path / "junk.npy").write_bytes(b"junk")
    for size in (64, 10**6):
        out = {r.path.rpartition("/")[2]: r for r in dense.file_histograms(spark, str(tmp_path), -1.0, 1.0, 4, size).collect()}
        assert {k: r.status for k, r in out.items()} == {"a.npy": "success", "b.npy": "success", "c.npy": "success", "cut.npy": "error", "junk.npy": "error"}
        good = x[np.isfinite(x)]
        assert out["a.npy"].counts == np.histogram(good, np.linspace(-1, 1, 5))[0].tolist() and out["a.npy"].total == len(good)
        assert all(out[k].counts == [0] * 4 and out[k].total == 0 for k in ("b.npy", "c.npy", "cut.npy", "junk.npy")) and "before its 50 rows" in out["cut.npy"].error


def test_table_functions(spark):
    tables.register(spark)
    tables.register(spark)
    rows = spark.createDataFrame([(1, [float(k) for k in range(10)], "".join(f"<|tok:{k}|>" for k in range(5))), (2, None, None), (3, [], "")], "id long, s array<double>, t string")
    out = spark.sql("select id, c.* from {r} r, lateral chunk_signal(r.s, 4, 1) c", r=rows).collect()
    assert [(r.id, r.start, r.stop, r.chunk) for r in sorted(out, key=lambda r: r.start)] == [(1, a, a + 4, [float(k) for k in range(a, a + 4)]) for a in (0, 3, 6)]
    out = spark.sql("select id, w.* from {r} r, lateral token_windows(r.t, 3, 1) w", r=rows).collect()
    assert sorted((r.number, r.start, r.text) for r in out) == [(0, 0, "<|tok:0|><|tok:1|><|tok:2|>"), (1, 2, "<|tok:2|><|tok:3|><|tok:4|>")]
    out = spark.sql("select id, k.* from {r} r, lateral tokenize_signal(r.s, 'tens') k", r=rows).collect()
    assert sorted((r.pos, r.token) for r in out) == [(k, 0) for k in range(10)]
    for bad in ("tokenize_signal(r.s, 'none')", "chunk_signal(r.s, 4, 4)"):
        with pytest.raises(Exception, match="no strategy|overlap"):
            spark.sql(f"select k.* from {{r}} r, lateral {bad} k", r=rows.where(F.col("id") == 1)).collect()
