"""Readers, writers and discovery of files, and global ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavecrest.operators import sampling as P
from wavecrest.operators import joins
from wavecrest.sources import dense, files, scratch


def test_jsonl_variants(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"read_id": "", "id": "x", "text": "t"}\n\n{"id": "y", "text": "u"}\n{"text": "v"}\n{"id": "z", "text": ""}\n')
    schema = "read_id string, id string, text string"
    assert sorted(r.read_id for r in files.read_jsonl(spark, str(tmp_path), schema).collect()) == ["x", "y"]
    assert files.read_jsonl(spark, str(tmp_path), schema, strict=True).count() == 4
    (tmp_path / "b.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path), schema, strict=True).collect()


def test_concatenated(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}{"a": 2}\n  {"a": 3, "b": "}{"}')
    out = files.read_concatenated_json(spark, str(tmp_path), "a long, b string").collect()
    assert sorted((r.a, r.b) for r in out) == [(1, None), (2, None), (3, "}{")]


def test_dense_layouts(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    np.save(tmp_path / "b.npy", np.arange(4, dtype=np.int16))
    np.save(tmp_path / "c.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "d.npy", np.zeros((0, 5)))
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "e.npy", np.asfortranarray(np.arange(12, dtype=">f8").reshape(4, 3)))
    np.save(tmp_path / ".hidden.npy", np.zeros((1, 1)))
    for size in (1, 24, 10**6):
        rows = sorted((r["index"], r.path[-5:], r.row, r.data) for r in dense.read_dense(spark, str(tmp_path), rangeBytes=size).collect())
        want = [("a.npy", 0, [0, 1, 2]), ("a.npy", 1, [3, 4, 5]), ("b.npy", 0, [0, 1, 2, 3])] + [("e.npy", k, [3 * k, 3 * k + 1, 3 * k + 2]) for k in range(4)]
        assert rows == [(k, *r) for k, r in enumerate(want)]
    assert dense.read_dense(spark, str(tmp_path), exact=3).count() == 6
    (tmp_path / "raw.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert [r.data for r in dense.read_dense(spark, str(tmp_path / "raw.bin"), rawWidth=2).collect()] == [[0, 1], [2, 3], [4, 5]]
    np.save(tmp_path / "bad.npy", np.array([{"a": 1}], object), allow_pickle=True)
    with pytest.raises(Exception, match="not numbers"):
        dense.read_dense(spark, str(tmp_path)).collect()


def test_dense_reads_ranges_only(tmp_path, monkeypatch):
    """No task reads more than its range, and together they read the file once."""
    x = np.arange(4000, dtype=np.float32).reshape(1000, 4)
    np.save(tmp_path / "a.npy", x)
    reader, took = dense.DenseReader({"path": str(tmp_path), "rangeBytes": "1600"}), []
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(k, k + 100) for k in range(0, 1000, 100)]
    plain = dense.read_rows
    monkeypatch.setattr(dense, "read_rows", lambda f, a, first, last: took.append((last - first) * a.row_bytes) or plain(f, a, first, last))
    got = np.concatenate([np.array(b.column(3).to_pylist()) for p in parts for b in reader.read(p)])
    assert (got == x).all() and max(took) <= 1600 and sum(took) == x.nbytes


def test_dense_shards(spark, tmp_path):
    rows = spark.range(250).repartitionByRange(3, "id").sortWithinPartitions("id").select(F.array(F.col("id").cast("float"), F.when(F.col("id") != 7, 2.0).cast("float")).alias("v"))
    path = f"file://{tmp_path}/out"
    dense.write_dense(rows, path, "v", 2, shard_rows=40)
    m = dense.read_manifest(spark, path).orderBy("start").collect()
    assert sum(r.rows for r in m) == 250 and max(r.rows for r in m) == 40 and [r.start for r in m] == [sum(x.rows for x in m[:k]) for k in range(len(m))]
    back = dense.read_dense(spark, path, rangeBytes=80).orderBy("index").collect()
    assert [r["index"] for r in back] == [r.data[0] for r in back] == list(range(250))
    assert np.isnan(back[7].data[1]) and sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".npy") == [r.shard for r in m]
    with pytest.raises(Exception, match="holds arrays already"):
        dense.write_dense(rows, path, "v", 2)
    assert dense.read_dense(spark, path).count() == 250
    dense.write_dense(rows.limit(0), path, "v", 2, overwrite=True)
    assert [p.name for p in (tmp_path / "out").glob("*.npy")] == ["shard_00000.npy"] and np.load(tmp_path / "out" / "shard_00000.npy").shape == (0, 2)
    assert dense.read_dense(spark, path).count() == 0


def test_failed_task_leaves_no_shard(spark, tmp_path):
    rows = spark.range(200).repartitionByRange(4, "id").select(F.when(F.col("id") != 190, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0))).alias("v"))
    with pytest.raises(Exception, match="doesn't have 2 numbers"):
        dense.write_dense(rows, f"file://{tmp_path}/out", "v", 2, shard_rows=10)
    assert [p for p in (tmp_path / "out").rglob("*")] == []


def test_rows_at(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    dense.write_dense(spark.range(500).coalesce(2).select(F.array(F.col("id").cast("float")).alias("v")), path, "v", 1, shard_rows=30)
    wanted = spark.createDataFrame([(k, "x") for k in [3, 3, 3, 499, 29, 30, 500, -1, None, *range(200, 260)]], "g long, data0 string")
    for shards in (10**6, 0):
        monkeypatch.setattr(joins, "BROADCAST_SHARDS", shards)
        out = dense.rows_at(wanted, "g", path).collect()
        assert len(out) == 69
        assert all((r.data == [r.g]) if r.g is not None and 0 <= r.g < 500 else r.data is None for r in out)


def test_csv_and_pairs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fast5,n\nx,1\ny,2\n")
    with pytest.raises(ValueError):
        files.read_csv_checked(spark, str(tmp_path), "fast5 string, n int", "fast5", "x")
    listing = spark.createDataFrame([("d/tokens_1.npy",), ("d/reference_1.npy",), ("d/tokens_2.npy",)], "path string")
    with pytest.raises(ValueError):
        files.pair_files(listing)
    assert files.pair_files(listing.where("path not like '%2.npy'")).count() == 1


def test_discovery(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for name in ("x/1.txt", "x/y/2.txt", "x/3.csv"):
        (tmp_path / name).write_text("t")
    found = files.discover(spark, f"{tmp_path}/x,{tmp_path}/x/1.txt", ".txt", "folder").collect()
    assert [r.group for r in found] == ["x", "y"]
    assert files.discover(spark, f"{tmp_path}/x", ".txt", recursive=False).count() == 1
    for paths, error in ((f"{tmp_path}/x/3.csv", ValueError), (f"{tmp_path}/none", FileNotFoundError), (f"{tmp_path}/x/y,", None), ("", ValueError)):
        if error:
            with pytest.raises(error):
                files.discover(spark, paths, ".txt")
    with pytest.raises(ValueError):
        files.discover(spark, f"{tmp_path}/x/y", ".csv")


def test_ranks_and_samples(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("h"))
    out = scratch.dense_index(rows, "h", "id").orderBy("h", "id").collect()
    assert [r["index"] for r in out] == list(range(1000))
    out = scratch.total_before(rows, "id", "h", "id").orderBy("h", "id").collect()
    assert [r.before for r in out] == np.concatenate([[0], np.cumsum([r.id for r in out])[:-1]]).tolist()
    per = P.sample_per_group(rows, "g", [F.col("h"), F.col("id")], 0.1).groupBy("g").count().collect()
    assert {r["count"] for r in per} == {33}
    assert P.fixed_sample(rows, "id", 0.0, least=1).count() == 1
    with pytest.raises(ValueError):
        P.fixed_sample(rows, "id", 2.0)
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id long")
    assert P.sample_per_group(nulls, "g", [F.col("id")], 0.5).count() == 1


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        scratch.base(Session)
