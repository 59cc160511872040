"""Files read by ranges equal files read whole, and large ones take several tasks."""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.sources import ranges, readers


def _add(tar, name, raw):
    info = tarfile.TarInfo(name)
    info.size = len(raw)
    tar.addfile(info, io.BytesIO(raw))


def _rows(df):
    return {(r["file"].rsplit("/", 1)[-1], r["row"]): r["v"] for r in df.collect()}


def test_arrays_by_ranges_equal_their_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(101, 7))
    np.save(tmp_path / "rows.npy", x)
    np.save(tmp_path / "columns.npy", np.asfortranarray(x))
    np.save(tmp_path / "big_endian.npy", x.astype(">f4"))
    np.save(tmp_path / "flat.npy", np.arange(4))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    np.savez(tmp_path / "stored.npz", other=np.zeros((2, 2)), features=x)
    np.savez_compressed(tmp_path / "packed.npz", arr_0=x, features=np.zeros((1, 1)))
    np.savez_compressed(tmp_path / "packed_columns.npz", only=np.asfortranarray(x))
    found = ranges.read_arrays(spark, str(tmp_path), "m", range_bytes=1000)
    assert found.rdd.getNumPartitions() == 1 + 2 + 3 * 6 + 3  # flat, two compressed, three of doubles by 17 rows, floats by 35
    got = _rows(found)
    wanted = {"rows.npy": x, "columns.npy": x, "big_endian.npy": x.astype("f4"), "flat.npy": np.arange(4.0)[None], "stored.npz": x, "packed.npz": x, "packed_columns.npz": x}
    assert len(got) == sum(len(w) for w in wanted.values())
    for name, w in wanted.items():
        assert np.array_equal([got[name, k] for k in range(len(w))], np.asarray(w, float)), name
    (one,) = found.select("model").distinct().collect()
    assert one["model"] == "m" and _rows(readers.read_arrays(spark, str(tmp_path), "m")) == got


def test_batches_within_a_range(spark, tmp_path, monkeypatch):
    x = np.arange(60.0).reshape(20, 3)
    np.save(tmp_path / "a.npy", np.asfortranarray(x))
    np.savez_compressed(tmp_path / "b.npz", x)
    monkeypatch.setattr(ranges, "BATCH_BYTES", 100)  # four rows
    reader = ranges.ArrayReader(str(tmp_path), "m", 1 << 20)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [len(b) for b in batches] == [4] * 10
    assert [v for b in batches for v in b.column(3).to_pylist()] == [*x.tolist(), *x.tolist()]


def test_other_arrays_are_errors(tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((2, 2, 2)))
    with pytest.raises(ValueError, match="two dimensions"):
        ranges.ArrayReader(str(tmp_path), "m", 100).partitions()
    np.save(tmp_path / "a.npy", np.array(["x"]))
    with pytest.raises(ValueError, match="numbers"):
        ranges.ArrayReader(str(tmp_path), "m", 100).partitions()
    with pytest.raises(FileNotFoundError):
        ranges.ArrayReader(str(tmp_path / "absent"), "m", 100).partitions()


def test_an_array_over_two_gigabytes_takes_several_tasks(tmp_path):
    x = np.lib.format.open_memmap(tmp_path / "a.npy", mode="w+", dtype="f8", shape=(300_000, 1000))  # a sparse file
    x[-1, :3] = 1, 2, 3
    x.flush()
    reader = ranges.ArrayReader(str(tmp_path / "a.npy"), "m", ranges.RANGE_BYTES)
    parts = reader.partitions()
    assert len(parts) == 18 and parts[-1].hi == 300_000
    last = list(reader.read(parts[-1]))[-1]
    assert last.column(2)[-1].as_py() == 299_999 and last.column(3)[-1].as_py()[:4] == [1, 2, 3, 0]


def test_shards_by_ranges_equal_their_files(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for k in range(40):  # every image far from its description, some without one
            _add(tar, f"d/{'long' * 40}{k}.jpg", bytes([k]) * (700 + k))
        _add(tar, "lonely.json", b"{}")
        for k in reversed(range(0, 40, 3)):
            _add(tar, f"d/{'long' * 40}{k}.json", b'{"k": %d}' % k)
    with tarfile.open(tmp_path / "empty.tar", "w"):
        pass
    found = ranges.read_shards(spark, str(tmp_path), range_bytes=10_000)
    assert found.rdd.getNumPartitions() > 8
    columns = ["member", "meta", F.md5("image").alias("image")]
    whole = readers.read_shards(spark, str(tmp_path)).select(*columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 14
    failed = spark.createDataFrame([(f"d/{'long' * 40}0",)], "member string")
    assert ranges.read_shards(spark, str(tmp_path / "s.tar"), failed, 10_000).count() == 13


def test_a_shard_over_two_gigabytes_takes_several_tasks(spark, tmp_path):
    with open(tmp_path / "s.tar", "wb") as raw:
        with tarfile.open(fileobj=raw, mode="w") as tar:
            _add(tar, "a.jpg", b"first")
        raw.seek(1024)  # over the end marks; then one member of 2.2 GB, a hole in the file
        info = tarfile.TarInfo("hole.bin")
        info.size = 2_200_000_000
        raw.write(info.tobuf())
        raw.seek(-(-info.size // 512) * 512, 1)
        with tarfile.open(fileobj=raw, mode="w") as tar:
            for name in ("a.json", "b.json", "b.jpg"):
                _add(tar, name, name.encode())
    found = ranges.read_shards(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 17
    got = found.withColumn("part", F.spark_partition_id()).orderBy("member").collect()
    assert [(r["member"], r["meta"], bytes(r["image"]), r["part"]) for r in got] == [("a", "a.json", b"first", 0), ("b", "b.json", b"b.jpg", 16)]


def test_windows_by_index_prune_row_groups(spark, tmp_path):
    spark.range(0, 1000, 1, 4).select(F.col("id").alias("global_idx"), F.lit("x").alias("v")).write.parquet(str(tmp_path / "t"))
    x = readers.window(spark.read.parquet(str(tmp_path / "t")), 300, 120)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(global_idx), GreaterThanOrEqual(global_idx,300), LessThan(global_idx,420)]" in plan
    assert [r["global_idx"] for r in x.orderBy("global_idx").collect()] == list(range(300, 420))
