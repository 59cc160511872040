"""Readers and writers: missing files, repeated runs, shards, streams."""

from __future__ import annotations

import io
import json
import tarfile

import numpy as np
import pytest

from prismal.sources import readers, writers
from prismal.streaming import scores


def test_csv_missing_empty_and_nan(spark, tmp_path):
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), readers.SCORES).count() == 0
    (tmp_path / "a.csv").write_text("subject,model_set,model,display_name,stimulus_type,bootstrap_idx,n_stimuli,score\ns1,x,m,M,c,0,5,NaN\ns2,x,m,M,c,1,5,0.5\n")
    rows = readers.read_csv(spark, str(tmp_path / "*.csv"), readers.SCORES).orderBy("subject").collect()
    assert [r["score"] for r in rows] == [None, 0.5]


def test_trial_labels(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("label\ncstim_3\nvicco12\n")
    assert [tuple(r)[1:] for r in readers.read_trials(spark, str(tmp_path / "t.tsv")).collect()] == [("cstim", 3), ("vicco", 12)]
    (tmp_path / "u.tsv").write_text("label\n??\n")
    with pytest.raises(Exception, match="unknown label"):
        readers.read_trials(spark, str(tmp_path / "u.tsv")).collect()


def test_arrays_and_shards(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    np.savez(tmp_path / "b.npz", features=np.ones((2, 2)), other=np.zeros((1, 2)))
    assert readers.read_arrays(spark, str(tmp_path), "m").count() == 5
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name in ("a.jpg", "a.json", "b.jpg", "c.jpg", "c.json"):
            raw = b"{}"
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    failed = spark.createDataFrame([("c",)], "member string")
    assert [r["member"] for r in readers.read_shards(spark, str(tmp_path), failed).collect()] == ["a"]


def test_appending_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, x double")
    writers.append_new(df, path, ["k"])
    writers.append_new(df.unionByName(spark.createDataFrame([(3, 0.3)], "k int, x double")), path, ["k"])
    assert spark.read.parquet(path).count() == 3
    assert [r["k"] for r in writers.pending(spark.createDataFrame([(3,), (4,)], "k int"), path, ["k"]).collect()] == [4]


def test_state_round_trip(spark, tmp_path):
    path, state = str(tmp_path / "state"), {"phase": "greedy", "chosen": [3, 1]}
    assert writers.load_state(spark, path) is None
    writers.save_state(spark, path, state)
    assert writers.load_state(spark, path) == state and json.dumps(state)


def test_windowed_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scores.windowed_means(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    batch = scores.windowed_means(events)
    assert spark.table("means").exceptAll(batch).count() == 0 and spark.table("means").count() == batch.count()
