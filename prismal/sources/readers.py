"""Reading score, trial and feature files as DataFrames with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SCORES = T.StructType(
    [
        T.StructField("subject", T.StringType()), T.StructField("model_set", T.StringType()), T.StructField("model", T.StringType()),
        T.StructField("display_name", T.StringType()), T.StructField("stimulus_type", T.StringType()), T.StructField("bootstrap_idx", T.IntegerType()),
        T.StructField("n_stimuli", T.IntegerType()), T.StructField("score", T.DoubleType()),
    ]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has files, asked of the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """Header files under a path or glob; an empty table where there is none. NaN becomes null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    x = spark.read.schema(schema).option("header", True).option("sep", separator).option("enforceSchema", False).csv(path)
    numbers = [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return x.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers}) if numbers else x


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """(label, grp, idx) of tab-separated trials; a label that does not parse is an error when it is read."""
    x = read_csv(spark, path, T.StructType([T.StructField("label", T.StringType())]), "\t")
    grp, idx = F.regexp_extract("label", r"^([A-Za-z]+)_?(\d+)$", 1), F.regexp_extract("label", r"^([A-Za-z]+)_?(\d+)$", 2)
    bad = F.raise_error(F.concat(F.lit("unknown label: "), "label"))
    return x.select("label", F.when(grp != "", grp).otherwise(bad.cast("string")).alias("grp"), F.when(idx != "", idx.cast("int")).alias("idx"))


def read_arrays(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(model, file, row, v): the rows of .npy files, and of .npz files' `arr_0`, `features` or first array.

    Files are read where their tasks run, one file at a time; large arrays belong in several files.
    """
    import io

    import numpy as np
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if hasattr(x, "files"):
                    x = x[next((k for k in ("arr_0", "features") if k in x.files), x.files[0])]
                x = np.atleast_2d(np.asarray(x, dtype=np.float64))
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pd.DataFrame({"model": model, "file": name, "row": np.arange(at, at + len(part)), "v": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content")
    return files.mapInPandas(rows, "model string, file string, row long, v array<double>")


def read_shards(spark: SparkSession, path: str, failed: DataFrame | None = None) -> DataFrame:
    """(shard, member, meta, image): images of tar shards that have a .json beside them, without failed members."""
    import io
    import os
    import tarfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    files = {m.name: m for m in tar.getmembers() if m.isfile()}
                    stems = sorted(os.path.splitext(n)[0] for n in files if n.endswith(".jpg") and os.path.splitext(n)[0] + ".json" in files)
                    for s in stems:
                        yield pd.DataFrame({"shard": [name], "member": [s], "meta": [tar.extractfile(files[s + ".json"]).read().decode()], "image": [tar.extractfile(files[s + ".jpg"]).read()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("path", "content")
    out = files.mapInPandas(members, "shard string, member string, meta string, image binary")
    return out if failed is None else out.join(failed.select("member"), "member", "left_anti")


def window(features: DataFrame, offset: int = 0, limit: int | None = None, index: str = "global_idx") -> DataFrame:
    """Rows by global index: a predicate that prunes files, never an unordered limit."""
    x = features.where(F.col(index) >= offset)
    return x if limit is None else x.where(F.col(index) < offset + limit)
