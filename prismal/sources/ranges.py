"""Large array and tar files as Spark data sources whose partitions are ranges of rows or members.

`register(spark)` makes the formats `array_ranges` and `shard_ranges` known; the functions below do so themselves.
Files are opened where their tasks run, by the file systems that pyarrow knows (local and mounted folders, HDFS, object
stores), and no task holds more than a batch of rows or one member. On file systems that only Spark can reach
`readers.read_arrays` and `readers.read_shards` read whole files.
"""

from __future__ import annotations

import math
import os
import struct
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file for each partition, and of rows for each batch.
RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
#: Arrays of an archive that are taken first.
PREFERRED = ("arr_0", "features")


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(file, bytes) of a file, or of all files below a folder that end so, by name."""
    from pyarrow import fs

    system, inner = _located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else [info]
    start = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((start + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(endings))


def _open(path: str):
    system, inner = _located(path)
    return system.open_input_file(inner)


class Layout:
    """Where an array's numbers are: type, shape (rows, columns), order, and the offset of the first; -1 if compressed."""

    def __init__(self, file):
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, self.by_column, self.dtype = read(file)
        if self.dtype.kind not in "fiub":
            raise ValueError(f"numbers are read, not {self.dtype}")
        if len(shape) > 2:
            raise ValueError(f"arrays of two dimensions at most are read, not of shape {shape}")
        self.rows, self.columns = (1, math.prod(shape)) if len(shape) < 2 else shape
        self.offset = file.tell()

    @property
    def row_bytes(self) -> int:
        return max(1, self.columns * self.dtype.itemsize)


def _member(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    names = {os.path.splitext(i.filename)[0]: i for i in archive.infolist()}
    return next((names[k] for k in PREFERRED if k in names), archive.infolist()[0])


def _layout(path: str) -> Layout:
    with _open(path) as file:
        if path.endswith(".npy"):
            return Layout(file)
        with zipfile.ZipFile(file) as archive:
            info = _member(archive)
            if info.compress_type != zipfile.ZIP_STORED:
                with archive.open(info) as inner:
                    found = Layout(inner)
                found.offset = -1
                return found
        file.seek(info.header_offset + 26)  # the lengths of name and extra field stand there in a local header
        file.seek(info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4))))
        return Layout(file)


def _stored(path: str, layout: Layout, lo: int, hi: int):
    """(first row, rows) by batches, of the rows lo to hi of an array that is not compressed."""
    step = max(1, BATCH_BYTES // layout.row_bytes)
    size = layout.dtype.itemsize
    with _open(path) as file:
        for at in range(lo, hi, step):
            n = min(step, hi - at)
            if layout.by_column:
                x = np.empty((n, layout.columns), layout.dtype)
                for c in range(layout.columns):
                    file.seek(layout.offset + (c * layout.rows + at) * size)
                    x[:, c] = np.frombuffer(file.read(n * size), layout.dtype)
            else:
                file.seek(layout.offset + at * layout.columns * size)
                x = np.frombuffer(file.read(n * layout.columns * size), layout.dtype).reshape(n, layout.columns)
            yield at, x


def _compressed(path: str, layout: Layout):
    """As _stored, from the start on: a compressed array cannot be entered in its middle."""
    with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(_member(archive)) as inner:
        if layout.by_column:
            yield 0, np.lib.format.read_array(inner, allow_pickle=False)
            return
        Layout(inner)
        step = max(1, BATCH_BYTES // layout.row_bytes)
        for at in range(0, layout.rows, step):
            n = min(step, layout.rows - at)
            yield at, np.frombuffer(inner.read(n * layout.columns * layout.dtype.itemsize), layout.dtype).reshape(n, layout.columns)


class Rows(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, model: str, range_bytes: int):
        self.path, self.model, self.range_bytes = path, model, range_bytes

    def partitions(self):
        """Ranges of rows; only the heads of the files are read for it."""
        out = []
        for path, _ in _files(self.path, (".npy", ".npz")):
            layout = _layout(path)
            step = max(1, self.range_bytes // layout.row_bytes) if layout.offset >= 0 else max(1, layout.rows)
            out += [Rows(path, lo, min(lo + step, layout.rows)) for lo in range(0, layout.rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, part):
        if part.hi > part.lo:
            layout = _layout(part.path)
            for at, x in _compressed(part.path, layout) if layout.offset < 0 else _stored(part.path, layout, part.lo, part.hi):
                n = len(x)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * layout.columns)
                values = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x, np.float64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([self.model] * n, pa.string()), pa.array([part.path] * n, pa.string()), pa.array(np.arange(at, at + n, dtype=np.int64)), values], ["model", "file", "row", "v"])


class ArrayRanges(DataSource):
    """(model, file, row, v): the rows of .npy files, and of .npz files' `arr_0`, `features` or first array."""

    @classmethod
    def name(cls):
        return "array_ranges"

    def schema(self):
        return "model string, file string, row long, v array<double>"

    def reader(self, schema):
        return ArrayReader(self.options["path"], self.options.get("model", ""), int(self.options.get("rangeBytes", RANGE_BYTES)))


class ShardReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        """Ranges of bytes; no file is opened for it."""
        out = [Rows(path, lo, min(lo + self.range_bytes, size)) for path, size in _files(self.path, (".tar",)) for lo in range(0, size, self.range_bytes)]
        return out or [Rows("", 0, 0)]

    def read(self, part):
        """The images that begin in the range. The heads of all members are walked, since the .json beside an image may be anywhere."""
        if part.hi > part.lo:
            with _open(part.path) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                files = {m.name: m for m in tar if m.isfile()}
                for name, m in files.items():
                    stem, ending = os.path.splitext(name)
                    if ending == ".jpg" and part.lo <= m.offset < part.hi and stem + ".json" in files:
                        yield part.path, stem, tar.extractfile(files[stem + ".json"]).read().decode(), tar.extractfile(m).read()


class ShardRanges(DataSource):
    """(shard, member, meta, image): images of tar shards that have a .json beside them."""

    @classmethod
    def name(cls):
        return "shard_ranges"

    def schema(self):
        return "shard string, member string, meta string, image binary"

    def reader(self, schema):
        return ShardReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    for source in (ArrayRanges, ShardRanges):
        spark.dataSource.register(source)


def read_arrays(spark: SparkSession, path: str, model: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(model, file, row, v) of the arrays of a file or below a folder, by ranges of rows.

    Arrays of fewer than two dimensions are one row. A compressed array is read by one task in batches of rows, or whole
    if it is stored by columns; other types than numbers and more than two dimensions are errors.
    """
    register(spark)
    return spark.read.format("array_ranges").option("model", model).option("rangeBytes", range_bytes).load(path)


def read_shards(spark: SparkSession, path: str, failed: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(shard, member, meta, image) of a tar file or of those below a folder, by ranges of members, without failed members."""
    register(spark)
    out = spark.read.format("shard_ranges").option("rangeBytes", range_bytes).load(path)
    return out if failed is None else out.join(failed.select("member"), "member", "left_anti")
