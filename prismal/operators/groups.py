"""What meets the rows of a group: one packed object a group, sent to every task while all are small, else cogrouped.

Objects are dicts of numpy arrays, pickled in a binary column `data` beside `grp`. Rows of a group never have to
lie in one task: beyond the broadcast they are dealt over as many salts as their number asks for, and the object is
copied once for each.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of all objects together that are sent to every task, and of the rows that meet one object in a task.
BROADCAST_BYTES, ROWS_BYTES = 64 << 20, 64 << 20
PACKED = "grp long, data binary"


def matrix(column) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def arrays(x: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays."""
    x = np.ascontiguousarray(x, dtype=float)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def pack(grp: list, objects: list[dict]) -> pa.Table:
    return pa.table({"grp": pa.array(grp, pa.int64()), "data": pa.array([pickle.dumps(o) for o in objects], pa.binary())})


def parts(table: pa.Table | pa.RecordBatch, key: str = "grp") -> Iterator[tuple[int, pa.Table]]:
    """The rows of each group of a batch."""
    value, inverse = np.unique(table.column(key).to_numpy(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    cuts = np.searchsorted(inverse[order], np.arange(len(value) + 1))
    for k, v in enumerate(value.tolist()):
        yield v, table.take(pa.array(order[cuts[k] : cuts[k + 1]]))


def arrow_schema(kinds: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(kinds))


def cogrouped(left: DataFrame, right: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(left rows, right rows) for each key; groups that lack either side give nothing. The sides may share their origin."""
    kinds = arrow_schema(schema)
    apart = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kinds.empty_table()
        return run(a, b.rename_columns([c.removeprefix("_r_") for c in b.column_names])).cast(kinds)

    return left.groupBy(*keys).cogroup(apart.groupBy(*[f"_r_{k}" for k in keys])).applyInArrow(both, schema)


def number(rows: DataFrame) -> int:
    """Groups of a table; ask for it where the table is cheap to read."""
    return rows.select("grp").distinct().count()


def meet(rows: DataFrame, packed: DataFrame, run: Callable[[int, pa.Table, dict], Iterator[pa.Table]], schema: str, total_bytes: int, key: str = "image_id", limit: int | None = None) -> DataFrame:
    """run(grp, rows, object) over all rows of groups that have an object, in bounded pieces.

    total_bytes: about the size of all objects together, which tells whether they are sent or cogrouped.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    if total_bytes <= limit:
        sent = rows.sparkSession.sparkContext.broadcast({r["grp"]: bytes(r["data"]) for r in packed.collect()})

        def each(batches):
            last, held = None, None
            for batch in batches:
                for grp, part in parts(batch):
                    if grp not in sent.value:
                        continue
                    if grp != last:
                        last, held = grp, pickle.loads(sent.value[grp])
                    for out in run(grp, pa.table(part), held):
                        yield from out.to_batches()

        return rows.mapInArrow(each, schema)
    one = rows.first()
    width = sum(8 * len(v) for v in one if isinstance(v, (list, tuple))) + 64 if one else 64
    salts = rows.groupBy("grp").agg(F.ceil(F.count("*") * width / F.lit(ROWS_BYTES)).cast("int").alias("_salts"))
    left = rows.join(salts, "grp").withColumn("_salt", F.pmod(F.hash(key), F.col("_salts"))).drop("_salts")
    right = packed.join(salts, "grp").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    def together(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.concat_tables(run(a.column("grp")[0].as_py(), a.drop_columns(["_salt"]), pickle.loads(b.column("data")[0].as_py())))

    return cogrouped(left, right, ["grp", "_salt"], together, schema)


def summed(rows: DataFrame, of: Callable[[pa.Table], np.ndarray], name: str = "v") -> DataFrame:
    """(grp, i, n, v ARRAY): by group the sum of the matrices that `of` makes of its rows, a row of it each; n counts rows.

    Each task adds up what it reads and gives one matrix a group; the rows of these are added by number.
    """
    schema = f"grp long, i int, n long, {name} array<double>"
    held_bytes = ROWS_BYTES

    def partial(batches):
        held: dict[int, list] = {}

        def out():
            for grp, (n, m) in held.items():
                at = max(1, (4 << 20) // (8 * m.shape[1] or 1))
                for k in range(0, len(m), at):
                    part = m[k : k + at]
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * len(part), pa.int64()), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array([n] * len(part), pa.int64()), arrays(part)], ["grp", "i", "n", name])
            held.clear()

        for batch in batches:
            for grp, part in parts(batch):
                m = of(pa.table(part))
                n, before = held.get(grp, (0, 0.0))
                held[grp] = (n + part.num_rows, before + m)
            if sum(m.nbytes for _, m in held.values()) > held_bytes and len(held) > 1:
                yield from out()
        yield from out()

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"grp": t.column("grp").slice(0, 1), "i": t.column("i").slice(0, 1), "n": pa.array([sum(t.column("n").to_pylist())]), name: arrays(matrix(t.column(name)).sum(axis=0, keepdims=True))})

    return rows.mapInArrow(partial, schema).groupBy("grp", "i").applyInArrow(add, schema)


def stacked(sums: pa.Table, name: str = "v") -> tuple[int, np.ndarray]:
    """n and the matrix of one group's rows of `summed`."""
    order = np.argsort(sums.column("i").to_numpy())
    return int(sums.column("n")[0].as_py()), matrix(sums.column(name))[order]
