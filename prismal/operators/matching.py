"""Deterministic subsets of a pool whose values match those of a target set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Targets of one group; what one task holds follows from their number alone, whatever the pool.
MOST_TARGETS = 2048
#: Tasks in which the survivors of all tasks meet before they meet in one.
MIDDLE_TASKS = 32


def nearest_unused(targets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each target, in this order, the place in values (ascending) of the nearest one that no earlier target took; -1 where none is left.

    Of two equally near ones the first in values is taken. Unused places are found through links that skip the used ones.
    """
    n = len(values)
    up, down = np.arange(n + 1), np.arange(n + 1)  # next unused at or after k; at or before k - 1, as k

    def find(link: np.ndarray, k: int) -> int:
        root = k
        while link[root] != root:
            root = link[root]
        while link[k] != root:
            link[k], k = root, link[k]
        return root

    out = np.full(len(targets), -1, np.int64)
    for t, x in enumerate(targets.tolist()):
        at = int(np.searchsorted(values, x, "left"))
        right, left = find(up, at), find(down, at) - 1
        if right >= n and left < 0:
            break
        if left < 0 or (right < n and values[right] - x < x - values[left]):
            k = right
        else:
            k = left
            if right < n and values[right] - x == x - values[left]:
                k = min(left, right)
            first = int(np.searchsorted(values, values[k], "left"))  # the first unused one of equal values
            k = min(k, find(up, first))
        out[t] = k
        up[k], down[k + 1] = k + 1, k
    return out


def _close(values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Places (in values, ascending) of the len(targets) values on either side of each target: no other can be taken.

    Of equal values the first ones are taken first, so as many of each are enough, and a side begins with the first of them.
    """
    k = len(targets)
    few = np.flatnonzero(np.arange(len(values)) - np.searchsorted(values, values, "left") < k)
    thin = values[few]
    low = np.maximum(np.searchsorted(thin, targets, "left") - k, 0)
    low = np.searchsorted(thin, thin[np.minimum(low, len(thin) - 1)], "left") if len(thin) else low
    edge = np.zeros(len(thin) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, np.minimum(np.searchsorted(thin, targets, "right") + k, len(thin)), -1)
    return few[np.cumsum(edge[:-1]) > 0]


def distribution_match(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """(grp, rank, target, image_id, value): each target, from the smallest on, with the nearest image not yet taken.

    pool: (grp, image_id, value), targets: (grp, value), null and NaN left out. Ties go to the smaller value, then the smaller
    id; targets that find none are left out. k targets take nobody beyond the k nearest values on either side of one of
    them, so each task sends on only these from what it has read, in two steps, and the order of taking is followed over them
    in one task a group: its size follows from the number of targets, not from the pool.
    """
    wanted = targets.where("value IS NOT NULL AND NOT isnan(value)").groupBy("grp").agg(F.array_sort(F.collect_list("value")).alias("t"))
    most = targets.groupBy("grp").count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > MOST_TARGETS:
        raise ValueError(f"{most} targets in a group; {MOST_TARGETS} at most")
    rows = pool.select("grp", "image_id", F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)").join(wanted, "grp")
    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)

    def sift(batches):
        held: dict = {}

        def close(grp):
            tables, t = held[grp]
            table = pa.Table.from_batches(tables).sort_by([("value", "ascending"), ("image_id", "ascending")])
            return table.take(pa.array(_close(table.column("value").to_numpy(), t)))

        for batch in batches:
            codes = batch.column("grp").dictionary_encode()
            for code, grp in enumerate(codes.dictionary.to_pylist()):
                part = batch.filter(pc.equal(codes.indices, code))
                if grp not in held:
                    held[grp] = ([], np.array(part.column("t")[0].as_py(), dtype=float))
                tables, t = held[grp]
                tables.append(part)
                if sum(map(len, tables)) > 4 * len(t) * len(t) + 100_000:
                    held[grp] = (close(grp).to_batches(), t)
        for grp in held:
            yield from close(grp).to_batches()

    near = rows.mapInArrow(sift, kinds)
    near = near.repartition(MIDDLE_TASKS, "grp", F.pmod(F.hash("image_id"), F.lit(MIDDLE_TASKS))).mapInArrow(sift, kinds)

    def take(table: pa.Table) -> pa.Table:
        table = table.sort_by([("value", "ascending"), ("image_id", "ascending")])
        t = np.array(table.column("t")[0].as_py(), dtype=float)
        got = nearest_unused(t, table.column("value").to_numpy())
        some = np.flatnonzero(got >= 0)
        chosen = table.take(pa.array(got[some]))
        return pa.table({"grp": chosen.column("grp"), "rank": pa.array(some + 1), "target": pa.array(t[some]), "image_id": chosen.column("image_id"), "value": chosen.column("value")})

    types = dict(rows.dtypes)
    return near.groupBy("grp").applyInArrow(take, f"grp {types['grp']}, rank long, target double, image_id {types['image_id']}, value double")
