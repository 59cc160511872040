"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import checkpointed

#: Links that one task takes; short lists of links are not dealt over all shuffle partitions.
TASK_LINKS = 200_000
#: Tasks that the links of one node are dealt over.
SALTS = 32


def _tasks(links: int) -> int:
    return max(1, -(-links // TASK_LINKS))


def _with_least(edges: DataFrame, links: int) -> DataFrame:
    """edges plus m, the least v of u.

    As many links as a task takes are one partition, whose minima need neither a shuffle nor a join. Where there are more,
    so that one node may have too many, minima are taken by node and salt first, and the links of a node are dealt over
    SALTS tasks.
    """
    if links <= TASK_LINKS:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "_salt").agg(F.min("v").alias("_p"))
    least = parts.groupBy("u").agg(F.min("_p").alias("m"))
    known = parts.select("u", "_salt").join(least, "u")
    return salted.join(known, ["u", "_salt"]).drop("_salt")


def _listed(edges: DataFrame, *links: Column) -> DataFrame:
    """(u, v) of these structs of every row; edges is read once, where a union reads it for each."""
    return edges.select(F.explode(F.array(*links)).alias("_e")).select("_e.u", "_e.v")


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Each node's larger neighbours move to the least of its neighbourhood."""
    both = _listed(edges, F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * links).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them; links may repeat."""
    known = _with_least(edges, links)
    moved = F.when(F.col("v") != F.col("m"), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return _listed(known, moved, F.struct("u", F.col("m").alias("v"))).where("u IS NOT NULL")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its least node.

    Links may repeat, run either way or link a node with itself; nulls are dropped. Every step takes
    minima by node and joins them back to the links; where there are more of them than TASK_LINKS, by node and a
    salt of the other end, so the links of one node lie in up to SALTS tasks. The number of rounds grows with the
    logarithm of the longest path.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    alone = pairs.where("a = b").select(F.col("a").alias("node"))
    edges = checkpointed(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        n = _tasks(before[0])
        large = _large_star(edges.coalesce(n), before[0]).coalesce(n).distinct().coalesce(n)
        edges = checkpointed(_small_star(large, before[0]).coalesce(n).distinct().coalesce(n))
        after = _state(edges)
        if after == before:
            break
        before = after
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    single = alone.select("node", F.col("node").alias("component"))
    return member.unionAll(root.distinct()).unionAll(single).groupBy("node").agg(F.min("component").alias("component"))
