"""Relational operators over long score tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F


def attach(left: DataFrame, right: DataFrame, on: list[str], default: dict[str, object] | None = None) -> DataFrame:
    """Left join that keeps every left row; `default` fills columns that found no partner."""
    out = left.join(right, on, "left")
    return out.fillna(default) if default else out


def common_mean(a: DataFrame, b: DataFrame, keys: list[str], group: list[str], value: str, least: int = 2) -> DataFrame:
    """Means of both sides over the keys they share in each group, where there are at least `least`."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    out = both.groupBy(*group).agg(F.count("*").alias("n_common"), F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"))
    return out.where(F.col("n_common") >= least)


def self_pairs(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """(group, key_a, key_b, a, b): unordered pairs of a group's rows, by an equi-join on the group."""
    a = df.select(*group, F.col(key).alias("key_a"), F.col(value).alias("a"))
    b = df.select(*group, F.col(key).alias("key_b"), F.col(value).alias("b"))
    return a.join(b, group).where(F.col("key_a") < F.col("key_b"))


def pick(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", k: int | None = None) -> DataFrame:
    """The first k rows of each group in a total order; Spark prunes to k before the shuffle."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in an explicit order."""
    return pick(df, keys, order, "_r", 1).drop("_r")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty for a valid table."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"repeated key: {bad[0].asDict()}")
    return df


def two_stage_mean(df: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over `outer` of the means over `inner` (which contains outer), with its error and count."""
    first = df.groupBy(*inner).agg(F.avg(value).alias("_m"))
    return first.groupBy(*outer).agg(F.avg("_m").alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count("_m"))).alias("sem"), F.count("_m").alias("n"))


def leave_one_out(df: DataFrame, group: list[str], unit: str, value: str) -> DataFrame:
    """Mean of a group without each of its units, from sums by unit: no cross join with the rows."""
    per = df.groupBy(*group, unit).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*group)
    s, n = F.sum("_s").over(w) - F.col("_s"), F.sum("_n").over(w) - F.col("_n")
    return per.select(*group, F.col(unit).alias("left_out"), F.when(n > 0, s / n).alias("mean_rest"))


def prevalence_shift(df: DataFrame, token: str, flag: str, least: int = 3, least_base: int = 6) -> DataFrame:
    """Share of rows with each token among flagged and other rows, and their difference."""
    totals = df.groupBy(flag).agg(F.countDistinct("row").alias("_total"))
    counts = df.groupBy(flag, token).agg(F.countDistinct("row").alias("_n"))
    share = counts.join(F.broadcast(totals), flag)  # one row for each value of the flag
    a = share.where(F.col(flag) == 1).select(token, F.col("_n").alias("n_a"), (F.col("_n") / F.col("_total")).alias("share_a"))
    b = share.where(F.col(flag) == 0).select(token, F.col("_n").alias("n_b"), (F.col("_n") / F.col("_total")).alias("share_b"))
    out = a.join(b, token, "full").fillna(0)
    return out.where((F.col("n_a") >= least) | (F.col("n_b") >= least_base)).withColumn("shift", F.col("share_a") - F.col("share_b"))


def average_rank(order: Column, group: list[Column]) -> Column:
    """1-based rank; ties share the mean of their ranks."""
    ties = Window.partitionBy(*group, order)
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts by bin; the last bin includes its upper end, values outside are left out."""
    x = F.col(value)
    k = F.least(F.floor((x - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(x.between(lo, hi)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a frame lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assignments(spark, sets: int, units: int) -> DataFrame:
    """(assignment, unit, set): all sets ** units ways to give each unit a set, from the digits of the assignment's number."""
    unit = F.explode(F.sequence(F.lit(0), F.lit(units - 1)).cast("array<long>")).alias("unit")
    digits = spark.range(sets**units).select(F.col("id").alias("assignment"), unit)
    return digits.withColumn("set", F.floor(F.col("assignment") / F.pow(F.lit(float(sets)), F.col("unit"))).cast("long") % sets)


def weighted_share(df: DataFrame, keys: list[str], share: str, n: str) -> DataFrame:
    """(keys, n, mean, sem) of shares by subset, weighed by their units; with one subset the error is that of a share of n units."""
    p, w = F.col(share), F.col(n)
    per = df.groupBy(*keys).agg(F.sum(w).alias("n"), F.try_divide(F.sum(p * w), F.sum(w)).alias("mean"), F.count(p).alias("_k"), (F.stddev_samp(p) / F.sqrt(F.count(p))).alias("_s"))
    alone = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    return per.select(*keys, "n", "mean", F.when(F.col("_k") > 1, F.col("_s")).otherwise(alone).alias("sem"))


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of all numeric columns by key; other columns are left out."""
    columns = [c for c, t in df.dtypes if t.split("(")[0] in _NUMERIC and c not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def histogram_entropy(df: DataFrame, keys: list[str], value: str, bins: int = 50, floor: float = 1e-10) -> DataFrame:
    """(keys, n, entropy): entropy of a density histogram between each group's least and largest value.

    Every bin's density is raised by `floor` and the densities are scaled to add up to one; empty bins count by
    their number, without rows of their own.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("n"))
    x = df.join(ends, keys).where(F.col("_hi") > F.col("_lo"))
    k = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    counts = x.groupBy(*keys, "_lo", "_hi", "n", k.alias("_bin")).agg(F.count("*").alias("_c"))
    scale = bins / (F.col("_hi") - F.col("_lo"))
    p, q = (F.col("_c") / F.col("n") * scale + floor) / (scale + bins * floor), floor / (scale + bins * floor)
    entropy = -F.sum(p * F.log(p)) - (bins - F.count(F.lit(1))) * F.max(q * F.log(q))
    return counts.groupBy(*keys, "n").agg(entropy.alias("entropy"))


def draw_key(seed: object, *parts) -> Column:
    """A text that orders rows at random, the same on every engine and for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def random_split(df: DataFrame, group: list[str], key: str, share: float, seed: int = 0) -> DataFrame:
    """df plus train: round(n * share) rows of each group, drawn by a hash of the key."""
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(draw_key(seed, F.col(key)), key))
    return df.withColumn("train", rank <= F.round(F.count(F.lit(1)).over(w) * share))


def pair_summaries(df: DataFrame, group: list[str], key: str, columns: list[str]) -> DataFrame:
    """(group, key_a, key_b, and for each column its absolute difference, mean and larger value) of unordered pairs."""
    a = df.select(*group, F.col(key).alias("key_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = df.select(*group, F.col(key).alias("key_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    out = []
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        out += [F.abs(x - y).alias(f"{c}_absdiff"), ((x + y) / 2).alias(f"{c}_mean"), F.greatest(x, y).alias(f"{c}_max")]
    return a.join(b, group).where("key_a < key_b").select(*group, "key_a", "key_b", *out)


def correlation_matrix(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, col_a, col_b, pearson, spearman) for each pair of columns, from one aggregation of values and ranks."""
    from ..functions.aggregate import correlation

    ranked = df.select(*group, *columns, *[average_rank(F.col(c), [F.col(g) for g in group]).alias(f"_r_{c}") for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), correlation(F.col(a), F.col(b)).alias("pearson"), correlation(F.col(f"_r_{a}"), F.col(f"_r_{b}")).alias("spearman")) for a, b in pairs]
    return ranked.groupBy(*group).agg(F.array(*cells).alias("_c")).select(*group, F.explode("_c").alias("_c")).select(*group, "_c.*")


def greedy_matches(targets: DataFrame, pool: DataFrame, group: list[str], key: str, covariates: list[str]) -> DataFrame:
    """(group, key, match, distance): one-to-one matches on z-scored covariates, within each group.

    Targets are taken in ascending order of their nearest distance (then key); each takes the nearest unused row
    of the pool (then key). The choice is sequential, so a group is one task: groups must be matching strata.
    """
    both = targets.select(*group, key, *covariates).withColumn("_t", F.lit(True)).unionByName(pool.select(*group, key, *covariates).withColumn("_t", F.lit(False)))
    kinds = dict(both.dtypes)
    schema = ", ".join([f"{g} {kinds[g]}" for g in group] + [f"{key} {kinds[key]}", f"match {kinds[key]}", "distance double"])

    return both.groupBy(*group).applyInPandas(lambda pdf: matched(pdf, group, key, covariates), schema)


def matched(pdf, group: list[str], key: str, covariates: list[str]):
    """The matches of one group, a pandas frame of targets (_t) and pool; in memory linear in its rows."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values(key, kind="stable")
    x = pdf[covariates].to_numpy(dtype=float)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    own, other = np.flatnonzero(pdf["_t"].to_numpy()), np.flatnonzero(~pdf["_t"].to_numpy())
    rows, used = [], np.zeros(len(other), bool)
    if not len(other):
        return pd.DataFrame(rows, columns=[*group, key, "match", "distance"])

    there = [np.ascontiguousarray(x) for x in z[other].T]

    def distances(i):  # of one target: all of them together would be targets times pool
        return np.sqrt(sum((x - x0) ** 2 for x, x0 in zip(there, z[own[i]])))

    names, keys = pdf[group].iloc[0].tolist(), pdf[key].tolist()
    for i in np.argsort([distances(i).min() for i in range(len(own))], kind="stable"):
        d = distances(i)
        j = int(np.where(used, np.inf, d).argmin())
        if not used[j] and np.isfinite(d[j]):
            used[j] = True
            rows.append([*names, keys[own[i]], keys[other[j]], float(d[j])])
    return pd.DataFrame(rows, columns=[*group, key, "match", "distance"])


def capped_appearances(pairs: DataFrame, group: list[str], a: str, b: str, order: list[str], most: int) -> DataFrame:
    """Pairs kept in order while neither side has been kept `most` times; sequential within a group, which is one task."""
    import pandas as pd

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, seen, kept = pdf.sort_values(order, kind="stable"), {}, []
        for x, y in zip(pdf[a], pdf[b]):
            ok = seen.get(x, 0) < most and seen.get(y, 0) < most
            kept.append(ok)
            if ok:
                seen[x], seen[y] = seen.get(x, 0) + 1, seen.get(y, 0) + 1
        return pdf[kept]

    return pairs.groupBy(*group).applyInPandas(keep, pairs.schema)


def nearest_to(df: DataFrame, group: list[str], key: str, value: str, k: int) -> DataFrame:
    """(group, subset, key): the k rows at the bottom, in the middle, at the top and nearest to the mean of each group."""
    w = Window.partitionBy(*group)
    n, up = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(value, key))
    gap = F.abs(F.col(value) - F.avg(value).over(w))
    x = df.select(*group, key, n.alias("_n"), up.alias("_r"), gap.alias("_gap"))
    x = x.withColumn("_g", F.row_number().over(w.orderBy(F.round("_gap", 9), key)))
    lo = F.floor((F.col("_n") - k) / 2)
    named = {"bottom": F.col("_r") <= k, "middle": (F.col("_r") > lo) & (F.col("_r") <= lo + k), "top": F.col("_r") > F.col("_n") - k, "mean": F.col("_g") <= k}
    kinds = F.filter(F.array(*[F.when(c, name) for name, c in named.items()]), lambda s: s.isNotNull())
    return x.select(*group, F.explode(kinds).alias("subset"), key)
