"""Reliability, effect sizes, multiple comparisons and resampling over score tables."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import aggregate as A


def spearman_brown(r: Column) -> Column:
    return F.when(r != -1, 2 * r / (1 + r))


def split_half(values: DataFrame, unit: str, item: str, half: str, value: str) -> DataFrame:
    """(unit, r, ceiling): correlation of two halves over items and its Spearman-Brown step-up."""
    wide = values.groupBy(unit, item).agg(F.avg(F.when(F.col(half) == 0, F.col(value))).alias("a"), F.avg(F.when(F.col(half) == 1, F.col(value))).alias("b"))
    r = wide.groupBy(unit).agg(A.correlation(F.col("a"), F.col("b")).alias("r"))
    return r.withColumn("ceiling", spearman_brown(F.col("r")))


def between_subjects(values: DataFrame, subject: str, item: str, value: str) -> DataFrame:
    """(subject, upper, lower): correlation with the mean of all and of the other subjects."""
    w = Window.partitionBy(item)
    s, n = F.sum(value).over(w), F.count(value).over(w)
    x = values.withColumn("_all", s / n).withColumn("_rest", F.when(n > 1, (s - F.col(value)) / (n - 1)))
    return x.groupBy(subject).agg(A.correlation(F.col(value), F.col("_all")).alias("upper"), A.correlation(F.col(value), F.col("_rest")).alias("lower"))


def normalisations(score: Column, within: Column, low: Column, high: Column) -> list[Column]:
    """Raw score and three ceilings of it; a zero ceiling gives null."""
    return [
        score.alias("raw"), F.try_divide(score, F.when(within >= 0, F.sqrt(within))).alias("by_root"),
        F.try_divide(score, within).alias("by_within"), F.try_divide(score, (low + high) / 2).alias("by_between"),
    ]


def paired(a: Column, b: Column) -> list[Column]:
    """n, mean difference, paired t, standardised difference and drop in percent (aggregates)."""
    x = a - b
    sd = F.stddev_samp(x)
    n = F.count(x)
    return [
        n.alias("n"), F.avg(x).alias("mean_diff"), F.when(sd > 0, F.avg(x) / (sd / F.sqrt(n))).alias("t"),
        F.when(sd > 0, F.avg(x) / sd).alias("dz"), F.try_divide(100 * F.avg(-x), F.avg(b)).alias("pct_drop"),
    ]


def one_sample_t(x: Column, mu: float = 0.0) -> Column:
    sd = F.stddev_samp(x)
    return F.when(sd > 0, (F.avg(x) - mu) / (sd / F.sqrt(F.count(x))))


def pooled_d(x: Column, flag: Column, equal: bool = False) -> Column:
    """Cohen's d of flagged against other rows, with the pooled deviation; equal weighs both variances alike."""
    a, b = F.when(flag, x), F.when(~flag, x)
    na, nb = F.count(a), F.count(b)
    pooled = (F.var_samp(a) + F.var_samp(b)) / 2 if equal else ((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2)
    return F.when(pooled > 0, (F.avg(a) - F.avg(b)) / F.sqrt(pooled))


def levene(df: DataFrame, scope: list[str], group: str, value: str) -> DataFrame:
    """(scope, w, k, n): Levene's statistic about group medians."""
    med = df.groupBy(*scope, group).agg(F.median(value).alias("_med"))
    z = df.join(med, [*scope, group]).withColumn("_z", F.abs(F.col(value) - F.col("_med")))
    per = z.groupBy(*scope, group).agg(F.count("_z").alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_v"))
    w = Window.partitionBy(*scope)
    per = per.withColumn("_grand", F.sum(F.col("_n") * F.col("_m")).over(w) / F.sum("_n").over(w))
    total, k = F.sum("_n"), F.count(F.lit(1))
    between = F.sum(F.col("_n") * (F.col("_m") - F.col("_grand")) ** 2)
    stat = F.try_divide((total - k) * between, (k - 1) * F.sum(F.col("_n") * F.col("_v")))
    return per.groupBy(*scope).agg(stat.alias("w"), k.alias("k"), total.alias("n"))


def benjamini_hochberg(df: DataFrame, scope: list[str], p: str, tie: str) -> DataFrame:
    """df plus q: adjusted p-values within each scope (null p stays null and is not counted)."""
    known = df.where(F.col(p).isNotNull())
    part = Window.partitionBy(*scope)
    m, r = F.count(F.lit(1)).over(part), F.row_number().over(part.orderBy(p, tie))
    raw = known.withColumn("_r", r).withColumn("_raw", F.col(p) * m / F.col("_r"))
    q = F.least(F.lit(1.0), F.min("_raw").over(part.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)))
    done = raw.withColumn("q", q).drop("_r", "_raw")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def holm(df: DataFrame, scope: list[str], p: str, tie: str) -> DataFrame:
    """df plus p_holm; null and non-finite p are left out."""
    part = Window.partitionBy(*scope)
    m = F.count(F.lit(1)).over(part)
    known = df.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn("_r", F.row_number().over(part.orderBy(p, tie)))
    step = F.least((m - F.col("_r") + 1) * F.col(p), F.lit(1.0))
    run = part.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(run)).drop("_r", "_s")


def bh_rejected(df: DataFrame, scope: list[str], p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """df plus rejected: p-values up to the largest k with p(k) <= k * alpha / m."""
    part = Window.partitionBy(*scope)
    m = F.count(F.lit(1)).over(part)
    x = df.withColumn("_r", F.row_number().over(part.orderBy(p, tie)))
    x = x.withColumn("_k", F.when(F.col(p) <= F.col("_r") * alpha / m, F.col("_r")))
    return x.withColumn("rejected", F.col("_r") <= F.coalesce(F.max("_k").over(part), F.lit(0))).drop("_r", "_k")


def fisher_statistic(p: Column) -> Column:
    """-2 sum ln p of a group (aggregate); p-values are held at 1e-10 or more."""
    return -2 * F.sum(F.log(F.greatest(p, F.lit(1e-10))))


def empirical_p(random: Column, selected: Column) -> Column:
    """(number of random values <= the selected one + 1) / (n + 1) (aggregate)."""
    return (F.sum(F.when(random <= selected, 1).otherwise(0)) + 1) / (F.count(random) + 1)


def trapezoid_log10(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, auc): area under y over log10 x divided by the covered span (+ 1e-10)."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = df.withColumn("_lx", F.log10(x)).withColumn("_px", F.lag("_lx").over(w)).withColumn("_py", F.lag(y).over(w))
    area = F.sum((F.col("_lx") - F.col("_px")) * (F.col(y) + F.col("_py")) / 2)
    return step.groupBy(*keys).agg((area / (F.max("_lx") - F.min("_lx") + 1e-10)).alias("auc"))


def confusion(cube: DataFrame) -> DataFrame:
    """(model_i, model_j, n): how often row model_i of (sim, model_i, model_j, r) is largest at model_j; ties to the first name."""
    top = cube.groupBy("sim", "model_i").agg(F.min(F.struct((-F.col("r")).alias("x"), "model_j"))["model_j"].alias("model_j"))
    return top.groupBy("model_i", "model_j").agg(F.count("*").alias("n"))


def margins(cube: DataFrame) -> DataFrame:
    """(sim, model_i, model_j, margin): own score of a row minus its score for each other model."""
    own = cube.where("model_i = model_j").select("sim", "model_i", F.col("r").alias("own"))
    return cube.where("model_i <> model_j").join(own, ["sim", "model_i"]).select("sim", "model_i", "model_j", (F.col("own") - F.col("r")).alias("margin"))


def discriminability(margin: DataFrame) -> DataFrame:
    """(model_i, model_j): d', dominance and non-parametric error of the margins.

    A margin in (0, 1e-8] counts as a win and as a near tie (1.5), as dominance is defined.
    """
    m = F.col("margin")
    close = F.when(F.abs(m) <= 1e-8, 0.5).otherwise(0.0)
    return margin.groupBy("model_i", "model_j").agg(
        (F.avg(m) / (F.stddev_samp(m) + 1e-10)).alias("d_prime"), F.avg(F.when(m > 0, 1.0).otherwise(0.0) + close).alias("dominance"), F.avg(F.when(m < -1e-8, 1.0).otherwise(0.0) + close).alias("error")
    )


def normal_upper(z: Column) -> Column:
    """P(Z > z), by the rational approximation of the error function (error below 2e-7)."""
    from .resampling import _normal_two_sided

    half = _normal_two_sided(F.abs(z)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def multiclass_error(cube: DataFrame) -> DataFrame:
    """(model_i, error): how often another model scores higher than the true one, ties within 1e-8 by half."""
    own = F.max(F.when(F.col("model_i") == F.col("model_j"), F.col("r")))
    other = F.max(F.when(F.col("model_i") != F.col("model_j"), F.col("r")))
    per = cube.groupBy("sim", "model_i").agg((own - other).alias("m"))
    m = F.col("m")
    return per.groupBy("model_i").agg(F.avg(F.when(m < -1e-8, 1.0).when(F.abs(m) <= 1e-8, 0.5).otherwise(0.0)).alias("error"))


def index_table(spark: SparkSession, n: int, size: int, draws: int, seed: int = 0, replace: bool = True) -> DataFrame:
    """(draw, pos, idx): resampled positions of n units; draw k uses the generator seeded with seed + k.

    The table is made on the driver (draws * size rows, for small sets of units) so that draws do not
    depend on how data are partitioned.
    """
    rows = []
    for k in range(draws):
        idx = np.random.default_rng(seed + k).choice(n, size, replace=replace)
        rows += [(k, p, int(i)) for p, i in enumerate(idx if replace else np.sort(idx))]
    return spark.createDataFrame(rows, "draw int, pos int, idx int")


def subsets(spark: SparkSession, n: int) -> DataFrame:
    """(subset, idx): every non-empty subset of n units, as bit masks."""
    mask = F.explode(F.sequence(F.lit(1), F.lit(2**n - 1))).alias("subset")
    units = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")
    return spark.range(1).select(mask).select("subset", units).where(F.expr("shiftright(subset, idx) & 1") == 1)


def bootstrap_ci(units: DataFrame, unit: str, value: str, draws: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(mean, lo, hi): cluster bootstrap of the mean over units, by a join of their means with an index table."""
    per = units.groupBy(unit).agg(F.avg(value).alias("_m"))
    per = per.withColumn("idx", F.row_number().over(Window.orderBy(unit)) - 1)  # one row a unit
    n = per.count()
    draw = index_table(units.sparkSession, n, n, draws, seed).join(per, "idx").groupBy("draw").agg(F.avg("_m").alias("m"))
    a = (1 - level) / 2
    band = draw.agg(F.percentile("m", F.lit(a)).alias("lo"), F.percentile("m", F.lit(1 - a)).alias("hi"))
    return per.agg(F.avg("_m").alias("mean")).crossJoin(band)  # one row with one row


def permutation_p(scores: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """(observed, n, p): exact sign-flip test of the mean of a - b over all 2^n assignments (n up to 20 units)."""
    per = scores.groupBy(unit).agg(F.avg(F.col(a) - F.col(b)).alias("d")).collect()  # one row a unit
    d = [r["d"] for r in per if r["d"] is not None]
    if not 0 < len(d) <= 20:
        raise ValueError(f"{len(d)} units: exhaustive permutation takes 1 to 20")
    signs = np.array(list(itertools.product((1, -1), repeat=len(d))))
    means = signs @ np.array(d) / len(d)
    p = float((np.abs(means) >= abs(means[0]) - 1e-12).mean())
    return scores.sparkSession.createDataFrame([(float(means[0]), len(d), p)], "observed double, n int, p double")
