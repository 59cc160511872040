"""Aggregate expressions with the guards that score tables need (nulls skipped, constants not divided by)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sem(x: Column) -> Column:
    """Standard error from the sample deviation of the non-null values."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def sem_all(x: Column) -> Column:
    """Standard error that divides by the number of rows, nulls included."""
    return F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))


def coefficient_of_variation(x: Column) -> Column:
    return F.when(F.avg(x) > 0, F.stddev_samp(x) / F.avg(x))


def iqr(x: Column) -> Column:
    """Distance of the exact quartiles, linear between order statistics."""
    return F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation from sums over pairs; null where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sxy = F.covar_pop(x, y)
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, sxy / F.sqrt(spread))


def mean_pair_distance(x: Column) -> Column:
    """Mean |xi - xj| over unordered pairs from the sorted values: no self-join.

    In ascending order the k-th value (from 0) counts 2k - (n - 1) times.
    """
    values = F.array_sort(F.collect_list(x))
    n = F.size(values)
    total = F.aggregate(F.transform(values, lambda v, k: v * (2 * k - n + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(n > 1, total / (n * (n - 1) / 2))
