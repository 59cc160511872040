"""How much a set of images sets models apart: utilities, noise and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels

WITHIN = ("mean", "min", "smooth_min")
_EPS = 1e-8


def _variances(profile: DataFrame) -> DataFrame:
    """(grp, model, var) of profiles of distances, or of cells.profiles, which has them already."""
    return profile.select("grp", "model", "var") if "var" in profile.columns else profile.groupBy("grp", "model").agg(F.var_pop("d").alias("var"))


def attenuated(agreements: DataFrame, profile: DataFrame, noise: float | DataFrame) -> DataFrame:
    """Expected correlation under measurement noise: r * sqrt(var / (var + noise + eps)) by the row's model."""
    var = _variances(profile)
    x = kernels.symmetric(agreements).join(var, ["grp", "model"])
    x = x.withColumn("noise", F.lit(float(noise))) if not isinstance(noise, DataFrame) else x.join(noise, ["grp", "model"])
    return x.select("grp", "model", "other", (F.col("r") * F.sqrt(F.col("var") / (F.col("var") + F.col("noise") + _EPS))).alias("r"))


def attenuated_levels(agreements: DataFrame, profile: DataFrame, levels: list[float]) -> DataFrame:
    """(grp, model, other, noise, r) for each noise variance: one row of agreements is met by all levels, a short list."""
    var = _variances(profile)
    x = kernels.symmetric(agreements).join(var, ["grp", "model"]).withColumn("noise", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return x.select("grp", "model", "other", "noise", (F.col("r") * F.sqrt(F.col("var") / (F.col("var") + F.col("noise") + _EPS))).alias("r"))


def smooth_min(x: Column, beta: float = 10.0) -> Column:
    """-log(sum(exp(-beta x))) / beta of a group, shifted by its minimum (so no term overflows)."""
    values = F.collect_list(x)  # one value a model
    least = F.array_min(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(-beta * (v - least)))
    return least - F.log(total) / beta


def fold(x: Column, how: str, beta: float = 10.0) -> Column:
    if how not in WITHIN:
        raise ValueError(f"aggregate: {how}")
    return {"mean": F.avg, "min": F.min}[how](x) if how != "smooth_min" else smooth_min(x, beta)


def within_utility(scores: DataFrame, how: str = "mean", self_score: float = 1.0) -> DataFrame:
    """(grp, model, utility): own score minus the folded scores of the other models.

    how="min" subtracts the least similar other model, as the definition says.
    """
    return scores.groupBy("grp", "model").agg((F.lit(self_score) - fold(F.col("r"), how)).alias("utility"))


def across_models(utilities: DataFrame, how: str = "mean", beta: float = 10.0) -> DataFrame:
    return utilities.groupBy("grp").agg(fold(F.col("utility"), how, beta).alias("utility"))


def normalised(x: Column, how: str, *group: str) -> Column:
    """Track scores over the pool: none, z (population deviation + 1e-6) or minmax (+ 1e-6)."""
    w = Window.partitionBy(*group)
    if how == "none":
        return x
    if how == "z":
        return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-6)
    if how == "minmax":
        return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-6)
    raise ValueError(f"normalisation: {how}")


def noise_variance(profile: DataFrame, ceiling: float) -> DataFrame:
    """(grp, noise): mean sample variance of the profiles * (1 / ceiling^2 - 1); 0 from a ceiling of 1; tiny variances give 0.01."""
    if "var" in profile.columns:  # of cells.profiles
        own = profile.select("grp", F.try_divide(F.col("var") * F.col("n"), F.col("n") - 1).alias("v"))
    else:
        own = profile.groupBy("grp", "model").agg(F.var_samp("d").alias("v"))
    var = own.groupBy("grp").agg(F.avg("v").alias("v"))
    noise = F.lit(0.0) if ceiling >= 1 else F.when(F.col("v") < 1e-10, 0.01).otherwise(F.col("v") * (1 / ceiling**2 - 1))
    return var.select("grp", noise.alias("noise"))


def reliability(multiplier: Column, ceiling: float, both_noisy: bool = False) -> Column:
    """Reliability of profiles whose noise is scaled by a multiplier."""
    if both_noisy:
        return 1 / (1 + multiplier * multiplier * (1 / ceiling - 1))
    return 1 / F.sqrt(1 + multiplier * multiplier * (1 / ceiling**2 - 1))


def group_margin(scores: DataFrame) -> DataFrame:
    """(grp, model, margin): diagonal minus the largest other score; masked entries count as 0, so the subtrahend is never negative."""
    own = F.max(F.when(F.col("model") == F.col("other"), F.col("r")))
    other = F.greatest(F.lit(0.0), F.max(F.when(F.col("model") != F.col("other"), F.col("r"))))
    return scores.groupBy("grp", "model").agg((own - other).alias("margin"))


def track_aggregate(tracks: DataFrame, how: str, weights: dict[str, float] | None = None, power: float = 2.0) -> DataFrame:
    """(candidate, score) from (track, candidate, score).

    A track without a weight weighs 0 in weighted_mean and 1 in power_mean; identity accepts one track only.
    """
    s = F.col("score")
    named = F.create_map(*[F.lit(x) for kv in (weights or {}).items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    by = tracks.groupBy("candidate")
    if how == "identity":
        one = F.when(F.count_distinct("track") <= 1, F.max(s)).otherwise(F.raise_error(F.lit("identity takes one track")).cast("double"))
        return by.agg(one.alias("score"))
    if how in ("mean", "min", "smooth_min"):
        return by.agg(fold(s, how).alias("score"))
    if how == "weighted_mean":
        w = F.coalesce(named[F.col("track")], F.lit(0.0))
        return by.agg(F.try_divide(F.sum(w * s), F.sum(w)).alias("score"))
    if how == "power_mean":
        least = F.least(tracks.agg(F.min("score").alias("m")).first()["m"] * F.lit(1.0), F.lit(0.0))  # one global shift keeps bases positive
        w = F.coalesce(named[F.col("track")], F.lit(1.0))
        return by.agg(F.pow(F.try_divide(F.sum(w * F.pow(s - least, F.lit(power))), F.sum(w)), F.lit(1 / power)).alias("score"))
    raise ValueError(f"aggregate: {how}")


def first_valid(candidates: DataFrame, group: list[str], score: str, valid: str, attempts: int) -> DataFrame:
    """The best valid candidate among the first `attempts` of each group by score, or else the best one even if invalid."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), "candidate")
    r = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= attempts)
    best = r.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col(valid), F.col("rank"))), F.lit(1)).alias("rank"))
    return r.join(best, [*group, "rank"])


def greedy_select(features: DataFrame, size: int, start: list[int], metric: str = "cosine") -> tuple[list[int], list[float]]:
    """A set of images on whose distance profiles the models agree least, chosen one by one; and its mean agreement.

    Each round is one Spark job: for every candidate and pair of models, the sums behind Pearson's r
    of the profile with that candidate are the current sums plus its own distances, so only the
    candidate's new distances are computed. The driver keeps the chosen ids and 6 numbers a pair
    of models. Ties go to the smaller id.
    """
    spark, chosen, history = features.sparkSession, list(start), []
    unit = features.select(F.lit(0).alias("grp"), "model", "image_id", "v")
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    terms = [F.lit(1.0), F.col("da"), F.col("db"), F.col("da") * F.col("da"), F.col("db") * F.col("db"), F.col("da") * F.col("db")]

    def sums(pairs: DataFrame, *keys: str) -> DataFrame:
        return pairs.groupBy(*keys, "model_a", "model_b").agg(*[F.sum(t).alias(n) for t, n in zip(terms, names)])

    base = sums(kernels.profile_pairs(kernels.distance_profile(unit.where(F.col("image_id").isin(chosen)), metric)))
    state = {(r["model_a"], r["model_b"]): [r[n] for n in names] for r in base.collect()}
    while len(chosen) < size:
        new = kernels.candidate_distances(unit.where(~F.col("image_id").isin(chosen)), unit.where(F.col("image_id").isin(chosen)), metric)
        a = new.select("candidate", "image", F.col("model").alias("model_a"), F.col("d").alias("da"))
        b = new.select("candidate", "image", F.col("model").alias("model_b"), F.col("d").alias("db"))
        own = sums(a.join(b, ["candidate", "image"]).where("model_a < model_b"), "candidate")
        known = spark.createDataFrame([(*k, *map(float, v)) for k, v in state.items()] or [("", "", *[0.0] * 6)], ["model_a", "model_b", *[f"_{n}" for n in names]])
        both = own.join(F.broadcast(known), ["model_a", "model_b"], "left")  # one row a pair of models
        n, sx, sy, sxx, syy, sxy = (F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0.0)) for x in names)
        spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
        r = F.when(spread > 1e-18, (n * sxy - sx * sy) / F.sqrt(spread)).otherwise(0.0)
        best = both.groupBy("candidate").agg(F.avg(r).alias("r")).orderBy("r", "candidate").first()
        if best is None:
            break
        for row in own.where(F.col("candidate") == best["candidate"]).collect():
            key = (row["model_a"], row["model_b"])
            state[key] = [x + row[m] for x, m in zip(state.get(key, [0.0] * 6), names)]
        chosen.append(best["candidate"])
        history.append(best["r"])
    return chosen, history
