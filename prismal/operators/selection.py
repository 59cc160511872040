"""Which images may be selected, by what method, and how a selection is refined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels

#: Choices of each part of a selection method.
METHODS = {
    "tracks": ("rdm", "encoding", "both"), "aggregate": ("mean", "min"), "normalisation": ("none", "z", "minmax"),
    "within": ("mean", "max", "min"), "across": ("mean", "min"), "attenuated": (True, False),
}


def usable_images(images: DataFrame, least_side: int, least_natural: float) -> DataFrame:
    """Images whose longer side and probability of being natural reach their bounds; one without a probability passes."""
    natural = F.col("p_natural").isNull() | (F.col("p_natural") >= least_natural)
    return images.where((F.greatest("width", "height") >= least_side) & natural)


def catalogue(spark: SparkSession) -> DataFrame:
    """One row for each combination of METHODS."""
    out = spark.range(1)
    for name, choices in METHODS.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, choices))))
    return out.drop("id")


def variant(selections: DataFrame, name: str) -> DataFrame:
    """The rows (place, image_id, stage, score) of a variant: final, greedy, or the best raw score of all passes."""
    if name in ("final", "greedy"):
        return selections.where(F.col("stage") == name)
    if name == "best_raw":
        best = selections.groupBy("stage").agg(F.max("score").alias("_s")).orderBy(F.desc("_s"), "stage").limit(1).select("stage")
        return selections.join(F.broadcast(best), "stage", "left_semi")
    raise ValueError(f"variant: {name}")


_NAMES = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _moments(pairs: DataFrame, *keys: str) -> DataFrame:
    a, b = F.col("da"), F.col("db")
    terms = [F.lit(1.0), a, b, a * a, b * b, a * b]
    return pairs.groupBy(*keys, "model_a", "model_b").agg(*[F.sum(t).alias(n) for t, n in zip(terms, _NAMES)])


def refine(features: DataFrame, chosen: list[int], passes: int = 3, least_replaced: int = 0, metric: str = "cosine") -> tuple[list[int], list[float]]:
    """Coordinate exchange: each place in turn is emptied and given the image with which the models agree least.

    Returns the images and the mean agreement after each pass. A pass that replaces `least_replaced` images or
    fewer is the last. One Spark job a place computes every image's distances to the others chosen; the driver keeps
    the ids and six numbers a pair of models. An image stays unless another is better; ties go to the smaller id.
    """
    unit = features.select(F.lit(0).alias("grp"), "model", "image_id", "v")
    chosen, history, spark = list(chosen), [], features.sparkSession
    for _ in range(passes):
        replaced = 0
        for place, old in enumerate(chosen):
            rest = [c for c in chosen if c != old]
            kept = unit.where(F.col("image_id").isin(rest))
            base = {(r["model_a"], r["model_b"]): [r[n] for n in _NAMES] for r in _moments(kernels.profile_pairs(kernels.distance_profile(kept, metric))).collect()}
            near = kernels.candidate_distances(unit.where(~F.col("image_id").isin(rest)), kept, metric)
            a = near.select("candidate", "image", F.col("model").alias("model_a"), F.col("d").alias("da"))
            b = near.select("candidate", "image", F.col("model").alias("model_b"), F.col("d").alias("db"))
            own = _moments(a.join(b, ["candidate", "image"]).where("model_a < model_b"), "candidate")
            known = spark.createDataFrame([(*k, *map(float, v)) for k, v in base.items()] or [("", "", *[0.0] * 6)], ["model_a", "model_b", *[f"_{n}" for n in _NAMES]])
            n, sx, sy, sxx, syy, sxy = (F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0.0)) for x in _NAMES)
            spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
            r = F.when(spread > 1e-18, (n * sxy - sx * sy) / F.sqrt(spread)).otherwise(0.0)
            scored = own.join(F.broadcast(known), ["model_a", "model_b"], "left").groupBy("candidate").agg(F.round(F.avg(r), 12).alias("r"))
            best = scored.orderBy("r", F.col("candidate") != old, "candidate").first()
            if best is not None and best["candidate"] != old:
                chosen[place], replaced = best["candidate"], replaced + 1
            last = best["r"] if best is not None else float("nan")
        history.append(last)
        if replaced <= least_replaced:
            break
    return chosen, history
