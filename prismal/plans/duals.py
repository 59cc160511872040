"""Queries of readouts on their smaller side, of candidate rows and of refitted selection, over whole vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dual, refit
from .catalog import register, table
from .kernels import features

#: Columns of an embedding that predict; the rest are targets.
WIDE = 48


def _rows(spark, d, part):
    x = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("v"))
    return x.select("grp", "image_id", part.alias("part"), F.slice("v", 1, WIDE).alias("x"), F.slice("v", WIDE + 1, 64).alias("y"))


def _quarter(*names):
    k = F.col("image_id") % 4
    return F.when(k == 0, names[0]).when(k == 1, names[1]).when(k == 2, names[2]).otherwise(names[3])


def _summary(found):
    """Agreement of left-out predictions with the targets, by group and target."""
    return found.groupBy("grp", "target").agg(F.count("*").alias("n"), F.round(F.corr("y", "predicted"), 6).alias("r"), F.round(F.avg("alpha"), 6).alias("mean_alpha"))


@register("dual_predictions")
def dual_predictions(spark, d):
    """Every fourth image predicted by the fit of the others of its group, all targets and penalties (tested against refits)."""
    found = dual.predict(_rows(spark, d, _quarter("fit", "fit", "fit", "eval")), (0.1, 1.0, 10.0))
    return found.select("grp", "image_id", "alpha", F.transform("predicted", lambda v: F.round(v, 6)).alias("predicted"))


@register("validated_penalties")
def validated_penalties(spark, d):
    """Each target's penalty by the error on validation images (tested against refits)."""
    return dual.penalties(_rows(spark, d, _quarter("fit", "fit", "val", "other")), (0.1, 1.0, 10.0), scoring="neg_mse").select("grp", "target", "alpha", F.round("score", 6).alias("score"))


def _sets(spark, d):
    return _rows(spark, d, _quarter("train", "train", "val", "eval")).withColumn("set", F.floor(F.col("image_id") / 4000))


@register("augmented_left_out")
def augmented_left_out(spark, d):
    """Evaluation images predicted by the fit and the other images of their set, penalties by validation (tested against refits)."""
    return _summary(dual.left_out(_sets(spark, d), (0.1, 1.0, 10.0)))


@register("nested_left_out")
def nested_left_out(spark, d):
    """As augmented_left_out, the penalty chosen anew for each image by predictions that leave out two (tested against refits)."""
    return _summary(dual.left_out(_sets(spark, d), (0.1, 1.0, 10.0), "nested"))


@register("candidate_errors")
def candidate_errors(spark, d):
    """For every candidate image the error of the selected images and itself, each predicted without itself (tested against refits)."""
    part = F.when(F.col("image_id") % 2 == 0, "fit").when(F.col("image_id") < 100, "selected").otherwise("candidate")
    return dual.candidate_errors(_rows(spark, d, part), (0.1, 1.0, 10.0)).withColumn("error", F.round("error", 6))


@register("refit_selection")
def refit_selection(spark, d):
    """Three more images chosen by refitted readouts of four models (tested against exhaustive refits)."""
    k = F.col("image_id") % 4
    part = F.when(k < 2, "train").when(k == 2, "val").otherwise("candidate")
    x = features(spark, d).select("image_id", "model", "v")
    start = [r["image_id"] for r in x.select("image_id").where("image_id % 4 = 3").distinct().orderBy("image_id").limit(3).collect()]
    return refit.refit_greedy(x, part, start, 6, noise=0.5).select("place", "image_id", F.round("score", 6).alias("score"), F.round("tie", 6).alias("tie"))
