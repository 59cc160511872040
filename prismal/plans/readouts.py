"""Queries of ridge readouts, residuals, adaptation and densities of feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C, readout as R
from .catalog import register, table
from .kernels import _COS, DIM, FEAT, _profile, _rdm, features
from .statistics import _readout, _rounded

#: One predictor and one target of each image, for closed forms in SQL.
_ONE = "one AS (SELECT CAST(label AS BIGINT) AS grp, vec_id AS image_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[17] AS DOUBLE) AS y FROM embeddings)"


def _one(spark, d):
    return _readout(spark, d).select("grp", "image_id", F.slice("x", 1, 1).alias("x"), F.slice("y", 1, 1).alias("y"))


def _hash(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {(' || chr(58) || ').join(parts)}), 1, 8) AS BIGINT)"


def _held_out(fold: str, alpha: float) -> str:
    """CTEs f (rows with a fold) and p (held-out predictions) of a ridge on one standardised predictor."""
    return f"""f AS (SELECT *, {fold} AS fold FROM one), s AS (SELECT grp, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM f GROUP BY 1, 2),
t AS (SELECT a.grp, a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM s a JOIN s b ON a.grp = b.grp AND a.fold <> b.fold GROUP BY 1, 2),
w AS (SELECT grp, fold, sx / n AS mx, sy / n AS my, sqrt(sxx / n - (sx / n) ** 2) AS sd, (sxy - sx * sy / n) / sqrt(sxx / n - (sx / n) ** 2) / (n + {alpha}) AS w FROM t),
p AS (SELECT f.grp, image_id, y, my + (x - mx) / sd * w AS p FROM f JOIN w USING (grp, fold))"""


@register("kfold_ridge", f"WITH {_ONE}, {_held_out(_hash(0, 'image_id') + ' % 5', 1.0)} SELECT grp, 0 AS target, 1.0 AS alpha, round(corr(y, p), 6) AS r FROM p GROUP BY 1")
def kfold_ridge(spark, d):
    x = R.kfold_ridge(_one(spark, d), (1.0,))
    return _rounded(x.withColumn("target", F.col("target").cast("long")), "grp", "target")


@register("kfold_penalties")
def kfold_penalties(spark, d):
    """Penalties by five folds for sixteen predictors and four targets (tested against numpy)."""
    return R.kfold_ridge(_readout(spark, d))


@register("fold_ensemble", f"WITH {_ONE}, {_held_out(_hash(4, '0', 'image_id') + ' % 5', 1.0)}, q AS (SELECT * FROM p UNION ALL SELECT * FROM (WITH {_held_out(_hash(4, '1', 'image_id') + ' % 5', 1.0)} SELECT * FROM p)) SELECT grp, image_id, round(any_value(y), 6) AS y, round(avg(p), 5) AS predicted, round(any_value(y) - avg(p), 5) AS residual FROM q GROUP BY 1, 2")
def fold_ensemble(spark, d):
    x = R.out_of_fold(_one(spark, d), 1.0, 5, 2, 4)
    return x.select("grp", "image_id", F.round("y", 6).alias("y"), F.round("predicted", 5).alias("predicted"), F.round("residual", 5).alias("residual"))


@register("readout_residual", f"WITH {_ONE}, m AS (SELECT grp, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, count(*) AS n, covar_pop(x, y) * count(*) / stddev_pop(x) / (count(*) + 10.0) AS w FROM one GROUP BY 1) SELECT grp, image_id, round(y - my - (x - mx) / sd * w, 5) AS residual FROM one JOIN m USING (grp)")
def readout_residual(spark, d):
    return R.full_residual(_one(spark, d), 10.0).select("grp", "image_id", F.round("residual", 5).alias("residual"))


@register("augmented_readout")
def augmented_readout(spark, d):
    """Penalties from train and val rows, exact left-out predictions of eval rows (tested against refits)."""
    k = F.col("image_id") % 4
    return R.augmented_loo(_readout(spark, d).withColumn("split", F.when(k < 2, "train").when(k == 2, "val").otherwise("eval")))


@register(
    "weighted_readout",
    f"""WITH {_ONE}, v AS (SELECT *, 1.0 + image_id % 3 AS w FROM one), m AS (SELECT grp, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM v GROUP BY 1), c AS (SELECT v.grp, any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) ** 2) AS xx, sum(w * (x - mx) * (y - my)) AS xy FROM v JOIN m USING (grp) GROUP BY 1),
p AS (SELECT v.grp, y, (x - mx) / sqrt(xx / sw) AS z, my, w, sw, xy / sqrt(xx / sw) / (sw + 2.0) AS b FROM v JOIN c USING (grp)), l AS (SELECT grp, y, y - (y - my - z * b) / (1 - w * (z * z / (sw + 2.0) + 1 / sw)) AS p FROM p) SELECT grp, 0 AS target, round(corr(y, p), 6) AS r FROM l GROUP BY 1""",
)
def weighted_readout(spark, d):
    x = R.weighted_loo(_one(spark, d).withColumn("w", 1.0 + F.col("image_id") % 3), 2.0)
    return _rounded(x.withColumn("target", F.col("target").cast("long")), "grp", "target")


@register("adapted_readout")
def adapted_readout(spark, d):
    """Target rows (the first fifth) predicted with and without the others, over a grid of weights (tested against refits)."""
    x = _readout(spark, d)
    own = F.col("image_id") % 5 == 0
    return R.adaptation(x.where(~own), x.where(own), 10.0, [0.1, 0.5, 0.9])


@register("readout_transfer", f"WITH {_ONE}, m AS (SELECT grp, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, covar_pop(x, y) * count(*) / stddev_pop(x) / (count(*) + 10.0) AS w FROM one WHERE image_id % 2 = 0 GROUP BY 1) SELECT grp, 0 AS target, round(corr(y, my + (x - mx) / sd * w), 6) AS r FROM one JOIN m USING (grp) WHERE image_id % 2 = 1 GROUP BY 1")
def readout_transfer(spark, d):
    x = R.transfer(_one(spark, d), 10.0, "image_id % 2 = 0")
    return _rounded(x.withColumn("target", F.col("target").cast("long")), "grp", "target")


@register("refit_predictions", f"WITH {_ONE}, m AS (SELECT grp, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, covar_pop(x, y) * count(*) / stddev_pop(x) / (count(*) + CASE WHEN grp % 2 = 0 THEN 1.0 ELSE 10.0 END) AS w FROM one WHERE image_id % 2 = 0 GROUP BY 1) SELECT grp, image_id, 0 AS target, round(my + (x - mx) / sd * w, 5) AS predicted FROM one JOIN m USING (grp) WHERE image_id % 2 = 1")
def refit_predictions(spark, d):
    x = _one(spark, d)
    penalty = x.select("grp").distinct().select("grp", F.lit(0).alias("target"), F.when(F.col("grp") % 2 == 0, 1.0).otherwise(10.0).alias("alpha"))
    out = R.refit(x.where("image_id % 2 = 0"), penalty, x.where("image_id % 2 = 1"), (1.0, 10.0))
    return out.select("grp", "image_id", F.col("target").cast("long").alias("target"), F.round("predicted", 5).alias("predicted"))


@register(
    "blocked_folds",
    f"WITH {FEAT}, {_rdm(_COS)}, f AS (SELECT vec_id AS image_id, {_hash(9, 'vec_id')} % 3 AS fold FROM embeddings), x AS (SELECT k AS fold, CASE WHEN a.fold = k AND b.fold = k THEN 'test' WHEN a.fold <> k AND b.fold <> k THEN 'train' END AS side, d FROM rdm JOIN f a ON a.image_id = i JOIN f b ON b.image_id = j, range(3) t(k) WHERE model = 'm0') SELECT fold, side, count(*) AS n, round(avg(d), 6) AS mean_d FROM x WHERE side IS NOT NULL GROUP BY 1, 2",
)
def blocked_folds(spark, d):
    folds = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), R.fold_of(F.col("vec_id"), 3, 9).cast("long").alias("fold"))
    x = R.blocked_pairs(_profile(spark, d).where("model = 'm0'"), folds).groupBy("fold", "side")
    return x.agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_d"))


@register("fixed_effects", "WITH m AS (SELECT p_type, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my, var_pop(p_size) AS vx, covar_pop(p_size, p_retailprice) AS c FROM part GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * c) / sum(n * vx) AS slope, avg(my) AS y, avg(mx) AS x FROM m) SELECT n, round(slope, 6) AS slope, round(y - slope * x, 5) AS mean_intercept FROM s")
def fixed_effects(spark, d):
    x = R.within_slope(table(spark, d, "part"), "p_type", "p_size", "p_retailprice")
    return x.select("n", F.round("slope", 6).alias("slope"), F.round("mean_intercept", 5).alias("mean_intercept"))


@register("weighted_z", "WITH m AS (SELECT p_brand, sum(p_size * p_retailprice) / sum(p_size) AS m, sum(p_size * p_retailprice ** 2) / sum(p_size) AS q FROM part GROUP BY 1) SELECT p_brand, p_partkey, round((p_retailprice - m) / sqrt(greatest(q - m * m, 1e-16)), 4) AS z FROM part JOIN m USING (p_brand)")
def weighted_z(spark, d):
    return R.weighted_z(table(spark, d, "part"), ["p_brand"], "p_retailprice", "p_size").select("p_brand", "p_partkey", F.round("z", 4).alias("z"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.slice(F.col("embedding").cast("array<double>"), 1, DIM).alias("v"), "label")


@register("ppca_loglik")
def ppca_loglik(spark, d):
    """Log-likelihoods of all images under the images of the first labels (tested against numpy)."""
    x = _vectors(spark, d)
    return R.ppca_log_likelihood(x, x.where("label < 5"))


@register("projected_scores")
def projected_scores(spark, d):
    """Agreement of models after a sparse random projection to eight dimensions (tested for its distances)."""
    f = R.sparse_projection(features(spark, d), ["image_id", "grp", "model"], "v", 8, 3)
    return _rounded(C.agreement(C.moments(f, "cosine")), "grp", "model_a", "model_b")


@register("semantic_clusters")
def semantic_clusters(spark, d):
    """Ten clusters of the images' leading principal components (seeded; tested for sizes and separation)."""
    from ..operators.clusters import clustered

    return clustered(_vectors(spark, d).select("image_id", "v"), components=8, clusters=10, seed=5)


@register("teacher_student")
def teacher_student(spark, d):
    """Which student gives back each teacher's distances, by group and draw (hashed noise; tested for its limits)."""
    from ..operators import recovery as V

    cube = R.teacher_student(features(spark, d), 0.01, 2, 1.0, "image_id % 2 = 0", seed=6)
    k = F.substring("teacher", 2, 9).cast("long"), F.substring("student", 2, 9).cast("long")
    cube = cube.select((F.col("grp") * 2 + F.col("draw")).alias("sim"), k[0].alias("model_i"), k[1].alias("model_j"), "r")
    own = spark.range(4).select(F.col("id").alias("model"), F.col("id").alias("class"))
    return _rounded(V.recovered(cube, own), "sim", "model_i")
