"""Queries of distance profiles, utilities and selection over slices of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C, disagreement as D, kernels as K, ranks
from .catalog import register, table

DIM = 16
#: CTE `feat(image_id, grp, model, v)`: four models, one for each slice of 16 dimensions.
FEAT = f"feat AS (SELECT vec_id AS image_id, CAST(label AS BIGINT) AS grp, 'm' || m AS model, CAST(embedding[{DIM} * m + 1 : {DIM} * m + {DIM}] AS DOUBLE[]) AS v FROM embeddings, range(4) t(m))"


def _rdm(distance: str, name: str = "rdm") -> str:
    return f"{name} AS (SELECT a.grp, a.model, a.image_id AS i, b.image_id AS j, {distance} AS d FROM feat a JOIN feat b ON a.grp = b.grp AND a.model = b.model AND a.image_id < b.image_id)"


_COS = "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_CORR = "1 - (list_dot_product(a.v, b.v) - list_sum(a.v) * list_sum(b.v) / 16) / sqrt((list_dot_product(a.v, a.v) - list_sum(a.v) ** 2 / 16) * (list_dot_product(b.v, b.v) - list_sum(b.v) ** 2 / 16))"
_EUC = "sqrt(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v))"
_PAIR = "pr AS (SELECT a.grp, a.model AS model_a, b.model AS model_b, a.i, a.j, a.d AS da, b.d AS db FROM rdm a JOIN rdm b ON a.grp = b.grp AND a.i = b.i AND a.j = b.j AND a.model < b.model)"
_AGREE = "agree AS (SELECT grp, model_a, model_b, corr(da, db) AS r FROM pr GROUP BY 1, 2, 3)"
_SYM = "sym AS (SELECT grp, model_a AS model, model_b AS other, r FROM agree UNION ALL SELECT grp, model_b, model_a, r FROM agree)"
_VAR = "vr AS (SELECT grp, model, var_pop(d) AS var FROM rdm GROUP BY 1, 2)"
_ATT = "att AS (SELECT grp, model, other, r * sqrt(var / (var + 0.01 + 1e-8)) AS r FROM sym JOIN vr USING (grp, model))"


def features(spark, d):
    """Four models of the same images: slices of the embedding, as double."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("e"))
    slices = F.array(*[F.struct(F.lit(f"m{m}").alias("model"), F.slice("e", DIM * m + 1, DIM).alias("v")) for m in range(4)])
    return e.select("image_id", "grp", F.explode(slices).alias("s")).select("image_id", "grp", "s.model", "s.v")


def _summary(profile):
    return profile.select("grp", "model", F.col("pairs").alias("n_pairs"), F.round("mean", 6).alias("mean_d"), F.round("high", 5).alias("max_d"), F.round(F.sqrt("var"), 6).alias("spread"))


_SUM = "SELECT grp, model, count(*) AS n_pairs, round(avg(d), 6) AS mean_d, round(max(d), 5) AS max_d, round(stddev_pop(d), 6) AS spread FROM rdm GROUP BY 1, 2"

for _metric, _sql in {
    "cosine": "1 - list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9))",
    "cosine_floor": _COS, "correlation": _CORR, "correlation_scaled": f"1 - (1 - ({_CORR})) * 15.0 / 16", "euclidean": _EUC,
}.items():
    register(f"profile_{_metric}", f"WITH {FEAT}, {_rdm(_sql)} {_SUM}")(lambda spark, d, m=_metric: _summary(C.profiles(C.moments(features(spark, d), m))))


_RANK = "rk AS (SELECT grp, model, i, j, rank() OVER (PARTITION BY grp, model ORDER BY d) + (count(*) OVER (PARTITION BY grp, model, d) - 1) / 2.0 AS d FROM raw)"


@register("rsa_scores", f"WITH {FEAT}, {_rdm(_COS, 'raw')}, {_RANK.replace('rk AS', 'rdm AS')}, {_PAIR} SELECT grp, model_a, model_b, count(*) AS n, round(corr(da, db), 6) AS r FROM pr GROUP BY 1, 2, 3")
def rsa_scores(spark, d):
    x = C.agreement(ranks.moments(features(spark, d), "cosine"))
    return x.select("grp", "model_a", "model_b", "n", F.round("r", 6).alias("r"))


@register("rsa_pearson", f"WITH {FEAT}, {_rdm(_CORR)}, {_PAIR} SELECT grp, model_a, model_b, count(*) AS n, round(corr(da, db), 6) AS r FROM pr GROUP BY 1, 2, 3")
def rsa_pearson(spark, d):
    x = C.agreement(C.moments(features(spark, d), "correlation"))
    return x.select("grp", "model_a", "model_b", "n", F.round("r", 6).alias("r"))


@register("rsa_ordinal", f"WITH {FEAT}, {_rdm(_COS, 'raw')}, rdm AS (SELECT grp, model, i, j, row_number() OVER (PARTITION BY grp, model ORDER BY d, i, j) AS d FROM raw), {_PAIR} SELECT grp, model_a, model_b, round(1 - 6 * sum((da - db) ** 2) / (count(*) * (count(*) ** 2 - 1.0)), 6) AS r FROM pr GROUP BY 1, 2, 3")
def rsa_ordinal(spark, d):
    x = C.agreement(ranks.moments(features(spark, d), "cosine", "ordinal"))
    return x.select("grp", "model_a", "model_b", F.round("r", 6).alias("r"))


@register("total_agreement", f"WITH {FEAT}, {_rdm(_EUC)}, {_PAIR} SELECT grp, model_a, model_b, round(corr(da, db), 6) AS r FROM pr GROUP BY 1, 2, 3")
def total_agreement(spark, d):
    x = C.total_agreement(C.moments(features(spark, d), "euclidean"))
    return x.select("grp", "model_a", "model_b", F.round("r", 6).alias("r"))


@register("candidate_block", f"WITH {FEAT} SELECT b.model, b.image_id AS image, count(*) AS n, round(min({_COS}), 6) AS nearest, round(avg({_COS}), 6) AS mean_d FROM feat a JOIN feat b ON a.model = b.model AND a.image_id <> b.image_id WHERE b.image_id % 20 = 0 GROUP BY 1, 2")
def candidate_block(spark, d):
    f = features(spark, d)
    x = C.candidate_summary(f, f.where("image_id % 20 = 0"), "cosine_floor")
    return x.select("model", "image", "n", F.round("low", 6).alias("nearest"), F.round("mean", 6).alias("mean_d"))


@register("linear_encoding", f"WITH {FEAT} SELECT image_id, model, round(list_dot_product(v, [x * 0.1 for x in range(16)]) + 0.5, 6) AS y0, round(v[1] - v[2] - 0.25, 6) AS y1 FROM feat")
def linear_encoding(spark, d):
    w = [[k * 0.1 for k in range(DIM)], [1.0, -1.0, *[0.0] * (DIM - 2)]]
    x = K.encode(features(spark, d), w, [0.5, -0.25])
    return x.select("image_id", "model", F.round(F.col("v")[0], 6).alias("y0"), F.round(F.col("v")[1], 6).alias("y1"))


@register("model_classes", "SELECT 'm' || m AS model, 'm' || (CASE WHEN m = 4 THEN 0 ELSE m END) AS class FROM range(5) t(m)")
def model_classes(spark, d):
    f = features(spark, d)
    copy = f.where("model = 'm0'").withColumn("model", F.lit("m4"))  # a fifth model that equals the first
    return K.equivalent_models(f.unionByName(copy))


def _profile(spark, d):
    return K.distance_profile(features(spark, d), "cosine_floor")


def _moments(spark, d):
    return C.moments(features(spark, d), "cosine_floor")


@register("attenuated_scores", f"WITH {FEAT}, {_rdm(_COS)}, {_PAIR}, {_AGREE}, {_SYM}, {_VAR}, {_ATT} SELECT grp, model, other, round(r, 6) AS r FROM att")
def attenuated_scores(spark, d):
    m = _moments(spark, d)
    return D.attenuated(C.agreement(m), C.profiles(m), 0.01).select("grp", "model", "other", F.round("r", 6).alias("r"))


_FOLD = {"mean": "avg(r)", "min": "min(r)", "smooth_min": "-ln(sum(exp(-10 * r))) / 10"}
for _how, _f in _FOLD.items():
    register(f"utility_{_how}", f"WITH {FEAT}, {_rdm(_COS)}, {_PAIR}, {_AGREE}, {_SYM}, {_VAR}, {_ATT}, w AS (SELECT grp, model, 1 - ({_f}) AS r FROM att GROUP BY 1, 2) SELECT grp, round({_f}, 6) AS utility FROM w GROUP BY 1")(
        lambda spark, d, how=_how: D.across_models(D.within_utility(D.attenuated(C.agreement(m := _moments(spark, d)), C.profiles(m), 0.01), how), how).select("grp", F.round("utility", 6).alias("utility"))
    )


@register("group_margins", f"WITH {FEAT}, {_rdm(_COS)}, {_PAIR}, {_AGREE}, {_SYM} SELECT grp, model, round(1 - greatest(0, max(r)), 6) AS margin FROM sym GROUP BY 1, 2")
def group_margins(spark, d):
    x = K.symmetric(C.agreement(_moments(spark, d)))
    own = x.select("grp", "model", F.col("model").alias("other"), F.lit(1.0).alias("r")).distinct()
    return D.group_margin(x.unionByName(own)).select("grp", "model", F.round("margin", 6).alias("margin"))


@register("noise_variances", f"WITH {FEAT}, {_rdm(_COS)}, v AS (SELECT grp, model, var_samp(d) AS v FROM rdm GROUP BY 1, 2) SELECT grp, round(avg(v) * (1 / 0.46 ** 2 - 1), 6) AS noise FROM v GROUP BY 1")
def noise_variances(spark, d):
    return D.noise_variance(C.profiles(_moments(spark, d)), 0.46).select("grp", F.round("noise", 6).alias("noise"))


@register("noise_reliability", "SELECT CAST(k AS DOUBLE) AS k, round(1 / sqrt(1 + k * k * (1 / 0.46 ** 2 - 1)), 6) AS clean, round(1 / (1 + k * k * (1 / 0.46 - 1)), 6) AS noisy FROM range(1, 8) t(k)")
def noise_reliability(spark, d):
    k = F.col("id").cast("double")
    return spark.range(1, 8).select(k.alias("k"), F.round(D.reliability(k, 0.46), 6).alias("clean"), F.round(D.reliability(k, 0.46, True), 6).alias("noisy"))


_TRACKS = "tracks AS (SELECT l_returnflag AS track, l_partkey AS candidate, avg(l_discount) AS score FROM lineitem GROUP BY 1, 2)"


def _tracks(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("track"), F.col("l_partkey").alias("candidate")).agg(F.avg("l_discount").alias("score"))


@register("track_scores", f"WITH {_TRACKS}, z AS (SELECT track, candidate, (score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6) AS score FROM tracks WINDOW w AS (PARTITION BY track)) SELECT candidate, round(avg(score), 6) AS mean_score, round(min(score), 6) AS min_score, round(sum(CASE track WHEN 'A' THEN 2 * score WHEN 'N' THEN score ELSE 0 END) / nullif(sum(CASE track WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END), 0), 6) AS weighted FROM z GROUP BY 1")
def track_scores(spark, d):
    z = _tracks(spark, d).withColumn("score", D.normalised(F.col("score"), "z", "track"))
    w = D.track_aggregate(z, "weighted_mean", {"A": 2.0, "N": 1.0}).select("candidate", F.round("score", 6).alias("weighted"))
    both = z.groupBy("candidate").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.min("score"), 6).alias("min_score"))
    return both.join(w, "candidate")


@register("first_valid", f"WITH {_TRACKS}, r AS (SELECT track, candidate, score, candidate % 3 = 0 AS ok, row_number() OVER (PARTITION BY track ORDER BY score DESC, candidate) AS rank FROM tracks), b AS (SELECT track, coalesce(min(CASE WHEN ok THEN rank END), 1) AS rank FROM r WHERE rank <= 5 GROUP BY 1) SELECT r.track, r.candidate, CAST(r.rank AS BIGINT) AS rank FROM r JOIN b USING (track, rank)")
def first_valid(spark, d):
    t = _tracks(spark, d).withColumn("ok", F.col("candidate") % 3 == 0)
    return D.first_valid(t, ["track"], "score", "ok", 5).select("track", "candidate", F.col("rank").cast("long").alias("rank"))


@register("similarity_summary", f"WITH {FEAT}, {_rdm(_COS)} SELECT model, count(*) AS n, round(avg(1 - d), 6) AS mean_s, round(stddev_pop(d), 6) AS sd, round(min(1 - d), 6) AS low, round(quantile_disc(1 - d, 0.5), 6) AS lower_median FROM rdm GROUP BY 1")
def similarity_summary(spark, d):
    f = features(spark, d)
    p = C.profiles(C.moments(f, "cosine_floor")).groupBy("model")
    # moments of groups together; 1 - d falls with d
    x = p.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"), F.collect_list(F.struct("n", "mean", "var")).alias("_g"), F.min("low").alias("low"), F.max("high").alias("high"))
    var = F.aggregate("_g", F.lit(0.0), lambda s, g: s + g["n"] * (g["var"] + (g["mean"] - F.col("_m")) * (g["mean"] - F.col("_m")))) / F.col("n")
    x = x.select("model", "pairs", "n", (1 - F.col("_m")).alias("mean"), F.sqrt(var).alias("sd"), (1 - F.col("high")).alias("low"), (1 - F.col("low")).alias("high"))
    # the lower of two middle values: percentile_disc, not the interpolated median
    both = x.join(C.lower_median(f, "cosine_floor", x), "model", "left")
    return both.select("model", F.col("pairs").alias("n"), F.round("mean", 6).alias("mean_s"), F.round("sd", 6).alias("sd"), F.round("low", 6).alias("low"), F.round("value", 6).alias("lower_median"))


@register("greedy_selection")
def greedy_selection(spark, d):
    """Eight images of the whole table, the three of the least ids given."""
    f = features(spark, d)
    chosen, history = D.greedy_select(f, 8, sorted(r[0] for r in f.select("image_id").distinct().orderBy("image_id").limit(3).collect()))
    rows = [(k, int(i), float(history[k - 3]) if k >= 3 else None) for k, i in enumerate(chosen)]
    return spark.createDataFrame(rows, "place int, image_id long, agreement double")
