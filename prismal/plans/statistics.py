"""Queries of reliability, inference, discriminability, readouts and summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import scalar as S, special as P
from ..operators import cells as C, disagreement as D, inference as I, ridge as R, tables as O
from .catalog import register, table
from .kernels import _AGREE, _COS, _PAIR, DIM, FEAT, _moments, _rdm, features
from .shared import SCORES, scores

_PER = "per AS (SELECT subject, model, kind, avg(score) AS score FROM scores GROUP BY 1, 2, 3)"
_WIDE = "wide AS (SELECT subject, model, avg(CASE WHEN kind = 'A' THEN score END) AS a, avg(CASE WHEN kind = 'R' THEN score END) AS b FROM scores GROUP BY 1, 2)"


def _per(spark, d):
    return scores(spark, d).groupBy("subject", "model", "kind").agg(F.avg("score").alias("score"))


def _wide(spark, d):
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.col("score")))
    return scores(spark, d).groupBy("subject", "model").agg(mean("A").alias("a"), mean("R").alias("b"))


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@register("split_half_ceiling", f"WITH {SCORES}, h AS (SELECT subject, model, avg(CASE WHEN boot % 2 = 0 THEN score END) AS a, avg(CASE WHEN boot % 2 = 1 THEN score END) AS b FROM scores GROUP BY 1, 2), r AS (SELECT subject, corr(a, b) AS r FROM h GROUP BY 1) SELECT subject, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS ceiling FROM r")
def split_half_ceiling(spark, d):
    x = scores(spark, d).withColumn("half", F.col("boot") % 2)
    return _rounded(I.split_half(x, "subject", "model", "half", "score"), "subject")


@register("between_subject_ceiling", f"WITH {SCORES}, p AS (SELECT subject, model, avg(score) AS x FROM scores GROUP BY 1, 2), w AS (SELECT subject, model, x, avg(x) OVER m AS al, (sum(x) OVER m - x) / (count(*) OVER m - 1) AS rest FROM p WINDOW m AS (PARTITION BY model)) SELECT subject, round(corr(x, al), 6) AS upper, round(corr(x, rest), 6) AS lower FROM w GROUP BY 1")
def between_subject_ceiling(spark, d):
    p = scores(spark, d).groupBy("subject", "model").agg(F.avg("score").alias("x"))
    return _rounded(I.between_subjects(p, "subject", "model", "x"), "subject")


@register("ceiling_variants", f"WITH {SCORES}, {_PER}, c AS (SELECT subject, max(CASE WHEN kind = 'A' THEN score END) AS w, min(score) AS lo, max(score) AS hi FROM per GROUP BY 1) SELECT p.subject, p.model, round(score, 6) AS raw, round(score / sqrt(w), 6) AS by_root, round(score / w, 6) AS by_within, round(score / ((lo + hi) / 2), 6) AS by_between FROM per p JOIN c USING (subject) WHERE kind = 'R'")
def ceiling_variants(spark, d):
    p = _per(spark, d)
    c = p.groupBy("subject").agg(F.max(F.when(F.col("kind") == "A", F.col("score"))).alias("w"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = p.where("kind = 'R'").join(c, "subject")
    return _rounded(x.select("subject", "model", *I.normalisations(F.col("score"), F.col("w"), F.col("lo"), F.col("hi"))), "subject", "model")


@register("paired_effects", f"WITH {SCORES}, {_WIDE} SELECT model, count(a - b) AS n, round(avg(a - b), 6) AS mean_diff, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(a - b))), 6) AS t, round(avg(a - b) / stddev_samp(a - b), 6) AS dz, round(100 * avg(b - a) / avg(b), 6) AS pct_drop FROM wide GROUP BY 1")
def paired_effects(spark, d):
    return _rounded(_wide(spark, d).groupBy("model").agg(*I.paired(F.col("a"), F.col("b"))), "model")


@register("pooled_effects", "SELECT l_returnflag AS kind, round((avg(l_quantity) FILTER (l_linestatus = 'F') - avg(l_quantity) FILTER (l_linestatus = 'O')) / sqrt(((count(*) FILTER (l_linestatus = 'F') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'F') + (count(*) FILTER (l_linestatus = 'O') - 1) * var_samp(l_quantity) FILTER (l_linestatus = 'O')) / (count(*) - 2)), 6) AS d, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem GROUP BY 1")
def pooled_effects(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.round(I.pooled_d(q, F.col("l_linestatus") == "F"), 6).alias("d"), F.round(I.one_sample_t(q, 25.0), 6).alias("t"))


@register(
    "levene_statistic",
    f"""WITH {SCORES}, {_PER}, m AS (SELECT subject, kind, median(score) AS med FROM per GROUP BY 1, 2), z AS (SELECT subject, kind, abs(score - med) AS z FROM per JOIN m USING (subject, kind)),
g AS (SELECT subject, kind, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1, 2), t AS (SELECT subject, avg(z) AS gm, count(*) AS nt FROM z GROUP BY 1)
SELECT subject, round(any_value(nt - 3) * sum(n * (m - gm) ** 2) / (2 * sum(n * v)), 6) AS w, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM g JOIN t USING (subject) GROUP BY 1""",
)
def levene_statistic(spark, d):
    return _rounded(I.levene(_per(spark, d), ["subject"], "kind", "score"), "subject")


_PV = "pv AS (SELECT p_type AS scope, p_partkey AS k, (p_size * p_partkey % 997 + 1) / 1000.0 AS p FROM part)"


def _pv(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_type").alias("scope"), F.col("p_partkey").alias("k"), ((F.col("p_size") * F.col("p_partkey") % 997 + 1) / 1000.0).alias("p"))


@register("fdr_adjusted", f"WITH {_PV}, r AS (SELECT *, count(*) OVER (PARTITION BY scope) AS m, row_number() OVER (PARTITION BY scope ORDER BY p, k) AS r FROM pv) SELECT scope, k, round(least(1.0, min(p * m / r) OVER (PARTITION BY scope ORDER BY r DESC)), 6) AS q FROM r")
def fdr_adjusted(spark, d):
    return I.benjamini_hochberg(_pv(spark, d), ["scope"], "p", "k").select("scope", "k", F.round("q", 6).alias("q"))


@register("holm_adjusted", f"WITH {_PV}, r AS (SELECT *, count(*) OVER (PARTITION BY scope) AS m, row_number() OVER (PARTITION BY scope ORDER BY p, k) AS r FROM pv) SELECT scope, k, round(max(least((m - r + 1) * p, 1.0)) OVER (PARTITION BY scope ORDER BY r), 6) AS p_holm, p < 0.05 / m AS bonferroni FROM r")
def holm_adjusted(spark, d):
    x = I.holm(_pv(spark, d), ["scope"], "p", "k")
    return x.select("scope", "k", F.round("p_holm", 6).alias("p_holm"), (F.col("p") < 0.05 / F.count("*").over(Window.partitionBy("scope"))).alias("bonferroni"))


@register("fdr_decisions", f"WITH {_PV}, r AS (SELECT *, count(*) OVER (PARTITION BY scope) AS m, row_number() OVER (PARTITION BY scope ORDER BY p, k) AS r FROM pv), c AS (SELECT scope, coalesce(max(CASE WHEN p <= r * 0.2 / m THEN r END), 0) AS cut FROM r GROUP BY 1) SELECT scope, k, r <= cut AS rejected FROM r JOIN c USING (scope)")
def fdr_decisions(spark, d):
    return I.bh_rejected(_pv(spark, d), ["scope"], "p", "k", 0.2).select("scope", "k", "rejected")


@register("fisher_combined", f"WITH {_PV} SELECT scope, round(-2 * sum(ln(greatest(p, 1e-10))), 6) AS chi2, 2 * count(*) AS df FROM pv GROUP BY 1")
def fisher_combined(spark, d):
    return _pv(spark, d).groupBy("scope").agg(F.round(I.fisher_statistic(F.col("p")), 6).alias("chi2"), (2 * F.count("*")).alias("df"))


@register("test_p_values")
def test_p_values(spark, d):
    """p-values of the statistics above, from the distribution functions (no SQL counterpart)."""
    t = paired_effects(spark, d).select("model", P.t_two_sided(F.col("t"), (F.col("n") - 1).cast("double")).alias("p_t"))
    w = levene_statistic(spark, d).select(F.col("subject").cast("string").alias("model"), P.f_greater(F.col("w"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")).alias("p_f"))
    c = _pv(spark, d).groupBy("scope").agg(F.round(I.fisher_statistic(F.col("p")), 6).alias("chi2"), (2 * F.count("*")).alias("df"))
    c = c.select(F.col("scope").alias("model"), P.chi2_greater(F.col("chi2"), F.col("df").cast("double")).alias("p_chi2"))
    return O.union_all([t, w, c])


@register("rank_agreement", f"WITH {SCORES}, p AS (SELECT subject, model, avg(score) AS s FROM scores GROUP BY 1, 2), r AS (SELECT subject, model, rank() OVER (PARTITION BY subject ORDER BY s DESC) AS k FROM p) SELECT a.subject AS key_a, b.subject AS key_b, count(*) AS n, round(corr(a.k, b.k), 6) AS rho, round(atanh(greatest(least(corr(a.k, b.k), 0.9999), -0.9999)), 5) AS z FROM r a JOIN r b ON a.model = b.model AND a.subject < b.subject GROUP BY 1, 2 HAVING count(*) >= 3")
def rank_agreement(spark, d):
    from ..functions.aggregate import correlation

    p = scores(spark, d).groupBy("subject", "model").agg(F.avg("score").alias("s"))
    p = p.withColumn("k", O.average_rank(-F.col("s"), [F.col("subject")]))
    x = O.self_pairs(p, ["model"], "subject", "k").groupBy("key_a", "key_b").agg(F.count("*").alias("n"), correlation(F.col("a"), F.col("b")).alias("rho"))
    return x.where("n >= 3").select("key_a", "key_b", "n", F.round("rho", 6).alias("rho"), F.round(F.atanh(S.clip(F.col("rho"), -0.9999, 0.9999)), 5).alias("z"))


@register("endpoint_table", f"WITH {SCORES}, {_WIDE} SELECT subject, count(*) AS n_common, round(avg(a - b), 6) AS delta, round(avg(a) / avg(b) - 1, 6) AS relative, round(stddev_samp(a) / nullif(stddev_samp(b), 0), 6) AS spread_ratio, round(median(a - b), 6) AS median_delta FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def endpoint_table(spark, d):
    a, b = F.col("a"), F.col("b")
    x = _wide(spark, d).where("a IS NOT NULL AND b IS NOT NULL").groupBy("subject")
    cols = {"delta": F.avg(a - b), "relative": F.try_divide(F.avg(a), F.avg(b)) - 1, "spread_ratio": F.try_divide(F.stddev_samp(a), F.stddev_samp(b)), "median_delta": F.median(a - b)}
    return _rounded(x.agg(F.count("*").alias("n_common"), *[c.alias(n) for n, c in cols.items()]).where("n_common >= 2"), "subject")


@register("linear_fit", "SELECT p_type, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 5) AS intercept FROM part GROUP BY 1")
def linear_fit(spark, d):
    y, x = F.col("p_retailprice"), F.col("p_size")
    ok = F.var_pop(x) > 0
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.when(ok, F.regr_slope(y, x)), 6).alias("slope"), F.round(F.when(ok, F.regr_intercept(y, x)), 5).alias("intercept"))


# a score cube: the draw `sim` is a line number, rows and columns are regions' customers and part types
_CUBE = "cube AS (SELECT CAST(l_linenumber AS BIGINT) AS sim, CAST(l_partkey % 4 AS BIGINT) AS model_i, CAST(l_suppkey % 4 AS BIGINT) AS model_j, avg(l_discount) + CASE WHEN l_partkey % 4 = l_suppkey % 4 THEN 0.001 ELSE 0 END AS r FROM lineitem GROUP BY l_linenumber, l_partkey % 4, l_suppkey % 4)"


def _cube(spark, d):
    i, j = F.col("l_partkey") % 4, F.col("l_suppkey") % 4
    x = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("sim"), i.alias("model_i"), j.alias("model_j")).agg(F.avg("l_discount").alias("r"))
    return x.withColumn("r", F.col("r") + F.when(F.col("model_i") == F.col("model_j"), 0.001).otherwise(0.0))


@register("confusion_counts", f"WITH {_CUBE}, t AS (SELECT *, row_number() OVER (PARTITION BY sim, model_i ORDER BY r DESC, model_j) AS k FROM cube) SELECT model_i, model_j, count(*) AS n FROM t WHERE k = 1 GROUP BY 1, 2")
def confusion_counts(spark, d):
    return I.confusion(_cube(spark, d))


@register("discriminability", f"WITH {_CUBE}, m AS (SELECT a.sim, a.model_i, a.model_j, o.r - a.r AS margin FROM cube a JOIN cube o ON o.sim = a.sim AND o.model_i = a.model_i AND o.model_j = a.model_i WHERE a.model_i <> a.model_j) SELECT model_i, model_j, round(avg(margin) / (stddev_samp(margin) + 1e-10), 6) AS d_prime, round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(margin) <= 1e-8 THEN 0.5 ELSE 0.0 END), 6) AS dominance, round(avg(CASE WHEN margin < -1e-8 THEN 1.0 ELSE 0.0 END + CASE WHEN abs(margin) <= 1e-8 THEN 0.5 ELSE 0.0 END), 6) AS error FROM m GROUP BY 1, 2")
def discriminability(spark, d):
    return _rounded(I.discriminability(I.margins(_cube(spark, d))), "model_i", "model_j")


_NOISE = "noise AS (SELECT l_returnflag AS track, CAST(l_linenumber AS DOUBLE) AS level, avg(l_tax) AS err FROM lineitem GROUP BY 1, 2)"


@register("error_area", f"WITH {_NOISE}, s AS (SELECT track, log10(level) AS lx, lag(log10(level)) OVER w AS px, err, lag(err) OVER w AS pe FROM noise WINDOW w AS (PARTITION BY track ORDER BY level)) SELECT track, round(sum((lx - px) * (err + pe) / 2) / (max(lx) - min(lx) + 1e-10), 6) AS auc FROM s GROUP BY 1")
def error_area(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("track"), F.col("l_linenumber").cast("double").alias("level")).agg(F.avg("l_tax").alias("err"))
    return _rounded(I.trapezoid_log10(n, ["track"], "level", "err"), "track")


@register("selected_vs_random", f"WITH {SCORES}, {_PER}, s AS (SELECT subject, avg(score) AS sel FROM per WHERE kind = 'A' GROUP BY 1) SELECT subject, count(*) AS n, round((sum(CASE WHEN score <= sel THEN 1 ELSE 0 END) + 1) * 1.0 / (count(*) + 1), 6) AS p FROM per JOIN s USING (subject) WHERE kind = 'N' GROUP BY 1")
def selected_vs_random(spark, d):
    p = _per(spark, d)
    s = p.where("kind = 'A'").groupBy("subject").agg(F.avg("score").alias("sel"))
    x = p.where("kind = 'N'").join(s, "subject").groupBy("subject")
    return _rounded(x.agg(F.count("*").alias("n"), I.empirical_p(F.col("score"), F.col("sel")).alias("p")), "subject")


@register("leaderboard", f"WITH {_NOISE}, w AS (SELECT level, max(CASE WHEN track = 'A' THEN err END) AS a, max(CASE WHEN track = 'N' THEN err END) AS n, max(CASE WHEN track = 'R' THEN err END) AS r FROM noise GROUP BY 1) SELECT level, round(a, 6) AS a, round(n, 6) AS n, round(r, 6) AS r, CASE WHEN a <= n AND a <= r THEN 'A' WHEN n <= r THEN 'N' ELSE 'R' END AS winner FROM w")
def leaderboard(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("level")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_tax"))
    a, n, r = F.col("A"), F.col("N"), F.col("R")
    win = F.when((a <= n) & (a <= r), "A").when(n <= r, "N").otherwise("R")
    return wide.select("level", F.round(a, 6).alias("a"), F.round(n, 6).alias("n"), F.round(r, 6).alias("r"), win.alias("winner"))


@register("pair_separation", f"WITH {SCORES}, {_PER}, x AS (SELECT a.kind, a.model AS key_a, b.model AS key_b, a.score - b.score AS diff FROM per a JOIN per b ON a.subject = b.subject AND a.kind = b.kind AND a.model < b.model) SELECT kind, key_a, key_b, count(*) AS n, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 5) AS t, bool_and(diff > 0) OR bool_and(diff < 0) AS same_sign FROM x GROUP BY 1, 2, 3")
def pair_separation(spark, d):
    x = O.self_pairs(_per(spark, d), ["subject", "kind"], "model", "score").withColumn("diff", F.col("a") - F.col("b"))
    same = F.bool_and(F.col("diff") > 0) | F.bool_and(F.col("diff") < 0)
    return x.groupBy("kind", "key_a", "key_b").agg(F.count("*").alias("n"), F.round(I.one_sample_t(F.col("diff")), 5).alias("t"), same.alias("same_sign"))


@register("repetition_subsets", "WITH m AS (SELECT CAST(s AS BIGINT) AS subset, CAST(i AS BIGINT) AS idx FROM range(1, 16) a(s), range(4) b(i) WHERE (s >> i) & 1 = 1), v AS (SELECT l_linenumber - 1 AS idx, l_returnflag AS kind, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2) SELECT subset, kind, count(*) AS n_reps, round(avg(x), 6) AS mean_x FROM m JOIN v USING (idx) GROUP BY 1, 2")
def repetition_subsets(spark, d):
    v = table(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("idx"), F.col("l_returnflag").alias("kind")).agg(F.avg("l_discount").alias("x"))
    x = I.subsets(spark, 4).join(v, "idx").groupBy(F.col("subset").cast("long").alias("subset"), "kind")
    return x.agg(F.count("*").alias("n_reps"), F.round(F.avg("x"), 6).alias("mean_x"))


@register("layer_transfer", f"WITH {SCORES}, {_PER}, b AS (SELECT subject, model, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, model) AS k FROM per WHERE kind = 'A') SELECT b.subject, b.model, round(b.score, 6) AS picked_on, round(p.score, 6) AS scored_on FROM b JOIN per p ON p.subject = b.subject AND p.model = b.model AND p.kind = 'R' WHERE k = 1")
def layer_transfer(spark, d):
    p = _per(spark, d)
    best = O.pick(p.where("kind = 'A'"), ["subject"], [F.desc("score"), F.col("model")], k=1).select("subject", "model", F.col("score").alias("picked_on"))
    x = best.join(p.where("kind = 'R'").select("subject", "model", F.col("score").alias("scored_on")), ["subject", "model"])
    return _rounded(x, "subject", "model")


@register("cohort_summary", f"WITH {SCORES}, {_PER}, c AS (SELECT 'all' AS cohort, * FROM per UNION ALL SELECT 'low', * FROM per WHERE subject < 3 UNION ALL SELECT 'first', * FROM per WHERE subject = 0) SELECT cohort, kind, count(*) AS n, round(avg(score), 6) AS mean FROM c GROUP BY 1, 2")
def cohort_summary(spark, d):
    # one scan: each row names the cohorts that it belongs to
    cohorts = F.filter(F.array(F.lit("all"), F.when(F.col("subject") < 3, "low"), F.when(F.col("subject") == 0, "first")), lambda c: c.isNotNull())
    x = _per(spark, d).withColumn("cohort", F.explode(cohorts))
    return x.groupBy("cohort", "kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@register("image_disagreement", f"WITH {FEAT}, {_rdm(_COS)}, z AS (SELECT grp, model, i, j, (d - avg(d) OVER w) / (stddev_pop(d) OVER w + 1e-10) AS z FROM rdm WINDOW w AS (PARTITION BY grp, model)), p AS (SELECT grp, i, j, var_pop(z) AS v FROM z GROUP BY 1, 2, 3), e AS (SELECT grp, i AS image, v FROM p UNION ALL SELECT grp, j, v FROM p) SELECT grp, image, round(avg(v), 6) AS disagreement FROM e GROUP BY 1, 2")
def image_disagreement(spark, d):
    return C.disagreement(features(spark, d), "cosine_floor").select("grp", "image", F.round("disagreement", 6).alias("disagreement"))


@register("equivalence_interval")
def equivalence_interval(spark, d):
    """Bootstrap interval of the leader's mean over subjects, and how many models' means lie inside."""
    p = _per(spark, d).where("kind = 'N'")
    mean = p.groupBy("model").agg(F.avg("score").alias("m"))
    top = mean.orderBy(F.desc("m"), "model").first()["model"]
    ci = I.bootstrap_ci(p.where(F.col("model") == top), "subject", "score", 500, seed=1)
    inside = mean.crossJoin(ci).where("m BETWEEN lo AND hi")  # the interval is one row
    return inside.agg(F.lit(top).alias("leader"), F.count("*").alias("n_inside"))


@register("sign_flip_test")
def sign_flip_test(spark, d):
    return I.permutation_p(_wide(spark, d), "subject", "a", "b")


def _readout(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("grp"), F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"))
    return e.select("grp", "image_id", F.slice("e", 1, DIM).alias("x"), F.slice("e", DIM + 1, 4).alias("y"))


@register("ridge_readout")
def ridge_readout(spark, d):
    return R.ridge_loo(_readout(spark, d))


@register("variance_partition")
def variance_partition(spark, d):
    return R.variance_partition(_readout(spark, d).withColumn("y", F.col("y")[0]), {"low": list(range(8)), "high": list(range(8, 16))})


@register("ood_distance")
def ood_distance(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.slice(F.col("embedding").cast("array<double>"), 1, DIM).alias("v"), "label")
    return R.mahalanobis(e, e.where("label < 5"))


@register("utility_by_noise", f"WITH {FEAT}, {_rdm(_COS)}, {_PAIR}, {_AGREE}, vr AS (SELECT grp, model, var_pop(d) AS var FROM rdm GROUP BY 1, 2), n AS (SELECT x AS noise FROM (VALUES (0.0), (0.01), (0.1)) t(x)), s AS (SELECT grp, model_a AS model, r FROM agree UNION ALL SELECT grp, model_b, r FROM agree) SELECT CAST(noise AS DOUBLE) AS noise, round(avg(r * sqrt(var / (var + noise + 1e-8))), 6) AS mean_r FROM s JOIN vr USING (grp, model), n GROUP BY 1")
def utility_by_noise(spark, d):
    m = _moments(spark, d)
    x = D.attenuated_levels(C.agreement(m), C.profiles(m), [0.0, 0.01, 0.1])
    return x.groupBy("noise").agg(F.round(F.avg("r"), 6).alias("mean_r"))


@register("noisy_recovery")
def noisy_recovery(spark, d):
    """d' and errors of noisy profiles against all clean ones, by group of images (seeded draws; no SQL counterpart)."""
    from ..operators.simulation import noisy_agreement

    cube = noisy_agreement(C.rows(features(spark, d), "cosine_floor"), 0.05, 20, seed=3).withColumn("sim", F.col("grp") * 1000 + F.col("draw"))
    return I.discriminability(I.margins(cube))


@register("bootstrap_means")
def bootstrap_means(spark, d):
    """Means over resampled subjects for each model and draw, by a join with an index table."""
    p = scores(spark, d).groupBy("subject", "model").agg(F.avg("score").alias("x"))
    draw = I.index_table(spark, 5, 5, 50, seed=2).select("draw", F.col("idx").cast("long").alias("subject"))
    return p.join(F.broadcast(draw), "subject").groupBy("model", "draw").agg(F.avg("x").alias("mean"))
