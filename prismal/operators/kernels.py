"""Distance profiles of feature tables and their comparison.

A feature table is long: (grp, model, image_id, v ARRAY<DOUBLE>). A distance profile has one row for
each model and unordered pair of a group's images, (grp, model, i, j, d) with i < j. All kernels here are
built-in expressions; pairs come from an equi-join on group, model and pair of blocks of images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.aggregate import correlation

#: Images of a group that one task compares with as many others, and cells that a profile's ranks are taken in.
BLOCK, CELLS = 512, 4096
METRICS = ("cosine", "cosine_floor", "correlation", "correlation_safe", "correlation_scaled", "euclidean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def prepared(features: DataFrame, metric: str) -> DataFrame:
    """Vectors for which the metric is a function of one dot product, computed once for each image."""
    v, n = F.col("v"), F.size("v").cast("double")
    if metric == "cosine":
        return features.withColumn("v", F.transform(v, lambda x: x / (F.sqrt(dot(v, v)) + 1e-9)))
    if metric == "cosine_floor":
        return features.withColumn("v", F.transform(v, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))))
    if metric == "correlation":
        centred = features.withColumn("_m", total(v) / n).withColumn("v", F.transform(v, lambda x: x - F.col("_m"))).drop("_m")
        return centred.withColumn("_s", F.sqrt(dot(v, v))).withColumn("v", F.transform(v, lambda x: F.when(F.col("_s") > 0, x / F.col("_s")))).drop("_s")
    if metric == "correlation_safe":  # a constant or non-finite vector correlates with nothing
        centred = features.withColumn("_m", total(v) / n).withColumn("v", F.transform(v, lambda x: x - F.col("_m"))).drop("_m")
        scaled = centred.withColumn("_s", F.sqrt(dot(v, v)))
        ok = (F.col("_s") > 1e-6) & (F.col("_s") < float("inf"))  # NaN is above infinity
        return scaled.withColumn("v", F.transform(v, lambda x: F.when(ok, x / F.col("_s")).otherwise(0.0))).drop("_s")
    if metric == "correlation_scaled":  # z-scores by the sample deviation, product divided by the dimension
        centred = features.withColumn("_m", total(v) / n).withColumn("v", F.transform(v, lambda x: x - F.col("_m"))).drop("_m")
        return centred.withColumn("_s", F.sqrt(dot(v, v) / (n - 1)) + 1e-9).withColumn("v", F.transform(v, lambda x: x / F.col("_s") / F.sqrt(n))).drop("_s")
    if metric == "euclidean":
        return features
    raise ValueError(f"metric: {metric}")


def _distances(pairs: DataFrame, metric: str, *keys: str) -> DataFrame:
    """(keys, d) of pairs of vectors va, vb; null where a vector or a component is null or the lengths differ."""
    if metric == "euclidean":
        return pairs.select(*keys, F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)).alias("d"))
    x, s = pairs.select(*keys, dot(F.col("va"), F.col("vb")).alias("_s")), F.col("_s")
    clipped = F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(-1.0)), F.lit(1.0)))  # greatest skips nulls
    return x.select(*keys, (1 - (clipped if metric.startswith("cosine") else s)).alias("d"))


def _blocks(features: DataFrame) -> int:
    """Blocks that the images of the largest group are dealt into, so that a task meets BLOCK of them with as many others."""
    most = features.groupBy("grp", "model").count().agg(F.max("count").alias("n")).first()["n"]
    return max(1, -(-(most or 0) // BLOCK))


def met(features: DataFrame, n: int) -> DataFrame:
    """features once for each of n blocks that an image's own block meets: plus _own, and _lo <= _hi, the pair of blocks."""
    own = F.pmod(F.xxhash64("image_id"), F.lit(n)).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.least(k, own).alias("lo"), F.greatest(k, own).alias("hi"))))
    return features.select("*", own.alias("_own"), pairs.alias("_b")).select(*features.columns, "_own", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))


def image_pairs(features: DataFrame) -> DataFrame:
    """(grp, model, i, j, va, vb) for all pairs i < j of a group: an equi-join on group, model and pair of blocks."""
    x = met(features, _blocks(features))
    a = x.select("grp", "model", "_lo", "_hi", F.col("_own").alias("_oa"), F.col("image_id").alias("i"), F.col("v").alias("va"))
    b = x.select("grp", "model", "_lo", "_hi", F.col("_own").alias("_ob"), F.col("image_id").alias("j"), F.col("v").alias("vb"))
    once = (F.col("_lo") == F.col("_hi")) | (F.col("_oa") != F.col("_ob"))  # images of one block meet where it meets itself only
    return a.join(b, ["grp", "model", "_lo", "_hi"]).where("i < j").where(once).drop("_lo", "_hi", "_oa", "_ob")


def distance_profile(features: DataFrame, metric: str = "cosine") -> DataFrame:
    """(grp, model, i, j, d) for all pairs i < j of a group."""
    return _distances(image_pairs(prepared(features, metric)), metric, "grp", "model", "i", "j")


def z_scored(features: DataFrame) -> DataFrame:
    """(grp, model, image_id, v) with z-scores of each vector's components (population deviation, at least 1e-12)."""
    v, n = F.col("v"), F.size("v").cast("double")
    x = features.withColumn("_m", total(v) / n).withColumn("v", F.transform(v, lambda x: x - F.col("_m")))
    x = x.withColumn("_s", F.greatest(F.sqrt(dot(v, v) / n), F.lit(1e-12))).withColumn("v", F.transform(v, lambda x: x / F.col("_s")))
    return x.select("grp", "model", "image_id", "v")


def similarity_profile(features: DataFrame) -> DataFrame:
    """(grp, model, i, j, d): products of z-scored vectors (population deviation, at least 1e-12) over their dimension minus one."""
    return image_pairs(z_scored(features)).select("grp", "model", "i", "j", (dot(F.col("va"), F.col("vb")) / (F.size("va") - 1)).alias("d"))


def chunked_cosine(features: DataFrame, chunk: str) -> DataFrame:
    """(grp, i, j, d): cosine distances of vectors that come in chunks, from sums of the chunks' products; similarity 0 where a norm vanishes."""
    norms = features.groupBy("grp", "image_id").agg(F.sum(dot(F.col("v"), F.col("v"))).alias("_n"))
    a = features.select("grp", chunk, F.col("image_id").alias("i"), F.col("v").alias("va"))
    b = features.select("grp", chunk, F.col("image_id").alias("j"), F.col("v").alias("vb"))
    dots = a.join(b, ["grp", chunk]).where("i < j").groupBy("grp", "i", "j").agg(F.sum(dot(F.col("va"), F.col("vb"))).alias("_ab"))
    x = dots.join(norms.select("grp", F.col("image_id").alias("i"), F.col("_n").alias("_aa")), ["grp", "i"]).join(norms.select("grp", F.col("image_id").alias("j"), F.col("_n").alias("_bb")), ["grp", "j"])
    den = F.sqrt(F.col("_aa") * F.col("_bb"))
    return x.select("grp", "i", "j", (1 - F.when(den > 1e-24, F.col("_ab") / den).otherwise(0.0)).alias("d"))


def candidate_distances(candidates: DataFrame, selected: DataFrame, metric: str = "cosine") -> DataFrame:
    """(model, candidate, image, d): every candidate against every selected image of its model.

    The selected set is the small side of a selection step (tens of rows a model).
    """
    a = prepared(candidates, metric).select("model", F.col("image_id").alias("candidate"), F.col("v").alias("va"))
    b = prepared(selected, metric).select("model", F.col("image_id").alias("image"), F.col("v").alias("vb"))
    return _distances(a.join(b, "model").where("candidate <> image"), metric, "model", "candidate", "image")


def ranked(profile: DataFrame, method: str = "average") -> DataFrame:
    """d replaced by its rank within (grp, model): ties averaged (from 1), or in the order of (i, j) (from 0).

    Ranks are taken within stretches of d (a monotone function of it, in CELLS cells) and raised by the counts of the
    stretches before, so no task sorts a whole profile.
    """
    if method not in ("average", "ordinal"):
        raise ValueError(f"rank method: {method}")
    d = F.col("d")
    cell = F.floor(CELLS * (d / (1 + F.abs(d)) + 1)).cast("int")
    x = profile.withColumn("_cell", F.coalesce(F.when(~F.isnan(d), cell), F.lit(4 * CELLS))).repartition("grp", "model", "_cell")
    counts = x.groupBy("grp", "model", "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("grp", "model").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    part = Window.partitionBy("grp", "model", "_cell")
    if method == "average":
        last = F.count(F.lit(1)).over(part.orderBy("d").rangeBetween(Window.unboundedPreceding, 0))
        r = (F.rank().over(part.orderBy("d")) + last) / F.lit(2.0)
    else:
        r = (F.row_number().over(part.orderBy("d", "i", "j")) - 1).cast("double")
    own = x.withColumn("_r", r)
    before = before.select("grp", "model", "_cell", F.coalesce("_before", F.lit(0)).alias("_before"))
    return own.join(before, ["grp", "model", "_cell"]).withColumn("d", F.col("_r") + F.col("_before")).drop("_r", "_before", "_cell")


def pair_rows(profile: DataFrame) -> DataFrame:
    """(grp, i, j, models, d), the models in order, of a profile; one that is in this form already (cells.rows) stays."""
    if "models" in profile.columns:
        return profile
    row = profile.groupBy("grp", "i", "j").agg(F.array_sort(F.collect_list(F.struct("model", "d"))).alias("_m"))  # one entry a model
    return row.select("grp", "i", "j", F.transform("_m", lambda m: m["model"]).alias("models"), F.transform("_m", lambda m: m["d"]).alias("d"))


def profile_pairs(profile: DataFrame) -> DataFrame:
    """(grp, model_a, model_b, i, j, da, db): two models' distances of the same image pair, from one grouping by image pair."""
    row = profile.groupBy("grp", "i", "j").agg(F.array_sort(F.collect_list(F.struct("model", "d"))).alias("_m"))  # one entry a model

    def others(x, k):
        return F.transform(F.slice("_m", k + 2, F.size("_m")), lambda y: F.struct(x["model"].alias("model_a"), y["model"].alias("model_b"), x["d"].alias("da"), y["d"].alias("db")))

    pairs = F.explode(F.flatten(F.transform("_m", others))).alias("_p")
    return row.select("grp", "i", "j", pairs).select("grp", "_p.model_a", "_p.model_b", "i", "j", "_p.da", "_p.db")


def agreement(profile: DataFrame, method: str = "spearman", rank_method: str = "average") -> DataFrame:
    """(grp, model_a, model_b, n, r): correlation of distance profiles; null where one is constant."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"method: {method}")
    x = ranked(profile, rank_method) if method == "spearman" else profile
    return profile_pairs(x).groupBy("grp", "model_a", "model_b").agg(F.count("*").alias("n"), correlation(F.col("da"), F.col("db")).alias("r"))


def total_agreement(profile: DataFrame) -> DataFrame:
    """Agreement that is always a number: 1 where both profiles are constant, 0 where one is or none has pairs."""
    both = profile_pairs(profile).groupBy("grp", "model_a", "model_b")
    x, y = F.col("da"), F.col("db")
    vx, vy = F.var_pop(x), F.var_pop(y)
    r = F.when((vx == 0) & (vy == 0), 1.0).when((vx == 0) | (vy == 0), 0.0).otherwise(F.covar_pop(x, y) / F.sqrt(vx * vy))
    return both.agg(F.coalesce(r, F.lit(0.0)).alias("r"))


def symmetric(agreements: DataFrame) -> DataFrame:
    """Both directions of each pair of models, as (grp, model, other, r)."""
    a = agreements.select("grp", F.col("model_a").alias("model"), F.col("model_b").alias("other"), "r")
    return a.unionAll(agreements.select("grp", F.col("model_b").alias("model"), F.col("model_a").alias("other"), "r"))


def encode(features: DataFrame, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """v replaced by v W + b; the weights are a fixed matrix (one list for each output)."""
    outs = [dot(F.col("v"), F.array(*map(F.lit, w))) + F.lit(b) for w, b in zip(weights, bias)]
    return features.withColumn("v", F.array(*outs))


def spread(profile: DataFrame) -> DataFrame:
    """(grp, model, spread): population deviation of each profile."""
    return profile.groupBy("grp", "model").agg(F.stddev_pop("d").alias("spread"))


def equivalent_models(features: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(model, class): models whose vectors agree within the tolerance on every image share the least name."""
    a = features.select("image_id", F.col("model").alias("a"), F.col("v").alias("va"))
    b = features.select("image_id", F.col("model").alias("b"), F.col("v").alias("vb"))
    gap = F.when(F.size("va") == F.size("vb"), F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y))))
    same = a.join(b, "image_id").groupBy("a", "b").agg(F.bool_and(F.coalesce(gap <= tolerance, F.lit(False))).alias("same"))
    return same.where("same").groupBy(F.col("a").alias("model")).agg(F.min("b").alias("class"))
