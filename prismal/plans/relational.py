"""Projection, join, aggregation, window and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import aggregate as A, scalar as S
from ..operators import tables as O
from .catalog import register, table
from .shared import SCORES, scores


@register("filter_and_in", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber IN (1, 3, 5)")
def filter_and_in(spark, d):
    x = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & F.col("l_linenumber").isin(1, 3, 5))
    return x.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")


@register("disjunctive_cap", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' OR l_linenumber < 3 GROUP BY 1")
def disjunctive_cap(spark, d):
    x = table(spark, d, "lineitem").where((F.col("l_returnflag") != "N") | (F.col("l_linenumber") < 3))
    return x.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))


@register("case_ladder", "SELECT p_partkey AS part_id, CASE WHEN p_size < 10 THEN 'low' WHEN p_size < 25 THEN 'mid' WHEN p_size < 40 THEN 'high' ELSE 'top' END AS band, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END AS in_roster FROM part")
def case_ladder(spark, d):
    size = F.col("p_size")
    band = F.when(size < 10, "low").when(size < 25, "mid").when(size < 40, "high").otherwise("top")
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), band.alias("band"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 1).otherwise(0).alias("in_roster"))


@register("guarded_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN round(c_acctbal / sqrt(c_acctbal - 5000), 6) END AS ratio FROM customer")
def guarded_ratio(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(S.positive_ratio(b, b - 5000), 6).alias("ratio"))


@register("finite_values", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, CASE WHEN event_type IN ('click', 'view') THEN 1.0 WHEN event_type = 'error' THEN 0.0 END AS flag FROM events")
def finite_values(spark, d):
    kind = F.col("event_type")
    x = F.when(kind == "error", F.lit(float("inf"))).otherwise(F.col("value"))
    flag = F.when(kind.isin("click", "view"), "Yes ").when(kind == "error", " FALSE").otherwise("?")
    return table(spark, d, "events").select("event_id", S.finite_or_null(x).alias("value"), S.to_flag(flag).alias("flag"))


@register("json_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_number(spark, d):
    return table(spark, d, "events").select("event_id", S.to_number(F.get_json_object("props", "$.k")).alias("k"))


@register("categories", "SELECT lower(trim(coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ' ' || c_mktsegment || ' ' END, 'missing'))) AS segment, count(*) AS n FROM customer GROUP BY 1")
def categories(spark, d):
    raw = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return table(spark, d, "customer").groupBy(S.category(raw).alias("segment")).agg(F.count("*").alias("n"))


@register("pair_key_parts", "SELECT p_partkey, split_part(p_brand || '||' || p_type, '||', 1) AS a, split_part(p_brand || '||' || p_type, '||', 2) AS b FROM part")
def pair_key_parts(spark, d):
    key = F.concat_ws("||", "p_brand", "p_type")
    return table(spark, d, "part").select("p_partkey", S.pair_part(key, 0).alias("a"), S.pair_part(key, 1).alias("b"))


@register("regex_parts", r"SELECT p_partkey, CAST(regexp_extract(p_brand, '([A-Za-z]+)#(\d+)', 2) AS BIGINT) AS number, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS safe, CASE WHEN regexp_extract(p_name, '^(\w+) (\w+)$', 1) = 'red' THEN 'warm' ELSE 'other' END AS tone FROM part")
def regex_parts(spark, d):
    tone = F.when(F.regexp_extract("p_name", r"^(\w+) (\w+)$", 1) == "red", "warm").otherwise("other")
    return table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"([A-Za-z]+)#(\d+)", 2).cast("long").alias("number"), S.safe_name(F.col("p_name")).alias("safe"), tone.alias("tone"))


@register("substring_rules", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'round' WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'bolt') THEN 'fastener' ELSE 'other' END AS family FROM part")
def substring_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", S.first_match(F.col("p_name"), [("ring", "round"), ("red", "red"), ("bolt", "fastener")], "other").alias("family"))


@register("natural_order", r"SELECT brand, row_number() OVER (ORDER BY CAST(regexp_extract(brand, '(\d+)', 1) AS BIGINT)) AS place FROM (SELECT DISTINCT p_brand AS brand FROM part)")
def natural_order(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("brand")).distinct()
    # a list of names: few rows, ranked as a whole
    return brands.select("brand", F.row_number().over(Window.orderBy(S.natural_key(F.col("brand")))).cast("long").alias("place"))


_STOP = ("the", "and", "that")


@register(
    "token_sets",
    r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9_''-]{2,}'), lambda x: trim(x, '_''-')), lambda x: x NOT IN ('the', 'and', 'that'))) AS ws FROM documents WHERE text IS NOT NULL)
SELECT word, count(*) AS n_docs FROM w, unnest(ws) AS u(word) GROUP BY word""",
)
def token_sets(spark, d):
    docs = table(spark, d, "documents").select(F.explode(S.tokens(F.col("text"), _STOP)).alias("word"))
    return docs.groupBy("word").agg(F.count("*").alias("n_docs"))


@register("joined_text", "SELECT p_brand AS brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS kinds, max(p_name || ' ' || p_type) AS last_text FROM part GROUP BY 1")
def joined_text(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("kinds"), F.max(F.concat_ws(" ", "p_name", "p_type")).alias("last_text"))


@register("math_columns", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln_p, round(log2(o_totalprice), 6) AS log2_p, round(log10(o_totalprice), 6) AS log10_p, round(sqrt(o_totalprice), 6) AS root, CAST(sign(o_totalprice - 200000) AS DOUBLE) AS side, least(greatest(o_totalprice, 1000.0), 300000.0) AS clipped FROM orders")
def math_columns(spark, d):
    p = F.col("o_totalprice")
    cols = {"ln_p": F.log(p), "log2_p": F.log2(p), "log10_p": F.log10(p), "root": F.sqrt(p)}
    return table(spark, d, "orders").select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in cols.items()], F.signum(p - 200000).alias("side"), S.clip(p, 1000.0, 300000.0).alias("clipped"))


@register("index_lists", "SELECT n_nationkey AS id, CAST(x AS BIGINT) AS x FROM (SELECT n_nationkey, unnest(list_concat([n_nationkey], range(n_nationkey + 2, n_nationkey + 5))) AS x FROM nation)")
def index_lists(spark, d):
    k = F.col("n_nationkey")
    text = F.concat(k.cast("string"), F.lit(","), (k + 2).cast("string"), F.lit("-"), (k + 4).cast("string"))
    return table(spark, d, "nation").select(k.alias("id"), F.explode(S.index_list(text).cast("array<long>")).alias("x"))


@register("one_hot_levels", "SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END AS is_large, CASE WHEN p_type = 'MEDIUM' THEN 1 ELSE 0 END AS is_medium, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS is_promo, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS is_small, CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END AS is_standard FROM part")
def one_hot_levels(spark, d):
    return table(spark, d, "part").select("p_partkey", *S.one_hot(F.col("p_type"), ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]))


@register("label_parts", "SELECT c_custkey, split_part(c_name, '#', 1) AS grp, CAST(split_part(c_name, '#', 2) AS BIGINT) - 1 AS idx FROM customer")
def label_parts(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", r"^(\w+)#(\d+)$", 1).alias("grp"), (F.regexp_extract("c_name", r"^(\w+)#(\d+)$", 2).cast("long") - 1).alias("idx"))


# joins


@register("attach_ceiling", f"WITH {SCORES}, c AS (SELECT subject, model_set, avg(score) AS ceiling FROM scores WHERE kind = 'N' AND boot < 4 AND subject < 4 GROUP BY 1, 2) SELECT s.subject, s.model_set, s.kind, count(*) AS n, round(avg(s.score / sqrt(ceiling)), 6) AS normed FROM scores s LEFT JOIN c USING (subject, model_set) GROUP BY 1, 2, 3")
def attach_ceiling(spark, d):
    s = scores(spark, d)
    ceiling = s.where("kind = 'N' AND boot < 4 AND subject < 4").groupBy("subject", "model_set").agg(F.avg("score").alias("ceiling"))
    out = O.attach(s, ceiling, ["subject", "model_set"]).withColumn("x", S.positive_ratio(F.col("score"), F.col("ceiling")))
    return out.groupBy("subject", "model_set", "kind").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("normed"))


_PER = "per AS (SELECT subject, model, kind, avg(score) AS score FROM scores GROUP BY 1, 2, 3)"


def _per(spark, d):
    return scores(spark, d).groupBy("subject", "model", "kind").agg(F.avg("score").alias("score"))


@register("common_models", f"WITH {SCORES}, {_PER} SELECT a.subject, count(*) AS n_common, round(avg(a.score), 6) AS mean_a, round(avg(b.score), 6) AS mean_b FROM per a JOIN per b ON a.subject = b.subject AND a.model = b.model WHERE a.kind = 'A' AND b.kind = 'R' GROUP BY 1 HAVING count(*) >= 2")
def common_models(spark, d):
    p = _per(spark, d)
    out = O.common_mean(p.where("kind = 'A'"), p.where("kind = 'R'"), ["subject", "model"], ["subject"], "score")
    return out.select("subject", "n_common", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@register("outer_summaries", "WITH a AS (SELECT o_custkey AS k, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, n_open, n_done FROM a FULL JOIN b ON a.k = b.k")
def outer_summaries(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.where("o_orderstatus = 'O'").groupBy("k").agg(F.count("*").alias("n_open"))
    return a.join(o.where("o_orderstatus = 'F'").groupBy("k").agg(F.count("*").alias("n_done")), "k", "full")


@register("semi_anti", "SELECT (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    done = c.join(o, "c_custkey", "left_semi").select(F.lit(1).alias("y"))
    todo = c.join(o, "c_custkey", "left_anti").select(F.lit(0).alias("y"))
    return done.unionAll(todo).agg(F.sum("y").alias("with_orders"), F.sum(1 - F.col("y")).alias("without_orders"))


@register("model_pairs", f"WITH {SCORES}, {_PER} SELECT a.subject, a.model AS key_a, b.model AS key_b, round(a.score - b.score, 6) AS diff FROM per a JOIN per b ON a.subject = b.subject AND a.model < b.model WHERE a.kind = 'R' AND b.kind = 'R'")
def model_pairs(spark, d):
    return O.self_pairs(_per(spark, d).where("kind = 'R'"), ["subject"], "model", "score").select("subject", "key_a", "key_b", F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@register("set_assignments", "SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM range(3) x(a), range(3) y(b), range(3) z(c)")
def set_assignments(spark, d):
    three = F.sequence(F.lit(0), F.lit(2)).cast("array<long>")  # n_sets ** n_subjects rows, by explodes
    return spark.range(1).select(F.explode(three).alias("a")).select("a", F.explode(three).alias("b")).select("a", "b", F.explode(three).alias("c"))


@register("nearest_sizes", "SELECT kind, part_id, rank FROM (SELECT p_type AS kind, p_partkey AS part_id, row_number() OVER (PARTITION BY p_type ORDER BY abs(p_retailprice - 950), p_partkey) AS rank FROM part) WHERE rank <= 5")
def nearest_sizes(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("part_id"), "p_retailprice")
    return O.pick(p, ["kind"], [F.abs(F.col("p_retailprice") - 950), F.col("part_id")], k=5).select("kind", "part_id", F.col("rank").cast("long").alias("rank"))


# aggregation


@register("named_aggregates", f"WITH {SCORES} SELECT model, kind, round(avg(score), 8) AS mean, round(stddev_samp(score) / sqrt(count(score)), 6) AS sem, count(DISTINCT subject) AS n_subjects, count(*) AS n, min(model_set) AS first_set FROM scores GROUP BY 1, 2")
def named_aggregates(spark, d):
    s = F.col("score")
    return scores(spark, d).groupBy("model", "kind").agg(F.round(F.avg(s), 8).alias("mean"), F.round(A.sem(s), 6).alias("sem"), F.countDistinct("subject").alias("n_subjects"), F.count("*").alias("n"), F.min("model_set").alias("first_set"))


@register("two_stage_means", f"WITH {SCORES}, a AS (SELECT model, subject, avg(score) AS m FROM scores GROUP BY 1, 2) SELECT model, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS n FROM a GROUP BY 1")
def two_stage_means(spark, d):
    return O.two_stage_mean(scores(spark, d), ["model", "subject"], ["model"], "score").select("model", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@register("value_shares", "SELECT event_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def value_shares(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row a category
    return n.select("event_type", "n", F.round(F.col("n") / total, 6).alias("share"))


@register(
    "spread_metrics",
    f"""WITH {SCORES}, {_PER}, pairs AS (SELECT a.subject, a.kind, abs(a.score - b.score) AS x FROM per a JOIN per b ON a.subject = b.subject AND a.kind = b.kind AND a.model < b.model),
g AS (SELECT subject, kind, avg(x) AS gini FROM pairs GROUP BY 1, 2)
SELECT p.subject, p.kind, round(max(score) - min(score), 6) AS span, round(stddev_samp(score), 6) AS sd, round(stddev_samp(score) / avg(score), 6) AS cv,
  round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) AS iqr, round(any_value(gini), 6) AS gini
FROM per p JOIN g ON p.subject = g.subject AND p.kind = g.kind GROUP BY 1, 2""",
)
def spread_metrics(spark, d):
    s = F.col("score")
    cols = {"span": F.max(s) - F.min(s), "sd": F.stddev_samp(s), "cv": A.coefficient_of_variation(s), "iqr": A.iqr(s), "gini": A.mean_pair_distance(s)}
    return _per(spark, d).groupBy("subject", "kind").agg(*[F.round(c, 6).alias(n) for n, c in cols.items()])


@register("weighted_means", "SELECT l_returnflag AS kind, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wmean FROM lineitem GROUP BY 1")
def weighted_means(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("wmean"))


@register("arg_extremes", f"WITH {SCORES}, {_PER}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, kind ORDER BY score DESC, model) AS hi, row_number() OVER (PARTITION BY subject, kind ORDER BY score, model) AS lo FROM per) SELECT subject, kind, max(CASE WHEN hi = 1 THEN model END) AS best, max(CASE WHEN lo = 1 THEN model END) AS worst FROM r GROUP BY 1, 2")
def arg_extremes(spark, d):
    # extremes of (score, name): no sort and no tie left open
    p = _per(spark, d)
    best = F.min(F.struct((-F.col("score")).alias("x"), "model"))["model"]
    worst = F.min(F.struct(F.col("score").alias("x"), "model"))["model"]
    return p.groupBy("subject", "kind").agg(best.alias("best"), worst.alias("worst"))


@register("boolean_folds", f"WITH {SCORES}, {_PER} SELECT model, bool_and(score > 0.28) AS all_high, bool_or(score > 0.33) AS any_top, sum(CASE WHEN score < 0.3 THEN 1 ELSE 0 END)::BIGINT AS n_low FROM per GROUP BY 1")
def boolean_folds(spark, d):
    s = F.col("score")
    return _per(spark, d).groupBy("model").agg(F.bool_and(s > 0.28).alias("all_high"), F.bool_or(s > 0.33).alias("any_top"), F.sum(F.when(s < 0.3, 1).otherwise(0)).alias("n_low"))


@register("quantile_flag", "WITH q AS (SELECT p_type, quantile_cont(p_retailprice, 0.75) AS cut FROM part GROUP BY 1) SELECT p_type, count(*) AS n_over FROM part JOIN q USING (p_type) WHERE p_retailprice > cut GROUP BY 1")
def quantile_flag(spark, d):
    p = table(spark, d, "part")
    cut = p.groupBy("p_type").agg(F.percentile("p_retailprice", F.lit(0.75)).alias("cut"))
    return p.join(cut, "p_type").where("p_retailprice > cut").groupBy("p_type").agg(F.count("*").alias("n_over"))


@register("leave_one_out_means", f"WITH {SCORES}, u AS (SELECT DISTINCT kind, subject AS left_out FROM scores) SELECT u.kind, u.left_out, round(avg(score), 6) AS mean_rest FROM u JOIN scores s ON s.kind = u.kind AND s.subject <> u.left_out GROUP BY 1, 2")
def leave_one_out_means(spark, d):
    return O.leave_one_out(scores(spark, d), ["kind"], "subject", "score").select("kind", "left_out", F.round("mean_rest", 6).alias("mean_rest"))


@register("pooled_scopes", f"WITH {SCORES} SELECT coalesce(model_set, 'all') AS scope, kind, count(*) AS n, round(avg(score), 6) AS mean FROM scores GROUP BY GROUPING SETS ((kind), (model_set, kind))")
def pooled_scopes(spark, d):
    s = scores(spark, d).groupingSets([["kind"], ["model_set", "kind"]], "model_set", "kind")
    return s.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")).select(F.coalesce("model_set", F.lit("all")).alias("scope"), "kind", "n", "mean")


@register("pivot_scores", f"WITH {SCORES} SELECT model, round(avg(CASE WHEN kind = 'A' THEN score END), 6) AS a, round(avg(CASE WHEN kind = 'N' THEN score END), 6) AS n, round(avg(CASE WHEN kind = 'R' THEN score END), 6) AS r FROM scores GROUP BY 1")
def pivot_scores(spark, d):
    wide = scores(spark, d).groupBy("model").pivot("kind", ["A", "N", "R"]).agg(F.avg("score"))
    return wide.select("model", *[F.round(k, 6).alias(k.lower()) for k in "ANR"])


@register("count_crosstab", "SELECT event_type, CAST(count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS BIGINT) AS g0, CAST(count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS BIGINT) AS g1, CAST(count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS BIGINT) AS g2 FROM events GROUP BY 1")
def count_crosstab(spark, d):
    e = table(spark, d, "events").withColumn("g", F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")))
    return e.groupBy("event_type").pivot("g", ["g0", "g1", "g2"]).agg(F.count("user_id")).fillna(0)


@register("melted", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def melted(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_tax", "l_discount")
    return x.unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "variable", "value")


@register("column_correlations", "SELECT l_returnflag AS kind, round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_discount, l_tax), 6) AS dt FROM lineitem GROUP BY 1")
def column_correlations(spark, d):
    c = F.col
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("kind")).agg(F.round(A.correlation(c("l_quantity"), c("l_extendedprice")), 6).alias("qp"), F.round(A.correlation(c("l_discount"), c("l_tax")), 6).alias("dt"))


@register(
    "prevalence_shifts",
    """WITH x AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)), t AS (SELECT quality, count(DISTINCT doc_id) AS total FROM x GROUP BY 1),
c AS (SELECT source, count(DISTINCT CASE WHEN quality = 1 THEN doc_id END) AS n_a, count(DISTINCT CASE WHEN quality = 0 THEN doc_id END) AS n_b FROM x GROUP BY 1)
SELECT source, n_a, n_b, round(n_a * 1.0 / (SELECT total FROM t WHERE quality = 1) - n_b * 1.0 / (SELECT total FROM t WHERE quality = 0), 6) AS shift FROM c WHERE n_a >= 3 OR n_b >= 6""",
)
def prevalence_shifts(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").withColumnRenamed("doc_id", "row")
    return O.prevalence_shift(x, "source", "quality").select("source", "n_a", "n_b", F.round("shift", 6).alias("shift"))


@register("value_histogram", "SELECT CAST(least(floor(l_quantity / 5.0), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def value_histogram(spark, d):
    return O.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10)


@register("filter_audit", "SELECT source, count(*) AS n, round(avg(CASE WHEN n_chars >= 500 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, sum(CASE WHEN n_chars < 500 THEN 1 ELSE 0 END)::BIGINT AS too_short, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS median_chars FROM documents GROUP BY 1")
def filter_audit(spark, d):
    ok = F.col("n_chars") >= 500
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("pass_rate"), F.sum(F.when(ok, 0).otherwise(1)).alias("too_short"), F.median(F.col("n_chars").cast("double")).alias("median_chars"))


@register("last_by_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_by_key(spark, d):
    return O.dedupe(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@register("repeated_keys", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return O.duplicate_keys(table(spark, d, "orders"), ["o_custkey"])


# ordering, windows and sets


@register("top_k_delta", f"WITH {SCORES}, {_PER}, top AS (SELECT subject, model, score, row_number() OVER (PARTITION BY subject ORDER BY score DESC, model) AS rank FROM per WHERE kind = 'N') SELECT t.subject, t.model, CAST(t.rank AS BIGINT) AS rank, round(p.score - t.score, 6) AS delta FROM top t JOIN per p ON p.subject = t.subject AND p.model = t.model AND p.kind = 'R' WHERE t.rank <= 10")
def top_k_delta(spark, d):
    p = _per(spark, d)
    top = O.pick(p.where("kind = 'N'"), ["subject"], [F.desc("score"), F.col("model")], k=10).select("subject", "model", "rank", F.col("score").alias("base"))
    return top.join(p.where("kind = 'R'"), ["subject", "model"]).select("subject", "model", F.col("rank").cast("long").alias("rank"), F.round(F.col("score") - F.col("base"), 6).alias("delta"))


@register("tied_ranks", "SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0 AS avg_rank, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) - 1 AS BIGINT) AS ordinal FROM part")
def tied_ranks(spark, d):
    kind, size = F.col("p_type"), F.col("p_size")
    ordinal = F.row_number().over(Window.partitionBy(kind).orderBy(size, "p_partkey")) - 1
    return table(spark, d, "part").select("p_partkey", "p_type", O.average_rank(size, [kind]).alias("avg_rank"), ordinal.cast("long").alias("ordinal"))


@register("gain_crossing", "WITH e AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, sum(value) OVER (PARTITION BY user_id) AS total, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, CAST(min(CASE WHEN run >= 0.5 * total THEN k END) AS BIGINT) AS half_at, CAST(min(CASE WHEN run >= 0.9 * total THEN k END) AS BIGINT) AS most_at, round(max(value - prev), 6) AS top_step FROM e GROUP BY 1")
def gain_crossing(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = table(spark, d, "events").select("user_id", (F.col("value") - F.lag("value").over(w)).alias("step"), run.alias("run"), F.sum("value").over(Window.partitionBy("user_id")).alias("total"), F.row_number().over(w).cast("long").alias("k"))
    at = lambda share: F.min(F.when(F.col("run") >= share * F.col("total"), F.col("k")))
    return e.groupBy("user_id").agg(at(0.5).alias("half_at"), at(0.9).alias("most_at"), F.round(F.max("step"), 6).alias("top_step"))


@register("percentiles_of", "SELECT p_partkey, round(100.0 * (SELECT count(*) FROM part b WHERE b.p_type = a.p_type AND b.p_size < a.p_size) / count(*) OVER (PARTITION BY p_type), 6) AS pct_left, round(100.0 * count(*) OVER (PARTITION BY p_type ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY p_type), 6) AS pct_right FROM part a")
def percentiles_of(spark, d):
    w, whole = Window.partitionBy("p_type").orderBy("p_size"), Window.partitionBy("p_type")
    n = F.count("*").over(whole)
    left, right = F.rank().over(w) - 1, F.count("*").over(w.rangeBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "part").select("p_partkey", F.round(100.0 * left / n, 6).alias("pct_left"), F.round(100.0 * right / n, 6).alias("pct_right"))


@register("group_z", "SELECT p_partkey, round((p_size - avg(p_size) OVER w) / stddev_pop(p_size) OVER w, 6) AS z, round((p_size - min(p_size) OVER w) / (max(p_size) OVER w - min(p_size) OVER w + 1e-6), 6) AS scaled, round((sum(p_size) OVER w - p_size) * 1.0 / (count(*) OVER w - 1), 6) AS loo FROM part WINDOW w AS (PARTITION BY p_type)")
def group_z(spark, d):
    w, x = Window.partitionBy("p_type"), F.col("p_size")
    z = (x - F.avg(x).over(w)) / F.stddev_pop(x).over(w)
    scaled = (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-6)
    loo = (F.sum(x).over(w) - x) / (F.count("*").over(w) - 1)
    return table(spark, d, "part").select("p_partkey", F.round(z, 6).alias("z"), F.round(scaled, 6).alias("scaled"), F.round(loo, 6).alias("loo"))


@register("repetition_halves", "SELECT o_custkey, round(avg(CASE WHEN k % 2 = 1 THEN o_totalprice END), 6) AS odd, round(avg(CASE WHEN k % 2 = 0 OR n < 2 THEN o_totalprice END), 6) AS even FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) GROUP BY 1")
def repetition_halves(spark, d):
    w = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", F.row_number().over(w.orderBy("o_orderkey")).alias("k"), F.count("*").over(w).alias("n"))
    odd = F.when(F.col("k") % 2 == 1, F.col("o_totalprice"))
    even = F.when((F.col("k") % 2 == 0) | (F.col("n") < 2), F.col("o_totalprice"))
    return o.groupBy("o_custkey").agg(F.round(F.avg(odd), 6).alias("odd"), F.round(F.avg(even), 6).alias("even"))


@register("rolling_mean", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events")
def rolling_mean(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


@register("union_by_name", "SELECT 'customer' AS origin, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    return O.union_all([c, s]).select("origin", "nation", "bal", "segment")


@register("set_overlap", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2), i AS (SELECT count(*) AS n FROM a JOIN b USING (k)), u AS (SELECT count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b)) SELECT i.n AS n_both, u.n AS n_any, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, round(i.n * 1.0 / u.n, 6) AS jaccard FROM i, u")
def set_overlap(spark, d):
    line = table(spark, d, "lineitem")
    a = line.where("l_returnflag = 'A' AND l_linenumber = 1").select(F.col("l_partkey").alias("k"), F.lit(1).alias("a"))
    b = line.where("l_returnflag = 'R' AND l_linenumber = 2").select(F.col("l_partkey").alias("k"), F.lit(1).alias("b"))
    # one pass for intersection, union and difference
    marks = O.union_all([a, b]).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    both = F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0))
    only = F.sum(F.when(F.col("b").isNull(), 1).otherwise(0))
    return marks.agg(both.alias("n_both"), F.count("*").alias("n_any"), only.alias("only_a"), F.round(F.coalesce(F.try_divide(both, F.count("*")), F.lit(0.0)), 6).alias("jaccard"))


@register("windowed_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    from ..streaming.scores import windowed_means

    return windowed_means(table(spark, d, "events")).withColumn("mean", F.round("mean", 6))
