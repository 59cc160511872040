"""The long score table that the relational queries share, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import table

#: CTE `scores(subject, model_set, model, kind, boot, score)` for the SQL side.
SCORES = """scores AS (
  SELECT CAST(n_regionkey AS BIGINT) AS subject, l_linestatus AS model_set, p_brand AS model, l_returnflag AS kind,
    CAST(l_linenumber AS BIGINT) AS boot, l_discount + l_quantity / 100.0 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score for each subject, model set, model, kind and bootstrap draw (several rows each)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        F.col("n_regionkey").cast("long").alias("subject"), F.col("l_linestatus").alias("model_set"), F.col("p_brand").alias("model"),
        F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("long").alias("boot"), (F.col("l_discount") + F.col("l_quantity") / 100.0).alias("score"),
    )
