"""Writing result tables so that a repeated run adds nothing twice."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from .readers import exists


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces a table; Spark's commit protocol makes it visible as a whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table does not hold yet."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.dropDuplicates(keys).write.mode("append").parquet(path)


def pending(todo: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The rows of todo that a result table does not cover: what a resumed run has left to do."""
    spark = todo.sparkSession
    return todo.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else todo


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """A selection's state (phase, chosen ids, history) as one JSON document."""
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path).first()[0]) if exists(spark, path) else None
