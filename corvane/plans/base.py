"""How queries are registered: a function of (spark, sf_dir) with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded as the SQL side is."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict-shaped view of ``lineitem``: run, question, criterion, weight, met, class."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("criterion"),
        F.col("l_suppkey").alias("rater"), F.col("l_quantity").alias("weight"),
        (F.col("l_returnflag") == "N").cast("int").alias("met"), F.col("l_linestatus").alias("class"))


#: The same view in SQL.
V = ("v AS (SELECT l_linenumber AS run, l_orderkey AS question, l_partkey AS criterion, l_suppkey AS rater, l_quantity AS weight, "
     "CAST(l_returnflag = 'N' AS INTEGER) AS met, l_linestatus AS class FROM lineitem)")
