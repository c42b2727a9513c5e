"""Queries written once in the SQL that Spark and DuckDB share, with the few differences in place holders.

Tables are written {name}. R[x;n] rounds and removes a negative zero, PCT[x;q] is the exact interpolated percentile.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def _round(sql: str) -> str:
    return re.sub(r"R\[([^\[\]]*);(\d+)\]", r"(round(CAST(\1 AS DOUBLE), \2) + 0e0)", sql)


def spark_text(sql: str) -> str:
    return _round(re.sub(r"PCT\[([^\[\]]*);([^\[\]]*)\]", r"percentile(\1, \2)", sql))


def duck_text(sql: str) -> str:
    sql = _round(re.sub(r"PCT\[([^\[\]]*);([^\[\]]*)\]", r"quantile_cont(\1, \2)", sql))
    return re.sub(r"\{(\w+)\}", r"\1", sql)


Maker = Callable[[SparkSession, str], dict[str, DataFrame]]


def query(sql: str, make: Maker | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A query over one folder of Parquet tables; only the tables that it names are read. make: tables of its own, named in place holders too."""
    text = spark_text(sql)
    names = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make(spark, sf_dir) if make else {}
        return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}, **made)

    return run


class Book:
    """Named queries with their SQL for both engines."""

    def __init__(self, prefix: str = "", oracle_prefix: str | None = None, make: Maker | None = None) -> None:
        self.prefix, self.make, self.queries, self.oracles = prefix, make, {}, {}
        self.oracle_prefix = prefix if oracle_prefix is None else oracle_prefix

    def add(self, name: str, sql: str, oracle: str | None = None) -> None:
        """oracle: a text of its own for the other engine, else the same."""
        self.queries[name] = query(self.prefix + sql, self.make)
        self.oracles[name] = duck_text(self.oracle_prefix + (oracle or sql))
