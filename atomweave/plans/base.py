"""Helpers shared by the query modules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a statement over the tables it names; each becomes a relation of this statement alone."""
    frames = {n: table(spark, sf_dir, n) for n in TABLES if re.search(rf"\b{n}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}")  # names of relations go in braces
    for n in frames:
        sql = re.sub(rf"\b(FROM|JOIN|,)(\s+){n}\b", rf"\1\2{{{n}}}", sql)
    return spark.sql(sql, **frames)


class Registry:
    """Collects a module's queries; ``add`` is a decorator that takes the oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep

    def sql(self, name: str, spark_sql: str, oracle: str | None = None) -> None:
        """A query whose plan is one SQL statement; both dialects share it unless an oracle text is given."""
        self.queries[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, spark_sql)
        self.oracles[name] = oracle or spark_sql
