"""Tokens as text, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A column `token`; blanks around a token and empty lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def write_tokens(tokens: DataFrame, path: str, token: str = "token") -> None:
    """A null token is an empty line, which readers skip."""
    tokens.select(F.coalesce(F.col(token), F.lit("")).alias(token)).write.text(path)
