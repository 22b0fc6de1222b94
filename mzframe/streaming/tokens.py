"""Token streams. Encoding and decoding keep no state, so the batch operators run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mzframe.functions.urls import MAGIC
from mzframe.operators.tokens import decode


def decoded_stream(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """Spectra of the tokens in text files as these arrive in a folder; bad tokens have an error."""
    lines = spark.readStream.text(path).select(F.trim("value").alias("token")).where("token <> ''")
    return decode(lines, "token", magic, mode="PERMISSIVE")


def error_counts(decoded: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Good and bad tokens in each window of event time; the watermark bounds what is kept for late ones."""
    return decoded.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("tokens"), F.count("error").alias("bad"))
