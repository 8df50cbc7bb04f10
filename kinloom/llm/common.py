"""Helpers shared by the training-data operators: table access and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.plans.storage import new_path, written

__all__ = ["load", "new_path", "word_count", "words", "written"]

WORD_BREAK = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the runs of ``[^\\x20\\x09-\\x0D]``; null text gives an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1)
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as bigint without keeping them; null text has none."""
    t = F.coalesce(text, F.lit(""))
    edge = F.substring(t, 1, 1).rlike(WORD_BREAK).cast("int") + F.substring(t, -1, 1).rlike(WORD_BREAK).cast("int")
    blank = F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, WORD_BREAK, -1)) - edge)
    return blank.cast("long")
