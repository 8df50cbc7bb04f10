"""Fusing independent evidence into scored edges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinloom.config import SYMMETRIC, Thresholds

T = Thresholds()


def canonical_ends(rows: DataFrame, a: str = "a", b: str = "b", relation: str = "relation") -> DataFrame:
    """Symmetric relations get their ends in string order, so that both directions are one edge."""
    turned = F.col(relation).isin(*SYMMETRIC) & (F.col(b) < F.col(a))
    return rows.withColumns({a: F.when(turned, F.col(b)).otherwise(F.col(a)), b: F.when(turned, F.col(a)).otherwise(F.col(b))})


def noisy_or(confidence: Column) -> Column:
    """Aggregate: 1 - product(1 - c), each c clamped, the result capped; full precision."""
    clamped = F.greatest(F.least(confidence, F.lit(T.evidence_ceiling)), F.lit(T.evidence_floor))
    return F.least(F.lit(1.0) - F.product(F.lit(1.0) - clamped), F.lit(T.fused_cap))


@F.pandas_udf(DoubleType())
def half_even(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Decimal rounding of the binary value, as Python's round does; Spark's own rounds its shortest decimal form."""
    return pd.Series([None if pd.isna(v) else round(v, int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def fuse_evidence(rows: DataFrame, keys: list[str], page: str, confidence: str) -> DataFrame:
    """One scored edge per key: n_evidence, n_pages, confidence (6 decimals), corroborated (two pages at least)."""
    pages = F.countDistinct(page)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_evidence"),
        pages.alias("n_pages"),
        F.round(noisy_or(F.col(confidence)), 6).alias("confidence"),
        (pages >= 2).alias("corroborated"),
    )


def dedupe_evidence(rows: DataFrame, keys: list[str], confidence: str, order: list[str], first: list[str]) -> DataFrame:
    """One row per key: the largest confidence, and the other fields of the first row by ``order``."""
    head = F.min(F.struct(*order, *[c for c in first if c not in order])).alias("__first")
    out = rows.groupBy(*keys).agg(F.max(confidence).alias(confidence), head)
    return out.select(*keys, confidence, *[F.col(f"__first.{c}").alias(c) for c in first])


def majority_vote(rows: DataFrame, key: str, m: Column, f: Column) -> DataFrame:
    """Votes by key and the winner: m on a tie, none without a vote."""
    out = rows.groupBy(key).agg(
        F.sum(F.when(m, 1).otherwise(0)).alias("votes_m"), F.sum(F.when(f, 1).otherwise(0)).alias("votes_f")
    )
    winner = F.when(F.col("votes_m") + F.col("votes_f") > 0, F.when(F.col("votes_m") >= F.col("votes_f"), "m").otherwise("f"))
    return out.withColumn("winner", winner)


def fuse_relations(relations: DataFrame) -> DataFrame:
    """Scored edges (a, b, relation) with nested evidence from relation rows.

    Rows of one page and sentence are one piece of evidence, with the largest of their confidences and the fields of
    the first row by ``order``. Confidence is rounded to two decimals as in the source format.
    """
    rows = canonical_ends(relations.withColumnsRenamed({"person": "a", "relative": "b"})).filter("a <> b")
    key = ["a", "b", "relation", "source_page", "evidence"]
    first = F.min(F.struct("order", "method", "pattern", "refs", "alias", "side")).alias("f")
    single = rows.groupBy(*key).agg(F.max("confidence").alias("confidence"), first)
    piece = F.struct(
        F.col("f.order").alias("order"), "source_page", F.col("evidence").alias("text"), F.col("f.refs").alias("refs"),
        F.col("f.method").alias("method"), F.col("f.pattern").alias("pattern"), "confidence", F.col("f.alias").alias("alias"),
    )
    side = F.min(F.when(F.col("f.side").isNotNull(), F.struct(F.col("f.order"), F.col("f.side"))))
    pages = F.countDistinct("source_page")
    edges = single.groupBy("a", "b", "relation").agg(
        F.array_sort(F.collect_list(piece)).alias("evidence"),
        noisy_or(F.col("confidence")).alias("exact"),
        pages.alias("n_pages"),
        F.bool_or(F.size("f.refs") > 0).alias("has_ref"),
        F.bool_and("f.alias").alias("alias_only"),
        side.alias("side"),
    )
    flags = F.array_compact(F.array(F.when(F.col("n_pages") >= 2, F.lit("corroborated")), F.when(~F.col("has_ref"), F.lit("no_ref"))))
    return edges.select(
        "a", "b", "relation", half_even("exact", F.lit(2)).alias("confidence"), flags.alias("flags"),
        F.col("side.side").alias("side"), F.lit(False).alias("inferred"), "alias_only", "evidence",
    )
