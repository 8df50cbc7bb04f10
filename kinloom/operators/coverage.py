"""How well existing trees cover families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.config import Thresholds

T = Thresholds()


def status(ratio: Column, covered: Column, hinted: Column, draft: Column) -> Column:
    full = hinted | ((ratio >= T.cover_ratio) & (covered >= T.cover_least))
    return F.when(full & ~draft, "exists").when(full & draft, "draft").when(covered > 0, "partial").otherwise("none")


def best_coverage(members: DataFrame, trees: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(family, members, tree, covered, score, status): the best tree of each family.

    ``members`` is (family, person), ``trees`` (tree, person, draft). A hint (family, tree) raises the score to 0.99
    with two people covered, to 0.6 with fewer. Ties go to finished trees, then to the smallest name.
    """
    size = members.groupBy("family").agg(F.countDistinct("person").alias("members"))
    hit = members.distinct().join(trees.distinct(), "person").groupBy("family", "tree", "draft").agg(F.count(F.lit(1)).alias("covered"))
    if hints is not None:
        hit = hit.join(hints.select("family", "tree", F.lit(True).alias("hinted")), ["family", "tree"], "left")
    else:
        hit = hit.withColumn("hinted", F.lit(False))
    hinted = F.coalesce("hinted", F.lit(False))
    ratio = F.col("covered") / F.col("members")
    score = F.when(hinted & (F.col("covered") >= 2), F.greatest(ratio, F.lit(0.99))).when(hinted, F.greatest(ratio, F.lit(0.6))).otherwise(ratio)
    scored = hit.join(size, "family").withColumns({"hinted": hinted, "score": score, "ratio": ratio})
    best = scored.groupBy("family").agg(F.min(F.struct((-F.col("score")).alias("s"), "draft", "tree", "covered", "hinted", "ratio")).alias("b"))
    out = size.join(best, "family", "left")
    none = F.col("b").isNull()
    state = F.when(none, "none").otherwise(status(F.col("b.ratio"), F.col("b.covered"), F.col("b.hinted"), F.col("b.draft")))
    return out.select("family", "members", F.col("b.tree").alias("tree"), F.coalesce("b.covered", F.lit(0)).alias("covered"),
                      F.round(F.coalesce(-F.col("b.s"), F.lit(0.0)), 6).alias("score"), state.alias("status"))
