"""Relations from a language model, with a cache of what it said about each revision of a page.

The model is any callable (title, text) -> list of relation dictionaries, made in each task by a factory, so that nothing
here knows a service. Pages that the cache has are not asked again; failures are rows, not exceptions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[str, str], list[dict]]
MOST_CHARS = 60_000  # fixed value: what of a page is shown to the model
FLOOR, CAP = 0.2, 0.85
KINDS = ("parent", "spouse", "sibling", "grandparent", "great_grandparent", "parent_in_law", "sibling_in_law", "uncle")
CACHED = "key string, title string, relations array<struct<person:string,relative:string,relation:string,evidence:string,confidence:double>>, error string"


def asked(pages: DataFrame, cache: DataFrame | None) -> DataFrame:
    """(key, title, text): the page revisions that the cache has no answer for. ``pages`` is (title, revid, wikitext)."""
    key = F.concat_ws("@", "title", F.col("revid").cast("string"))
    rows = pages.select(key.alias("key"), "title", F.substring("wikitext", 1, MOST_CHARS).alias("text")).dropDuplicates(["key"])
    return rows if cache is None else rows.join(cache.filter("error IS NULL").select("key"), "key", "left_anti")


def ask(rows: DataFrame, factory: Callable[[], Model], attempts: int = 4, wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """CACHED: the answers for (key, title, text). A page is tried ``attempts`` times, waiting twice as long each time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            out = []
            for key, title, text in batch.itertuples(index=False):
                found, error = [], None
                for k in range(attempts):
                    try:
                        found, error = [x for x in map(_valid, model(title, text)) if x], None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a service may raise is a failure of this page alone
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            sleep(wait * 2**k)
                out.append((key, title, found, error))
            yield pd.DataFrame(out, columns=["key", "title", "relations", "error"])

    return rows.select("key", "title", "text").mapInPandas(run, CACHED)


def _valid(x: dict) -> dict | None:
    """A relation with known kind and two different ends, its confidence within bounds."""
    a, b = (str(x.get(k) or "").strip() for k in ("person", "relative"))
    if x.get("relation") not in KINDS or not a or not b or a == b:
        return None
    sure = min(CAP, max(FLOOR, float(x.get("confidence") or FLOOR)))
    return {"person": a, "relative": b, "relation": x["relation"], "evidence": str(x.get("evidence") or ""), "confidence": sure}


def updated_cache(cache: DataFrame | None, answers: DataFrame) -> DataFrame:
    """The cache with new answers; an answer replaces an earlier failure of its key."""
    if cache is None:
        return answers
    return cache.join(answers.select("key"), "key", "left_anti").unionByName(answers)


def relations(cache: DataFrame, known: DataFrame) -> DataFrame:
    """Relation rows (see ``extraction.SCHEMA``) of cached answers; ends that are no page of ``known`` (title) are
    unlinked."""
    rows = cache.filter("error IS NULL").select("title", F.posexplode("relations").alias("order", "r")).select("title", "order", "r.*")
    for end in ("person", "relative"):
        there = known.select(F.col("title").alias(end), F.lit(True).alias("__there"))
        rows = rows.join(there, end, "left").withColumn(end, F.when(F.col("__there"), F.col(end)).otherwise(F.concat(F.lit("~"), F.regexp_replace(end, "^~", "")))).drop("__there")
    return rows.filter("person <> relative").select(
        "person", "relative", "relation", F.col("title").alias("source_page"), "evidence", F.array().cast("array<string>").alias("refs"), F.lit("model").alias("method"),
        F.lit("model").alias("pattern"), "confidence", F.lit(None).cast("string").alias("side"), F.lit(False).alias("alias"), "order",
        F.lit(False).alias("doubtful"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
    )
