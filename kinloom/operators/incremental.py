"""Refreshing a table in steps: change detection, upserts, retries, result caches."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def since(last_check: datetime | None, fetched: Iterable[datetime], overlap_hours: int = 2) -> datetime | None:
    """Where to read changes from: the last check, or the oldest fetch, less an overlap for what came late."""
    base = last_check or min(fetched, default=None)
    return base - timedelta(hours=overlap_hours) if base else None


def changed(changes: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that changed: known ones, and new ones of the main namespace (without a colon)."""
    keys = changes.select(key).distinct()
    old = keys.join(known.select(key), key, "left_semi")
    new = keys.join(known.select(key), key, "left_anti").filter(~F.col(key).contains(":"))
    return old.unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """``new`` over ``old``: new rows, and old rows whose key is not among them; with ``version``, the latest new row."""
    if version is not None:
        fields = F.struct(F.col(version).alias("__v"), *[c for c in new.columns if c not in keys])
        new = new.groupBy(*keys).agg(F.max(fields).alias("__n")).select(*keys, *[F.col(f"__n.{c}").alias(c) for c in new.columns if c not in keys])
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def pending(wanted: DataFrame, done: DataFrame, failed: DataFrame, missing: DataFrame, key: str, refresh: bool = False) -> DataFrame:
    """(key, retry): what is to be fetched. Failures of earlier runs always are, also those no longer wanted; pages
    that are there or known to be missing only on refresh."""
    retry = failed.select(key).distinct().withColumn("retry", F.lit(True))
    fresh = wanted.select(key).distinct().join(failed.select(key), key, "left_anti")
    if not refresh:
        fresh = fresh.join(done.select(key), key, "left_anti").join(missing.select(key), key, "left_anti")
    return retry.unionByName(fresh.withColumn("retry", F.lit(False)))


def uncached(rows: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a cached result for their key (such as title and revision)."""
    return rows.join(cache.select(*key), key, "left_anti")
