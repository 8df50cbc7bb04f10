"""Every registered query of the base library against its SQL equivalent, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from kinloom.plans import registry, wiki_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(values):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    if name in registry.ORACLE_SQL:
        expect = duck.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})")
        assert got == rows(expect.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pages_of_one_file_are_read_in_several_tasks(spark):
    from pyspark.sql import functions as F

    read = wiki_queries.page_relations(spark, SF).select(F.spark_partition_id().alias("task"))
    assert read.distinct().count() > 1
