import json

import pytest
from pyspark.sql import functions as F

from kinloom.sinks.files import TextFiles


def save(spark, rows, path, mode="overwrite", partitions=3):
    spark.dataSource.register(TextFiles)
    df = spark.createDataFrame(rows, "name string, text string").repartition(partitions)
    df.write.format("text_files").mode(mode).option("path", str(path)).save()


def there(path):
    files = {p.name: p.read_text() for p in path.iterdir() if p.is_file()}
    index = json.loads(files.pop("index.json"))
    assert index == sorted(files)
    return files


def test_a_file_for_each_row_and_the_index(spark, tmp_path):
    out = tmp_path / "out"
    save(spark, [("a.wiki", "one"), ("b.html", "ב"), ("c", None)], out)
    assert there(out) == {"a.wiki": "one", "b.html": "ב", "c": ""}
    save(spark, [("a.wiki", "new"), ("d", "x")], out, "append")
    assert there(out) == {"a.wiki": "new", "b.html": "ב", "c": "", "d": "x"}
    save(spark, [("e", "only")], f"file://{out}")
    assert there(out) == {"e": "only"}


@pytest.mark.parametrize("rows", [[("good", "1"), ("bad/name", "2")], [("good", "1"), (None, "2")], [("same", "1"), ("same", "2")]])
def test_a_failed_job_leaves_the_old_files_and_nothing_else(spark, tmp_path, rows):
    out = tmp_path / "out"
    save(spark, [("old", "kept")], out)
    with pytest.raises(Exception):
        save(spark, rows, out)
    assert there(out) == {"old": "kept"} and [p for p in out.rglob("*") if p.is_file() and "_staging" in p.parts] == []


def test_a_task_that_dies_half_way_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    spark.dataSource.register(TextFiles)
    rows = spark.range(20).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 17, F.raise_error(F.lit("half way"))).otherwise("t").alias("text"))
    with pytest.raises(Exception, match="half way"):
        rows.repartition(1).write.format("text_files").mode("append").option("path", str(out)).save()
    assert not (out / "index.json").exists() and [p for p in out.rglob("f*") if p.is_file()] == []
