import pytest

import __spark_entry__ as entry
from helpers import rows_of
from folium.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name not in plans.ORACLE:
        assert len(got)
        return
    want = duck.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_page_regions_of_halves_and_nulls(spark, tmp_path):
    """Widths that are halves, on both sides of a limit and of even and odd numbers; events without a user or an id."""
    import duckdb

    values = [k + 0.5 for k in range(0, 400, 3)] + [k + 0.1 for k in range(0, 400, 7)]
    rows = [(k * 11, k % 9 if k % 9 else None, v) for k, v in enumerate(values)] + [(None, 1, 20.5), (None, 77, 20.5), (5001, 1, None), (5002, 78, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(plans.QUERIES["page_regions"](spark, str(tmp_path)).toPandas()) == rows_of(con.sql(plans.ORACLE["page_regions"]).df())


def test_entry(spark, sf_dir):
    rows = entry.entry(spark).collect()
    assert rows
    key = [(-(r.field_accuracy or -1), r.error_pages, r.engine) for r in rows]
    assert key == sorted(key)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_split_and_review_are_whole(spark, sf_dir):
    rows = plans.split_train_val(spark, sf_dir).toPandas()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert not set(rows[rows.split == "val"].source) & set(rows[rows.split == "train"].source)
    lights = plans.validation_summary(spark, sf_dir).toPandas()
    assert (lights.green + lights.yellow + lights.red == 12).all()


def test_workers_get_the_library_by_an_archive(tmp_path):
    """A session that was started elsewhere, with workers that know no path to the library."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,900]").config("spark.ui.enabled", "false").config("spark.executor.memory", "500m").getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__ as e
rows = e.queries()["ocr_stub_engine"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows), sum(r.avg_confidence for r in rows))
"""
    # Executors work below Spark's home: one of the test's own, of links.
    installed, home = os.path.dirname(__import__("pyspark").__file__), tmp_path / "home"
    home.mkdir()
    for name in os.listdir(installed):
        if name != "work":
            (home / name).symlink_to(os.path.join(installed, name))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 50 50.0" in done.stdout, done.stderr[-2000:]
