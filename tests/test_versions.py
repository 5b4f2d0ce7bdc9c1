"""Versions, manifests of ranges, counts of a writing pass, and case folding."""

import sys
import threading

import pytest
from pyspark.sql import functions as F

from folium.functions.text import folded
from folium.operators import progress
from folium.sources import files, sinks, versions


def test_two_writers_at_once(spark, tmp_path):
    """Both survive, and numbers give the order whatever the clock says."""
    path, got = str(tmp_path / "t"), []
    threads = [threading.Thread(target=lambda k=k: got.append((versions.commit(spark.createDataFrame([("a", k)], "id string, v int"), path), k))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in got) == [1, 2, 3, 4, 5, 6]
    stored = versions.read(spark, path)
    assert sorted((r.version, r.v) for r in stored.collect()) == sorted(got)
    assert [r.v for r in sinks.first_versions(stored, ["id"], versions.VERSION).collect()] == [dict(got)[1]]
    assert versions.read(spark, path, 2).count() == 2


def test_replacing_expected_and_broken_commits(spark, tmp_path):
    path, row = str(tmp_path / "t"), lambda v, kind="int": spark.createDataFrame([(v,)], f"v {kind}")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.commit(row(1), path) == 1
    with pytest.raises(versions.Conflict):
        versions.commit(row(2), path, expected=0)
    assert versions.commit(row(2), path, replaces=True, expected=1) == 2
    (tmp_path / "t" / "log" / "000000000003.json").write_text("")  # a writer that died
    assert versions.commit(row(4).withColumn("w", F.lit("x")), path) == 4
    assert sorted((r.v, r.w, r.version) for r in versions.read(spark, path).collect()) == [(2, None, 2), (4, "x", 4)]
    assert [r.v for r in versions.read(spark, path, 1).collect()] == [1]


def test_manifest_of_ranges(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.range(500).selectExpr("concat('d', id % 100) AS document_id", "cast(id div 100 AS int) AS page", "'s' AS source", "cast(id AS string) AS raw_image", "map('raw', 'r') AS images")
    assert files.manifest(spark, path).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small ranges stay
    try:
        sinks.write_manifest(rows.limit(3), path)
        sinks.write_manifest(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r)[:4] for r in files.manifest(spark, path).collect()} == {tuple(r)[:4] for r in rows.collect()}
    assert len(list((tmp_path / "m").glob("*/pages/*.txt"))) > 3  # two versions, several files of the second
    one = files.manifest(spark, path, "d7")
    assert sorted(r.page for r in one.collect()) == [0, 1, 2, 3, 4] and len(one.inputFiles()) < 3
    assert files.manifest(spark, path, "none").count() == 0
    (tmp_path / "one.json").write_text('{"pages": [{"document_id": "a", "page": 1}, {"document_id": "b", "page": 1}]}')
    assert [r.document_id for r in files.manifest(spark, str(tmp_path / "one.json"), "b").collect()] == ["b"]


def test_reports_say_what_they_leave_out(spark):
    rows = spark.range(5).orderBy("id")
    assert sinks.markdown(rows, 3).endswith("| 2  |\n\n2 more rows") and "more" not in sinks.markdown(rows, 5)


def test_counts_of_a_writing_pass(spark, tmp_path, caplog):
    rows = spark.createDataFrame([("a", None, 1.5), ("b", "bad", None), ("c", None, 0.25)], "d string, error string, runtime_seconds double")
    with caplog.at_level("INFO", "folium"), progress.counted(rows, "run") as seen:
        seen.rows.write.parquet(str(tmp_path / "o"))
    assert seen.counts == {"pages": 3, "errors": 1, "seconds": 1.75} and "run: 3 pages, 1 errors, 1.8 s" in caplog.text
    with progress.counted(rows.select("d").limit(0), "none") as seen:
        seen.rows.write.parquet(str(tmp_path / "p"))
    assert seen.counts == {"pages": 0, "errors": 0, "seconds": 0.0}


def test_case_folding_of_every_letter(spark):
    """Two letters are equal folded if and only if they are by Unicode's full case folding."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and (c != c.casefold() or c != c.lower() or c != c.upper())]
    rows = spark.createDataFrame([(c, c.casefold()) for c in letters], "c string, f string")
    got = rows.select("c", "f", folded(F.col("c")).alias("x"), folded(F.col("f")).alias("y")).collect()
    assert [r.c for r in got if r.x != r.y] == []
    by_fold, by_ours = {}, {}
    for r in got:
        by_fold.setdefault(r.f, set()).add(r.c)
        by_ours.setdefault(r.x, set()).add(r.c)
    assert sorted(map(sorted, by_fold.values())) == sorted(map(sorted, by_ours.values()))
