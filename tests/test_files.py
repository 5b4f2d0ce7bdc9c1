import json

import pytest
from pyspark.sql import functions as F

from folium.models import engines
from folium.sources import files, sinks, versions
from folium.streaming.ingest import ingest


def test_input_files_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b c.PNG", "sub/b c.png", "x.txt", "d.pdf"):
        (tmp_path / name).write_bytes(b"12")
    found = files.input_files(spark, str(tmp_path))
    assert found.count() == 3
    rows = files.raw_pages(found, lambda pdf: [pdf, pdf]).collect()
    assert sorted((r.document_id, r.page) for r in rows) == [("b_c", 1), ("b_c_2", 1), ("d", 1), ("d", 2)]
    read = engines.read_pages(files.raw_pages(found).select("document_id", "page", "image"), "stub").collect()
    assert {r.text for r in read if r.document_id == "b_c"} == {"2 bytes"}
    absent = engines.read_pages(spark.createDataFrame([("a", b"1")], "document_id string, image binary"), "paddle").first()
    assert absent.error and absent.text == ""
    with pytest.raises(ValueError):
        engines.build("nothing")


def test_records_truth_and_transcripts(spark, tmp_path):
    run = tmp_path / "runs"
    for name, text in (("r1/a.json", '{"document_id": "a", "page": 1}'), ("r2/a.json", '{"document_id": "b", "page": 2}'), ("r2/a.raw.json", "{}"), ("r2/a_20240101T000000Z.json", "{}"), ("r2/bad.json", "{")):
        (run / name).parent.mkdir(parents=True, exist_ok=True)
        (run / name).write_text(text)
    rows = files.records(spark, str(run), "document_id string, page int")
    assert rows.count() == 2
    assert [r.document_id for r in files.latest_run(rows).collect()] == ["b"]
    truth = tmp_path / "truth.csv"
    truth.write_text("document_id,page,subject\na,1,old\na,1,new\n,1,none\nb,,none\n")
    assert [(r.document_id, r.page, r.subject) for r in files.ground_truth(spark, str(truth)).collect()] == [("a", 1, "new")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "doc_x_p003_raw.md").write_text(" \n")
    assert files.transcripts(spark, str(tmp_path / "t")).collect()[0][:3] == ("doc_x", 3, None)
    assert files.manifest(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"pages": [{"document_id": "a", "page": 1, "source": "s", "raw_image": "i", "images": {"raw": "i"}}]}))
    assert files.manifest(spark, str(tmp_path / "m.json")).first().images == {"raw": "i"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    sinks.write_versions(rows, str(tmp_path / "v"))
    sinks.write_versions(rows.withColumn("v", F.lit(2)), str(tmp_path / "v"), overwrite=False)
    stored = versions.read(spark, str(tmp_path / "v"))
    assert stored.count() == 2 and [r.v for r in sinks.first_versions(stored, ["id"], versions.VERSION).collect()] == [1]
    sinks.write_jsonl(spark.createDataFrame([("{}", "val")], "line string, split string"), "line", str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first().split == "val"
    assert sinks.markdown(rows).splitlines()[2] == "| a  | 1 |"
    sinks.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "v"]


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    for k in range(2):
        (tmp_path / "in" / f"p{k}.txt").write_text(f"Subject: topic {k}")
        ingest(spark, *args).awaitTermination()
        assert sorted(r.subject for r in spark.read.parquet(args[1]).collect()) == [f"topic {i}" for i in range(k + 1)]
