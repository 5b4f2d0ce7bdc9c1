import json

from folium import cli
from folium.operators import split


def options(command, **given):
    return cli.parser().parse_args([command, *[x for k, v in given.items() for x in (f"--{k}", str(v))]])


def test_answers_to_packets_and_training_data(spark, tmp_path):
    answers = [{"document_id": f"d{k}", "page": 1, "source": f"s{k}.pdf", "text": '```json\n{"subject": "roads", "document_number": "No 12/A"}\n```'} for k in range(3)] + [{"document_id": "d0", "page": 2, "source": "s0.pdf", "text": "none"}]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, answers)))
    a = options("parse-answers", input=tmp_path / "in.json", output=tmp_path / "out", run="20240101T000000Z", ratio=0.3, prompt="Read.", content="Copy.")
    assert cli.parse_answers(spark, a).where("error IS NULL").count() == 3
    rows = {r.source: r for r in cli.aggregate(spark, a).collect()}
    assert rows["s0.pdf"].page_count == 2 and rows["s0.pdf"].document_fields.document_number == "12"
    found = cli.build_finetune_data(spark, a).first()
    assert (found.train_examples, found.val_examples, found.skipped_pages_without_clean_metadata) == (2, 1, 1)
    assert found.train_sources == ["s0.pdf", "s1.pdf"] and found.val_sources == ["s2.pdf"]
    lines = [json.loads(r.value) for r in spark.read.text(f"{a.output}/finetune").collect()]
    assert sorted(x["task"] for x in lines) == ["content"] * 4 + ["metadata"] * 3
    assert all([m["role"] for m in x["messages"]] == ["user", "assistant"] for x in lines)
    target = json.loads(next(x for x in lines if x["task"] == "metadata")["messages"][1]["content"])
    assert list(target) == list(split.TARGET) and target["attachments"] == [] and target["document_number"] == "12"
    header = spark.read.json(f"{a.output}/run").first()
    assert (header.run_id, header.packet_count) == ("20240101T000000Z", 3)


def test_pages_to_leaderboard(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"123")
    a = options("preprocess", input=tmp_path / "in", output=tmp_path / "out", engine="stub")
    assert cli.preprocess(spark, a).count() == 1
    cli.run_ocr(spark, a)
    stored = spark.read.parquet(f"{a.output}/ocr/stub")
    assert stored.count() == 3
    cli.run_ocr(spark, a)
    assert spark.read.parquet(f"{a.output}/ocr/stub").count() == 3
    (tmp_path / "rec").mkdir()
    for k, e in enumerate(("x", "y")):
        (tmp_path / "rec" / f"{e}.json").write_text(json.dumps({"document_id": "a", "page": 1, "engine": e, "subject": "s" if k else "t", "raw_text": "abc"}))
    (tmp_path / "truth.csv").write_text("document_id,page,subject\na,1,s\n")
    a.input, a.truth = str(tmp_path / "rec"), str(tmp_path / "truth.csv")
    assert [(r.engine, r.field_accuracy) for r in cli.evaluate(spark, a).collect()] == [("y", 1.0), ("x", 0.0)]
