"""Records out of several origins, reports, review, images and model servers."""

import json
import shlex
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium import cli, config
from folium.functions import geometry
from folium.models import answers, png, regions, server
from folium.operators import documents, merge, records, reports, review, split
from folium.sources import files, sinks


def options(command, **given):
    return cli.parser().parse_args([command, *[x for k, v in given.items() for x in (f"--{k}", str(v))]])


def picture(width=200, height=160):
    """White, with a blue square that has a red dot in its hole, a red bar, and a speck."""
    out = np.full((height, width, 3), 255, np.uint8)
    out[20:60, 30:75] = (20, 30, 200)
    out[30:50, 40:65] = 255
    out[38:42, 50:54] = (200, 10, 10)
    out[100:110, 20:150] = (210, 20, 20)
    out[140:143, 180:183] = (0, 0, 255)
    return out


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (13, 17, 3), dtype=np.uint8)
    assert (png.decode(png.encode(pixels)) == pixels).all()
    # Each filter of the format, made by its definition.
    import struct
    import zlib

    def filtered(kind):
        raw, flat = b"", pixels.reshape(13, -1).astype(int)
        for y in range(13):
            line = []
            for x in range(51):
                a, b, c = flat[y, x - 3] if x > 2 else 0, flat[y - 1, x] if y else 0, flat[y - 1, x - 3] if y and x > 2 else 0
                p = a + b - c
                guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))][kind]
                line.append((flat[y, x] - guess) % 256)
            raw += bytes([kind, *line])
        return raw

    whole = png.encode(pixels)
    for kind in range(5):
        data = zlib.compress(filtered(kind))
        at = whole.index(b"IDAT") - 4
        made = whole[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data)) + whole[whole.index(b"IEND") - 4 :]
        assert (png.decode(made) == pixels).all(), kind
    for bad in (b"", None, b"nothing", whole[:40]):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_regions_of_a_page(spark):
    """The dot is inside of the square and no area of its own, the speck is too small; from the bottom up."""
    assert regions.boxes(regions.ink(picture())) == [(180, 140, 3, 3), (20, 100, 130, 10), (30, 20, 45, 40)]
    pages = spark.createDataFrame([("a", 1, png.encode(picture())), ("b", 1, b"none")], "document_id string, page int, image binary")
    rows = {r.document_id: r for r in regions.detected(pages).collect()}
    assert [(r.place, r.kind, r.box) for r in rows["a"].regions] == [(2, "signature", [20, 100, 150, 110]), (3, "stamp", [30, 20, 75, 60])]
    assert (rows["a"].stamp_present, rows["a"].signature_present) == (True, True)
    assert png.decode(rows["a"].regions[1].crop).shape == (40, 45, 3)
    assert (rows["b"].stamp_present, rows["b"].regions, rows["b"].confidence_notes) == (None, [], regions.UNREADABLE)


def test_boxes_are_drawn(spark):
    made = [("a", '{"box": [10, 10, 30, 20]}'), ("b", "[[1, 2], [3.9, 4], [5, 6]]"), ("c", '{"bbox": [[1, 2], [3, 4]]}'), ("d", '"x"'), ("e", "[1, 2]"), ("f", "null")]
    boxes = spark.createDataFrame(made, "k string, b string").select("k", geometry.polygon(F.parse_json("b")).alias("p"))
    got = {r.k: None if r.p is None else [tuple(q) for q in r.p] for r in boxes.collect()}
    assert got == {"a": [(10, 10), (30, 10), (30, 20), (10, 20)], "b": [(1, 2), (3, 4), (5, 6)], "c": [(1, 2), (3, 4)], "d": None, "e": None, "f": None}
    page = spark.createDataFrame([("a", png.encode(np.full((40, 50, 3), 255, np.uint8))), ("x", b"bad")], "k string, image binary").join(boxes.where("k = 'a'").select(F.array("p").alias("polygons")), how="cross")
    rows = {r.k: r.annotated for r in regions.annotated(page).collect()}
    drawn = np.argwhere((png.decode(rows["a"]) == regions.COLOR).all(axis=2))
    assert rows["x"] is None and drawn.min(axis=0).tolist() == [10, 10] and drawn.max(axis=0).tolist() == [21, 31]


def test_four_origins_of_a_record(spark):
    rows = [
        ("a", "Subject: roads\nNo. 12/2024", '{"subject": "bridges", "address": "", "attachments": [], "unknown": 1}', '{"subject": {"value": null}, "document_number": {"value": "13"}, "address": null}'),
        ("b", "Subject: roads", '{"error": "no", "subject": "x"}', None),
        ("c", " ", None, None),
        ("d", "Subject: roads", '{"uncertain_lines": ["l", "l", "m"]}', '{"subject": ["x"], "stamp_present": true}'),
    ]
    pages = spark.createDataFrame(rows, "input_file string, text string, e string, c string").select(
        "input_file", F.col("input_file").alias("image_file"), F.lit("stub").alias("engine"), "text", F.lit(0.5).alias("avg_confidence"), F.try_parse_json("e").alias("extracted"), F.try_parse_json("c").alias("corrected"),
        F.lit(1.0).alias("ocr_runtime_seconds"), F.lit(0.5).alias("extraction_runtime_seconds"), F.lit(None).cast("double").alias("correction_runtime_seconds"),
    )
    got = {r.input_file: r for r in documents.merged(pages).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.rule_based_fields.subject, a.extracted_fields.subject, a.corrected_fields.subject) == ("roads", "bridges", None)
    assert (a.extracted_fields.address, a.corrected_fields.address, a.extracted_fields.attachments, a.corrected_fields.document_number) == ("", "", [], "13")
    assert (a.extraction_mode, a.total_runtime_seconds, a.error) == ("vlm_image", 1.5, None)
    assert (b.extraction_mode, b.extracted_fields.subject, b.corrected_fields) == ("rules_only", "roads", b.extracted_fields)
    assert c.error and c.extracted_fields is None
    assert d.extracted_fields.uncertain_lines == ["l", "m"] and d.corrected_fields.stamp_present is True
    asked = pages.select(documents.question(F.col("text"), F.struct(F.repeat(F.lit("x"), 5000).alias("f"))).alias("q")).first().q
    assert "... (truncated)" in asked and len(asked) < 4000


@pytest.mark.parametrize(
    ("correction", "want"),
    [('{"value": "b"}', "b"), ('{"value": null}', None), ('"c"', "c"), ("null", "a"), (None, "a"), ("[]", "a"), ('{"myvalue": "b"}', '{"myvalue":"b"}'), ('{"a": {"value": 1}}', '{"a":{"value":1}}'), ("7", "7"), ("true", "True"), ('["x"]', '["x"]'), ('""', ""), ("{}", "{}")],
)
def test_corrections(spark, correction, want):
    row = spark.createDataFrame([("a", correction)], "e string, c string").select(merge.corrected(F.col("e"), F.try_parse_json("c")).alias("v")).first()
    assert row.v == want


def test_flat_records(spark):
    rows = spark.createDataFrame([("d", 3, "s", 0.4, "x")], "document_id string, PAGE long, subject string, extraction_confidence double, extra string")
    flat = records.flat(rows)
    assert flat.columns == list(records.SCHEMA) and flat.first().page == 3 and flat.first().error is None
    assert records.with_confidence(rows).first().avg_ocr_confidence == 0.4
    assert records.with_confidence(rows.drop("extraction_confidence")).first().avg_ocr_confidence == round(1 / 9, 4)
    stem = rows.select(records.stem(F.col("document_id"), F.col("page"), F.lit("e"), F.lit("raw")).alias("s")).first().s
    assert stem == "d_p003_e_raw"
    answers_ = spark.createDataFrame([("none" * 2000,), ('{"subject": "s", "error": "e"}',)], "text string")
    got = records.with_answers(answers_).collect()
    assert (got[0].error, len(got[0].raw_output)) == ("Model did not return a JSON object", 4000) and (got[1].subject, got[1].error, got[1].raw_output) == ("s", "e", None)
    lines = spark.createDataFrame([(["a", "b", "a"] + [str(k) for k in range(20)], "r" * 3000)], "uncertain_lines array<string>, raw_output string")
    kept = records.sanitized(lines).first()
    assert kept.uncertain_lines == ["a", "b", *map(str, range(8))] and len(kept.raw_output) == 2000
    maps = spark.createDataFrame([({"a": None, "b": "[]", "c": ""},)], "m map<string,string>")
    assert maps.select(records.present(F.col("m")).alias("m")).first().m == {"c": ""}
    images = spark.createDataFrame([({"raw": "r", "clean": ""}, "page")], "i map<string,string>, p string")
    assert images.select(*[records.image_path(F.col("i"), k, F.col("p")).alias(k) for k in ("raw", "clean", "other")]).first()[:] == ("r", "page", "page")
    assert records.by_modes(rows, ("raw", "clean"), ("x", "y", "z")).count() == 6


def test_edits_win_even_if_null(spark):
    base = spark.createDataFrame([("a", 1, "s", "x", "/r/e/a.json"), ("b", 1, "t", "y", "/r/e/b.json")], "document_id string, page int, subject string, address string, file_path string")
    edits = spark.createDataFrame([("a", 1, None, "accepted", None)], "document_id string, page int, subject string, review_status string, review_notes string")
    row = review.reviewed(base, edits, ["document_id", "page"]).collect()
    assert len(row) == 1 and (row[0].subject, row[0].address, row[0].review_status, row[0].review_notes, row[0].review_source_path) == (None, "x", "accepted", "", "/r/e/a.json")
    assert {r.document_id: r.subject for r in merge.edited(base, edits.select("document_id", "page", "subject"), ["document_id", "page"]).collect()} == {"a": None, "b": "t"}
    form = spark.createDataFrame([("", " a \n\nb", None, "0.5")], "subject string, attachments string, stamp_present boolean, extraction_confidence string")
    assert review.edited_values(form).first()[:] == (None, ["a", "b"], False, 0.5)
    fill = merge.filled(spark.createDataFrame([(("p", "q"), "own")], "r struct<a:string,b:string>, b string"), "r", ("a", "b")).first()
    assert (fill.a, fill.b) == ("p", "own")


def test_review_from_files_to_labels(spark, tmp_path):
    root = tmp_path / "structured_json"
    record = {"document_id": "d", "page": 1, "engine": "vlm", "subject": "s", "extraction_confidence": 0.0, "avg_ocr_confidence": 0.7, "validation_summary": {"green": 1, "yellow": 2, "red": 3}, "run_id": "r2"}
    for name, change in (("vlm/runs/r1/d.json", {"subject": "old"}), ("vlm/runs/r2/d.json", {}), ("vlm/d.json", {}), ("ocr/raw/p.json", {"engine": None, "document_id": None, "page": None}), ("vlm/bad.json", None)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("{" if change is None else json.dumps(record | change))
    found = files.review_records(spark, str(root), cli.REVIEW, "vlm")
    rows = review.review_rows(found).collect()
    assert sorted((r.engine, r.document_id, r.page, r.subject, r.confidence, r.red_flags) for r in rows) == [("raw", "p", 0, "s", 0.7, 3), ("vlm", "d", 1, "s", 0.7, 3), ("vlm", "d", 1, "s", 0.7, 3)]
    assert review.latest_run_id(review.review_rows(found)).first().run_id == "r2"
    assert [(r.value, r.selected) for r in review.options(review.review_rows(found), "engine", "vlm").collect()] == [("raw", False), ("vlm", True)]
    a = options("review", input=root, output=tmp_path / "out", engine="vlm", search="S", confidence=0.5)
    assert {r.label for r in cli.review_list(spark, a).collect()} == {"d | page 001 | s"}
    (tmp_path / "edits.json").write_text(json.dumps({"document_id": "d", "page": 1, "subject": "", "review_status": "accepted"}))
    a = options("review-save", input=root, output=tmp_path / "out", engine="vlm", edits=tmp_path / "edits.json")
    assert [r.review_status for r in cli.review_save(spark, a).collect()] == ["accepted"]
    line = json.loads(spark.read.text(f"{a.output}/approved").first().value)
    assert line["document_id"] == "d" and json.loads(line["messages"][1]["content"])["subject"] is None


def test_reports_and_header(spark):
    board = spark.createDataFrame([("b", 2, 0), ("a", 1, 1)], "engine string, pages long, error_pages long")
    text = reports.without_truth(board)
    assert text.startswith(reports.TITLE) and text.index("| a ") < text.index("| b ")
    assert "| b " in reports.with_truth(board.withColumn("field_accuracy", F.lit(0.5)))
    pages = spark.createDataFrame([("r1", "b"), ("r0", "a")], "run_id string, file_name string")
    assert reports.run_header(pages, board, "/x/run").first()[:] == ("r0", "/x/run", 2)
    assert reports.run_header(pages.limit(0), board.limit(0), "/x/run").first()[:] == ("run", "/x/run", 0)


def test_files_of_runs_texts_and_manifests(spark, tmp_path):
    for name, text in (("run/b.json", '{"document_id": "b"}'), ("run/a_20240101T000000Z.json", '{"document_id": "a"}'), ("run/x.json", "{"), ("run/below/c.json", '{"document_id": "c"}'), ("ocr/e/raw/p.txt", "one"), ("ocr/e/clean/p.txt", "two")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.document_id for r in files.run_records(spark, str(tmp_path / "run"), "document_id string").collect()] == ["a", "b"]
    assert sorted((r["mode"], r.stem, r.text) for r in files.ocr_texts(spark, str(tmp_path / "ocr"), "e").collect()) == [("clean", "p", "two"), ("raw", "p", "one")]
    pages = spark.createDataFrame([("d", 2, "s"), ("d", 1, "s")], "document_id string, page int, source string")
    made = files.manifest_rows(pages, spark.createDataFrame([("d", 1, "raw", "p1")], "document_id string, page int, mode string, path string"))
    sinks.write_manifest(made, str(tmp_path / "manifest"))
    rows = files.manifest_or_build(spark, str(tmp_path / "manifest"), lambda: 1 / 0).orderBy("page").collect()
    assert [(r.page, r.raw_image, r.images) for r in rows] == [(1, "p1", {"raw": "p1"}), (2, "s", None)]
    assert files.manifest_or_build(spark, str(tmp_path / "none"), lambda: "built") == "built"
    (tmp_path / "p.txt").write_text("Read.")
    assert files.prompt(str(tmp_path / "p.txt")) == "Read."
    texts = spark.createDataFrame([("raw", "p", "x")], "mode string, stem string, text string")
    sinks.write_text(texts, str(tmp_path / "t"), ["mode"], overwrite=False)
    sinks.write_text(texts.withColumn("text", F.lit("y")), str(tmp_path / "t"), ["mode"], overwrite=False)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["x"]
    head = texts.select(sinks.transcript(F.lit("d"), F.lit(1), F.lit("m"), F.col("text")).alias("t")).first().t
    assert head.splitlines() == ["<!-- document_id: d -->", "<!-- page: 1 -->", "<!-- model: m -->", "", "x"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("input_dir: in\noutput_dir: s3a://bucket/out\ndpi: 200\n")
    found = config.load(str(tmp_path / "c.yaml"))
    assert found["input_dir"] == str(tmp_path / "in") and found["output_dir"] == "s3a://bucket/out" and (found["dpi"], found["device"]) == (200, "auto")
    log = config.logger(str(tmp_path / "r"))
    config.logger(str(tmp_path / "r")).info("once")
    assert (tmp_path / "r" / "benchmark.log").read_text().count("once") == 1 and len(log.handlers) == 2
    assert config.device("cpu") == "cpu" and config.device() in ("cpu", "cuda")


SERVER = """
import http.server, json, sys
class H(http.server.BaseHTTPRequestHandler):
    def do_GET(self): self.answer(200, b"ok")
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"][-1]["text"]
        self.answer(500, b"broken") if asked == "fail" else self.answer(200, json.dumps({"choices": [{"message": {"content": asked.upper()}}]}).encode())
    def answer(self, code, body): self.send_response(code); self.end_headers(); self.wfile.write(body)
    def log_message(self, *a): pass
http.server.HTTPServer(("127.0.0.1", int(sys.argv[1])), H).serve_forever()
"""


def free_port():
    import socket

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_a_server_is_started_asked_and_stopped(spark):
    port = free_port()
    url = f"http://127.0.0.1:{port}"
    with server.Server([sys.executable, "-c", SERVER, str(port)], url, 30, 0.1) as s:
        model = server.SafeHttpModel(url)
        assert model("read", b"1") == "READ" and json.loads(model("fail", None)) == {"error": "HTTP 500", "raw_output": "broken"}
        process = s.process
    assert process.poll() is not None and "error" in json.loads(server.SafeHttpModel(url)("read", None))
    with pytest.raises(RuntimeError):
        server.Server([sys.executable, "-c", "raise SystemExit(3)"], url, 30, 0.1).__enter__()


def test_commands_that_ask_a_model(spark, tmp_path):
    port = free_port()
    url = f"http://127.0.0.1:{port}"
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"p{k}.png").write_bytes(png.encode(picture()))
    given = {"input": tmp_path / "in", "output": tmp_path / "out", "server": url, "engine": "stub"}
    with server.Server([sys.executable, "-c", SERVER, str(port)], url, 30, 0.1):
        assert cli.run_transcription(spark, options("run-transcription", **given, prompt="text of it", limit=1)).count() == 1
        rows = cli.run_transcription(spark, options("run-transcription", **given, prompt="text of it", limit=0)).collect()
        assert sorted(r.document_id for r in rows) == ["p0", "p1"] and rows[0].transcript == "TEXT OF IT"
        found = cli.run_vlm(spark, options("run-vlm", **given, prompt='{"subject": "roads"}', run="r1", limit=0)).collect()
        assert len(found) == 2 and all(r.run_id == "r1" and r.field_validation for r in found)
        cli.run_ocr(spark, options("run-ocr", **given))
        cleaned = cli.run_llm_clean(spark, options("run-llm-clean", **given, prompt="clean", mode="raw"))
        assert {r.cleaned[:5] for r in cleaned.collect()} == {"CLEAN"}
        served = {**{k: v for k, v in given.items() if k != "server"}, "serve": shlex.join([sys.executable, "-c", SERVER, "{port}"])}
        own = cli.run_transcription(spark, options("run-transcription", **served, prompt="text of it", limit=0)).collect()
        assert {r.transcript for r in own} == {"TEXT OF IT"}
        record = cli.pipeline(spark, options("pipeline", **{**given, "input": tmp_path / "in" / "p0.png"}, prompt='{"SUBJECT": 1}')).first()
        assert (record.ocr_engine, record.extraction_mode, record.error if "error" in record else None) == ("stub", "vlm_image", None)
    board = cli.full_benchmark(spark, options("full-benchmark", **given, engines="stub,nothing")).collect()
    assert [(r.engine, r.pages) for r in board] == [("stub", 6)]
    stored = spark.read.parquet(f"{given['output']}/ocr/stub").collect()
    assert all(r.stamp_present and len(r.regions) == 2 for r in stored)


def test_check_tokenizer(spark):
    import public_tokenizers

    row = cli.check_tokenizer(spark, options("check-tokenizer", model=public_tokenizers.path("byte_bpe_50k.json"), text="one two")).first()
    assert row.round_trip and row.n_tokens == 2


def test_targets_need_clean_records(spark):
    pages = spark.createDataFrame([("a", 1), ("b", 1)], "document_id string, page int")
    empty = {n: None for n in split.TARGET}
    rows = [("a", 1, None, {**empty, "subject": "كتاب", "attachments": None}), ("b", 1, "failed", empty)]
    kinds = {**{n: "string" for n in split.TARGET}, "attachments": "array<string>", "uncertain_lines": "array<string>"}
    made = spark.createDataFrame([(d, p, e, *[r[n] for n in split.TARGET]) for d, p, e, r in rows], "document_id string, page int, error string, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    got = {r.document_id: r.target for r in split.label_targets(pages, made).collect()}
    assert got["b"] is None and json.loads(got["a"])["subject"] == "کتاب" and json.loads(got["a"])["attachments"] == []
    assert pages.select(split.content_target(F.col("document_id"), F.col("page")).alias("t")).first().t == "a\npage 1"


def test_pages_are_asked_with_their_own_prompts(spark):
    pages = spark.createDataFrame([("a", 1, "s", b"1", "x"), ("b", 1, "s", b"2", "y")], "document_id string, page int, source string, image binary, prompt string")
    assert {r.document_id: r.text for r in answers.ask_each(pages, lambda: lambda p, i: p + p).collect()} == {"a": "xx", "b": "yy"}
