"""Commands over folders of pages and records: python -m folium.cli COMMAND --help."""

from __future__ import annotations

import argparse
import logging
import shlex
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import json_text, rules, validate
from folium.models import answers, engines, images, regions, server
from folium.operators import documents, merge, packets, progress, records, reports, review, scoring, split
from folium.sources import files, sinks

RECORD = ", ".join(f"{n} string" for n in json_text.TEXT_FIELDS) + ", document_id string, page int, source string, engine string, error string, raw_text string, run_id string, runtime_seconds double, gpu_memory_mb double, avg_ocr_confidence double"
REVIEW = (
    RECORD + ", image_path string, extracted_at string, attachments array<string>, uncertain_lines array<string>, stamp_present boolean, signature_present boolean, "
    "extraction_confidence double, validation_summary struct<green:int,yellow:int,red:int>"
)
log = logging.getLogger("folium")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _stamp():
    return F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")


def _model(a: argparse.Namespace) -> Callable[[], Callable[[str, bytes | None], str]]:
    """How workers get at the model: a server's address, the command of a server that each executor starts, or a checkpoint that they load."""
    if a.server:
        url = a.server
        return lambda: server.SafeHttpModel(url)
    if a.serve:
        return server.executor_model(shlex.split(a.serve), safe=True, health=a.health, path=a.path)
    if a.model:
        return server.transformers_model(a.model)
    raise ValueError("--server, --serve or --model has to name a model")


def preprocess(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pages of all input files and their image variants; pages that are there already stay as they are."""
    pages = files.raw_pages(files.input_files(spark, a.input), files.pdf_pages(a.dpi))
    done = _table(spark, f"{a.output}/pages", "document_id string, page int")
    merge.missing(pages, done, ["document_id", "page"]).write.mode("append").parquet(f"{a.output}/pages")
    pages = spark.read.parquet(f"{a.output}/pages")
    images.variants(pages).write.mode("overwrite").partitionBy("mode").parquet(f"{a.output}/variants")
    made = spark.read.parquet(f"{a.output}/variants").select("document_id", "page", "mode", F.concat_ws("_", records.stem(F.col("document_id"), F.col("page")), "mode").alias("path"))
    rows = files.manifest_rows(pages, made)
    sinks.write_manifest(rows, f"{a.output}/manifest")
    return rows


def _pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The manifest's pages; they are made first where there are none."""
    return files.manifest_or_build(spark, f"{a.output}/manifest", lambda: preprocess(spark, a))


def run_ocr(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Text of all variants by an engine, with the page's stamps, rule fields and lights; variants that are there already are left alone."""
    _pages(spark, a)
    variants = spark.read.parquet(f"{a.output}/variants")
    path = f"{a.output}/ocr/{a.engine}"
    if not a.overwrite:
        variants = merge.missing(variants, _table(spark, path, "document_id string, page int, mode string"), ["document_id", "page", "mode"])
    found = regions.detected(spark.read.parquet(f"{a.output}/pages").select("document_id", "page", "image"))
    found = found.select("document_id", "page", "stamp_present", "signature_present", "regions", F.col("confidence_notes").alias("notes"))
    read = engines.read_pages(variants.drop("error"), a.engine).join(found, ["document_id", "page"], "left")
    out = validate.validate(rules.extract(read, notes=F.col("notes")).drop("notes"))
    with progress.counted(out, f"{a.engine}: pages read") as counted:
        counted.rows.write.mode("overwrite" if a.overwrite else "append").partitionBy("mode").parquet(path)
    stored = spark.read.parquet(path)
    flat = records.flat(stored.withColumns({"preprocessing_mode": F.col("mode"), "raw_text": F.col("text"), "avg_ocr_confidence": F.col("avg_confidence")}))
    flat.write.mode("overwrite").parquet(f"{a.output}/records/{a.engine}")
    return stored


def full_benchmark(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """run-ocr by each of the engines, then their leaderboard; an engine that fails is logged and left out."""
    done = []
    for name in a.engines.split(","):
        a.engine = name.strip()
        try:
            run_ocr(spark, a)
            done.append(a.engine)
        except Exception:
            log.exception("engine %s failed", a.engine)
    if not done:
        raise RuntimeError("no engine has come to its end")
    rows = spark.read.parquet(*[f"{a.output}/records/{n}" for n in done])
    return _evaluated(spark, a, rows)


def _asked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pages with images and transcripts, as many as the limit says."""
    pages = spark.read.parquet(f"{a.output}/variants").where(F.col("mode") == a.variant).select("document_id", "page", "image")
    sources = spark.read.parquet(f"{a.output}/pages").select("document_id", "page", "source")
    pages = files.limited(pages.join(sources, ["document_id", "page"]), 0 if a.all else a.limit)
    texts = _table(spark, f"{a.output}/transcripts", "document_id string, page int, transcript string").select("document_id", "page", "transcript")
    return pages.join(texts, ["document_id", "page"], "left")


def run_vlm(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A model's answers to page images and transcripts, parsed, repaired, coerced and validated, by run; with --engine vlm the confidence is filled in and OCR text attached."""
    _pages(spark, a)
    got = answers.ask(_asked(spark, a), _model(a), a.prompt)
    return _answered(spark, a, got)


def parse_answers(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A model's answers (document_id, page, source, text as JSON lines) parsed, repaired, coerced and validated, by run."""
    return _answered(spark, a, spark.read.schema("document_id string, page int, source string, text string").json(a.input))


def _answered(spark: SparkSession, a: argparse.Namespace, got: DataFrame) -> DataFrame:
    keep = [c for c in ("document_id", "page", "source", "runtime_seconds") if c in got.columns]
    asked = F.col("error") if "error" in got.columns else F.lit(None).cast("string")
    made = records.with_answers(got.select(*keep, "text", asked.alias("_asked"))).withColumn("error", F.coalesce("_asked", "error")).drop("_asked")
    out = validate.validate(records.sanitized(made)).withColumn("run_id", F.lit(a.run) if a.run else _stamp())
    with progress.counted(out, "answers") as counted:
        sinks.write_run(counted.rows, f"{a.output}/answers")
    return spark.read.parquet(f"{a.output}/answers")


def run_transcription(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A model's transcripts of the pages; pages that have one are left alone unless --overwrite."""
    _pages(spark, a)
    pages, path = _asked(spark, a), f"{a.output}/transcripts"
    if not a.overwrite:
        pages = pages.where("transcript IS NULL")
    got = answers.ask(pages.withColumn("transcript", F.lit(None).cast("string")), _model(a), a.prompt).where("error IS NULL")
    name = F.lit(a.server or a.serve or a.model)
    made = got.select("document_id", "page", F.nullif(F.trim("text"), F.lit("")).alias("transcript"), sinks.transcript(F.col("document_id"), F.col("page"), name, F.col("text")).alias("markdown"))
    made.write.mode("overwrite" if a.overwrite else "append").parquet(path)
    return spark.read.parquet(path)


def run_llm_clean(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """An engine's texts cleaned by a model, by mode; what is cleaned already is left alone."""
    texts = spark.read.parquet(f"{a.output}/ocr/{a.engine}").select("mode", records.stem(F.col("document_id"), F.col("page")).alias("stem"), "text")
    if a.mode != "all":
        texts = texts.where(F.col("mode") == a.mode)
    path = f"{a.output}/cleaned/{a.engine}"
    new = merge.missing(texts, _table(spark, path, "mode string, stem string"), ["mode", "stem"])
    answers.clean_texts(new, _model(a), a.prompt).write.mode("append").partitionBy("mode").parquet(path)
    return spark.read.parquet(path)


def pipeline(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """One file from image to record: OCR, rules, a model's fields and its second look if there is a model. A file that the engine reads no text from is an error."""
    pages = files.raw_pages(files.input_files(spark, a.input), files.pdf_pages(a.dpi, first_only=True)).where("page = 1")
    read = engines.read_pages(pages.drop("error").withColumn("kept", F.col("image")), a.engine).withColumnsRenamed({"kept": "image", "source": "input_file", "runtime_seconds": "ocr_runtime_seconds"})
    read.write.mode("overwrite").parquet(f"{a.output}/pipeline/ocr")
    read = spark.read.parquet(f"{a.output}/pipeline/ocr")
    bad = read.where("trim(coalesce(text, '')) = ''").select("input_file", "error").first()
    if bad:
        raise RuntimeError(f"{a.engine} read no text of {bad.input_file}: {bad.error or 'nothing there'}")
    rows = read.withColumn("image_file", F.col("input_file"))
    asks = a.server or a.serve or a.model
    rows = _look(rows, _model(a), F.lit(a.prompt), "extracted", "extraction") if asks else rows.withColumns(_none("extracted", "extraction"))
    first = documents.merged(rows.withColumns(_none("corrected", "correction"))).select("input_file", F.col("extracted_fields").alias("_first"))
    rows = rows.join(first, "input_file")
    rows = _look(rows, _model(a), documents.question(F.col("text"), F.col("_first")), "corrected", "correction") if asks else rows.withColumns(_none("corrected", "correction"))
    sinks.write_json(documents.merged(rows.drop("_first")), f"{a.output}/pipeline/records")
    return spark.read.json(f"{a.output}/pipeline/records")


def _none(name: str, times: str) -> dict:
    return {name: F.try_parse_json(F.lit(None).cast("string")), f"{times}_runtime_seconds": F.lit(0.0)}


def _look(rows: DataFrame, model: Callable, prompt, name: str, times: str) -> DataFrame:
    """rows with a model's answer as VARIANT; each row is asked with its own prompt."""
    pages = rows.select(F.col("input_file").alias("document_id"), F.lit(1).alias("page"), F.lit("").alias("source"), "image", prompt.alias("prompt"))
    got = answers.ask_each(pages, model).select(F.col("document_id").alias("input_file"), json_text.parse(F.col("text"), repair=False).alias(name), F.col("runtime_seconds").alias(f"{times}_runtime_seconds"))
    return rows.join(got, "input_file", "left")


def aggregate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Document packets of the latest run, and the run's header."""
    pages = packets.latest_run(spark.read.parquet(f"{a.output}/answers"))
    pages = pages.withColumn("file_name", F.concat_ws("_", "document_id", "page"))
    sinks.write_json(packets.packets(pages).orderBy("source"), f"{a.output}/packets")
    out = spark.read.json(f"{a.output}/packets")
    sinks.write_json(reports.run_header(pages, out, f"{a.output}/answers"), f"{a.output}/run")
    return out


def build_finetune_data(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chat examples of the pages, split by source: of the fields where there is an answer without error, and with --content of the content."""
    found = spark.read.parquet(f"{a.output}/answers")
    pages = found.select("document_id", "page", "source").distinct().withColumn("key", split.source_key(F.col("source"), F.col("document_id")))
    pages = split.label_targets(split.split_by_source(pages, "key", a.ratio), packets.latest_run(found))
    pages = pages.withColumn("image", records.stem(F.col("document_id"), F.col("page")))
    sinks.write_jsonl(split.examples(pages, a.prompt, a.content), "line", f"{a.output}/finetune")
    sinks.write_json(split.summary(pages, "key"), f"{a.output}/finetune-summary")
    return spark.read.json(f"{a.output}/finetune-summary")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Leaderboard of the engines' records: by accuracy where there is a truth, else by name."""
    return _evaluated(spark, a, files.records(spark, a.input, RECORD))


def _evaluated(spark: SparkSession, a: argparse.Namespace, rows: DataFrame) -> DataFrame:
    means = {"avg_runtime_seconds": F.col("runtime_seconds"), "avg_gpu_memory_mb": F.col("gpu_memory_mb"), "avg_ocr_confidence": F.col("avg_ocr_confidence")}
    if a.truth and (truth := files.ground_truth(spark, a.truth)).take(1):
        scored = scoring.score(rows, truth, ["document_id", "page"])
        sinks.write_csv(scored.drop("boxes"), f"{a.output}/scores")
        board = scoring.ranked(scoring.leaderboard(scored, "engine", F.col("error"), F.col("raw_text"), means | {"field_accuracy": F.col("field_accuracy")}))
        report = reports.with_truth(board)
    else:
        board = scoring.leaderboard(rows, "engine", F.col("error"), F.col("raw_text"), means).orderBy("engine")
        report = reports.without_truth(board)
    sinks.write_csv(board, f"{a.output}/leaderboard")
    sinks.write_report(report, f"{a.output}/report", spark)
    return board


def check_tokenizer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Does a tokenizer's file give a text back?"""
    path = a.model

    def codec():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return (lambda x: t.encode(x, add_special_tokens=False).ids), (lambda ids: t.decode(ids))

    return answers.round_trips(spark.createDataFrame([(a.text,)], "text string"), codec)


def download_model(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A model's files in a folder."""
    found = server.fetch(a.model, a.files.split(","), a.output)
    return spark.createDataFrame([(p,) for p in found], "path string")


def review_list(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Records under review that the facets let through, by document and page."""
    rows = review.review_rows(files.review_records(spark, a.input, REVIEW, a.engine))
    rows = rows.withColumnsRenamed({"red_flags": "red", "yellow_flags": "yellow"})
    found = review.filtered(rows, a.engine, a.document, a.search, a.errors, a.flags, a.confidence)
    return found.withColumn("label", review.page_label(F.col("document_id"), F.col("page"), F.col("subject"))).orderBy("document_id", "page")


def review_save(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Edits (JSON lines with document_id and page, of the kept run) over the records, saved beside them; accepted ones are also appended to the labels."""
    found = files.review_records(spark, a.input, REVIEW, a.engine).where(F.col("engine") == a.engine).dropDuplicates(["document_id", "page"])
    edits = spark.read.json(a.edits)
    for c in ("review_status", "review_notes"):
        if c not in edits.columns:
            edits = edits.withColumn(c, F.lit(None).cast("string"))
    saved = review.reviewed(found, edits.withColumn("page", F.col("page").cast("int")), ["document_id", "page"])
    sinks.write_versions(saved, f"{a.output}/reviewed", overwrite=False)
    accepted = saved.where("review_status = 'accepted'").select(review.approved_line(F.lit(a.prompt)).alias("line"))
    sinks.write_jsonl(accepted, "line", f"{a.output}/approved", by=None)
    return saved.select("document_id", "page", "review_status")


COMMANDS = {
    "preprocess": preprocess, "run-ocr": run_ocr, "full-benchmark": full_benchmark, "run-vlm": run_vlm, "parse-answers": parse_answers, "run-transcription": run_transcription,
    "run-llm-clean": run_llm_clean, "pipeline": pipeline, "aggregate": aggregate, "build-finetune-data": build_finetune_data, "evaluate": evaluate, "check-tokenizer": check_tokenizer,
    "download-model": download_model, "review": review_list, "review-save": review_save,
}
_TEXTS = {"input": "input", "output": "output", "engine": "stub", "engines": "stub", "mode": "all", "variant": "raw", "truth": None, "run": None, "prompt": "Read the page.", "content": None, "server": None, "serve": None, "health": "/health", "path": "/v1/chat/completions", "model": None, "text": "one, two", "files": "", "document": None, "search": None, "edits": None}
_NUMBERS = {"ratio": 0.1, "confidence": 0.0}
_WHOLE = {"dpi": 300, "limit": None}
_FLAGS = ("overwrite", "all", "errors", "flags")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folium")
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for kind, options in ((str, _TEXTS), (float, _NUMBERS), (int, _WHOLE)):
            for k, v in options.items():
                p.add_argument(f"--{k}", type=kind, default=v)
        for k in _FLAGS:
            p.add_argument(f"--{k}", action="store_true")
        p.add_argument("--config", help="a YAML file of folders and settings")
    return top


def main(argv: list[str] | None = None) -> None:
    from folium import config
    from folium.session import session

    a = parser().parse_args(argv)
    if a.config:
        found = config.load(a.config)
        a.input, a.output, a.dpi = found["input_dir"], found["output_dir"], int(found["dpi"])
        a.engines = ",".join(found["selected_engines"]) or a.engines
        config.logger(found["report_dir"])
    print(sinks.markdown(COMMANDS[a.command](session(), a), 20))


if __name__ == "__main__":
    main()
