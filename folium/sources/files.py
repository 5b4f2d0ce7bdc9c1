"""Input files, page manifests, records, transcripts and truth, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions.text import strip
from folium.sources.sinks import POINTER

IMAGES, PDFS = (".png", ".jpg", ".jpeg"), (".pdf",)
MANIFEST = "document_id string, page int, source string, raw_image string, images map<string,string>"
#: A name that a versioned write has given: _ and a UTC time before the suffix.
BACKUP = r"_\d{8}T\d{6}Z\.json$"


def document_id(path: Column) -> Column:
    """Name of the file without its suffix, spaces as _."""
    return F.replace(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(" "), F.lit("_"))


def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, content and suffix of all images and PDFs below a folder, whatever the case of their suffix."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.withColumn("suffix", suffix).where(F.col("suffix").isin(*IMAGES, *PDFS))


def raw_pages(files: DataFrame, pdf_pages: Callable[[bytes], list[bytes]] | None = None) -> DataFrame:
    """document_id, page, source and image of each page: PDFs give their pages from 1 on, images are page 1; repeated image ids get _2, _3, ... by path.

    pdf_pages turns a PDF into page images; without it PDFs give an error row, as a missing library would.
    """
    images = files.where(F.col("suffix").isin(*IMAGES)).select(document_id(F.col("path")).alias("document_id"), "path", "content")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("path"))
    images = images.select(F.when(n > 1, F.concat("document_id", F.lit("_"), n.cast("string"))).otherwise(F.col("document_id")).alias("document_id"), F.lit(1).alias("page"), F.col("path").alias("source"), F.col("content").alias("image"), F.lit(None).cast("string").alias("error"))

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, path, content in frame.itertuples(index=False):
                try:
                    if pdf_pages is None:
                        raise RuntimeError("no PDF reader")
                    out += [(d, k, path, image, None) for k, image in enumerate(pdf_pages(bytes(content)), 1)]
                except Exception as e:  # a broken file is a row, not the end of the job
                    out.append((d, 1, path, None, str(e)))
            yield pd.DataFrame(out, columns=["document_id", "page", "source", "image", "error"])

    pdfs = files.where(F.col("suffix").isin(*PDFS)).select(document_id(F.col("path")).alias("document_id"), "path", "content")
    return images.unionByName(pdfs.mapInPandas(explode, "document_id string, page int, source string, image binary, error string"))


def manifest(spark: SparkSession, path: str, document: str | None = None) -> DataFrame:
    """Rows of a manifest: a folder of versions, as write_manifest makes it, or one JSON document {"pages": [...]}; none if it isn't there.

    document: pages of one document only; of a folder just the files whose range it falls into are read.
    """
    from pyspark.errors import AnalysisException

    kind = ",".join(c.replace(" ", ":", 1) for c in MANIFEST.split(", "))
    try:
        current = spark.read.text(f"{path}/{POINTER}").first()
    except AnalysisException:
        current = None
    try:
        if current is None:
            rows = spark.read.schema(f"pages array<struct<{kind}>>").json(path, multiLine=True).select(F.inline("pages"))
        elif document is None:
            rows = spark.read.schema(MANIFEST).json(f"{path}/{current.value}/pages")
        else:
            span = "first struct<document_id:string,page:int>, last struct<document_id:string,page:int>, file string"
            hit = spark.read.schema(span).json(f"{path}/{current.value}/index").where((F.col("first.document_id") <= document) & (F.col("last.document_id") >= document))
            found = [f"{path}/{current.value}/pages/{r.file}" for r in hit.select("file").collect()]  # those that one document spans
            rows = spark.read.schema(MANIFEST).json(found) if found else spark.createDataFrame([], MANIFEST)
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    return rows if document is None else rows.where(F.col("document_id") == document)


def pdf_pages(dpi: int = 300, first_only: bool = False) -> Callable[[bytes], list[bytes]]:
    """A PDF reader for raw_pages: all pages as images, or the first one.

    Where the library pdf2image is installed it draws the pages at so many dots an inch. Elsewhere scanned pages give their image as it is
    in the file; pages of text have none, and the file's row says so.
    """

    def read(content: bytes) -> list[bytes]:
        import io

        from folium.sources import pdf

        try:
            from pdf2image import convert_from_bytes
        except ImportError:
            return pdf.pages(content, first_only)
        out = []
        for image in convert_from_bytes(content, dpi=dpi, **({"first_page": 1, "last_page": 1} if first_only else {})):
            held = io.BytesIO()
            image.convert("RGB").save(held, "PNG")
            out.append(held.getvalue())
        return out

    return read


def manifest_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The manifest, or what build gives where it isn't there or has no pages."""
    found = manifest(spark, path)
    return found if found.take(1) else build()


def manifest_rows(pages: DataFrame, variants: DataFrame) -> DataFrame:
    """Manifest rows: document_id, page, source, raw_image and images (path by mode). variants has document_id, page, mode and path."""
    images = variants.groupBy("document_id", "page").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "path")))).alias("images"))
    out = pages.select("document_id", "page", "source").join(images, ["document_id", "page"], "left")
    return out.select("document_id", "page", "source", F.coalesce(F.col("images")["raw"], F.col("source")).alias("raw_image"), "images")


def prompt(path: str) -> str:
    """A prompt's text; prompts are a few KB on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def run_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Page records of one run's folder, in order of their names: not of folders below, backups and raw outputs too, without broken files."""
    return records(spark, folder, schema, recursive=False, keep_backups=True, keep_raw=True).orderBy("file_name")


def review_records(spark: SparkSession, folder: str, schema: str, engine: str) -> DataFrame:
    """Records to review below folder/<engine>: the last run of the engine, and all that stand two or three deep outside of runs. What is in both comes twice."""
    rows = records(spark, folder, schema, keep_backups=True, keep_raw=True)
    below = F.substring_index("file_path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    depth = F.size(F.split(below, "/"))
    runs = rows.where(below.startswith(f"{engine}/runs/") & (depth == 4))
    return latest_run(runs).unionAll(rows.where(depth.isin(2, 3) & ~F.contains(below, F.lit("/runs/"))))


def ocr_texts(spark: SparkSession, folder: str, engine: str, modes: tuple[str, ...] = ("raw", "clean", "binarized")) -> DataFrame:
    """mode, stem and text of the files <folder>/<engine>/<mode>/*.txt; modes without a folder have none."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "mode string, stem string, text string")
    for mode in modes:
        try:
            texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(f"{folder}/{engine}/{mode}")
        except AnalysisException:
            continue
        out = out.unionAll(texts.select(F.lit(mode).alias("mode"), F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("stem"), F.col("value").alias("text")))
    return out


def records(spark: SparkSession, folder: str, schema: str, recursive: bool = True, keep_backups: bool = False, keep_raw: bool = False) -> DataFrame:
    """JSON records below a folder, one a file, with file_name; raw outputs and backups are left out unless they are asked for, and so are broken files."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json").text(folder)
    texts = texts.select(F.col("value"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"))
    if not keep_raw:
        texts = texts.where(~F.col("file_name").contains(".raw"))
    if not keep_backups:
        texts = texts.where(~F.col("file_name").rlike(BACKUP))
    parsed = texts.where(F.try_parse_json("value").isNotNull()).select("file_name", "file_path", F.from_json("value", schema).alias("r"))
    return parsed.select("file_name", "file_path", "r.*")


def latest_run(rows: DataFrame) -> DataFrame:
    """Of records below runs/<run>/, those of the last run; all, if there are no runs."""
    run = F.regexp_extract("file_path", r"/runs/([^/]+)/", 1)
    last = rows.agg(F.max(run).alias("_last"))
    return rows.join(F.broadcast(last), run == F.col("_last"), "left_semi")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the truth's CSV with a document_id and a page; the last of repeated keys by place in the file."""
    rows = spark.read.csv(path, header=True)
    rows = rows.where("coalesce(document_id, '') <> '' AND coalesce(page, '') <> ''").withColumn("page", F.col("page").try_cast("int"))
    rows = rows.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    others = [c for c in rows.columns if c not in ("document_id", "page", "_at")]
    return rows.groupBy("document_id", "page").agg(F.max_by(F.struct(*others), "_at").alias("r")).select("document_id", "page", "r.*")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, page and transcript of Markdown files named <document>_p<page>...; blank ones are null."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    name = F.col("_metadata.file_name")
    stripped = strip(F.col("value"))
    return texts.select(F.regexp_extract(name, r"^(.*)_p(\d+)", 1).alias("document_id"), F.regexp_extract(name, r"^(.*)_p(\d+)", 2).cast("int").alias("page"), F.nullif(stripped, F.lit("")).alias("transcript"))


def limited(pages: DataFrame, limit: int | None, default: int = 5, order: tuple[str, ...] = ("document_id", "page")) -> DataFrame:
    """The first pages by order: none given takes the default, 0 or less takes all."""
    n = default if limit is None else limit
    return pages if n <= 0 else pages.orderBy(*order).limit(n)
