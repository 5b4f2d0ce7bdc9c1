"""Queries over page images, drawn from the characters of `pages`, and over engines and servers that stand in for models."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.models import answers, engines, images, png, server
from folium.plans.base import query, table

# Characters of a line, pixels of a character's side, and the white border.
LINE, CELL, BORDER = 60, 2, 40


def drawn(text: str) -> np.ndarray:
    """A page with a black square for each character that is no white space."""
    rows = -(-len(text) // LINE)
    ink = np.zeros(rows * LINE, bool)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ink[: len(text)] = np.all([codes != ord(c) for c in " \t\r\n"], axis=0)
    cells = np.where(ink.reshape(rows, LINE), 0, 255).astype(np.uint8)
    return np.pad(cells.repeat(CELL, axis=0).repeat(CELL, axis=1), BORDER, constant_values=255)


#: Tasks for each core, where a table in few files would leave cores idle that images could be made on.
SPREAD = 4


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each page. A page takes far longer to work on than to send, so few large parts are dealt out anew."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [png.encode(drawn(t or "")) for t in frame["html"]]
            yield pd.DataFrame({"document_id": frame["page_id"].astype(str), "page": 1, "image": content})

    pages, parts = table(spark, sf_dir, "pages").select("page_id", "html"), SPREAD * spark.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < parts:
        pages = pages.repartition(parts, "page_id")
    return pages.mapInPandas(draw, "document_id string, page int, image binary")


def _side(low: str, high: str, size: str) -> str:
    return f"least({BORDER} + {CELL} * ({high} + 1) + {images.MARGIN}, {size}) - greatest({BORDER} + {CELL} * {low} - {images.MARGIN}, 0)"


@query(f"""
WITH sizes AS (
    SELECT page_id, coalesce(html, '') AS html, {CELL * LINE + 2 * BORDER} AS w, {CELL} * ceil(length(coalesce(html, '')) / {LINE})::INT + {2 * BORDER} AS h FROM pages
), cells AS (
    SELECT page_id, i // {LINE} AS r, i % {LINE} AS c FROM (SELECT page_id, html, unnest(range(length(html))) AS i FROM sizes) WHERE substr(html, i + 1, 1) NOT IN (' ', chr(9), chr(10), chr(13))
), ink AS (SELECT page_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY page_id), cut AS (
    SELECT page_id, w, h, {_side("c0", "c1", "w")} AS cw, {_side("r0", "r1", "h")} AS ch FROM sizes LEFT JOIN ink USING (page_id)
), kept AS (SELECT *, cw >= {images.LEAST_SIDE} * w AND ch >= {images.LEAST_SIDE} * h AS fits FROM cut)
SELECT page_id::VARCHAR AS document_id, mode, CASE WHEN mode <> 'raw' AND fits THEN cw ELSE w END::INT AS width, CASE WHEN mode <> 'raw' AND fits THEN ch ELSE h END::INT AS height, true AS made
FROM kept, (VALUES ('raw'), ('clean'), ('binarized')) modes(mode)
""")
def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the three variants of each page's image: the border goes where enough is left."""
    return images.variants(_scans(spark, sf_dir)).selectExpr("document_id", "mode", "width", "height", "image IS NOT NULL AS made")


@query(f"""
WITH cells AS (
    SELECT page_id, i // {LINE} AS r, i % {LINE} AS c FROM (SELECT page_id, html, unnest(range(length(html))) AS i FROM pages) WHERE substr(html, i + 1, 1) NOT IN (' ', chr(9), chr(10), chr(13))
)
SELECT p.page_id::VARCHAR AS document_id, {CELL * CELL} * count(c.r) AS ink, {BORDER} + {CELL} * min(c.c) AS x, {BORDER} + {CELL} * min(c.r) AS y
FROM pages p LEFT JOIN cells c USING (page_id) GROUP BY p.page_id
""")
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black pixels of each page's image, which is written and read as PNG, and the corner of their box."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, content in zip(frame["document_id"], frame["image"]):
                ink = images.grey(png.decode(content)) <= images.PAPER
                out.append((d, int(ink.sum()), *((int(ink.any(axis=k).argmax()) for k in (0, 1)) if ink.any() else (None, None))))
            yield pd.DataFrame(out, columns=["document_id", "ink", "x", "y"]).astype({"x": "Int64", "y": "Int64"})

    return _scans(spark, sf_dir).select("document_id", "image").mapInPandas(count, "document_id string, ink long, x long, y long")


class Narrow(engines.LengthEngine):
    """A stand-in that takes 64 images at once, but holds five only, and can't read those of an odd length."""

    name, batch = "narrow", 64

    def read_batch(self, images: list[bytes]) -> list[tuple[str, list[dict], float | None]]:
        if len(images) > 5:
            raise MemoryError
        if any(len(i) % 2 for i in images):
            raise ValueError("odd")
        return super().read_batch(images)


@query("SELECT page_id, CASE WHEN strlen(html) % 2 = 1 THEN '' ELSE coalesce(strlen(html), 0) || ' bytes' END AS text, CASE WHEN strlen(html) % 2 = 1 THEN 'odd' END AS error, true AS fits FROM pages")
def ocr_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page comes back from an engine whose memory doesn't hold its batches, broken pages by themselves."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("image"))
    return engines.read_pages(pages, Narrow).select("page_id", "text", "error", (F.col("batch_size") <= 5).alias("fits"))


# A model server that tells the length of what it is asked.
LENGTH_SERVER = """
import http.server, json, sys
class H(http.server.BaseHTTPRequestHandler):
    def do_GET(self): self.answer(b"ok")
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"][-1]["text"]
        self.answer(json.dumps({"choices": [{"message": {"content": str(len(asked))}}]}).encode())
    def answer(self, body): self.send_response(200); self.end_headers(); self.wfile.write(body)
    def log_message(self, *a): pass
http.server.ThreadingHTTPServer(("127.0.0.1", int(sys.argv[1])), H).serve_forever()
"""


@query("SELECT page_id::VARCHAR AS document_id, length(coalesce(html, ''))::VARCHAR AS text, NULL::VARCHAR AS error FROM pages")
def served_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page asked of the server that its executor's workers start and share."""
    pages = table(spark, sf_dir, "pages").selectExpr("cast(page_id AS string) AS document_id", "1 AS page", "'pages' AS source", "cast(null AS binary) AS image", "coalesce(html, '') AS prompt")
    return answers.ask_each(pages, server.executor_model([sys.executable, "-c", LENGTH_SERVER, "{port}"], linger=5.0)).select("document_id", "text", "error")
