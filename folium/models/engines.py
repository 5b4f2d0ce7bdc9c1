"""Engines that turn page images into text, run inside mapInPandas.

An engine is built once for each partition. What it raises becomes the row's error: a broken page never fails a task.
"""

from __future__ import annotations

import functools
import importlib.util
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folium import config
from folium.models.png import decode

RESULT = "engine string, text string, boxes string, avg_confidence double, error string, runtime_seconds double, gpu_memory_mb double, batch_size int"


class Engine(ABC):
    """name, the library that it needs, and read(): text, boxes (polygon, text, confidence) and mean confidence of an image."""

    name = ""
    library: str | None = None
    #: Images that read_batch takes at once.
    batch = 1

    def available(self) -> bool:
        return self.library is None or importlib.util.find_spec(self.library) is not None

    @abstractmethod
    def read(self, image: bytes) -> tuple[str, list[dict], float | None]: ...

    def read_batch(self, images: list[bytes]) -> list[tuple[str, list[dict], float | None]]:
        """What read() gives of each image; engines that take many images at once have their own."""
        return [self.read(i) for i in images]


class LengthEngine(Engine):
    """Deterministic stand-in: tells an image's length. For tests and dry runs."""

    name = "stub"

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        return f"{len(image)} bytes", [], 1.0 if image else 0.0


class TesseractEngine(Engine):
    name, library = "tesseract", "pytesseract"

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        import io

        import pytesseract
        from PIL import Image

        page = Image.open(io.BytesIO(image))
        words = pytesseract.image_to_data(page, lang="ara", output_type=pytesseract.Output.DICT)
        boxes = [
            {"box": [[x, y], [x + w, y], [x + w, y + h], [x, y + h]], "text": t, "confidence": float(c) / 100}
            for x, y, w, h, t, c in zip(*(words[k] for k in ("left", "top", "width", "height", "text", "conf")))
            if float(c) > 0
        ]
        known = [b["confidence"] for b in boxes]
        return pytesseract.image_to_string(page, lang="ara"), boxes, sum(known) / len(known) if known else None


class EasyOcrEngine(Engine):
    name, library = "easyocr", "easyocr"

    def __init__(self):
        self.reader = None

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        import easyocr

        self.reader = self.reader or easyocr.Reader(["ar", "en"])
        boxes = [{"box": [[int(x), int(y)] for x, y in b], "text": t, "confidence": float(c)} for b, t, c in self.reader.readtext(image)]
        known = [b["confidence"] for b in boxes]
        return "\n".join(b["text"] for b in boxes), boxes, round(sum(known) / len(known), 4) if known else None


def _polygon(box) -> list[list[int]]:
    return [[int(x), int(y)] for x, y in box]


def _mean(boxes: list[dict]) -> float | None:
    known = [b["confidence"] for b in boxes if b["confidence"] is not None]
    return round(sum(known) / len(known), 4) if known else None


def _lines(boxes: list[dict]) -> tuple[str, list[dict], float | None]:
    return "\n".join(b["text"] for b in boxes), boxes, _mean(boxes)


class PaddleEngine(Engine):
    """The interface of version 3 (predict) where there is one, else the older one (ocr)."""

    name, library = "paddle", "paddleocr"

    def __init__(self):
        self.reader = None

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        from paddleocr import PaddleOCR

        self.reader = self.reader or PaddleOCR(lang="ar")
        pixels = decode(image)[:, :, ::-1]
        if hasattr(self.reader, "predict"):
            boxes = [
                {"box": _polygon(p), "text": t, "confidence": float(c)}
                for page in self.reader.predict(pixels) or []
                for t, c, p in zip(page["rec_texts"], page["rec_scores"], page["rec_polys"])
            ]
        else:
            boxes = [{"box": _polygon(p), "text": t, "confidence": float(c)} for page in self.reader.ocr(pixels) or [] for p, (t, c) in page or []]
        return _lines(boxes)


class SuryaEngine(Engine):
    """Detection and recognition on the device; a page that its memory can't hold is read on the CPU, and so are the next ones."""

    name, library = "surya", "surya"

    def __init__(self):
        self.predictors = None

    def _load(self, where: str | None = None):
        from surya.detection import DetectionPredictor
        from surya.recognition import RecognitionPredictor

        options = {"device": where} if where else {}
        try:
            from surya.foundation import FoundationPredictor

            recognition = RecognitionPredictor(FoundationPredictor(**options))
        except ImportError:
            recognition = RecognitionPredictor(**options)
        return recognition, DetectionPredictor(**options)

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        from PIL import Image

        page = Image.fromarray(decode(image))
        self.predictors = self.predictors or self._load()
        try:
            found = self.predictors[0]([page], det_predictor=self.predictors[1])[0]
        except RuntimeError as e:
            if "out of memory" not in str(e).lower():
                raise
            self.predictors = self._load("cpu")
            found = self.predictors[0]([page], det_predictor=self.predictors[1])[0]
        return _lines([{"box": [int(v) for v in line.bbox], "text": line.text, "confidence": None if line.confidence is None else float(line.confidence)} for line in found.text_lines])


class DoclingEngine(Engine):
    """Markdown of the page; it gives neither boxes nor confidences."""

    name, library = "docling", "docling"

    def __init__(self):
        self.converter = None

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        import io

        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        self.converter = self.converter or DocumentConverter()
        page = DocumentStream(name="page.png", stream=io.BytesIO(image))
        return self.converter.convert(page).document.export_to_markdown(), [], None


class TrOcrEngine(Engine):
    """Text of the page by an encoder and decoder; it gives neither boxes nor confidences. Checkpoints that know Latin letters only are no use for other scripts, and say so once."""

    name, library, checkpoint = "trocr", "transformers", "microsoft/trocr-base-printed"

    def __init__(self):
        self.model = None

    def read(self, image: bytes) -> tuple[str, list[dict], float | None]:
        import warnings

        from PIL import Image
        from transformers import TrOCRProcessor, VisionEncoderDecoderModel

        if self.model is None:
            if any(k in self.checkpoint for k in ("printed", "handwritten")):
                warnings.warn(f"{self.checkpoint} reads Latin letters only", stacklevel=2)
            self.processor = TrOCRProcessor.from_pretrained(self.checkpoint)
            self.model = VisionEncoderDecoderModel.from_pretrained(self.checkpoint).to(config.device())
        pixels = self.processor(images=Image.fromarray(decode(image)), return_tensors="pt").pixel_values.to(config.device())
        return self.processor.batch_decode(self.model.generate(pixels, max_new_tokens=256), skip_special_tokens=True)[0], [], None


REGISTRY: dict[str, type[Engine]] = {e.name: e for e in (LengthEngine, TesseractEngine, EasyOcrEngine, PaddleEngine, SuryaEngine, DoclingEngine, TrOcrEngine)}


def build(name: str) -> Engine:
    try:
        return REGISTRY[name.lower()]()
    except KeyError:
        raise ValueError(f"unknown engine {name}: {', '.join(sorted(REGISTRY))}") from None


def out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


class Batches:
    """Reads images in batches of an engine. Where memory runs out, the size is halved and stays so; a batch that fails otherwise is read image by image."""

    def __init__(self, reader: Engine):
        self.reader, self.size = reader, max(1, reader.batch)

    def _tried(self, images: list[bytes]) -> tuple[list | None, Exception | None, config.Measured]:
        with config.Measured() as run:
            try:
                if not self.reader.available():
                    raise RuntimeError(f"{self.reader.library} is not installed")
                got, error = self.reader.read_batch(images), None
                if len(got) != len(images):
                    raise ValueError(f"{len(got)} results of {len(images)} images")
            except Exception as e:
                got, error = None, e
        return got, error, run

    def rows(self, images: list[bytes]) -> Iterator[tuple]:
        """text, boxes, confidence, error, seconds (an image's share of its batch's), the batch's peak MB and its size, for each image in order."""
        at = 0
        while at < len(images):
            part = images[at : at + self.size]
            got, error, run = self._tried(part)
            if error is not None and len(part) > 1:
                if out_of_memory(error):
                    self.size = len(part) // 2
                    continue
                for image in part:
                    one, error, run = self._tried([image])
                    yield (*(one[0] if one else ("", [], None)), str(error) if error else None, run.seconds, run.gpu_memory_mb, 1)
            else:
                share = round(run.seconds / len(part), 4)
                for text, boxes, confidence in got or [("", [], None)]:
                    yield text, boxes, confidence, str(error) if error else None, share, run.gpu_memory_mb, len(part)
            at += len(part)


def read_pages(pages: DataFrame, engine: str | Callable[[], Engine], image: str = "image") -> DataFrame:
    """pages without the image, with the engine's result, times and the size of the batch that a page was read in; engine is a name, or builds one."""
    make = engine if callable(engine) else functools.partial(build, engine)
    make()  # an unknown name fails here, not on the workers
    import json

    keep = [c for c in pages.columns if c != image]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != image)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        batches = Batches(reader)
        for frame in frames:
            found = batches.rows([bytes(c or b"") for c in frame[image]])
            rows = [(reader.name, text, json.dumps(boxes, ensure_ascii=False), *rest) for text, boxes, *rest in found]
            got = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
            got["gpu_memory_mb"] = got["gpu_memory_mb"].astype("float64")
            yield pd.concat([frame[keep].reset_index(drop=True), got], axis=1)

    return pages.mapInPandas(read, f"{schema}, {RESULT}")
