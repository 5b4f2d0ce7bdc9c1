"""Vision-language models and text clean-up behind an HTTP server or a plug-in, inside mapInPandas.

A model is a callable of (prompt, image) to text. Each page that comes back with an error is asked once more without its
transcript; what a model raises becomes the row's error.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a transcript that a prompt quotes.
ANCHOR = 3000


def data_url(mime: Column, content: Column) -> Column:
    # Without the line ends that some versions of base64() set.
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def prompt_with_transcript(prompt: Column, transcript: Column) -> Column:
    """The prompt, and the start of the transcript where there is one."""
    return F.when(transcript.isNotNull(), F.concat(prompt, F.lit("\n\nTranscript of the page:\n"), F.left(transcript, F.lit(ANCHOR)))).otherwise(prompt)


class HttpModel:
    """A chat-completion server; it is asked with fixed decoding settings."""

    def __init__(self, url: str, timeout: float = 600, max_tokens: int = 1400):
        self.url, self.timeout, self.max_tokens = url, timeout, max_tokens

    def __call__(self, prompt: str, image: bytes | None) -> str:
        content: list[dict] = [{"type": "text", "text": prompt}]
        if image:
            content.insert(0, {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}})
        body = {"messages": [{"role": "user", "content": content}], "max_tokens": self.max_tokens, "temperature": 0, "top_k": 1, "seed": 0}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def ask(pages: DataFrame, model: Callable[[], Callable[[str, bytes | None], str]], prompt: str) -> DataFrame:
    """document_id, page, source, text, error, retried and runtime_seconds of each page; pages has document_id, page, source, image and transcript.

    model builds the model, once for each partition.
    """
    anchored = F.col("transcript").isNotNull()
    plain = F.when(anchored, F.lit(prompt))
    return ask_each(pages.select("document_id", "page", "source", "image", prompt_with_transcript(F.lit(prompt), F.col("transcript")).alias("prompt"), plain.alias("plain")), model)


def ask_each(pages: DataFrame, model: Callable[[], Callable[[str, bytes | None], str]]) -> DataFrame:
    """The same with a prompt for each page, and if there is a column plain, what a page is asked again with where its prompt gives an error."""
    plain = F.col("plain") if "plain" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("document_id", "page", "source", "image", "prompt", plain.alias("plain"))

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = model()

        def once(text: str, image: bytes | None) -> tuple[str | None, str | None]:
            try:
                return asked(text, image), None
            except Exception as e:
                return None, str(e)

        for frame in frames:
            out = []
            for d, page, source, image, text, again in frame.itertuples(index=False):
                began = time.perf_counter()
                got, error = once(text, image)
                if retried := bool(error is not None and again is not None):
                    got, error = once(again, image)
                out.append((d, page, source, got, error, retried, round(time.perf_counter() - began, 4)))
            yield pd.DataFrame(out, columns=["document_id", "page", "source", "text", "error", "retried", "runtime_seconds"])

    return rows.mapInPandas(answer, "document_id string, page int, source string, text string, error string, retried boolean, runtime_seconds double")


def clean_texts(texts: DataFrame, model: Callable[[], Callable[[str, bytes | None], str]], prompt: str) -> DataFrame:
    """texts with cleaned and seconds; blank texts come back as they are, in no time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = model()
        for frame in frames:
            got = []
            for text in frame["text"]:
                began = time.perf_counter()
                blank = not (text or "").strip()
                got.append((text if blank else asked(f"{prompt}\n{text}", None), 0.0 if blank else round(time.perf_counter() - began, 4)))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(got, columns=["cleaned", "seconds"])], axis=1)

    return texts.mapInPandas(clean, f"{schema}, cleaned string, seconds double")


def round_trips(texts: DataFrame, codec: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]]) -> DataFrame:
    """text, n_tokens and round_trip: does a tokenizer give a text back? codec builds its encode and decode."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = codec()
        for frame in frames:
            ids = [encode(t or "") for t in frame["text"]]
            yield pd.DataFrame({"text": frame["text"], "n_tokens": [len(x) for x in ids], "round_trip": [decode(x) == (t or "") for x, t in zip(ids, frame["text"])]})

    return texts.select("text").mapInPandas(probe, "text string, n_tokens long, round_trip boolean")
