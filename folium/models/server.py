"""Vision-language models: a server process for each executor, an HTTP client that never fails a task, and a model inside the worker."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import time
import urllib.error
from collections.abc import Callable

from folium import config
from folium.models.answers import HttpModel
from folium.models.keeper import READY, TAIL, Held, Server  # noqa: F401

#: How often a page is sent again to a server that ended over it, and the pause before that, in seconds.
AGAIN, PAUSE = 3, 0.2


class Safe:
    """A server's errors come back as an answer that says so: {"error": ...}."""

    def __call__(self, prompt: str, image: bytes | None) -> str:
        try:
            return super().__call__(prompt, image)
        except urllib.error.HTTPError as e:
            return json.dumps({"error": f"HTTP {e.code}", "raw_output": e.read().decode("utf-8", "replace")[:TAIL]})
        except (OSError, http.client.HTTPException, RuntimeError, KeyError, ValueError) as e:
            return json.dumps({"error": str(e)})


class SafeHttpModel(Safe, HttpModel):
    pass


class ExecutorModel:
    """A model of the server that all workers of an executor share; it ends some seconds after the last of them let go.

    command has {port} where the server's port belongs. A page is sent again where the server ended over it; what the
    server itself answers with an error, or doesn't answer in time, is the page's error. Workers of an executor have one parent process.
    """

    def __init__(self, command: list[str], health: str = "/", path: str = "/", timeout: float = 600, ready: float = READY, linger: float = 30.0, executor: str | None = None):
        executor = executor or f"{os.readlink('/proc/self/ns/pid')}-{os.getppid()}"
        name = f"folium-{executor}-{hashlib.sha256(json.dumps(command).encode()).hexdigest()[:16]}"
        self.held, self.path, self.timeout = Held(name, command, health, ready, linger), path, timeout
        self.port: int | None = None

    def __call__(self, prompt: str, image: bytes | None) -> str:
        for k in range(AGAIN + 1):
            self.port = self.port or self.held.port()
            try:
                return HttpModel(f"http://127.0.0.1:{self.port}{self.path}", self.timeout)(prompt, image)
            except (urllib.error.HTTPError, TimeoutError):
                raise
            except (OSError, http.client.HTTPException, ValueError) as e:
                if k == AGAIN:
                    raise
                time.sleep(PAUSE)
                before, self.port = self.port, self.held.port()
                # Half an answer counts as the page's error, unless the server ended over it.
                if self.port == before and not isinstance(e, OSError):
                    raise
        raise AssertionError


class SafeExecutorModel(Safe, ExecutorModel):
    pass


def executor_model(command: list[str], safe: bool = False, **options) -> Callable[[], Callable[[str, bytes | None], str]]:
    """A builder of ExecutorModel, for answers.ask and, where errors are to be answers, answers.clean_texts."""
    return lambda: (SafeExecutorModel if safe else ExecutorModel)(command, **options)


def transformers_model(path: str, max_new_tokens: int = 1000) -> Callable[[], Callable[[str, bytes | None], str]]:
    """A builder of a model inside the worker, for answers.ask; of the library's classes for images and text the first that it has."""

    def build() -> Callable[[str, bytes | None], str]:
        import io

        import transformers
        from PIL import Image

        kinds = [getattr(transformers, n) for n in ("AutoModelForImageTextToText", "AutoModelForVision2Seq") if hasattr(transformers, n)]
        processor, where = transformers.AutoProcessor.from_pretrained(path), config.device()
        errors = []
        for kind in kinds:
            try:
                model = kind.from_pretrained(path, torch_dtype="auto").to(where)
                break
            except (ValueError, KeyError) as e:
                errors.append(str(e))
        else:
            raise RuntimeError("; ".join(errors) or "this version has no class for images and text")

        def answer(prompt: str, image: bytes | None) -> str:
            content = ([{"type": "image", "image": Image.open(io.BytesIO(image)).convert("RGB")}] if image else []) + [{"type": "text", "text": prompt}]
            inputs = processor.apply_chat_template([{"role": "user", "content": content}], add_generation_prompt=True, tokenize=True, return_dict=True, return_tensors="pt").to(where)
            made = model.generate(**inputs, max_new_tokens=max_new_tokens, do_sample=False)
            return processor.batch_decode(made[:, inputs["input_ids"].shape[1] :], skip_special_tokens=True)[0]

        return answer

    return build


def fetch(repository: str, files: list[str], folder: str) -> list[str]:
    """Paths of a model's files, which are fetched from a hub where they aren't in the folder yet; needs the optional library huggingface_hub."""
    import os

    have = [os.path.join(folder, f) for f in files]
    if all(map(os.path.exists, have)):
        return have
    from huggingface_hub import hf_hub_download

    return [hf_hub_download(repo_id=repository, filename=f, local_dir=folder) for f in files]
