"""Settings, folders, logging and the device."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping

FOLDERS = ("input_dir", "processed_dir", "output_dir", "report_dir")
DEFAULTS = {"input_dir": "input", "processed_dir": "processed", "output_dir": "output", "report_dir": "reports", "device": "auto", "dpi": 300, "selected_engines": [], "preprocessing_modes": ["raw", "clean", "binarized"]}


def load(path: str, root: str | None = None) -> dict:
    """The settings of a YAML file over the defaults; the four folders are made absolute, below root (the file's folder if not given). Folders with a scheme stay."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    if not isinstance(given, Mapping):
        raise ValueError(f"{path} has no settings")
    out, root = DEFAULTS | dict(given), root or os.path.dirname(os.path.abspath(path))
    return out | {k: out[k] if "://" in str(out[k]) else os.path.normpath(os.path.join(root, str(out[k]))) for k in FOLDERS}


def logger(report_dir: str, name: str = "folium") -> logging.Logger:
    """Log lines on the console and in report_dir/benchmark.log; asked twice it doesn't write twice."""
    os.makedirs(report_dir, exist_ok=True)
    out = logging.getLogger(name)
    out.setLevel(logging.INFO)
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(), logging.FileHandler(os.path.join(report_dir, "benchmark.log"), encoding="utf-8")):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        out.addHandler(h)
    return out


def _torch():
    try:
        import torch
    except Exception:
        return None
    return torch


def device(asked: str = "auto") -> str:
    """cuda where there is one, unless another is asked for."""
    torch = _torch()
    return asked if asked != "auto" else "cuda" if torch is not None and torch.cuda.is_available() else "cpu"


class Measured:
    """Seconds and the device's peak MB (null without one) of a with block; the device's memory is let go after it."""

    seconds: float = 0.0
    gpu_memory_mb: float | None = None

    def __enter__(self) -> Measured:
        import time

        torch = _torch()
        self.cuda = torch.cuda if torch is not None and torch.cuda.is_available() else None
        if self.cuda:
            self.cuda.reset_peak_memory_stats()
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        import gc
        import time

        self.seconds = round(time.perf_counter() - self.began, 4)
        if self.cuda:
            self.gpu_memory_mb = round(self.cuda.max_memory_allocated() / 2**20, 2)
            gc.collect()
            self.cuda.empty_cache()
