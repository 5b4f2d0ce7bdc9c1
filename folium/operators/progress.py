"""Counts that come with the pass that writes, so nothing is read twice for them."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("folium")


@dataclass
class Counted:
    #: What is to be written, in one action.
    rows: DataFrame
    #: pages, errors (rows with an error) and seconds (of their runtime), once it is written.
    counts: dict = field(default_factory=dict)


@contextmanager
def counted(rows: DataFrame, name: str) -> Iterator[Counted]:
    """Write .rows inside the block by one action; after it the counts are there, and a line of the log says them.

    A block that raises, or that runs no action, counts nothing. Columns that rows lacks count as empty.
    """
    have = set(rows.columns)
    error = F.count("error") if "error" in have else F.lit(0).cast("long")
    seconds = F.coalesce(F.sum("runtime_seconds"), F.lit(0.0)) if "runtime_seconds" in have else F.lit(0.0)
    seen = Observation()
    out = Counted(rows.observe(seen, F.count(F.lit(1)).alias("pages"), error.alias("errors"), seconds.cast("double").alias("seconds")))
    yield out
    out.counts = dict(seen.get)
    log.info("%s: %d pages, %d errors, %.1f s", name, out.counts["pages"], out.counts["errors"], out.counts["seconds"])
