"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import erase, written

#: Links that one task joins at most, 16 bytes each; more go through rounds over all executors.
ONE_TASK = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of the links of one task: labels go to the smallest of each link, and then to those labels' labels, until nothing changes."""
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not links:
        return
    u, v = (np.concatenate([x[k] for x in links]) for k in (0, 1))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[u], label[v]), label.copy()
        for x in (label[u], label[v]):
            np.minimum.at(new, x, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of a link but the roots; links has u and v (long).

    Few links are joined by one task. The number of rounds of more grows with the logarithm of the longest path. Only a count
    and a checksum reach the driver; each round is written, and a node's smallest neighbour is an aggregate, so hubs are
    gathered nowhere.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    if state[0] <= ONE_TASK:
        out = written(edges.repartition(1).mapInArrow(_joined, "node long, root long"), "roots")
        erase(edges)
        return out
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        erase(before)
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
