"""Connected components as alternating large and small stars, each round written to the shared folder.

Few links (LOCAL_LINKS, counted) are joined up by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each node's neighbours (the larger ones, or it and the smaller ones) to the least of them all."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    near = edges.join(least, F.col("u") == F.col("c"))
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


#: Links (16 bytes each) up to which one task finds the components.
LOCAL_LINKS = 1_000_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) links to (node, least): each round takes over the neighbours' least label, then its label's label."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, index = np.unique(np.concatenate([x for p in zip(*parts, strict=True) for x in p]), return_inverse=True)
    u, v = np.split(index, 2)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, u, before[v])
        np.minimum.at(label, v, before[u])
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "least"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between different longs to (node, least node of its component), for nodes that have links."""
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    if now.count() <= LOCAL_LINKS:
        return durable(now.coalesce(1).mapInArrow(_local, "node long, least long"))
    before = None
    while True:
        now = durable(_star(_star(now, True), False))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == before:
            break
        before = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("least")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
