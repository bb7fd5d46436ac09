"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow, checkpointed, map_arrow


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch with the cycles left out: every node to the least one it reaches there."""
    schema = arrow("a long, b long")
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while len(nodes):
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[label[far]]), pa.array(nodes[far])], schema=schema)


EDGES_PER_TASK = 200_000
HUB, MOST_HUBS = 1000, 5000  # more neighbours than the first, and than edges over the second, so at most 10,000 nodes


def _tasks(n: int) -> int:
    """Partitions, and so files, for ``n`` edges; a handful of edges is not worth one for every core."""
    return -(-n // EDGES_PER_TASK) or 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its least node.

    Links are first thinned to a forest within each batch.  Then each node hands
    its neighbours to the least of them until nothing changes; that takes about
    log2 of the longest chain in rounds, each cut by a checkpoint.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    edges = checkpointed(map_arrow(edges, _forest, "a long, b long").distinct())
    n = edges.count()
    tasks = _tasks(n)
    mark = None
    while True:
        # large star: every larger neighbour to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("k"))
        # nodes with so many neighbours that there are few such nodes are told them where the edges are
        hub = low.where(F.col("k") > max(HUB, n // MOST_HUBS)).select("a", F.col("m").alias("hub"))
        told = both.where("b > a").join(F.broadcast(hub), "a", "left")
        large = told.where("hub IS NULL").join(low, "a").select(F.col("m").alias("a"), "b").unionByName(told.where("hub IS NOT NULL").select(F.col("hub").alias("a"), "b")).distinct()
        # small star: every smaller neighbour, and the node, to the least
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a != b").unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        edges = checkpointed(small, tasks)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum("a")).first()
        if now == mark or not now[0]:
            break
        mark, n, tasks = now, now[0], _tasks(now[0])
    stars = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
