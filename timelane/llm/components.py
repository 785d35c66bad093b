"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timelane.llm.store import stored

c = F.col

FEW = 1 << 18
"""Links (4 MB) that one task joins up by itself; rounds of joins would be hundreds of short stages."""


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``links`` (long ``a``, ``b``).

    The component is its smallest node. Each round hangs the larger neighbours of a node, and
    then its smaller ones, under the smallest of them, until nothing changes; a chain of n links
    takes about log n rounds. Minima are combined before the shuffle, and a node with very many
    links meets its minimum in a plain join, which Spark splits where it is skewed. Up to FEW
    links are joined up in one task.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_joined_up, "node bigint, component bigint")
    edges = stored(edges.distinct())
    while not _flat(edges):
        both = edges.unionByName(edges.select(c("v").alias("u"), c("u").alias("v")))
        least = both.groupBy(c("u").alias("k")).agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, c("u") == c("k")).select(
            c("v").alias("u"), F.least("u", "m").alias("v"))
        least = large.groupBy(c("u").alias("k")).agg(F.min("v").alias("m"))
        edges = stored(large.join(least, c("u") == c("k")).select(
            F.explode(F.array(F.struct(c("u").alias("u"), c("m").alias("v")),
                              F.struct(c("v").alias("u"), c("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct())
    return edges.select(c("u").alias("node"), c("v").alias("component")).unionByName(
        edges.select(c("v").alias("node"), c("v").alias("component")).distinct()
    )


def _joined_up(batches):
    """Nodes and components of all links of a task."""
    links = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches if b.num_rows]
    if not links:
        return
    node, at = np.unique(np.concatenate([x for ends in zip(*links) for x in ends]), return_inverse=True)
    one, two = at.reshape(2, -1)
    root = np.arange(len(node))
    while (root[one] != root[two]).any():
        a, b = root[one], root[two]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "component"])


def _flat(edges: DataFrame) -> bool:
    """Whether every edge leads from a node to one that has no smaller neighbour, and no node
    has two such."""
    ends = edges.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    tops = edges.select(c("v").alias("u")).distinct().withColumns({"low": F.lit(0), "high": F.lit(0)})
    # one look: a node is a leaf with one parent, or a top; a node that is both counts twice
    seen = ends.unionByName(tops).groupBy("u").agg(F.count("*").alias("n"), F.max(c("low") < c("high")).alias("more"))
    return seen.where("n > 1 or more").isEmpty()
