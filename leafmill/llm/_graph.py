"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

#: A graph of at most so many edges (16 bytes each) is solved within one task; a larger one in rounds.
ONE_TASK_EDGES = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component, for nodes that have an edge.

    Alternates large-star and small-star steps until no edge changes: the number of rounds grows as the logarithm of the
    graph, and no row ever holds more than an edge. ``edges`` has the bigint columns src and dst; direction, repeats
    and loops don't matter. Each round is a written table.
    """
    current = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct(), "components")
    if current.count() <= ONE_TASK_EDGES:
        return current.coalesce(1).mapInArrow(_union_find, "node bigint, component bigint")
    current = materialize(_stars(current), "components")
    last = None
    while True:
        current = materialize(_stars(_large_star(current)), "components")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    tails = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    heads = current.select(F.col("dst").alias("node"), F.col("dst").alias("component"))
    return tails.union(heads).groupBy("node").agg(F.min("component").alias("component"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least labels over all edges at once, halving paths, until none changes."""
    got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not got:
        return
    nodes, flat = np.unique(np.concatenate(got, axis=1), return_inverse=True)
    src, dst = flat.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[src], label[dst])
        np.minimum.at(label, label[src], least)
        np.minimum.at(label, label[dst], least)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
    return both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).filter("src <> dst").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.union(least.select("src", F.col("least").alias("dst"))).distinct()
