"""Connected components of a link table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: So many links go to one task (some 50 MB there); beyond, components are found in rounds over all tasks.
LOCAL = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links, and the smallest node of each one's component."""
    nodes, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = number[: len(a)], number[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for at in (label[x], label[y], x, y):  # labels offer to labels, then to the nodes
            np.minimum.at(label, at, low)
        label = label[label]
        if np.array_equal(label, before):
            return nodes, nodes[label]


def components(links: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """(node, component) for the nodes of (a, b) links; the component is its smallest node. The path of the table that
    the result reads is added to `kept`.

    Each round every node takes the smallest label among its neighbours, and each label is replaced by its own label
    (pointer jumping), so chains shrink by a power in each round. Sums over neighbours are combined before the
    shuffle, so a node with very many links is no hot key. Every round is a written table. Up to LOCAL links are done
    by one task instead, with the same result.
    """
    spark = links.sparkSession
    made: list[str] = []
    edges = cut(links.select("a", "b").filter("a <> b").distinct(), "graph-links", made)
    if edges.count() <= LOCAL:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            links = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            empty = np.empty(0, np.int64)
            nodes, labels = joined(np.concatenate([empty, *(a for a, _ in links)]), np.concatenate([empty, *(b for _, b in links)]))
            for first in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[first : first + 100_000]), pa.array(labels[first : first + 100_000])], names=["node", "component"])

        last: list[str] = []
        done = cut(edges.coalesce(1).mapInArrow(run, "node long, component long"), "graph-labels", last)
        drop(spark, made)
        if kept is not None:
            kept += last
        return done
    both = edges.union(edges.select("b", "a"))
    old: list[str] = []
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "graph-labels", old)
    while True:
        new: list[str] = []
        # a link's ends offer their labels to each other and to their own labels
        far = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        offers = far.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = offers.join(labels.select("node", F.col("label").alias("own")), "node").select(F.col("own").alias("node"), "label")
        offers = offers.union(up).groupBy("node").agg(F.min("label").alias("label"))
        jump = offers.join(offers.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        fresh = cut(jump.select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "graph-labels", new)
        changed = fresh.join(labels.select("node", F.col("label").alias("before")), "node").filter("label <> before").limit(1).count()
        drop(spark, old)
        labels, old = fresh, new
        if not changed:
            drop(spark, made)
            if kept is not None:
                kept += old
            return labels.withColumnRenamed("label", "component")
