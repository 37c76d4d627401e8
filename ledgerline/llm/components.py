"""Connected components of a table of links, and of arrays of links inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import durable


def local_roots(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge links (positions) into labels, where a label is the position of a smaller or equal member."""
    while True:
        low = np.minimum(labels[left], labels[right])
        before = labels.copy()
        np.minimum.at(labels, labels[left], low)
        np.minimum.at(labels, labels[right], low)
        labels = labels[labels]
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels = jumped
        if (labels[left] == labels[right]).all() and (labels == before).all():
            return labels


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in links (``a, b``); the component is its smallest node.

    Each round hooks every other parent of a node to its smallest parent and then skips one level, so that chains
    shrink by half; it ends when every node points at a root. A round is a few joins on the nodes, checkpointed;
    no node's neighbours are gathered. Links with a null end, or of a node with itself, say nothing. An empty
    table gives an empty one.
    """
    pairs = links.select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
    pairs = durable(pairs.where("child <> parent").distinct())
    while True:
        least = pairs.groupBy("child").agg(F.min("parent").alias("least"))
        joined = pairs.join(least, "child")
        hooked = (
            joined.select("child", F.col("least").alias("parent"))
            .union(joined.where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent")))
            .distinct()
        )
        above = hooked.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("above"))
        pairs = durable(
            hooked.join(above, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent")).distinct()
        )
        many = pairs.groupBy("child").count().where("count > 1").select("child")
        deep = pairs.join(pairs.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child")
        if many.union(deep).isEmpty():
            break
    roots = pairs.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
    return pairs.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(roots)
