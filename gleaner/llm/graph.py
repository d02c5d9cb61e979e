"""Connected components over links, by alternating large-star and small-star rounds; and a local spanning forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for all nodes of the links a-b that aren't the smallest of theirs."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links(a, b) but the roots, the smallest node it is connected with.

    The links are rewritten round by round until each component is a star around its smallest node. Minima are
    pre-aggregated, and joins on a node of many links are left to adaptive execution to split. Each round's links are
    a table in the shared folder.
    """
    links = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v != u").distinct()
    links = staged(links, "links")
    state = None
    while True:
        both = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(links.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("v"), F.least("x", "m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        links = staged(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = now
