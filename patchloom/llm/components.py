"""Connected components of a table of links, by alternating star steps.

Large-star hangs the larger neighbours of a node on the smallest node around it, small-star the
smaller ones; both only ever make stars flatter (Kiveris and others, 2014). Each round is two
grouped minima and two joins; the links are written after each, so a lost executor costs one round.

Rounds go on until nothing changes or the links left are few enough for one task, which then finishes
them. A few links cost a few tasks that way, however many partitions the session shuffles to: the
driver keeps an account of each task, and rounds have thousands, most of them empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C

LINKS_PER_TASK = 100_000   # more are never taken into one task


def _around(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m, the smallest of u and its neighbours v."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = _around(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = _around(large.filter("u <> v").distinct())
    out = small.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(
        small.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.filter("a < b").distinct()


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), sorted, and for each the smallest node reachable. Trees hang on the
    smallest of their neighbours and are flattened, until each link lies inside one tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _finished(links: DataFrame) -> DataFrame:
    """(node, component) of at most LINKS_PER_TASK links, in one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(f["a"].to_numpy(np.int64), f["b"].to_numpy(np.int64)) for f in batches]
        if rows:
            nodes, component = smallest(*(np.concatenate(side) for side in zip(*rows)))
            yield pd.DataFrame({"node": nodes, "component": component})

    return C.written(links.coalesce(1).mapInPandas(run, "node bigint, component bigint"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b), all bigint; component is the smallest node
    reachable.

    Links to oneself and nulls count for nothing; nodes without links give no rows. Links are read more
    than once, in the end by one task, so hand over written ones."""
    now = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if now.count() <= LINKS_PER_TASK:
        return _finished(now)
    now = C.written(now.distinct())
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen = mark(now)
    while seen[0] > LINKS_PER_TASK:
        now = C.written(_round(now))
        last, seen = seen, mark(now)
        if seen == last:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return _finished(now)
