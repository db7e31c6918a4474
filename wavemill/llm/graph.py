"""Connected components of a graph that may not fit one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: A graph up to this many edges (some 100 MB in numpy) is solved by one task.
FIT_EDGES = 1_000_000


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0 to n - 1 and edges a - b."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (a, b) of one partition."""
    edges = [(x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)) for x in batches]
    if edges:
        a, b = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[labels(len(nodes), at[: len(a)], at[len(a) :])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["node", "root"])


def components(edges: DataFrame, folder: str, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Up to FIT_EDGES edges are solved by one task. More of them go through large-star and small-star steps
    until nothing changes. Each step aggregates with partial aggregation and joins once, so no node's
    neighbours are ever gathered in one place. Every round is written to ``folder``; two rounds exist at a
    time.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), folder, f"{name}-0")
    sums = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last, step = sums(now), 0
    if last[0] <= FIT_EDGES:
        return written(now.coalesce(1).mapInArrow(_solved, "node long, root long"), folder, f"{name}-solved")
    while last[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step += 1
        now = written(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), folder, f"{name}-{step}")
        if step > 1:
            discard(spark, folder, f"{name}-{step - 2}")
        this = sums(now)
        if this == last:
            break
        last = this
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
