"""Connected components of a link table: union-find in each partition, then stars until nothing moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import partitions, saved

LINKS = 200_000  # links that one union-find holds


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of a partition as links of each node to the smallest node it reaches there."""

    def reduced(links: pd.DataFrame) -> pd.DataFrame:
        nodes, flat = np.unique(links[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        parent = list(range(len(nodes)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for x, y in flat.reshape(-1, 2).tolist():
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        top = np.array([root(i) for i in range(len(nodes))], np.int64)
        out = pd.DataFrame({"a": nodes, "b": nodes[top]})
        return out[out["a"] != out["b"]]

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= LINKS:
            yield reduced(pd.concat(held))
            held, size = [], 0
    if held:
        yield reduced(pd.concat(held))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``links`` (long columns ``a`` and ``b``).

    Each round points a node's larger neighbours, then the node with all its smaller neighbours, to the smallest of
    them; rounds are as many as the logarithm of the longest chain. A round's links, one for each node at most after
    the first, are written to the shared folder. Only their count and checksum come to the driver.
    """
    n = partitions(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = saved(edges.repartition(n, "b").mapInPandas(_forest, "a long, b long").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = larger.groupBy("a").agg(F.min("b").alias("m"))
        joined = larger.join(smallest, "a")
        edges = joined.select("a", F.col("m").alias("b")).union(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = saved(edges.filter("a <> b").distinct())
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
