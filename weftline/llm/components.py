"""Connected components of an edge table by alternating large and small stars; every round is written to the checkpoint folder.

Groups are never collected: a round is two minimum aggregations, which add up by task first, and two joins on the node, whose
sides come from exchanges of their own, so that adaptive execution splits a node of very many edges. Before the first round
each task replaces its edges by a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, own_exchange


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, r = self.up, x
        while (y := up.get(r, r)) != r:
            r = y
        while (y := up.get(x, x)) != r:
            up[x], x = r, y
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def forest(pairs: Iterator[tuple[int, int]], names: list[str], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Edges for edges: stars of what is connected within a bounded number of pairs."""
    f, n = Forest(), 0

    def out():
        e = f.edges()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in e], pa.int64()), pa.array([r for _, r in e], pa.int64())], names=names)

    for u, v in pairs:
        f.join(u, v)
        n += 1
        if n >= most:
            yield out()
            f, n = Forest(), 0
    yield out()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from forest(((u, v) for b in batches for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), ["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", thin: bool = False) -> DataFrame:
    """(node long, component long): every node of an edge with the smallest node it is connected to. Null ends and loops link nothing.

    ``thin``: each task's edges are a forest already, so that no further Python worker is needed to make one.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    if thin:
        e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    else:
        e = cut(e.mapInArrow(_forest, "u long, v long"))
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(own_exchange("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(own_exchange("u"), "m")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = e.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
