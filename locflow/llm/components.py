"""Connected components of a table of links, by alternating large and small stars.

First every task joins the links it holds (union-find over at most
``HELD`` of them at a time) and passes on one link per node to its smallest
known neighbour; then rounds of large star (every larger neighbour of a node
is linked to the node's smallest neighbour) and small star (every smaller
neighbour likewise) run until every node is linked to one smaller node and
that one to none, which is then the smallest id of its component. Minima are pre-aggregated on the map
side; both inputs of each join are written tables, so AQE splits a node with
very many neighbours. Nothing is collected but one number a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locflow.llm.shared import written

HELD = 1_000_000


class Union:
    """Union-find with the smallest id as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def joined_in_task(links: DataFrame) -> DataFrame:
    def run(batches):
        held = Union()

        def flush():
            rows = np.array(held.links(), dtype=np.int64).reshape(-1, 2)
            held.up.clear()
            return pa.RecordBatch.from_pydict({"u": pa.array(rows[:, 0]), "v": pa.array(rows[:, 1])})

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                held.join(a, b)
            if len(held.up) > HELD:
                yield flush()
        yield flush()

    return links.mapInArrow(run, "u bigint, v bigint")


def open_nodes(now: DataFrame) -> int:
    """Nodes with more than one smaller neighbour, or with a smaller and a larger one; none if all are stars."""
    seen = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        now.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = seen.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").count()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links`` (columns ``a, b``): the smallest id that links reach."""
    links = links.where("a is not null and b is not null and a <> b").select("a", "b")
    now = written(joined_in_task(links).distinct(), "links")
    while open_nodes(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u <> v"), "links-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
