"""Connected components of an edge table by alternating large-star and small-star steps.

Each partition first contracts its own edges with a union-find, so what is shuffled is a forest. Links and labels
stay distributed; each round ends as a table in the shared folder. Only the number of changes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import stored


@K.frugal
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 10_000):
        part = pairs[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node with an edge can reach, for bigint nodes; roots themselves are left out."""
    star = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_contract, "u bigint, v bigint"), "star")
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub is mostly the least of its neighbours already; only the others are looked up, in a table of known size
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"), "least")
        large = both.where("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).where("u <> v")
        large = stored(large.distinct(), "star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = stored(small, "star")
        # done when every node has one link and no root has one: then each link leads to the least node
        again = small.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("n"))
        wrong = again.where("n > 1").count() or again.alias("x").join(again.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        star = small
        if not wrong:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
