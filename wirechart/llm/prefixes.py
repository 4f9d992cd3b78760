"""An exact pass over crowded regions: what candidates by neighbourhood leave open there is compared in full.

A region whose rows are one component already is done. The sets of all other rows are joined by prefixes: items are put in
one order, the rarest first, and two sets that are alike enough share an item among the first few of both. The smaller
set needs fewer of them (its index prefix) than the larger one (its probe prefix), so items that a whole template has
seldom count. Rows that share an item few rows have are pairs; an item of many rows deals them out in blocks, index blocks
against probe blocks, without comparing the largest component with itself, so no item's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.components import components
from wirechart.llm.crowded import BLOCK, compare
from wirechart.llm.shared import stored

#: Rows that share an item and are compared as pairs at most.
SELDOM = 8


@K.frugal
def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, item) of rows (id, items)."""
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            items = np.frombuffer(raw, np.int64)
            for begin in range(0, len(items), 1 << 16):
                part = items[begin : begin + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(np.full(len(part), len(items), np.int64)), pa.array(part)], names=["id", "n", "item"])


@K.frugal
def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the labels of rows (label_a, items_a, label_b, items_b) whose sets are alike enough."""
    for batch in batches:
        a, b = (batch.column(c).to_pylist() for c in (1, 3))
        keep = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
        part = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], names=["a", "b"])


def undecided(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, label): the rows of members(region, id) that lie in a region of several components."""
    rows = members.join(roots.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = rows.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region")
    return rows.join(mixed, "region", "left_semi").select("id", "label").distinct()


def prefixes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(item, id, n, label, index): the probe prefix of each set of sets(id, items); index: whether the item is in the index prefix, too.

    Of two sets that share i items, 100 * i >= percent * (n + m - i) holds. The larger one, of n, then has at most
    n - ceil(percent * n / 100) items that the other hasn't, the smaller one, of m, at most m - ceil(2 * percent * m / (100 + percent)).
    """
    every = stored(sets.mapInArrow(_items, "id bigint, n bigint, item bigint"), "items")
    counts = stored(every.groupBy("item").agg(F.count("*").alias("often")), "counts")
    ordered = every.join(counts, "item").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("all"))
    at_most = lambda share, of: (F.col("n") - F.ceil(F.col("n") * share / F.lit(of)) + 1).cast("int")
    probe, index = at_most(percent, 100), at_most(2 * percent, 100 + percent)
    few = ordered.select("id", "n", index.alias("_index"), F.posexplode(F.slice("all", 1, probe)).alias("at", "x"))
    return few.join(rows, "id").select("x.item", "id", "n", "label", (F.col("at") < F.col("_index")).alias("index"))


def dealt(firsts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, label_a, b, label_b) of rows that share a seldom item, (part, side, id, label) of the blocks of the others)."""
    groups = firsts.groupBy("item").agg(F.min("id").alias("lead"), F.count("*").alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or("index").alias("any"))
    groups = stored(groups.where("lo < hi and any").select("item", "lead", "rows"), "shared")
    rows = stored(firsts.join(groups, "item"), "firsts")
    few = rows.where(F.col("rows") <= SELDOM)
    side = lambda s, own: own.select("item", F.col("id").alias(s), F.col("label").alias(f"label_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = side("a", few.where("index")).join(side("b", few), "item").where("label_a <> label_b and (n_a < n_b or n_a = n_b and a < b)")
    pairs = pairs.where(100 * F.col("n_a") >= percent * F.col("n_b")).select("a", "label_a", "b", "label_b").distinct()
    # items that run together in a template have the same first row: their rows are dealt once, not for each of them
    many = stored(rows.where(F.col("rows") > SELDOM).groupBy(F.col("lead").alias("item"), "id", "label").agg(F.bool_or("index").alias("index")), "many")
    counts = many.groupBy("item", "label").agg(F.count("*").alias("n"), F.sum(F.col("index").cast("long")).alias("i"))
    sizes = counts.groupBy("item").agg(F.max(F.struct("n", "label", "i")).alias("most"), F.sum("n").alias("rows"), F.sum("i").alias("indexed"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("item", F.col("most.label").alias("most"), blocks(F.col("most.n")).alias("main_probe"), blocks(F.col("rows") - F.col("most.n")).alias("rest_probe"), blocks(F.col("most.i")).alias("main_index"), blocks(F.col("indexed") - F.col("most.i")).alias("rest_index"))
    many = many.join(stored(sizes, "sizes"), "item").withColumn("main", F.col("label") == F.col("most"))
    own = lambda main, rest: F.pmod(F.xxhash64("id", "item"), F.greatest(F.when(F.col("main"), F.col(main)).otherwise(F.col(rest)), F.lit(1))).cast("int")
    many = many.withColumn("own_index", own("main_index", "rest_index")).withColumn("own_probe", own("main_probe", "rest_probe"))
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    # the rest's index blocks against all probe blocks, the main component's against those of the rest
    place = lambda i, p, x, y, to: F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), x.alias("x"), y.alias("y"), F.lit(to).alias("side"))
    as_index = lambda i, p, c: F.transform(numbers(c), lambda y: place(i, p, F.col("own_index"), y, 0))
    as_probe = lambda i, p, c: F.transform(numbers(c), lambda x: place(i, p, x, F.col("own_probe"), 1))
    rest = F.concat(as_probe("rest", "rest", "rest_index"), as_probe("main", "rest", "main_index"), F.when(F.col("index"), F.concat(as_index("rest", "rest", "rest_probe"), as_index("rest", "main", "main_probe"))).otherwise(F.slice(as_index("rest", "rest", "rest_probe"), 1, 0)))
    main = F.concat(as_probe("rest", "main", "rest_index"), F.when(F.col("index"), as_index("main", "rest", "rest_probe")).otherwise(F.slice(as_index("main", "rest", "rest_probe"), 1, 0)))
    out = many.withColumn("to", F.explode(F.when(F.col("main"), main).otherwise(rest)))
    return pairs, out.select(F.xxhash64("item", "to.i", "to.p", "to.x", "to.y").alias("part"), "to.side", "id", "label")


def joined(members: DataFrame, roots: DataFrame, sets, percent: int) -> DataFrame:
    """roots(node, root) with the links that are left to find between rows of one region of members(region, id).

    sets(ids): a table (id, items) of the distinct items, as bytes, of each id of ids(id).
    """
    rows = stored(undecided(members, roots), "open")
    if rows.isEmpty():
        return roots
    items = stored(sets(rows.select("id")), "sets")
    pairs, blocks = dealt(stored(prefixes(rows, items, percent), "prefixes"), percent)
    side = lambda s: items.select(F.col("id").alias(s), F.col("items").alias(f"items_{s}"))
    both = stored(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").select("label_a", "items_a", "label_b", "items_b")
    links = both.mapInArrow(lambda it: _alike(it, percent), "a bigint, b bigint")
    rows = stored(blocks, "blocks").join(items, "id").select("part", "side", "label", "items").repartition("part").sortWithinPartitions("part", "side")
    links = links.unionByName(rows.mapInArrow(lambda it: compare(it, percent), "a bigint, b bigint"))
    more = components(links).select(F.col("node").alias("old"), F.col("root").alias("new"))
    more = stored(more, "more")
    known = roots.join(more, roots["root"] == more["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return known.unionByName(more.select(F.col("old").alias("node"), F.col("new").alias("root")))
