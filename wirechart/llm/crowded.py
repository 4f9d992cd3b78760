"""An exact pass over crowded regions: what candidates by neighbourhood leave open there is compared in full.

A region whose rows are one component already is done. In the others, the rows of the largest component needn't be
compared among themselves; the rest is dealt out in blocks, each block against each other one, so no region meets in
one task. A task counts what the sets of two blocks share, exactly, and sends a forest of links between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.components import components
from wirechart.llm.shared import stored

#: Rows of a block; items in at most RARE sets are counted pair by pair, the others as CHUNK columns of a matrix at a time.
BLOCK, RARE, CHUNK = 512, 8, 1024


def shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many items each of the first ``left`` sets (distinct items) has in common with each of the others; without others, with each later one."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, row = items[order], row[order]
    fresh = np.concatenate([[True], items[1:] != items[:-1]])
    count = np.diff(np.append(np.flatnonzero(fresh), len(items)))
    often = np.repeat(count, count)
    square = left == len(sets)
    width = left if square else len(sets) - left
    out = np.zeros(left * width, np.float64)
    few, few_row = items[often <= RARE], row[often <= RARE]
    for lag in range(1, RARE):
        at = np.flatnonzero(few[lag:] == few[:-lag])
        a, b = few_row[at], few_row[at + lag]
        if not square:
            cross = (a < left) & (b >= left)
            a, b = a[cross], b[cross] - left
        out += np.bincount(a * width + b, minlength=len(out))
    out = out.reshape(left, width)
    many = often > RARE
    column, own = (np.cumsum(fresh & many) - 1)[many], row[many]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        lo, hi = np.searchsorted(column, [begin, begin + CHUNK])
        ones = np.zeros((len(sets), CHUNK), np.float32)
        ones[own[lo:hi], column[lo:hi] - begin] = 1
        out += ones[:left] @ (ones if square else ones[left:]).T
    return np.triu(out, 1) if square else out


def _forest(labels: np.ndarray, sets: list[np.ndarray], left: int, percent: int) -> tuple[list, list]:
    """Links between the labels of sets that are alike enough."""
    size = np.array([len(x) for x in sets], np.int64)
    inter = shared(sets, left)
    begin = 0 if left == len(sets) else left
    hit = (inter > 0) & (100 * inter >= percent * (size[:left, None] + size[None, begin:] - inter))
    near = np.zeros((len(sets), len(sets)), bool)
    near[:left, begin:] = hit
    near |= near.T
    a, b = [], []
    todo = near.any(axis=1)
    while todo.any():
        first = int(np.argmax(todo))
        frontier = np.array([first])
        todo[first] = False
        while len(frontier):
            frontier = np.flatnonzero(near[frontier].any(axis=0) & todo)
            todo[frontier] = False
            other = np.unique(labels[frontier])
            other = other[other != labels[first]]
            a.extend([labels[first]] * len(other))
            b.extend(other)
    return a, b


@K.frugal
def compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between labels, from rows (part, side, label, items) in the order of part and side."""

    def links(rows):
        labels, sets = np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.uint64) for r in rows]
        a, b = _forest(labels, sets, sum(not r[0] for r in rows) or len(rows), percent)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    part, held = None, []
    for batch in batches:
        for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if own != part:
                if len(held) > 1:
                    yield links(held)
                part, held = own, []
            held.append(row)
    if len(held) > 1:
        yield links(held)


def undecided(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(part, side, id, label): the rows of members(region, id) whose region holds several components, for each two blocks to compare."""
    rows = members.join(roots.select(F.col("node").alias("id"), F.col("root").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = rows.groupBy("region", "label").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("region").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("region", F.col("most.label").alias("most"), blocks(F.col("n") - F.col("most.n")).alias("rest_blocks"), blocks(F.col("most.n")).alias("most_blocks"))
    rows = rows.join(sizes, "region").withColumn("main", F.col("label") == F.col("most"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "region"), F.when(F.col("main"), F.col("most_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    # the rest's blocks against one another, and each against those of the largest component
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda kind, a, b, side: F.struct(F.lit(kind).alias("kind"), a.alias("x"), b.alias("y"), side.cast("int").alias("side"))
    own = F.col("own")
    inner = F.transform(numbers("rest_blocks"), lambda j: place(0, F.least(own, j), F.greatest(own, j), own > j))
    outer = F.transform(numbers("most_blocks"), lambda j: place(1, own, j, F.lit(0)))
    main = F.transform(numbers("rest_blocks"), lambda i: place(1, i, own, F.lit(1)))
    dealt = rows.withColumn("to", F.explode(F.when(F.col("main"), main).otherwise(F.concat(inner, outer))))
    return dealt.select(F.xxhash64("region", "to.kind", "to.x", "to.y").alias("part"), "to.side", "id", "label")


def joined(members: DataFrame, roots: DataFrame, texts: DataFrame, sets, percent: int) -> DataFrame:
    """roots(node, root) with the links that are left to find between rows of one region of members(region, id).

    texts: (id, text), also of other ids. Texts are dealt, as they are several times smaller than their sets;
    sets(batches): rows whose last column is a text, with its distinct items, as bytes, in place of it.
    """
    dealt = stored(undecided(members, roots), "blocks")
    if dealt.isEmpty():
        return roots
    rows = dealt.join(texts, "id").select("part", "side", "label", "text").repartition("part").sortWithinPartitions("part", "side")
    more = components(rows.mapInArrow(lambda it: compare(sets(it), percent), "a bigint, b bigint")).select(F.col("node").alias("old"), F.col("root").alias("new"))
    more = stored(more, "more")
    known = roots.join(more, roots["root"] == more["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return known.unionByName(more.select(F.col("old").alias("node"), F.col("new").alias("root")))
