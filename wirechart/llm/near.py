"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same shingle set form one class, found by a key of the whole set; only one of each class goes on.
Each of ``TREES`` signature orders sorts the classes. Neighbours that share the first ``DEPTH`` values are candidates;
in crowded regions, small groups that agree further and next neighbours are. Candidates are confirmed on the full sets,
and links become components; then a crowded region that holds several components is compared in full (``crowded``).

A pair at the threshold of 0.8 shares no prefix in any tree with a chance of (1 - 0.8**4)**16 = 2e-4, one at 0.9 of 2e-8.

Documents without words or with a null text are linked with nothing. Rows with a null id are left alone; rows that
share an id are one document. Texts of any length are read whole. Empty tables give empty results, and other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.components import components
from wirechart.llm.prefixes import joined
from wirechart.llm.shared import TEXTS, Sieve, sieved, stored

TREES, DEPTH, LEVELS = 16, 4, 6
#: Groups of up to SMALL rows are compared in full, of larger ones NEAR neighbours; a region beyond HOT is cut deeper before it is dealt out.
SMALL, NEAR, HOT = 24, 2, 4096
_FACTORS = K.permutations(TREES * LEVELS, 11)
_RULE = K.table("graph")


def shingles(buf: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all documents in order, where those of each begin and the number of all); shorter documents have one."""
    hashes, first = K.words(buf, starts, _RULE)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(begin[-1], np.uint64)
    full = K.grams(hashes, k)
    out[np.repeat(counts >= k, n)] = full[K.within(first, k, len(full))]
    for short in range(1, k):
        docs = np.flatnonzero(counts == short)
        value = np.zeros(len(docs), np.uint64)
        for j in range(short):
            value = value * np.uint64(K._MULT) + hashes[first[docs] + j]
        out[begin[docs]] = K.mix(value ^ np.uint64(short))
    return out, begin


@K.frugal
def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts in K.slabs(batch.column(1)):
            items, begin = shingles(buf, starts, k)
            size = np.zeros(len(starts) - 1, np.int64)
            keys = np.zeros((2, len(starts) - 1), np.uint64)
            some = np.flatnonzero(np.diff(begin))
            for d in some:
                own = K.distinct(items[begin[d] : begin[d + 1]])
                size[d], keys[0, d], keys[1, d] = len(own), own.sum(), np.bitwise_xor.reduce(K.mix(own))
            marks = np.zeros((len(size), len(_FACTORS)), np.uint32)
            if len(some):
                marks[some] = K.signatures(items, begin[some], _FACTORS)
            ids = batch.column(0).slice(row, len(size))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), K.signed(keys[0]), K.signed(keys[1]), K.binary(marks)], names=["doc_id", "n", "key_a", "key_b", "marks"])


def _lengths(same: np.ndarray) -> np.ndarray:
    """The length of the run that each row is in; same[i]: row i + 1 belongs to the run of row i."""
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    return np.repeat(np.diff(np.append(begin, len(same) + 1)), np.diff(np.append(begin, len(same) + 1)))


@K.frugal
def _neighbours(batches: Iterator[pa.RecordBatch], small: int, near: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, false) from rows (region, tail, id, n) in order: region, then the rest of the signature.

    Rows of regions that aren't compared in full follow as (region, id, true).
    tail: bytes of MinHash values, or two of them in a bigint; without n, sets of all sizes are paired.
    """

    def pairs(region, tail, ids, n):
        levels, alike = [], region[1:] == region[:-1]
        for depth in range(tail.shape[1] + 1):
            if depth:
                alike = alike & (tail[1:, depth - 1] == tail[:-1, depth - 1])
            levels.append((np.concatenate([[0], np.cumsum(~alike)]), _lengths(alike)))
        crowd = (levels[0][1] > small) | (region == cut_region)
        found = [np.stack([region[crowd], ids[crowd], np.ones(crowd.sum(), np.int64)])] if crowd.any() else []
        for lag in range(1, min(small, len(ids))):
            take = np.zeros(len(ids) - lag, bool)
            for run, length in levels:
                take |= (run[lag:] == run[:-lag]) & (length[lag:] <= small)
            if lag <= near:
                take |= levels[0][0][lag:] == levels[0][0][:-lag]
            take &= (10 * np.minimum(n[lag:], n[:-lag]) >= 8 * np.maximum(n[lag:], n[:-lag])) & (ids[lag:] != ids[:-lag])
            at = np.flatnonzero(take)
            if len(at):
                found.append(np.stack([np.minimum(ids[at], ids[at + lag]), np.maximum(ids[at], ids[at + lag]), np.zeros(len(at), np.int64)]))
        if found:
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(both[2] > 0)], names=["a", "b", "crowded"])
        return None

    held = cut_region = last = None
    for batch in batches:
        if not len(batch):
            continue
        tail = batch.column(1)
        wide = np.frombuffer(b"".join(tail.to_pylist()), np.uint32).reshape(len(batch), -1) if pa.types.is_binary(tail.type) else tail.to_numpy().view(np.uint32).reshape(-1, 2)[:, ::-1]
        sizes = batch.column(3).to_numpy() if batch.num_columns > 3 else np.ones(len(batch), np.int64)
        new = [batch.column(0).to_numpy(), wide, batch.column(2).to_numpy(), sizes]
        # a row may come from several tasks
        fresh = np.ones(len(batch), bool)
        fresh[1:] = (new[0][1:] != new[0][:-1]) | (new[2][1:] != new[2][:-1])
        fresh[0] = (int(new[0][0]), int(new[2][0])) != last
        last = int(new[0][-1]), int(new[2][-1])
        new = [x[fresh] for x in new]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(held[0]):
            continue
        # the last region may go on; a very long one is cut, and its next neighbours carry over
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        if cut == 0 and len(held[0]) > 200_000:
            cut_region = held[0][0]
            if (out := pairs(*held)) is not None:
                yield out
            held = [x[-near:] for x in held]
        elif cut:
            if (out := pairs(*[x[:cut] for x in held])) is not None:
                yield out
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]) and (out := pairs(*held)) is not None:
        yield out


def candidates(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, levels: int = LEVELS) -> DataFrame:
    """Of classes(rep, n, marks), distinct pairs (a, b, false) of representatives that are neighbours in some tree, and
    (region, rep, true) for the regions that need an exact pass."""
    width = 4 * levels
    rows = classes.select("rep", "n", "marks", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("rep", "n", "tree", F.substring("marks", F.col("tree") * width + 1, F.lit(width)).alias("own"))
    rows = rows.select(F.xxhash64("tree", F.substring("own", 1, 4 * depth)).alias("region"), F.substring("own", 4 * depth + 1, 4 * (levels - depth)).alias("tail"), F.col("rep").alias("id"), "n")
    whole = rows
    hot = rows.groupBy("region").count().where(F.col("count") > HOT).select("region", F.lit(True).alias("hot"))
    rows = rows.join(hot, "region", "left").withColumn("region", F.when(F.col("hot"), F.xxhash64("region", "tail")).otherwise(F.col("region")))
    rows = rows.select("region", "tail", "id", "n").repartition("region").sortWithinPartitions("region", "tail", "id")
    found = rows.mapInArrow(lambda it: _neighbours(it, SMALL, NEAR), "a bigint, b bigint, crowded boolean")
    # a region that was cut deeper before it was dealt out is still one for the exact pass
    return found.unionByName(whole.join(hot, "region", "left_semi").select(F.col("region").alias("a"), F.col("id").alias("b"), F.lit(True).alias("crowded"))).distinct()


def crowds(found: DataFrame) -> DataFrame:
    """(region, id) of the crowded regions that ``_neighbours`` found."""
    return found.where("crowded").select(F.col("a").alias("region"), F.col("b").alias("id"))


@K.frugal
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, buf, starts in K.slabs(batch.column(1)):
            items, begin = shingles(buf, starts, k)
            own = [K.distinct(items[begin[d] : begin[d + 1]]).tobytes() for d in range(len(starts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(own)), pa.array(own, pa.binary())], names=["id", "items"])


@K.frugal
def _fetch(batches: Iterator[pa.RecordBatch], sieve: Sieve) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        keep = sieve.keeps(K.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if keep.any():
            yield batch.filter(pa.array(keep))


def chosen(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose bigint id is in ids(id), found on the map side in bounded passes."""
    keyed = stored(ids.mapInArrow(_mixed, "id bigint, key bigint"), "ids")
    every = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null")
    found = sieved([(keyed, "key")], None, lambda sieve: every.mapInArrow(lambda it: _fetch(it, sieve), "doc_id bigint, text string"), "texts")
    return found.join(keyed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


@K.frugal
def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), K.signed(K.mix(K.unsigned(batch.column(0))))], names=["id", "key"])


@K.frugal
def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, text_a, b, text_b), the pairs whose full sets are alike enough."""
    last: tuple = (None, None)
    for batch in batches:
        a, b, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
        left: dict = {last[0]: last[1]}
        firsts = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
        texts = batch.column(1).take(pa.array([i for i in firsts if a[i] not in left], pa.int64()))
        names = [a[i] for i in firsts if a[i] not in left]
        for row, buf, starts in K.slabs(texts):
            items, begin = shingles(buf, starts, k)
            for d in range(len(starts) - 1):
                left[names[row + d]] = K.distinct(items[begin[d] : begin[d + 1]])
        for row, buf, starts in K.slabs(batch.column(3)):
            items, begin = shingles(buf, starts, k)
            for d in range(len(starts) - 1):
                x, y = left[a[row + d]], K.distinct(items[begin[d] : begin[d + 1]])
                both = np.concatenate([x, y])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if len(both) and 100 * inter >= percent * (len(both) - inter):
                    keep.append(row + d)
        if len(a):
            last = (a[-1], left[a[-1]])
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def links(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose documents' shingle sets hold 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = chosen(documents, ids)
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")
    return both.mapInArrow(lambda it: _confirm(it, k, percent), "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_shingles, component_id, kept."""
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = stored(ids.mapInArrow(lambda it: _sketch(it, k), "doc_id bigint, n bigint, key_a bigint, key_b bigint, marks binary"), "sketch", TEXTS)
    real = sketch.where("n > 0 and doc_id is not null")
    keys = ["n", "key_a", "key_b"]
    classes = stored(real.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("marks").alias("marks")), "classes")
    found = stored(candidates(classes), "pairs")
    roots = components(links(found.where("not crowded").select("a", "b"), ids, k, percent))
    sets = lambda wanted: chosen(ids, wanted).dropDuplicates(["doc_id"]).mapInArrow(lambda it: _sets(it, k), "id bigint, items binary")
    roots = joined(crowds(found), roots, sets, percent)
    members = classes.drop("marks").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, F.coalesce("root", "rep").alias("component_id"))
    out = sketch.drop("marks").join(members, keys, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the first of each group of near copies, with all their columns."""
    gone = near_duplicates(documents, k, percent).where("not kept").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
