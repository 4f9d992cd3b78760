"""Runs of repeating words in every document, found on suffix trees by Stoye and Gusfield's traversal.

A run is a stretch of words with smallest period q and at least two periods and ``SHORTEST`` words long that no neighbour
extends. Documents are cut into words by tasks; a run never leaves its document.

1. Every window of ``GRAM`` words of a run occurs twice in it, so only stretches that such windows cover can hold one. Stretches
   are narrowed to windows that repeat within the stretch; all else is left out before any tree is built.
2. The stretches of a batch get one suffix tree: suffixes sorted by prefix doubling, common prefixes from the ranks of the
   doubling steps, nodes as intervals of equal prefixes. Each stretch ends with a word of its own.
3. At every node the leaves of all children but the largest are visited: leaf i under a node of depth D begins a branching
   tandem repeat if leaf i + D is below the node too and the word after it differs; so does i - D, looked at from i. A leaf
   meets at most log n such lists.
4. A run holds one branching repeat of its period, at its end. It is rotated to the left as long as words agree, and repeats of a
   multiple of the period are merged into it.

Words are compared by 64-bit hashes. Null and empty texts have no words and no runs; null and repeated ids are rows like all
others; a text is read whole, whatever its length, and one document is the most that a task holds beyond ``K.SLAB`` bytes. Empty
tables give no rows, and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K

#: The least words of a run, and the words of a window that must repeat inside a stretch: half of them fit any run.
SHORTEST, GRAM = 12, 6
_WORDS = (K.table("graph")[0], np.arange(256, dtype=np.uint8))


def stretches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(begin, end) of the stretches of words, each in one document, that windows repeated inside the same stretch cover."""
    n, none = len(hashes), np.zeros((0, 2), np.int64)
    grams = K.grams(hashes, GRAM)
    at = np.flatnonzero(K.within(first, GRAM, len(grams)))
    heads = np.zeros(n + 1, bool)
    heads[first] = True
    group = np.cumsum(heads[:n]).astype(np.uint64)
    left = -1
    while len(at) and left != len(at):
        left = len(at)
        key = K.mix(grams[at] + group[at] * np.uint64(K._MULT))
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        depth = np.zeros(n + GRAM + 1, np.int32)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + GRAM, -1)
        covered = np.cumsum(depth)[:n] > 0
        opens = covered.copy()
        opens[1:] &= ~covered[:-1] | heads[1:n]
        group = np.cumsum(opens).astype(np.uint64)
    if not len(at):
        return none
    begin = np.flatnonzero(opens)
    closes = covered.copy()
    closes[:-1] &= ~covered[1:] | heads[1:n]
    return np.stack([begin, np.flatnonzero(closes) + 1], axis=1)


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, their ranks, common prefix of each with the one before); each string in text ends with an item of its own."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    change = np.ones(n, bool)
    change[1:] = text[order[1:]] != text[order[:-1]]
    h, levels = 1, []
    while True:
        ranks = np.full(n + 1, -1, np.int64)
        ranks[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        levels.append((h, ranks))
        alone = change.copy()
        alone[:-1] &= change[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        # only groups that aren't settled are sorted again, at twice the depth
        own = order[open_]
        key = ranks[own] * (n + 1) + ranks[np.minimum(own + h, n)] + 1
        again = np.argsort(key)
        order[open_], key = own[again], key[again]
        moved = np.ones(len(key), bool)
        moved[1:] = key[1:] != key[:-1]
        change[open_] = moved
        h *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for h, level in reversed(levels):
        done = common[1:]
        done += h * (level[np.minimum(a + done, n)] == level[np.minimum(b + done, n)])
    return order, levels[-1][1][:n], common


def small_lists(common: np.ndarray) -> np.ndarray:
    """Of the inner nodes, rows (depth, node's first leaf, its end, child's first leaf, its end) for all children but the largest."""
    out: list[tuple[int, int, int, int, int]] = []
    depths, cuts = [0], [[0]]  # the path from the root: of each node its depth and where its children begin
    for i, own in enumerate([*common.tolist()[1:], 0], 1):
        begin = i - 1
        while own < depths[-1]:
            depth, own_cuts = depths.pop(), cuts.pop()
            own_cuts.append(i)
            begin = own_cuts[0]
            largest = max(range(len(own_cuts) - 1), key=lambda k: own_cuts[k + 1] - own_cuts[k])
            out += [(depth, begin, i, own_cuts[k], own_cuts[k + 1]) for k in range(len(own_cuts) - 1) if k != largest]
        if own > depths[-1]:
            depths.append(own)
            cuts.append([begin, i])
        elif own:
            cuts[-1].append(i)
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every tandem repeat whose next word doesn't go on with the period, by end, then period."""
    order, ranks, common = suffixes(text)
    lists = small_lists(common)
    size = lists[:, 4] - lists[:, 3]
    depth, low, high = (np.repeat(lists[:, k], size) for k in range(3))
    leaf = order[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lists[:, 3], size)]
    n, found = len(text), []
    for start, other in ((leaf, leaf + depth), (leaf - depth, leaf - depth)):
        fits = (other >= 0) & (start + 2 * depth < n)
        start, other, own, a, b = start[fits], other[fits], depth[fits], low[fits], high[fits]
        hit = (ranks[other] >= a) & (ranks[other] < b) & (text[start] != text[start + 2 * own])
        found.append(np.stack([start[hit], own[hit]], axis=1))
    start, period = np.unique(np.concatenate(found), axis=0).T
    by = np.lexsort((period, start + 2 * period))
    return start[by], period[by]


def _rotated(text: np.ndarray, start: int, period: int, least: int) -> int:
    """Where the run begins whose branching repeat begins at start: to the left as long as words agree, not before ``least``."""
    step = 32
    while start > least:
        low = max(least, start - step)
        differ = np.flatnonzero(text[low:start] != text[low + period : start + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, step * 2
    return start


def runs_of(hashes: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> dict[int, list[tuple[int, int, int]]]:
    """Document -> its runs (start, length, period) in order of start and period; hashes and first: as from ``K.words``."""
    cut = stretches(hashes, first)
    if not len(cut):
        return {}
    size = cut[:, 1] - cut[:, 0]
    begin = np.cumsum(size + 1) - size - 1
    place = np.repeat(cut[:, 0] - begin, size + 1) + np.arange(int((size + 1).sum()))
    ends = begin + size
    inside = np.ones(len(place), bool)
    inside[ends] = False
    text = np.empty(len(place), np.int64)
    words, text[inside] = np.unique(hashes[place[inside]], return_inverse=True)
    text[ends] = len(words) + np.arange(len(ends))
    out: dict[int, list] = {}
    last, merged = -1, []
    for start, period in zip(*(x.tolist() for x in branching_repeats(text))):
        end = start + 2 * period
        if end != last:
            last, merged = end, []
        if any(period % q == 0 and begun <= start for begun, q in merged):
            continue
        own = int(np.searchsorted(begin, start, "right")) - 1
        begun = _rotated(text, start, period, int(begin[own]))
        merged.append((begun, period))
        if end - begun >= shortest:
            at = int(place[begun])
            doc = int(np.searchsorted(first, at, "right")) - 1
            out.setdefault(doc, []).append((at - int(first[doc]), end - begun, period))
    for own in out.values():
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


@K.frugal
def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = batch.column(1)
        for row, buf, starts in K.slabs(texts):
            hashes, first = K.words(buf, starts, _WORDS)
            found, data, runs, collapsed = runs_of(hashes, first), buf.tobytes(), [], []
            edges = starts.tolist()
            for doc, (i, j) in enumerate(zip(edges, edges[1:])):
                own = found.get(doc, [])
                words = data[i:j].split()  # bytes are split at the six white-space bytes alone
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                collapsed.append(b" ".join(kept(words, own) if own else words))
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(runs)), pa.array(n), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_words, runs (start, length, period) and collapsed, the text without repeated periods."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest(runs: Column) -> Column:
    """Of runs, the one of greatest length, then smallest start, then period; null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def planted(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) in which every tenth text by the checksum of its id repeats a part of itself from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    g, n = F.floor(F.col("h") / 10).cast("bigint"), F.size("w").cast("bigint")
    some = F.col("h") % 10 == 0
    rows = documents.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(some, words)).withColumn("a", F.when(n > 0, g % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("bigint"))
    moved = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(some & (n > 0), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))
