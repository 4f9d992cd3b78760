"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier (in a document of smaller id, or earlier
in its own). Suffix-sorting the whole corpus would move every suffix, so only text that can repeat is sorted:

1. Anchors: in each string of SPAN bytes the place of the least GRAM-byte hash. Equal strings have it at the same place,
   so a string can repeat only around anchors whose hash occurs twice; all others are left out.
2. An anchor's context holds all strings around it. Occurrences with the context of an earlier one are repeats as a
   whole; of each distinct context only the first occurrence goes on.
3. Shards are sets of anchor hashes with all their contexts. Each gets a suffix array by Larsson-Sadakane refinement in
   numpy, where only groups that aren't settled are sorted again at twice the depth. Common prefixes of neighbours
   come from the ranks of two depths, whose blocks together cover SPAN bytes. So no match crosses shards.
4. An anchor with more than ``HOT`` contexts is spread: its strings are merged by 128-bit digests over all tasks.

Null texts are empty; null ids come before all others; rows that share an id are one document, so none of them is
earlier than the other. Empty tables give empty results, and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import TEXTS, Sieve, sieved, stored

SPAN, GRAM, SHARD = 100, 32, 1 << 20
#: Bytes of text that a suffix array is made of at least, and of a slab in which anchors are looked for: their arrays stay in the processor's cache.
ARRAY, SLAB = 1 << 16, 1 << 15
_REACH = SPAN - GRAM
#: Contexts of one anchor that still fit a shard.
HOT = SHARD // (SPAN + _REACH)


def anchors(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of all GRAM-byte blocks) of a slab."""
    hashes = K.blocks(buf, GRAM)
    high = np.uint64(0xFFFFFFFF00000000)
    least = K.minima((hashes & high) | np.arange(len(buf), dtype=np.uint64), _REACH + 1)
    inside = K.within(starts, SPAN, max(len(buf) - SPAN + 1, 0))
    least = least[: len(inside)][inside] & ~high
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    return K.distinct(least[fresh]).astype(np.int64), hashes


@K.frugal
def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, buf, starts in K.slabs(batch.column(1), SLAB):
            places, hashes = anchors(buf, starts)
            if len(places):
                yield pa.RecordBatch.from_arrays([K.signed(hashes[places])], names=["h"])


def _occurrences(buf, starts, ids, places, hashes) -> dict[str, np.ndarray]:
    """Of anchors: h, c (hash of the context), doc, lo and hi of the context in its document, and a key of the occurrence."""
    row = np.searchsorted(starts, places, "right") - 1
    first, end = starts[row], starts[row + 1]
    lo, hi = np.maximum(places - _REACH, first), np.minimum(places + SPAN, end)
    c = np.zeros(len(places), np.uint64)
    whole = (lo == places - _REACH) & (hi == places + SPAN)
    own = places[whole]
    for at in (-68, -36, -4, 0, 32, 64, 68):  # blocks of 32 that cover 68 bytes before and 100 after
        c[whole] = c[whole] * np.uint64(K._MULT) + hashes[own + at]
    data = buf.tobytes() if not whole.all() else b""
    for i in np.flatnonzero(~whole):
        c[i] = xxhash.xxh3_64_intdigest(data[lo[i] : hi[i]], seed=int(places[i] - lo[i]) + 1)
    doc, h = ids[row], hashes[places]
    key = h ^ doc.view(np.uint64) ^ ((lo - first).astype(np.uint64) << np.uint64(13)) ^ (doc.view(np.uint64) << np.uint64(33))
    return {"h": h, "c": K.mix(c), "doc": doc, "lo": lo - first, "hi": hi - first, "key": key, "at": lo, "to": hi}


@K.frugal
def _shared(batches: Iterator[pa.RecordBatch], sieve: Sieve) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, buf, starts in K.slabs(batch.column(1), SLAB):
            places, hashes = anchors(buf, starts)
            places = places[sieve.keeps(hashes[places])]
            if len(places):
                x = _occurrences(buf, starts, ids[row : row + len(starts) - 1], places, hashes)
                yield pa.RecordBatch.from_arrays([K.signed(x["h"]), K.signed(x["c"]), pa.array(x["doc"]), pa.array(x["lo"].astype(np.int32)), pa.array(x["hi"].astype(np.int32))], names=["h", "c", "doc", "lo", "hi"])


@K.frugal
def _contexts(batches: Iterator[pa.RecordBatch], several: Sieve, owners: Sieve, hot: Sieve) -> Iterator[pa.RecordBatch]:
    """The contexts that owners(key) names, by anchors that are among several(h); hot: those of an anchor that is spread."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for row, buf, starts in K.slabs(batch.column(1), SLAB):
            places, hashes = anchors(buf, starts)
            places = places[several.keeps(hashes[places])]
            if not len(places):
                continue
            x = _occurrences(buf, starts, ids[row : row + len(starts) - 1], places, hashes)
            keep = np.flatnonzero(owners.keeps(x["key"], x["h"]))
            if len(keep):
                data = buf.tobytes()
                texts = [data[i:j] for i, j in zip(x["at"][keep].tolist(), x["to"][keep].tolist())]
                much = hot.keeps(x["h"][keep])
                yield pa.RecordBatch.from_arrays([K.signed(x["h"][keep]), pa.array(x["doc"][keep]), pa.array(x["lo"][keep].astype(np.int32)), pa.array(texts, pa.binary()), pa.array(much)], names=["h", "doc", "lo", "text", "hot"])


def suffix_array(text: np.ndarray, depth: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffixes in order of their first ``depth`` items or more, [(h, ranks by the first h items)]); items are under 512, 0 ends a string.

    asked: where only the order of some suffixes counts; the others' places and ranks may then be those of half the depth.
    """
    n = len(text)
    wide = np.zeros(n + 8, np.int64)
    wide[:n] = text
    two = (wide[:-1] << 9) | wide[1:]
    four = (two[:-2] << 18) | two[2:]
    packed = (four[:n] << 27) | (two[4 : n + 4] << 9) | wide[6 : n + 6]
    order = np.argsort(packed)
    change = np.ones(n, bool)
    change[1:] = packed[order[1:]] != packed[order[:-1]]
    h, levels = 7, []
    while True:
        # a group's rank is its first place, so settled suffixes keep theirs at every depth
        first = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        ranks = np.empty(n + 1, np.int64)
        ranks[order], ranks[n] = first, -1
        levels.append((h, ranks))
        if h >= depth:
            return order, levels
        alone = change.copy()
        alone[:-1] &= change[1:]
        if asked is not None and 2 * h >= depth:
            alone |= ~asked[order]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            h = depth
            continue
        own = order[open_]
        key = ranks[own] * (n + 1) + ranks[np.minimum(own + h, n)] + 1
        again = np.argsort(key)
        order[open_] = own[again]
        key = key[again]
        moved = np.ones(len(key), bool)
        moved[1:] = key[1:] != key[:-1]
        change[open_] = moved
        h *= 2


def repeats(texts: list[bytes], docs: np.ndarray, begins: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of each string of ``span`` bytes in the texts that also starts earlier; a text is bytes of a document from a begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    body = np.zeros(int(ends[-1]), np.int16)
    inside = np.ones(len(body), bool)
    inside[ends - 1] = False
    body[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(len(body)) - (ends - sizes - 1)[owner]
    fits = offset + span <= sizes[owner]
    order, levels = suffix_array(body, span, fits)
    # neighbours that share h items, and h items after the first span - h, share span items
    h, ranks = max(x for x in levels if x[0] <= span) if levels[0][0] <= span else levels[0]
    order = order[fits[order]]
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = order[:-1], order[1:]
    same = (ranks[a] == ranks[b]) if h == span else np.ones(len(a), bool)
    at = 0
    while at < span and h != span:
        same &= ranks[a + at] == ranks[b + at]
        at = min(at + h, span - h) if at < span - h else span
    run = np.concatenate([[0], np.cumsum(~same)])
    # only runs of two or more matter
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, run = order[shared], run[shared]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, start = docs[owner[order]], begins[owner[order]] + offset[order]
    by = np.lexsort((start, doc, run))
    run, doc, start = run[by], doc[by], start[by]
    lead = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(lead, len(run)))
    later = (doc != np.repeat(doc[lead], size)) | (start != np.repeat(start[lead], size))
    return doc[later], start[later]


def _runs(doc: np.ndarray, start: np.ndarray, span: int = SPAN) -> pa.RecordBatch:
    """Runs of removed bytes from starts of removed strings."""
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + span)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + span).astype(np.int32))], names=["doc", "lo", "hi"])


@K.frugal
def _sorted(batches: Iterator[pa.RecordBatch], limit: int = ARRAY) -> Iterator[pa.RecordBatch]:
    """Repeats in rows (h, doc, lo, text) in order of h; a suffix array holds whole groups of h, about ``limit`` bytes."""
    held: list = []
    size, last = 0, None

    def flush():
        doc, start = repeats([x[3] for x in held], np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64))
        return _runs(doc, start) if len(doc) else None

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns[:4]]):
            if size >= limit and row[0] != last:
                if (out := flush()) is not None:
                    yield out
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[3]), row[0]
    if held and (out := flush()) is not None:
        yield out


@K.frugal
def _windows(batches: Iterator[pa.RecordBatch], span: int = SPAN) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, doc, start = [], [], []
        for d, lo, text in zip(*[batch.column(c).to_pylist() for c in ("doc", "lo", "text")]):
            for i in range(len(text) - span + 1):
                digest.append(xxhash.xxh3_128_digest(text[i : i + span]))
                doc.append(d)
                start.append(lo + i)
        if doc:
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int32())], names=["digest", "doc", "start"])


def repeated_runs(documents: DataFrame) -> DataFrame:
    """(doc, lo, hi): byte ranges of documents(doc_id, text) whose strings also start earlier; they may overlap."""
    texts = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") >= SPAN)
    counts = texts.mapInArrow(_hashes, "h bigint").groupBy("h").count().where("count > 1").select("h")
    twice = stored(counts, "anchors", TEXTS)
    seen = sieved([(twice, "h")], None, lambda own: texts.mapInArrow(lambda it: _shared(it, own), "h bigint, c bigint, doc bigint, lo int, hi int"), "occurrences")
    contexts = stored(seen.groupBy("h", "c").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count("*").alias("n")), "contexts")
    copies = seen.join(contexts.where("n > 1").select("h", "c", F.col("first.doc").alias("d0"), F.col("first.lo").alias("l0")), ["h", "c"])
    copies = copies.where("doc <> d0 or lo <> l0").select("doc", "lo", "hi")
    several = stored(contexts.groupBy("h").count().where("count > 1"), "several")
    doc, lo = F.col("first.doc"), F.col("first.lo").cast("bigint")
    key = F.col("h").bitwiseXOR(doc).bitwiseXOR(F.shiftleft(lo, 13)).bitwiseXOR(F.shiftleft(doc, 33))  # as in _occurrences
    owners = stored(contexts.join(several, "h").select("h", key.alias("key")), "owners")
    crowded = stored(several.where(F.col("count") > HOT).select("h"), "crowded")
    tables = [(several.select("h"), "h"), (owners, "key"), (crowded, "h")]
    rows = sieved(tables, "h", lambda *own: texts.mapInArrow(lambda it: _contexts(it, *own), "h bigint, doc bigint, lo int, text binary, hot boolean"), "contexts")
    cold = rows.where("not hot").select("h", "doc", "lo", "text").repartition("h").sortWithinPartitions("h", "doc", "lo").mapInArrow(_sorted, "doc bigint, lo int, hi int")
    windows = stored(rows.where("hot").mapInArrow(_windows, "digest binary, doc bigint, start int"), "windows")
    firsts = windows.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(firsts, "digest").where("doc <> first.doc or start <> first.start")
    return copies.unionByName(cold).unionByName(later.select("doc", F.col("start").alias("lo"), (F.col("start") + SPAN).alias("hi")))


def _united(runs: np.ndarray, n: int) -> np.ndarray:
    """Maximal runs from overlapping ones, as rows of begin and end."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0], 1)
    np.add.at(depth, np.minimum(runs[:, 1], n), -1)
    return np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(depth)[:n] > 0).astype(np.int8), [0]]))).reshape(-1, 2)


@K.frugal
def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {x: [] for x in ("text", "n_bytes", "n_removed", "spans")}
        runs = batch.column("runs")
        for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            text = text or b""
            spans = np.zeros((0, 2), np.int64)
            if runs[i].is_valid and len(text):
                own = runs[i].values
                spans = _united(np.stack([own.field(0).to_numpy(), own.field(1).to_numpy()], axis=1).astype(np.int64), len(text))
            at, parts = 0, []
            for lo, hi in spans.tolist():
                parts.append(text[at:lo])
                at = hi
            out["text"].append(b"".join([*parts, text[at:]]) if len(spans) else text)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
            out["spans"].append(spans.tolist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["text"], pa.binary()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(pa.list_(pa.int32())))], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, kept (remaining bytes), n_bytes, n_removed, spans (maximal removed runs)."""
    runs = repeated_runs(documents).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"))
    return rows.join(runs, "doc", "left").select("doc_id", "text", "runs").mapInArrow(_kept, f"doc_id {kind}, kept binary, n_bytes bigint, n_removed bigint, spans array<array<int>>")
