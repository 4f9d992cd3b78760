"""Benchmark decontamination by winnowing.

A window is ``span`` successive words of a benchmark item (the whole item if it has fewer). Of each text the least
k-gram hash in every run of ``span - k + 1`` k-grams is kept, so each shared span of ``span`` words has a fingerprint in
both texts; the kept ones that the benchmark has too are extended to the windows around them. Items of fewer words have
a window length of their own and are looked up at every place. Words and windows are compared by 64-bit hashes.

Fingerprints and windows of the benchmark are made in tasks and written as tables. Up to ``most`` rows, counted first,
they go to the tasks as a broadcast; beyond that documents' fingerprints are joined with them as tables, and only
documents with a shared one are read again to extend them. Both ways give the same rows.

Nulls and texts without a word have no words and no hits; items without words have no window; texts of any length are
read whole; repeated rows give repeated results, rows with a null id count like others; an empty table on either side gives no hits;
columns other than those named are kept out of the result. ``copy`` columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import TEXTS, stored

SPAN, GRAM = 10, 5
#: Fingerprints and windows of a benchmark that are broadcast at most, and bytes of their items' ids.
MOST, MOST_BYTES = 1 << 20, 32 << 20
_RULE = K.table("alnum")


def _unique(hashes: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, where the items of each begin, and the items."""
    order = np.lexsort((items, hashes))
    hashes, items = hashes[order], items[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
    hashes, items = hashes[fresh], items[fresh]
    keys, begin = np.unique(hashes, return_index=True)
    return keys, np.append(begin, len(hashes)), items


def _item_windows(own: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, int, np.ndarray]:
    """(fingerprints, window length, windows) of an item's word hashes; no windows without words."""
    none = np.zeros(0, np.uint64)
    if len(own) >= span:
        return K.distinct(K.minima(K.grams(own, gram), span - gram + 1)), span, K.distinct(K.grams(own, span))
    return none, len(own), K.grams(own, len(own)) if len(own) else none


@K.frugal
def _prints(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (n, h, item_id) of items: n is 0 for fingerprints, else the length of a window."""
    for batch in batches:
        for row, buf, starts in K.slabs(batch.column("text")):
            hashes, first = K.words(buf, starts, _RULE)
            at, length, value = [], [], []
            for d in range(len(starts) - 1):
                marks, n, windows = _item_windows(hashes[first[d] : first[d + 1]], span, gram)
                at.append(np.full(len(marks) + len(windows), row + d))
                length.append(np.concatenate([np.zeros(len(marks), np.int32), np.full(len(windows), n, np.int32)]))
                value.append(np.concatenate([marks, windows]))
            if sum(map(len, at)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(length), pa.int32()), K.signed(np.concatenate(value)), batch.column("item_id").take(pa.array(np.concatenate(at)))], names=["n", "h", "item_id"])


class Fingerprints:
    """What the tasks look up: fingerprints, and windows by length with the places of their items in ``ids``."""

    def __init__(self, rows: list, span: int, gram: int):
        self.span, self.gram = span, gram
        self.ids = sorted({r.item_id for r in rows if r.n}, key=lambda x: (x is not None, x))
        place = {x: i for i, x in enumerate(self.ids)}
        self.marks = np.unique(np.array([r.h for r in rows if not r.n], np.int64).view(np.uint64))
        self.windows = {}
        for n in {r.n for r in rows if r.n}:
            own = [r for r in rows if r.n == n]
            self.windows[n] = _unique(np.array([r.h for r in own], np.int64).view(np.uint64), np.array([place[r.item_id] for r in own]))


def _among(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, values), max(len(sorted_keys) - 1, 0))
    return sorted_keys[at] == values if len(sorted_keys) else np.zeros(len(values), bool)


def _winnowed(hashes: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where windows of ``span`` words begin, the fingerprint of each)."""
    least = K.minima(K.grams(hashes, gram), span - gram + 1)
    near = np.flatnonzero(K.within(first, span, len(least))) if len(least) else np.zeros(0, np.int64)
    return near, least[near]


def _candidates(hashes: np.ndarray, first: np.ndarray, prints: Fingerprints) -> np.ndarray:
    """Where windows of ``span`` words may begin: around each winnowed k-gram that the benchmark has."""
    near, least = _winnowed(hashes, first, prints.span, prints.gram)
    if not len(near):
        return near
    # successive windows mostly share their fingerprint: each is looked up once
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    hit = _among(prints.marks, least[fresh])
    return near[hit[np.cumsum(fresh) - 1]]


def _hits(hashes: np.ndarray, first: np.ndarray, prints: Fingerprints) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word is inside a window, document of each found item, item) over a slab of documents."""
    inside = np.zeros(len(hashes) + 1, np.int32)
    docs, items = [], []
    for n, (keys, begin, owners) in prints.windows.items():
        if n == prints.span:
            at = _candidates(hashes, first, prints)
            values = np.zeros(len(at), np.uint64)
            for j in range(n):
                values *= np.uint64(K._MULT)
                values += hashes[at + j]
            values = K.mix(values)
        else:
            values = K.grams(hashes, n)
            at = np.flatnonzero(K.within(first, n, len(values)))
            values = values[at]
        found = _among(keys, values)
        at, values = at[found], values[found]
        if not len(at):
            continue
        np.add.at(inside, at, 1)
        np.add.at(inside, at + n, -1)
        key = np.searchsorted(keys, values)
        doc = np.searchsorted(first, at, "right") - 1
        pairs = np.unique(np.stack([doc, key]), axis=1)
        counts = begin[pairs[1] + 1] - begin[pairs[1]]
        docs.append(np.repeat(pairs[0], counts))
        flat = np.repeat(begin[pairs[1]] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        items.append(owners[flat])
    none = np.zeros(0, np.int64)
    return np.cumsum(inside[:-1]) > 0, np.concatenate([none, *docs]), np.concatenate([none, *items])


def _spans(inside: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


@K.frugal
def _scan(batches: Iterator[pa.RecordBatch], held, copy: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    prints = held.value
    for batch in batches:
        texts = batch.column("text")
        n_words, found, spans = np.zeros(len(batch), np.int64), {}, {}
        for row, buf, starts in K.slabs(texts):
            hashes, first = K.words(buf, starts, _RULE)
            n_words[row : row + len(starts) - 1] = np.diff(first)
            inside, docs, items = _hits(hashes, first, prints)
            for d, i in sorted(set(zip(docs.tolist(), items.tolist()))):
                found.setdefault(row + d, set()).add(prints.ids[i])
            for d in set(docs.tolist()):
                spans[row + d] = _spans(inside[first[d] : first[d + 1]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in copy] + [pa.array(n_words), pa.array([spans.get(i, []) for i in range(len(batch))], schema.field("spans").type), pa.array([sorted(found.get(i, ()), key=str) for i in range(len(batch))], schema.field("items").type)],
            schema=schema,
        )


@K.frugal
def _marks(batches: Iterator[pa.RecordBatch], span: int, gram: int, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (row, n, h) of texts: their fingerprints with n 0, and every window of the given lengths."""
    for batch in batches:
        ids = batch.column("_row").to_numpy()
        for row, buf, starts in K.slabs(batch.column("text")):
            hashes, first = K.words(buf, starts, _RULE)
            at, length, value = [], [], []
            for n in (0, *lengths):
                if n:
                    values = K.grams(hashes, n)
                    places = np.flatnonzero(K.within(first, n, len(values)))
                    values = values[places]
                else:
                    places, values = _winnowed(hashes, first, span, gram)
                docs = np.searchsorted(first, places, "right") - 1
                order = np.lexsort((values, docs))
                docs, values = docs[order], values[order]
                fresh = np.ones(len(docs), bool)
                fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
                at.append(ids[row + docs[fresh]])
                value.append(values[fresh])
                length.append(np.full(fresh.sum(), n, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(length)), K.signed(np.concatenate(value))], names=["_row", "n", "h"])


@K.frugal
def _extended(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, n, at, h) of texts with shared marks (lists of n and h): the windows that may begin around each."""
    for batch in batches:
        ids, marks = batch.column("_row").to_numpy(), batch.column("marks").to_pylist()
        for row, buf, starts in K.slabs(batch.column("text")):
            hashes, first = K.words(buf, starts, _RULE)
            for d in range(len(starts) - 1):
                own, edge = hashes[first[d] : first[d + 1]], np.array([0, first[d + 1] - first[d]])
                for n in {m["n"] for m in marks[row + d]}:
                    have = np.unique(np.array([m["h"] for m in marks[row + d] if m["n"] == n], np.int64).view(np.uint64))
                    if n:
                        values = K.grams(own, n)
                        at = np.flatnonzero(_among(have, values))
                        values = values[at]
                    else:
                        near, least = _winnowed(own, edge, span, gram)
                        at = near[_among(have, least)]
                        values = K.grams(own, span)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[row + d])), pa.array(np.full(len(at), n or span, np.int32)), pa.array(at.astype(np.int32)), K.signed(values)], names=["_row", "n", "at", "h"])


@K.frugal
def _finished(batches: Iterator[pa.RecordBatch], copy: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The result's rows from texts with hits (lists of at and n) and items."""
    for batch in batches:
        hits, n_words, spans = batch.column("hits").to_pylist(), np.zeros(len(batch), np.int64), []
        for row, buf, starts in K.slabs(batch.column("text")):
            _, first = K.words(buf, starts, _RULE)
            n_words[row : row + len(starts) - 1] = np.diff(first)
        for n, own in zip(n_words.tolist(), hits):
            inside = np.zeros(n + 1, np.int32)
            for x in own or ():
                inside[x["at"]] += 1
                inside[x["at"] + x["n"]] -= 1
            spans.append(_spans(np.cumsum(inside[:n]) > 0))
        items = [sorted(x or (), key=str) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in copy] + [pa.array(n_words), pa.array(spans, schema.field("spans").type), pa.array(items, schema.field("items").type)], schema=schema)


def _joined(source: DataFrame, prints: DataFrame, copy: list[str], schema: str, arrow: pa.Schema, span: int, gram: int) -> DataFrame:
    """Hits by joins of written tables; a number stands for each row, as ids may be null or repeated."""
    rows = stored(source.withColumn("_row", F.monotonically_increasing_id()), "rows", TEXTS)
    lengths = sorted(r.n for r in prints.where((F.col("n") > 0) & (F.col("n") < span)).select("n").distinct().collect())
    own = rows.select("_row", "text").mapInArrow(lambda it: _marks(it, span, gram, lengths), "_row bigint, n int, h bigint")
    shared = own.join(prints.where(F.col("n") < span).select("n", "h").distinct(), ["n", "h"], "left_semi")
    shared = stored(shared.groupBy("_row").agg(F.collect_list(F.struct("n", "h")).alias("marks")), "shared", TEXTS)
    near = rows.select("_row", "text").join(shared, "_row").select("_row", "text", "marks").mapInArrow(lambda it: _extended(it, span, gram), "_row bigint, n int, at int, h bigint")
    hits = stored(near.join(prints.where("n > 0"), ["n", "h"]), "hits", TEXTS)
    found = hits.groupBy("_row").agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.collect_set("item_id").alias("items"))
    return rows.join(found, "_row", "left").select(*copy, "text", "hits", "items").mapInArrow(lambda it: _finished(it, copy, arrow), schema)


def find_hits(documents: DataFrame, benchmark: DataFrame, copy: tuple[str, ...] = ("doc_id",), span: int = SPAN, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Per document: the ``copy`` columns, n_words, spans (half-open runs of hit words) and items (ids of items with an occurring window).

    documents: text and the ``copy`` columns. benchmark: item_id, text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    source = documents.select(*copy, "text")
    schema = f"{', '.join(f'`{c}` {t}' for c, t in documents.select(*copy).dtypes)}, n_words bigint, spans array<array<int>>, items array<{kind}>".lstrip(", ")
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    prints = benchmark.select("item_id", "text").mapInArrow(lambda it: _prints(it, span, gram), f"n int, h bigint, item_id {kind}")
    prints = stored(prints.distinct(), "prints", TEXTS)
    size = prints.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("item_id").cast("string"))), F.lit(0)).alias("bytes")).first()
    if size.n > most or size.bytes > MOST_BYTES:
        return _joined(source, prints, list(copy), schema, arrow, span, gram)
    held = spark.sparkContext.broadcast(Fingerprints(prints.collect(), span, gram))
    return source.mapInArrow(lambda it: _scan(it, held, list(copy), arrow), schema)


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + (x[1] - x[0]))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents without a benchmark window, with all their columns; each row is judged by itself."""
    columns = documents.columns
    inner = documents.select(F.struct("*").alias("row"), F.col("text"))
    hits = find_hits(inner, benchmark, ("row",), span, gram)
    return hits.where(F.size("items") == 0).select(*[F.col("row").getField(c).alias(c) for c in columns])
