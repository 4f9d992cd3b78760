"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard confirmation, union-find.

Every line with a letter or digit takes part, lower-cased and without surrounding white space; blank lines and mere
punctuation say nothing and stay. Equal lines form one class by a 128-bit hash, whatever their length. Of lines of
``SHINGLE`` characters and more, those that agree on one of ``BANDS`` bands of ``ROWS`` values are candidates, confirmed on
their full shingle sets (Jaccard of 0.8 or more); shorter lines have no shingle and only equal ones. Of each
component the first line stays: least doc_id, then line number.

A pair at the threshold shares no band with a chance of (1 - 0.8**3)**10 = 8e-4, one at 0.9 of 2e-6. Most values of bands
are those of one line only; they are told by half of each hash first, and only the others are brought together (two lines
that also agree on 32 bits of their keys pass for one there: 2e-10 a pair). In a crowded band
small groups that agree on the next band too and next neighbours in the order of its hash are compared, as in ``near``;
then a crowded band that holds several components is compared in full (``crowded``).

Null texts have no lines; rows with a null id are left alone; rows that share an id are one document, whose lines at
the same number go or stay together. Texts and lines of any length are read whole; a text is in memory once or twice.
Empty tables give empty results; other columns pass through ``drop_lines``, n_removed replaces one of that name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.components import components
from wirechart.llm.crowded import joined
from wirechart.llm.near import _neighbours, crowds
from wirechart.llm.shared import TEXTS, Sieve, mark, release, sieved, stored

SHINGLE, PERCENT = 8, 80
BANDS, ROWS = 10, 3
SMALL, NEAR = 32, 4
#: Distinct lines that a task remembers before it begins anew.
SEEN = 200_000
#: Parts by which the values of bands are dealt to find those that several lines have.
PARTS_BITS, VALUE_BITS = 10, 32
#: Bytes of text in a run: its arrays stay in the processor's cache.
SLAB = 1 << 17
_FACTORS = K.permutations(BANDS * ROWS, 23)
_LETTER = np.uint64(0xD6E8FEB86659FD93)
_SAYS = re.compile(r"[^\W_]")


def _normal(line: str) -> str:
    return line.strip().lower()


def _lines(ids: list, texts: list) -> tuple[list, list, list[str]]:
    docs, numbers, lines = [], [], []
    for doc, text in zip(ids, texts):
        if text:
            for number, line in enumerate(text.split("\n")):
                if _SAYS.search(line):
                    docs.append(doc)
                    numbers.append(number)
                    lines.append(_normal(line))
    return docs, numbers, lines


def _digests(lines: list[str]) -> np.ndarray:
    """128-bit hashes, two words a line."""
    return np.frombuffer(b"".join(hashlib.md5(x.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for x in lines), np.uint64).reshape(-1, 2)


def _shingles(lines: list[str], width: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes of all lines, where those of each begin and end); every line has ``width`` characters or more.

    With ``whole``, the hashes of shingles that cross from one line into the next stay between the end and the next begin.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    items = K.grams(points * _LETTER, width)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    begin, end = np.concatenate([[0], ends[:-1]]), ends - width + 1
    if whole or not lines:
        return items, begin, end
    keep = np.ones(len(items), bool)
    keep[(end[:-1, None] + np.arange(width - 1)).ravel()] = False
    shift = np.arange(len(lines)) * (width - 1)
    return items[keep], begin - shift, end - shift


def _slabs(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list[str]]]:
    """Lines of a batch in runs of about a slab of text."""
    n, size = len(batch), max(1, batch.column(1).nbytes)
    step = max(1, int(n * SLAB / size))
    for i in range(0, n, step):
        part = batch.slice(i, step)
        docs, numbers, lines = _lines(part.column(0).to_pylist(), part.column(1).to_pylist())
        if lines:
            yield docs, numbers, lines


@K.frugal
def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Every line with its key; a line of no shingle has null bands, and one that equals an earlier one of the task, as the first of them has them."""
    seen: set[bytes] = set()
    for batch in batches:
        for docs, numbers, lines in _slabs(batch):
            keys = _digests(lines)
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.array([len(line) >= width and x not in seen and not seen.add(x) for line, x in zip(lines, keys.view("V16").ravel().tolist())], bool)
            bands = np.zeros((0, BANDS), np.uint64)
            if fresh.any():
                items, begin, end = _shingles([lines[i] for i in np.flatnonzero(fresh)], width, True)
                marks = K.signatures(items, begin, _FACTORS, end).astype(np.uint64)
                bands = np.stack([K.grams(marks[:, b : b + ROWS].ravel(), ROWS)[::ROWS] for b in range(0, BANDS * ROWS, ROWS)], axis=1)
            marks = K.pieces(bands.ravel(), np.concatenate([[0], np.cumsum(fresh * BANDS)]), fresh)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), K.signed(keys[:, 0].copy()), K.signed(keys[:, 1].copy()), marks], names=["doc_id", "line", "key", "key_b", "bands"])


def _regions(bands: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, regions) of the bands of lines, BANDS values as bytes each: one row a line; a region is a value of one band."""
    values = np.frombuffer(b"".join(bands.to_pylist()), np.uint64).reshape(-1, BANDS)
    return values, values ^ np.arange(BANDS, dtype=np.uint64)


@K.frugal
def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, bands), the regions by the part of their first bits: VALUE_BITS further ones, then 32 bits of the key."""
    for batch in batches:
        regions = _regions(batch.column(1))[1].ravel()
        part = (regions >> np.uint64(64 - PARTS_BITS)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        items = regions >> np.uint64(64 - PARTS_BITS - VALUE_BITS) << np.uint64(32)
        items |= np.repeat(K.unsigned(batch.column(0)) & np.uint64(0xFFFFFFFF), BANDS)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << PARTS_BITS))])
        some = np.flatnonzero(np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), K.pieces(items[order], np.append(cuts[some], len(items)))], names=["part", "items"])


@K.frugal
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes, as in ``_meeting``, of regions of several keys, from rows (part, items) in the order of part."""

    def several(part, held):
        items = K.distinct(np.frombuffer(b"".join(held), np.uint64))
        own = items >> np.uint64(32)
        own = K.distinct(own[1:][own[1:] == own[:-1]])
        return pa.RecordBatch.from_arrays([K.signed(K.mix(np.uint64(part << VALUE_BITS) | own))], names=["region"])

    last, held = None, []
    for batch in batches:
        for part, own in zip(*(c.to_pylist() for c in batch.columns)):
            if part != last:
                if held:
                    yield several(last, held)
                last, held = part, []
            held.append(own)
    if held:
        yield several(last, held)


@K.frugal
def _meeting(batches: Iterator[pa.RecordBatch], sieve: Sieve) -> Iterator[pa.RecordBatch]:
    """(region, tail, id) of rows (key, bands): the regions that the sieve keeps, each with the value of the next band."""
    for batch in batches:
        values, regions = _regions(batch.column(1))
        regions = regions.ravel()
        at = np.flatnonzero(sieve.keeps(K.mix(regions >> np.uint64(64 - PARTS_BITS - VALUE_BITS))))
        row, band = np.divmod(at, BANDS)
        yield pa.RecordBatch.from_arrays([K.signed(regions[at]), K.signed(values[row, (band + 1) % BANDS]), batch.column(0).take(pa.array(row))], names=["region", "tail", "id"])


def meeting(rows: DataFrame) -> DataFrame:
    """(region, tail, id) of rows(key, bands): the regions that several keys share, and few others."""
    rows = rows.where("bands is not null").select("key", "bands")
    dealt = rows.mapInArrow(_dealt, "part int, items binary").repartition("part").sortWithinPartitions("part")
    met = stored(dealt.mapInArrow(_met, "region bigint"), "met")
    return sieved([(met, "region")], None, lambda sieve: rows.mapInArrow(lambda it: _meeting(it, sieve), "region bigint, tail bigint, id bigint"), "bands", None)


@K.frugal
def _fetch(batches: Iterator[pa.RecordBatch], sieve: Sieve) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, lines in _slabs(batch):
            keys = _digests(lines)[:, 0].copy()
            at = np.flatnonzero(sieve.keeps(keys))
            if len(at):
                at = at[np.unique(keys[at], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([K.signed(keys[at]), pa.array([lines[i] for i in at], pa.string())], names=["key", "text"])


@K.frugal
def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = min(2048, max(1, int(len(batch) * SLAB / max(1, batch.nbytes))))
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            sides = [_shingles(part.column(c).to_pylist(), width) for c in ("text_a", "text_b")]
            keep = K.alike([x for x, _, _ in sides], [x for _, x, _ in sides], percent)
            if keep.any():
                yield part.filter(pa.array(keep)).select(["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text, with its distinct shingles in place of it."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            items, begin, end = _shingles(part.column(part.num_columns - 1).to_pylist(), width)
            sets = pa.array([K.distinct(items[a:b]).tobytes() for a, b in zip(begin, end)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sets], names=[*part.schema.names[:-1], "items"])


def _texts(ids: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the lines whose keys are in wanted(key), a written table."""
    found = sieved([(wanted, "key")], None, lambda sieve: ids.mapInArrow(lambda it: _fetch(it, sieve), "key bigint, text string"), "lines")
    return found.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def _placed(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(lines (doc_id, line, key, root, rest), classes (root, rest, first) of more than one line)."""
    ids = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    first = mark()
    rows = stored(ids.mapInArrow(lambda it: _sketch(it, width), "doc_id bigint, line int, key bigint, key_b bigint, bands binary"), "lines", TEXTS)
    begun = mark()
    # a band's rows are ordered by the next band, so lines that agree on it too are neighbours
    bands = meeting(rows).repartition("region").sortWithinPartitions("region", "tail", "id")
    found = bands.mapInArrow(lambda it: _neighbours(it, SMALL, NEAR), "a bigint, b bigint, crowded boolean")
    found = stored(found.distinct(), "pairs")
    release(begun, keep=1)
    begun = mark()
    pairs = found.where("not crowded").select("a", "b")
    # the texts serve the exact pass, too: a line of a crowded region is in a pair with its neighbour
    wanted = stored(found.select(F.explode(F.when(F.col("crowded"), F.array("b")).otherwise(F.array("a", "b"))).alias("key")).distinct(), "keys")
    texts = stored(_texts(ids, wanted), "texts")
    release(begun, keep=1)
    begun = mark()
    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    links = both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirm(it, width, percent), "a bigint, b bigint")
    roots = components(links)
    release(begun, keep=1)
    roots = joined(crowds(found), roots, texts.withColumnRenamed("key", "id"), lambda it: _sets(it, width), percent)
    # classes go by both halves of the key; in a component, whose links were confirmed on texts, by its root
    known = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    placed = rows.select("doc_id", "line", "key", "key_b").join(stored(known, "roots").withColumnRenamed("node", "key"), "key", "left")
    placed = placed.select("doc_id", "line", "key", F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("key_b")).otherwise(0).alias("rest"))
    placed = stored(placed, "placed")
    classes = placed.groupBy("root", "rest").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a written table has a known size: a small one is broadcast, and a hot class of a large one is split by the join
    classes = stored(classes.select("root", "rest", "first"), "classes")
    release(first, keep=2)
    return placed, classes


def _is_first() -> Column:
    return (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line") == F.col("first.line"))


def fuzzy_lines(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per line that takes part: doc_id, line (from 0), key, root (of its class) and kept."""
    placed, classes = _placed(documents, width, percent)
    out = placed.join(classes, ["root", "rest"], "left")
    return out.select("doc_id", "line", "key", "root", F.coalesce(_is_first(), F.lit(True)).alias("kept"))


def drop_lines(documents: DataFrame, width: int = SHINGLE, percent: int = PERCENT, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The documents without the lines that repeat an earlier one; texts are rejoined from the others, and n_removed is added."""
    placed, classes = _placed(documents, width, percent)
    gone = placed.join(classes, ["root", "rest"]).where(~_is_first()).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    columns = [c for c in keep or documents.columns if c != "n_removed"]
    rows = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id")).join(gone, "doc_id", "left")
    # the lines are split once: as an element, not again for each of them
    kept = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.element_at(F.transform(F.array(F.split("row.text", "\n")), kept), 1))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns], F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
