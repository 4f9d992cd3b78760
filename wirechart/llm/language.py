"""Scores of texts by an n-gram model whose counts lie in a log-frequency Bloom filter.

Training texts are cut into words, each text between a begin and an end mark. Tasks count n-grams of every length up to the order,
pre-aggregated, and merge the counts by ranges of their 64-bit hashes. A count c is stored as its level 1 + floor(log c): the filter
holds the n-gram with each level up to that, and a lookup asks for level after level until one is missing, so it never
understates a count. Bits of one n-gram lie in one block of the filter, chosen by its hash, so blocks are built apart.

Probabilities are smoothed towards the shorter history: p(w|h) = (c(hw) + s p(w|h')) / (c(h) + s), at last (c(w) + 1) / (N + V + 1), with
counts from the filter alone; a longer n-gram's count is held to those of its parts. The base score takes exact counts: those of
frequent words from a broadcast table of at most ``TIER`` rows, others from a join on what the filter doesn't rule out.

A filter of at most ``BOUND`` bytes is broadcast. A larger one stays a table: texts meet in chunks of about ``CHUNK`` bytes, chosen by a hash of
their rows, and each chunk asks once for each of its distinct n-grams. Their keys go, in order and packed, to the runs of blocks that have them, a
byte a level goes back to the chunk, and the same texts are scored with those, which gives the same scores. Both grow in proportion to the texts.

Null and empty texts have one token, the end; texts are read whole. Rows with null or repeated ids are rows like all others, as
are repeated rows; without training rows every probability is 1. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import TEXTS, mark, release, stored, swept

#: Length of the longest n-gram; growth of a count by a level; weight of the shorter history.
ORDER, GROWTH, STRENGTH = 2, 1.5, 20.0
#: Bits of the filter for each stored level, probes of a lookup (16 bits of a hash each) and bits of a block.
BITS, PROBES, BLOCK = 10, 4, 1 << 16
#: Most bytes of a broadcast filter, most words in the exact table.
BOUND, TIER = 128 << 20, 1 << 18
#: n-grams that a task counts before it sends them; bytes of text for each range that counts are merged by.
HELD, RANGE = 1 << 23, 4 << 20
#: Where the filter is a table: bytes of text that ask together, blocks of the filter that answer together, most keys in a row and rows of keys that go to a task at once.
CHUNK, RUN, PIECE, ROWS = 16 << 20, 256, 1 << 13, 128
_RULE = K.table("graph")
_BEGIN, _END = (K.mix(np.array([x], np.uint64))[0] for x in (1, 2))
_STEP = 0xD6E8FEB86659FD93


def sequences(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of words with a mark before and after each text, where every text begins) for runs of whole texts."""
    for row, buf, starts in K.slabs(texts):
        hashes, first = K.words(buf, starts, _RULE)
        edges = first + 2 * np.arange(len(first))
        out = np.empty(edges[-1], np.uint64)
        inside = np.ones(len(out), bool)
        inside[edges[:-1]] = inside[edges[1:] - 1] = False
        out[inside] = hashes
        out[edges[:-1]], out[edges[1:] - 1] = _BEGIN, _END
        yield row, out, edges


def keys(sequence: np.ndarray, edges: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length: (places where n-grams of one text end, their keys); keys of single words are odd, all others even."""
    out = [(np.arange(len(sequence)), sequence | np.uint64(1))]
    for n in range(2, order + 1):
        grams = K.grams(sequence, n)
        begin = np.flatnonzero(K.within(edges, n, len(grams)))
        out.append((begin + n - 1, grams[begin] & ~np.uint64(1)))
    return out


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(GROWTH) + 1e-9).astype(np.int64)


def decoded(top: int = 120) -> np.ndarray:
    """The mean of the counts of each level."""
    low = np.ceil(GROWTH ** np.arange(-1.0, top) - 1e-9)
    low[0] = 0
    return np.concatenate([[0], (low[1:-1] + low[2:] - 1) / 2])


def _places(key: np.ndarray, rung: int) -> list[np.ndarray]:
    """Bits within its block of each key at a level."""
    mixed = K.mix(key + np.uint64(rung * _STEP & (1 << 64) - 1))
    return [(mixed >> np.uint64(16 * i)) & np.uint64(BLOCK - 1) for i in range(PROBES)]


def block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def looked_up(key: np.ndarray, bits: np.ndarray, blocks: int, block: np.ndarray | None = None) -> np.ndarray:
    """The level of each key: asked level by level until one isn't there. bits: the filter's bytes; block: as ``block_of`` unless given."""
    out = np.zeros(len(key), np.int64)
    if not len(bits):
        return out
    base = (block_of(key, blocks) if block is None else block) * np.uint64(BLOCK // 8)
    alive, rung = np.arange(len(key)), 0
    while len(alive):
        rung += 1
        own, begin = key[alive], base[alive]
        for place in _places(own, rung):
            if len(place) != len(alive):
                place = place[left]
            hit = (bits[(begin + (place >> np.uint64(3))).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
            alive, begin = alive[hit], begin[hit]
            left = np.flatnonzero(hit) if len(place) == len(own) else left[hit]
        out[alive] = rung
    return out


def probabilities(levels: list[tuple[np.ndarray, np.ndarray]], size: int, total: int, strength: float) -> np.ndarray:
    """Of each place of a sequence of ``size``, log10 of its word's probability; levels: per length (places, levels there)."""
    mean = decoded()
    have = np.zeros(size)
    have[levels[0][0]] = mean[levels[0][1]]
    p = (have + 1) / total
    for places, found in levels[1:]:
        own = np.zeros(size)
        own[places] = np.minimum(mean[found], np.minimum(have[places], have[places - 1]))
        p[places] = (own[places] + strength * p[places]) / (have[places - 1] + strength)
        have = own
    return np.log10(p)


@K.frugal
def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        every = np.sort(np.concatenate(held))
        lead = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.diff(np.append(lead, len(every)))
        for i in range(0, len(lead), 1 << 17):
            yield pa.RecordBatch.from_arrays([K.signed(every[lead[i : i + (1 << 17)]]), pa.array(count[i : i + (1 << 17)])], names=["h", "n"])

    for batch in batches:
        for _, sequence, edges in sequences(batch.column(0)):
            for _, found in keys(sequence, edges, order):
                held.append(found)
                n += len(found)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
    if n:
        yield from flush()


@K.frugal
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each range added up; rows (range, h, n) come in order of ranges."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, n = h[order], n[order]
        lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return pa.RecordBatch.from_arrays([K.signed(h[lead]), pa.array(np.add.reduceat(n, lead))], names=["h", "n"])

    last = None
    for batch in batches:
        ranges, h, n = batch.column(0).to_numpy(), K.unsigned(batch.column(1)), batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and ranges[i] != last:
                yield flush()
                held = []
            last = ranges[i]
            held.append((h[i:j], n[i:j]))
    if held:
        yield flush()


@K.frugal
def _bits(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(block, bits) of the counts (h, n): a block may come in several rows, to be joined by or."""
    held, n = [], 0

    def flush():
        h, levels = (np.concatenate(x) for x in zip(*held))
        at = []
        for rung in range(1, int(levels.max()) + 1):
            own = h[levels >= rung]
            base = block_of(own, blocks) * np.uint64(BLOCK)
            at += [base + x for x in _places(own, rung)]
        at = K.distinct(np.concatenate(at))
        block = (at // np.uint64(BLOCK)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        rows = []
        for i, j in zip(cuts, cuts[1:]):
            one = np.zeros(BLOCK, bool)
            one[(at[i:j] % np.uint64(BLOCK)).astype(np.int64)] = True
            rows.append(np.packbits(one, bitorder="little").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(rows, pa.binary())], names=["block", "bits"])

    for batch in batches:
        held.append((K.unsigned(batch.column(0)), level(batch.column(1).to_numpy())))
        n += len(batch)
        if n >= HELD // 8:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


class Model:
    """Counts of the training texts: exact ones as a table (h, n), their levels in a Bloom filter."""

    def __init__(self, texts: DataFrame, order: int = ORDER, strength: float = STRENGTH):
        spark = texts.sparkSession
        self.order, self.strength = order, strength
        since = mark()
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        ranges = max(1, -(-size // RANGE))
        counted = texts.select("text").mapInArrow(lambda it: _counted(it, order), "h bigint, n bigint")
        own = F.shiftright(F.shiftrightunsigned("h", 32) * ranges, 32)  # as block_of: a range holds whole blocks or is in one
        counted = counted.select(own.alias("range"), "h", "n").repartition("range").sortWithinPartitions("range")
        counts = stored(counted.mapInArrow(_merged, "h bigint, n bigint"), "counts", TEXTS * 64)
        del counted
        swept(spark)
        word = F.col("h").bitwiseAND(F.lit(1)) == 1
        begin = F.col("h") == int((_BEGIN | np.uint64(1)).astype(np.int64))
        rung = (1 + F.floor(F.ln("n") / float(np.log(GROWTH)) + 1e-9)).cast("bigint")
        row = counts.agg(F.sum(F.when(word & ~begin, F.col("n"))).alias("n"), F.count_if(word & ~begin).alias("v"), F.sum(rung).alias("levels")).first()
        self.tokens, self.words = row.n or 0, row.v
        self.exact = stored(counts.where(word & ~begin), "words")
        self.blocks = max(1, -(-(row.levels or 0) * BITS // BLOCK))
        blocks = self.blocks
        bits = counts.mapInArrow(lambda it: _bits(it, blocks), "block bigint, bits binary")
        self.table = self.filter = None
        if self.blocks * BLOCK // 8 <= BOUND:
            whole = np.zeros((self.blocks, BLOCK // 8), np.uint8)
            for r in bits.toLocalIterator():
                whole[r.block] |= np.frombuffer(r.bits, np.uint8)
            self.filter = spark.sparkContext.broadcast(whole.ravel())
        else:
            self.table = stored(bits, "filter")
        release(since, 1 if self.table is None else 2)
        self.since = since + 1  #: tables from here on are read until the texts are scored
        # the exact table: words from the least power of two on that leaves at most TIER of them
        by = {r.k: r.n for r in self.exact.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()}
        least, have = max(by, default=0) + 1, 0
        while by.get(least - 1, 0) + have <= TIER and least > 0:
            least -= 1
            have += by.get(least, 0)
        top = self.exact.where(F.col("n") >= 2**least).toArrow()
        order_ = np.argsort(K.unsigned(top["h"].combine_chunks()))
        self.least = 2**least
        self.tier = spark.sparkContext.broadcast((K.unsigned(top["h"].combine_chunks())[order_], top["n"].to_numpy()[order_]))

    @property
    def total(self) -> int:
        """What a count plus one is divided by."""
        return self.tokens + self.words + 1


def _lists(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Values as a list for each of n rows; row: which one has each, in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values))


def _lines(runs: Iterator[tuple[int, np.ndarray, np.ndarray]], order: int, strength: float, total: int, look: Callable[[np.ndarray], np.ndarray], tier) -> Iterator[pa.RecordBatch]:
    """For runs of texts as from ``sequences``, per text: n_tokens, score, sums of the base score and words that are left to a join, with their numbers.

    look: the levels of keys.
    """
    frequent, often = tier.value
    for _, sequence, edges in runs:
        n, size = len(edges) - 1, len(sequence)
        doc = np.repeat(np.arange(n), np.diff(edges))
        every = keys(sequence, edges, order)
        word, back = np.unique(every[0][1], return_inverse=True)
        at = np.minimum(np.searchsorted(frequent, word), max(len(frequent) - 1, 0))
        common = frequent[at] == word if len(frequent) else np.zeros(len(word), bool)
        exact = np.zeros(len(word), np.int64)
        exact[common] = often[at[common]]
        found = look(word)
        rest = ~common & (found > 0) & (word != (_BEGIN | np.uint64(1)))  # the filter never understates, so words that it lacks are unknown for sure
        levels = [(every[0][0], found[back]), *((places, look(key)) for places, key in every[1:])]
        p = probabilities(levels, size, total, strength)
        p[edges[:-1]] = 0
        value = np.log10(exact + 1)[back]
        value[edges[:-1]] = 0
        known = (exact > 0)[back].astype(np.int64)
        known[edges[:-1]] = 0
        open_ = np.flatnonzero(rest[back])
        pair, times = np.unique(doc[open_] * len(word) + back[open_], return_counts=True)
        owner = pair // max(len(word), 1)
        words = _lists(word[pair % max(len(word), 1)].view(np.int64), owner, n)
        counts = _lists(times.astype(np.int64), owner, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(edges) - 1), *(pa.array(np.add.reduceat(x, edges[:-1])) for x in (p, value, known)), words, counts], names=_COLUMNS)


_COLUMNS = ["n_tokens", "score", "value", "known", "words", "counts"]


@K.frugal
def _scored(batches: Iterator[pa.RecordBatch], order: int, strength: float, total: int, blocks: int, filter_, tier) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) with the columns of ``_lines``."""
    for batch in batches:
        row = 0
        for own in _lines(sequences(batch.column(1)), order, strength, total, lambda key: looked_up(key, filter_.value, blocks), tier):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(own)), *own.columns], names=["key", *_COLUMNS])
            row += len(own)


def _stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of rows next to each other that are equal in all columns."""
    if len(columns[0]):
        new = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(columns[0])]
        yield from zip(cuts, cuts[1:])


def _bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What the cells of an Arrow column of bytes hold, one after the other, and the number of items of each."""
    column, width = column.cast(pa.binary()), np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind), np.diff(offsets) // width


def packed(key: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Keys in order as bytes, a cell for each stretch between cuts: steps of the upper 16 bits, nearly all 0, and the lower 48 bits."""
    upper = (key >> np.uint64(48)).astype(np.uint16)
    steps = np.diff(upper, prepend=np.uint16(0))
    steps[cuts[:-1]] = upper[cuts[:-1]]
    return K.pieces(steps, cuts), K.pieces(key.view(np.uint16).reshape(-1, 4)[:, :3], cuts)


def unpacked(steps: pa.Array, lower: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of cells made by ``packed`` and the number in each; no cell is empty."""
    step, n = _bytes(steps, np.uint16)
    out = np.empty((len(step), 4), np.uint16)
    out[:, :3] = _bytes(lower, np.uint16)[0].reshape(-1, 3)
    upper, first = np.cumsum(step, dtype=np.int64), np.cumsum(n) - n
    out[:, 3] = upper - np.repeat(upper[first] - step[first], n)
    return out.view(np.uint64).ravel(), n


@K.frugal
def _asked(batches: Iterator[pa.RecordBatch], order: int, blocks: int, run: int, piece: int, most: int) -> Iterator[pa.RecordBatch]:
    """From rows (chunk, text) in order of chunks, the distinct keys of each chunk as rows (part, chunk, at, steps, lower): at is the place of a row's first key.

    run: blocks of a part; piece: most keys of a row; most: keys that are held before they are compacted.
    """
    held: list[np.ndarray] = []
    last, n = None, 0

    def flush():
        key = K.distinct(np.concatenate(held))
        part = (block_of(key, blocks) // np.uint64(run)).astype(np.int64)
        every = np.unique(np.concatenate([np.flatnonzero(part[1:] != part[:-1]) + 1, np.arange(0, len(key), piece), [len(key)]]))
        for i in range(0, len(every) - 1, ROWS):
            cuts = every[i : i + ROWS + 1]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, last)), pa.array(cuts[:-1]), *packed(key[cuts[0] : cuts[-1]], cuts - cuts[0])], names=["part", "chunk", "at", "steps", "lower"])

    for batch in batches:
        chunk = batch.column(0).to_numpy()
        for i, j in _stretches(chunk):
            if held and chunk[i] != last:
                yield from flush()
                held, n = [], 0
            last = chunk[i]
            for _, sequence, edges in sequences(batch.column(1).slice(i, j - i)):
                own = [key for _, key in keys(sequence, edges, order)]
                held += own
                n += sum(map(len, own))
            if n >= most:  # many equal rows in one chunk
                held, n = [K.distinct(np.concatenate(held))], 0
    if held:
        yield from flush()


@K.frugal
def _answered(batches: Iterator[pa.RecordBatch], blocks: int, run: int) -> Iterator[pa.RecordBatch]:
    """From rows (part, kind, block, bits, chunk, at, steps, lower) in order, the bits of a part before its keys: (chunk, at, levels)."""
    now, bits = None, None
    for batch in batches:
        part, kind = (batch.column(i).to_numpy() for i in range(2))
        for i, j in _stretches(part, kind):
            if now != part[i]:
                now, bits = part[i], np.zeros((run, BLOCK // 8), np.uint8)
            own = batch.slice(i, j - i)
            if kind[i] == 0:
                for block, more in zip(own.column(2).to_pylist(), own.column(3).to_pylist()):
                    bits[block - now * run] |= np.frombuffer(more, np.uint8)
                continue
            key, n = unpacked(own.column(6), own.column(7))
            found = looked_up(key, bits.ravel(), blocks, block_of(key, blocks) - np.uint64(now * run))
            yield pa.RecordBatch.from_arrays([own.column(4), own.column(5), K.pieces(found.astype(np.uint8), np.append(0, np.cumsum(n)))], names=["chunk", "at", "levels"])


@K.frugal
def _gathered(batches: Iterator[pa.RecordBatch], order: int, strength: float, total: int, tier) -> Iterator[pa.RecordBatch]:
    """From rows (chunk, kind, at, levels, key, text) in order of chunks, (key, text) with the columns of ``_lines``.

    Equal texts of a batch are held once, so a chunk that many copies of one row have swollen stays small.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple[pa.Array, pa.Array, list]] = []
    last = None

    def flush():
        every = K.distinct(np.concatenate([key for _, _, runs in held for _, sequence, edges in runs for _, key in keys(sequence, edges, order)]))
        levels = np.zeros(len(every), np.uint8)
        for at, own in found:
            levels[at : at + len(own)] = own
        for key, which, runs in held:
            own = pa.Table.from_batches(_lines(iter(runs), order, strength, total, lambda x: levels[np.searchsorted(every, x)].astype(np.int64), tier)).take(which).combine_chunks()
            yield pa.RecordBatch.from_arrays([key, *(x.chunk(0) for x in own.columns)], names=["key", *_COLUMNS])

    for batch in batches:
        chunk, kind = (batch.column(i).to_numpy() for i in range(2))
        for i, j in _stretches(chunk, kind):
            if chunk[i] != last:
                if held:
                    yield from flush()
                found, held, last = [], [], chunk[i]
            own = batch.slice(i, j - i)
            if kind[i] == 0:
                levels, n = _bytes(own.column(3), np.uint8)
                found += zip(own.column(2).to_pylist(), np.split(levels.copy(), np.cumsum(n)[:-1]))
            else:
                texts = pc.fill_null(own.column(5), "").dictionary_encode()
                held.append((own.column(4), texts.indices, list(sequences(texts.dictionary))))
    if held:
        yield from flush()


def _dealt(rows: DataFrame, model: Model, form: str) -> DataFrame:
    """Rows (key, text) with the columns of ``_lines``, by chunks that ask the blocks of a filter that is a table."""
    spark = rows.sparkSession
    order, strength, total, blocks, tier = model.order, model.strength, model.total, model.blocks, model.tier
    run, piece, most = RUN, PIECE, HELD
    chunks = max(1, -(-(rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // CHUNK))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(chunks).cast("bigint")))
    own = rows.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk")
    asked = own.mapInArrow(lambda it: _asked(it, order, blocks, run, piece, most), "part bigint, chunk bigint, at bigint, steps binary, lower binary")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asked = asked.select("part", F.lit(1).alias("kind"), null("bigint", "block"), null("binary", "bits"), "chunk", "at", "steps", "lower")
    bits = model.table.select(F.floor(F.col("block") / run).cast("bigint").alias("part"), F.lit(0).alias("kind"), "block", "bits", null("bigint", "chunk"), null("bigint", "at"), null("binary", "steps"), null("binary", "lower"))
    both = bits.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    levels = stored(both.mapInArrow(lambda it: _answered(it, blocks, run), "chunk bigint, at bigint, levels binary"), "levels", ROWS)
    del own, asked, both
    swept(spark)
    levels = levels.select("chunk", F.lit(0).alias("kind"), "at", "levels", null(rows.schema["key"].dataType, "key"), null("string", "text"))
    texts = rows.select("chunk", F.lit(1).alias("kind"), null("bigint", "at"), null("binary", "levels"), "key", "text")
    both = levels.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(lambda it: _gathered(it, order, strength, total, tier), form)


def scored(documents: DataFrame, trains: Column, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; trains: which rows the model learns from."""
    kind = dict(documents.dtypes)["doc_id"]
    model = Model(documents.where(trains).select("text"), order, strength)
    total, blocks, filter_, tier = model.total, model.blocks, model.filter, model.tier
    rows = documents.select(F.struct("doc_id", (~trains).alias("held_out")).alias("key"), "text")
    form = f"key struct<doc_id: {kind}, held_out: boolean>, n_tokens bigint, score double, value double, known bigint, words array<bigint>, counts array<bigint>"
    rows = _dealt(rows, model, form) if filter_ is None else rows.mapInArrow(lambda it: _scored(it, order, strength, total, blocks, filter_, tier), form)
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "scores", TEXTS)
    release(model.since, 1)
    swept(documents.sparkSession)
    left = rows.select("id", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("id", F.col("x.words").alias("h"), F.col("x.counts").alias("times"))
    rare = model.exact.where(F.col("n") < model.least)
    more = left.join(rare, "h").groupBy("id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("v"), F.sum("times").alias("k"))
    out = rows.join(more, "id", "left")
    base = F.col("value") + F.coalesce("v", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total))
    known = (F.col("known") + F.coalesce("k", F.lit(0))).cast("bigint")
    return out.select("key.doc_id", "key.held_out", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score")
