"""Token counts and ids by a public tokenizer file, looked up on the map side in two tiers.

A text is cut at ASCII white space, which no pre-token of these tokenizers spans, and each piece is looked up: first in
a broadcast table of the most frequent pieces of the whole corpus, then in the worker's own cache; what neither has is
encoded by the library and kept. Counts are those of the library for the whole text, whatever the tables hold. Pieces
themselves are never shuffled: each task sends only its own heaviest ones, pre-aggregated, to choose the table.

Null and empty texts have no tokens; texts of any length are counted whole. Rows with null or repeated ids are counted like
any other; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K

#: Pieces in the broadcast table and their longest; pieces a task keeps while counting, and how many of them it sends.
FREQUENT, LONGEST, COUNTING, SENT = 16_384, 32, 200_000, 4_096
#: Pieces in a worker's cache; a full one is emptied.
CACHED = 400_000
#: Splitting characters of str.split() that the tokenizers take for text.
_ODD = "\x1c\x1d\x1e\x1f"
_BEYOND = re.compile("[^\x00-\u024f]|\u0130")
_SPACE = re.compile("[\x09-\x0d ]+")
#: Letters that keep one code point when lower-cased and that composition leaves alone, then marks that form one pre-token.
_PLAIN = re.compile("([%s]+)([.,!?;:]*)" % "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1))
_loaded: dict = {}


def _plain(text: str) -> bool:
    """Lower-casing the whole text changes no count: no special string, no letter whose lower case depends."""
    if "<|" in text:
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _BEYOND.search(text)


class Library:
    """A tokenizer of a file, loaded once in each worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ends = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_padding()
            own.no_truncation()
            self.encode = lambda texts: [x.ids for x in own.encode_batch_fast(texts, add_special_tokens=False)]
            suffix = json.loads(own.to_str())["model"].get("end_of_word_suffix")
            if suffix:
                self.ends = np.zeros(own.get_vocab_size(), bool)
                self.ends[[i for x, i in own.get_vocab().items() if x.endswith(suffix)]] = True
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)

    def pieces(self, text: str) -> list[str]:
        """What may be encoded apart: runs without white space if the vocabulary marks word ends, else the text."""
        if self.ends is None:
            return [text] if text else []
        if _plain(text):
            text = text.lower()
        if any(x in text for x in _ODD):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold only letters, many in one text: each ends with the one token that has the suffix."""
        ids = np.array(self.encode([" ".join(words)])[0], "<u4")
        raw, at = ids.tobytes(), [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()]
        return [raw[i:j] for i, j in itertools.pairwise(at)]


def tokenizer(path: str) -> Library:
    if path not in _loaded:
        _loaded[path] = Library(path)
    return _loaded[path]


def resolved(name: str) -> str:
    """A tokenizer's path on this machine: ``name`` is a path or a file of the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Cache(dict):
    """piece -> its ids as little-endian bytes, or their number; misses are encoded together.

    Most misses are a word of plain letters and some marks; such words are lower-cased and encoded many at a time.
    """

    def __init__(self, name: str, count: bool):
        super().__init__()
        self.library, self.count = tokenizer(resolved(name)), count

    def _value(self, ids):
        return len(ids) if self.count else np.array(ids, "<u4").tobytes()

    def learn(self, texts: list[list[str]], tier=()) -> None:
        """Make sure that every piece of the texts is in ``tier`` or here."""
        every = set().union(*texts)
        new = [x for x in every if x not in self and x not in tier]
        if self.library.ends is None or len(self) + len(new) > CACHED:
            self.clear()
            new = [x for x in every if x not in tier]
        split, rest, fresh = [], [], set()
        for x in new:
            if self.library.ends is not None and (m := _PLAIN.fullmatch(x)):
                word, marks = m.groups()
                word = word.lower()
                if word not in self:
                    fresh.add(word)
                if word is not x and (marks or word != x):
                    split.append((x, word, marks))
                    if marks and marks not in self:
                        self[marks] = self._value(self.library.encode([marks])[0])
            else:
                rest.append(x)
        fresh = list(fresh)
        for i in range(0, len(fresh), 256):
            part = fresh[i : i + 256]
            found = self.library.words(part)
            self.update(zip(part, [len(x) // 4 for x in found] if self.count else found, strict=True))
        for x, word, marks in split:
            self[x] = self[word] + self[marks] if marks else self[word]
        for i in range(0, len(rest), 1000):
            part = rest[i : i + 1000]
            for x, ids in zip(part, self.library.encode(part)):
                self[x] = self._value(ids)


@K.frugal
def _heavy(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    pieces = tokenizer(resolved(name)).pieces
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(pieces(text))
                if len(counts) > COUNTING:
                    counts = Counter(dict(counts.most_common(COUNTING // 4)))
    top = [x for x in counts.most_common(SENT) if len(x[0]) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.int64())], names=["piece", "n"])


def frequent(documents: DataFrame, name: str, top: int = FREQUENT) -> list[str]:
    """The pieces that make up most of all texts, at most ``top``."""
    heavy = documents.select("text").mapInArrow(lambda it: _heavy(it, name), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in heavy.orderBy(F.desc("n"), "piece").limit(top).toLocalIterator()]


_held: dict = {}


def cached(name: str, count: bool) -> Cache:
    if (count, name) not in _held:
        _held[count, name] = Cache(name, count)
    return _held[count, name]


@K.frugal
def _count(batches: Iterator[pa.RecordBatch], name: str, table) -> Iterator[pa.RecordBatch]:
    tier, cache = table.value, cached(name, True)
    for batch in batches:
        for begin in range(0, len(batch), 256):
            part = batch.slice(begin, 256)
            cut = [cache.library.pieces(x or "") for x in part.column(1).to_pylist()]
            cache.learn(cut, tier)
            both = cache if not tier else _Both(cache, tier)
            get = both.__getitem__
            n = np.fromiter((sum(map(get, x)) for x in cut), np.int64, len(cut))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n)], names=["key", "n_tokens"])
    cache.clear()  # a worker that waits for its next task holds little


class _Both(dict):
    """The first tier as a table of its own; what it doesn't have is asked of the worker's cache."""

    def __new__(cls, cache, tier):
        if (own := _held.get("both")) is None or own.tier is not tier:
            own = dict.__new__(cls)
            dict.__init__(own, tier)
            own.tier = tier
            _held["both"] = own
        own.cache = cache
        return own

    def __init__(self, cache, tier):
        pass

    def __missing__(self, key):
        return self.cache[key]


def count_tokens(documents: DataFrame, name: str, key: str = "doc_id", top: int = FREQUENT, limit: int = 2048) -> DataFrame:
    """Per row of documents(key, text): the key, n_bytes, n_tokens and over_limit (more tokens than ``limit``)."""
    spark = documents.sparkSession
    common = frequent(documents, name, top)
    table = spark.sparkContext.broadcast(dict(zip(common, map(len, tokenizer(resolved(name)).encode(common)))) if common else {})
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.struct(F.col(key), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")).alias("key"), "text")
    out = rows.mapInArrow(lambda it: _count(it, name, table), f"key struct<`{key}`: {kind}, n_bytes: bigint>, n_tokens bigint")
    return out.select(F.col("key").getField(key).alias(key), "key.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
