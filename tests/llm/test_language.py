"""Scores of the n-gram model against plain dictionaries of counts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirechart.llm import kernels, language, queries, shared


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def coarse(c):
    """The mean of the counts that share a level."""
    if not c:
        return 0.0
    lev = lambda x: math.floor(math.log(x) / math.log(language.GROWTH) + 1e-9)
    low = high = c
    while low > 1 and lev(low - 1) == lev(c):
        low -= 1
    while lev(high + 1) == lev(c):
        high += 1
    return (low + high) / 2


def expected(rows, order):
    grams = Counter()
    for i, text in rows:
        if not held(i):
            seq = ["<", *words(text), ">"]
            grams.update(tuple(seq[j : j + n]) for n in range(1, order + 1) for j in range(len(seq) - n + 1))
    single = {g: c for g, c in grams.items() if len(g) == 1 and g != ("<",)}
    n, v = sum(single.values()), len(single)
    out = []
    for i, text in rows:
        seq = ["<", *words(text), ">"]
        base = sum(math.log10((single.get((w,), 0) + 1) / (n + v + 1)) for w in seq[1:])
        score, have = 0.0, {}
        for k in range(1, order + 1):
            for j in range(len(seq) - k + 1):
                own = coarse(grams.get(tuple(seq[j : j + k]), 0))
                have[k, j] = own if k == 1 else min(own, have[k - 1, j], have[k - 1, j + 1])
        for j in range(1, len(seq)):
            p = (have[1, j] + 1) / (n + v + 1)
            for k in range(2, min(order, j + 1) + 1):
                p = (have[k, j - k + 1] + language.STRENGTH * p) / (have[k - 1, j - k + 1] + language.STRENGTH)
            score += math.log10(p)
        out.append((i, held(i), len(seq) - 1, sum((w,) in single for w in seq[1:]), n, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    """Texts over a skewed vocabulary with nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(6)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "The", "\x1cx"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    out = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, weight, k=rng.randint(0, 60)))) for i in range(120)]
    return out + [(None, "w1 w2"), (None, None), (200, None), (201, ""), (5, out[5][1]), (5, "w1"), (202, "w1 w2 " * 3000), (203, "new words only")]


@pytest.fixture
def exact(monkeypatch):
    """So many bits that no lookup finds what isn't there."""
    monkeypatch.setattr(language, "BITS", 4000)


def same(got, want):
    order = lambda r: tuple((x is not None, x) for x in r[:5]) + (round(r[5], 6),)
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def write(spark, at, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("key", "h", "n", "id", "score", "words")})
    frame.repartition(5).write.parquet(f"{at}/documents.parquet")


@pytest.mark.parametrize("bound", [1 << 27, 0])
def test_query_against_dictionaries(spark, tmp_path, rows, exact, monkeypatch, bound):
    """Broadcast filter and dealt one; the exact table holds but a few words, so the join is used too."""
    monkeypatch.setattr(language, "BOUND", bound)
    monkeypatch.setattr(language, "TIER", 6)
    write(spark, tmp_path, rows)
    out = queries.op12_lm_score(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    same(out.collect(), expected(rows, 2))


@pytest.mark.parametrize("bound", [1 << 27, 0])
def test_longer_histories(spark, rows, exact, monkeypatch, bound):
    monkeypatch.setattr(language, "BOUND", bound)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    same(language.scored(frame, trains, order=4).collect(), expected(rows, 4))


def test_without_training_rows(spark):
    out = language.scored(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string"), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_lookups_never_understate_and_seldom_overstate():
    rng = np.random.default_rng(1)
    key = rng.integers(0, (1 << 64) - 1, 40_000, dtype=np.uint64)
    count = np.minimum(rng.zipf(1.6, len(key)), 10**9)
    levels = language.level(count)
    blocks = int(-(-levels.sum() * language.BITS // language.BLOCK))
    import pyarrow as pa

    whole = np.zeros((blocks, language.BLOCK // 8), np.uint8)
    for batch in language._bits(iter([pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["h", "n"])]), blocks):
        for block, bits in zip(*(c.to_pylist() for c in batch.columns)):
            whole[block] |= np.frombuffer(bits, np.uint8)
    found = language.looked_up(key, whole.ravel(), blocks)
    assert (found >= levels).all() and (found > levels).mean() < 0.02
    other = rng.integers(0, (1 << 64) - 1, 40_000, dtype=np.uint64)
    assert (language.looked_up(other, whole.ravel(), blocks) > 0).mean() < 0.02


def test_levels_and_their_means():
    counts = np.arange(1, 5000)
    assert np.allclose(language.decoded()[language.level(counts)], [coarse(int(c)) for c in counts])


def test_model_beats_the_base_on_held_out_texts(spark):
    """On texts of a first-order process the model's held-out score is far above that of single words."""
    rng = random.Random(2)
    follow = {i: rng.sample(range(200), 4) for i in range(200)}
    rows = []
    for i in range(400):
        w, own = rng.randrange(200), []
        for _ in range(80):
            own.append(f"t{w}")
            w = rng.choice(follow[w])
        rows.append((i, " ".join(own)))
    trains = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    out = [r for r in language.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), trains).collect() if r.held_out]
    assert len(out) > 30 and sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def test_dealt_n_grams_take_little_disk(spark, monkeypatch, tmp_path):
    """A chunk asks for each n-gram once: before, all n-grams of all texts were stored, over three times the texts."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(60))) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, write = [], shared.stored

    def stored(*args):
        out = write(*args)
        seen.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return out

    monkeypatch.setattr(language, "stored", stored)
    monkeypatch.setattr(shared, "folder", lambda session: f"file://{tmp_path}")
    trains = F.col("doc_id") % 7 != 2
    wide = sorted(tuple(r) for r in language.scored(frame, trains).collect())
    seen.clear()
    monkeypatch.setattr(language, "BOUND", 0)
    assert sorted(tuple(r) for r in language.scored(frame, trains).collect()) == wide
    assert len(seen) > 3 and max(seen) < 2 * sum(len(text) for _, text in rows)


def test_small_chunks_and_copies_of_rows(spark, rows, exact, monkeypatch):
    """Many chunks, runs of blocks and rows of keys; a chunk that equal rows have swollen is compacted on the way."""
    for name, value in (("BOUND", 0), ("CHUNK", 2000), ("RUN", 2), ("PIECE", 16), ("HELD", 500)):
        monkeypatch.setattr(language, name, value)
    rows = rows + [(None, "w1 w2 w3 w1")] * 700
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    same(language.scored(spark.createDataFrame(rows, "doc_id bigint, text string"), trains, order=3).collect(), expected(rows, 3))


def test_packed_keys_come_back():
    key = kernels.distinct(np.random.default_rng(3).integers(0, (1 << 64) - 1, 5000, dtype=np.uint64))
    cuts = np.array([0, 1, 2, 1700, 5000])
    steps, lower = language.packed(key, cuts)
    back, n = language.unpacked(steps.slice(1, 2), lower.slice(1, 2))
    assert n.tolist() == [1, 1698] and (back == key[1:1700]).all()
