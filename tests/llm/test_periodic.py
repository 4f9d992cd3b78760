"""Runs of repeating words against definitions that are tried out place by place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm import periodic, queries


def brute(words, shortest=12):
    """Every maximal stretch of each period; those with a smaller period go."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kernel(texts):
    import pyarrow as pa

    for _, buf, starts in K.slabs(pa.array(texts), 1 << 30):
        hashes, first = K.words(buf, starts, periodic._WORDS)
        return periodic.runs_of(hashes, first)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_random_words_over_few_letters(letters):
    rng = random.Random(letters)
    texts = [" ".join(rng.choice("abcde"[:letters]) for _ in range(rng.randint(0, 70))) for _ in range(120)]
    found = kernel(texts)
    assert [found.get(i, []) for i in range(len(texts))] == [brute(t.split()) for t in texts]


def test_planted_periods_nested_and_overlapping_runs():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    texts = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += [word() for _ in range(rng.randint(0, 15))]
            unit = [rng.choice("xy") for _ in range(rng.randint(1, 4))] if i % 3 else [word() for _ in range(rng.randint(1, 9))]
            words += (unit * 9)[: rng.randint(1, 9 * len(unit))]
            if i % 5 == 0:
                words += words[-20:] * 2
        texts.append(" ".join(words))
    found = kernel(texts)
    want = [brute(t.split()) for t in texts]
    assert [found.get(i, []) for i in range(len(texts))] == want and sum(map(len, want)) > 150


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(0, 3, n), 10 + k) for k, n in enumerate((40, 1, 0, 90))])
    order, ranks, common = periodic.suffixes(text)
    own = [tuple(text[i:]) for i in range(len(text))]
    assert [own[i] for i in order] == sorted(own) and (ranks[order] == np.arange(len(text))).all()
    for a, b, n in zip(order, order[1:], common[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert n == k


def test_one_word_many_times_is_quick():
    import time

    began = time.time()
    assert kernel(["a " * 20000, "b"]) == {0: [(0, 20000, 1)]} and time.time() - began < 20


def expected(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
    rest = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, rest)


def test_query_against_brute_force_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like those that are made."""
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "bé", "中", "x" * 40, "A", "\x1cz"])
    rows = []
    for i in range(160):
        unit = [word() for _ in range(rng.randint(1, 5))]
        text = rng.choice([" ", "\n", "\t \r"]).join((unit * 20)[: rng.randint(0, 60)] + [word() for _ in range(rng.randint(0, 30))])
        rows.append((i, text, "en"))
    rows += [(None, "q r " * 9, None), (None, None, None), (500, None, "x"), (501, "", "x"), (502, " \n\t", "x"), (3, rows[3][1], "en"), (3, "q " * 13, "en"), (9, " ".join(["u", "v", "w"] * 700), None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").withColumns({c: F.lit(7) for c in ("h", "w", "a", "p", "runs")})
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_periodic_runs(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in out.collect()), key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert [t for _, t in out.select(*names[:6]).dtypes] == ["bigint"] * 6
