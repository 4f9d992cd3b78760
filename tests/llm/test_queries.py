"""The registered queries themselves on small tables: their columns against brute force, and odd rows in every column."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirechart.llm import quality, queries, shared


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, benchmark and conversations with ties, repeats, nulls and empty texts."""
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(1, 4)))
        if i % 5 == 1:
            text = f"{text} {passage}"
        if i % 7 == 3:
            text = rows[-1][1]
        rows.append((i, text, "en" if i % 3 else None, f"s{i % 2}", 1))
    rows += [(60, None, "en", "s0", 1), (61, "", None, None, None), (62, "a" * 400, "en", "s1", 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, rows[4][1]), (3, None)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    said = [(i, t, role, rng.choice([None, "", "</s>", "hi [INST] there", "é\n"])) for i in range(9) for t, role in enumerate(("user", "assistant", "user", "assistant")[: i % 5])]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, rows, said


def test_op1(spark, tables):
    at, _, said = tables
    turns: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for i, _, role, text in said:
        turns.setdefault(i, []).append((role, text or ""))
    want = {}
    for i, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        want[i] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op1_chat_format(spark, at).collect()} == want


def test_op2(spark, tables):
    at, rows, _ = tables
    seen, want = set(), {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p + 1 : p + 101] = 1
            seen.add(raw[p : p + 100])
        kept = bytes(c for c, g in zip(raw, gone[1:]) if not g)
        want[i] = (len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, at).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 8


def test_op4_law_rows(spark, tables):
    at, rows, _ = tables
    out = queries.op4_shard(spark, at).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in out} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1 and {r.law for r in out} == {"rows"}


def test_op9_verdicts_against_an_independent_estimate(spark, tables):
    """The same rates, but determinants by exhaustive concentration in numpy from many random starts: verdicts agree away from the cut."""
    rng = np.random.default_rng(5)
    good = rng.normal([1.6, 0.2, 0.1, 0.05, 1.0], [0.03, 0.2, 0.05, 0.03, 0.2], (400, 5))
    bad = rng.normal([2.6, 3.5, 0.1, 0.05, 3.0], [0.1, 0.2, 0.05, 0.03, 0.3], (60, 5))
    x = np.concatenate([good, bad])
    rows = spark.createDataFrame([(i, "0", *map(float, v)) for i, v in enumerate(x)], "id int, g string, " + ", ".join(f"{r} double" for r in quality.RATES)).withColumn("up", F.lit(None).cast("string"))
    got = quality.estimates(rows).first()
    best = None
    floor = np.diag(np.square(quality.SPREAD))
    for _ in range(40):
        own = x[rng.choice(len(x), 20, replace=False)]
        for _ in range(15):
            m, c = own.mean(0), np.cov(own.T, bias=True) + floor
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[np.argsort(d2)[: int(0.75 * len(x))]]
        m, c = own.mean(0), np.cov(own.T, bias=True) + floor
        if best is None or np.linalg.det(c) < best[0]:
            best = (np.linalg.det(c), m, c)
    assert np.allclose(got.m, best[1], atol=0.05)
    assert np.allclose(np.array(got["cov"]).reshape(5, 5), best[2], atol=0.05)
    inv = spark.createDataFrame([(best[2].ravel().tolist(),)], "c array<double>").select(quality.inverted(F.col("c")).alias("i")).first().i
    assert np.allclose(np.array(inv.a).reshape(5, 5), np.linalg.inv(best[2])) and np.isclose(inv.logdet, np.log(np.linalg.det(best[2])))


def test_op9_groups_with_nulls_stay_apart_and_salted_joins_agree(spark, tables, monkeypatch):
    at, rows, _ = tables
    first = {r.doc_id: (r.kept, r.base_failed) for r in queries.op9_quality(spark, at).collect()}
    assert set(first) == {r[0] for r in rows} and first[60] == (False, True)
    monkeypatch.setattr(quality.joined, "__defaults__", (0,))
    assert {r.doc_id: (r.kept, r.base_failed) for r in queries.op9_quality(spark, at).collect()} == first


@pytest.mark.parametrize("name", ["op3_decontaminate", "op5_line_dedup", "op6_near_duplicates", "op7_pack", "op8_secret_scan", "op10_token_counts"])
def test_other_queries_run_on_odd_rows(spark, tables, name):
    at, rows, _ = tables
    out = queries.queries()[name](spark, at)
    if name not in ("op8_secret_scan", "op7_pack"):
        assert sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in rows)
    else:
        out.collect()


@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_empty_tables(spark, tables, tmp_path, name):
    at = tables[0]
    for table in ("documents", "benchmark", "conversations"):
        spark.read.parquet(f"{at}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    want = 1 if name == "op1_chat_format" else 0
    assert queries.queries()[name](spark, str(tmp_path)).count() == want


def test_scratch_tables_are_released(spark, tmp_path):
    import os

    since = shared.mark()
    a = shared.stored(spark.range(3).toDF("id"), "a")
    b = shared.stored(a.where("id > 0"), "b")
    first = a.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(first)
    shared.release(since, keep=1)
    assert b.count() == 2 and not os.path.exists(first)
