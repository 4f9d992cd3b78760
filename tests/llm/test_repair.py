"""Repairs of conversations against all edit sequences, tried out one by one, and long ones cut into stretches."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from wirechart.llm import queries, repair

_FORM = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit) over every audit: each row kept, reroled or deleted, up to two rows inserted in each gap."""
    best, n = None, len(rows)
    for letters in itertools.product("DKR", repeat=n):
        for inserted in itertools.product(range(3), repeat=n + 1):
            for target in itertools.product("ua", repeat=letters.count("R") + sum(inserted)):
                target, cost, roles, audit = list(target), 0, "", ""
                for i in range(n + 1):
                    roles, audit, cost = roles + "".join(target.pop(0) for _ in range(inserted[i])), audit + "I" * inserted[i], cost + 5 * inserted[i]
                    if i < n:
                        audit += letters[i]
                        initial, fault = rows[i]
                        if letters[i] == "D":
                            cost += 2
                            continue
                        if fault in ("b", "d"):
                            cost = 10**9
                        cost += (letters[i] == "R") + 5 * (fault == "t")
                        roles += initial if letters[i] == "K" else target.pop(0)
                if _FORM.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_chart_against_all_edit_sequences(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3):
        rows = [(rng.choice("sua x"), rng.choice(["", "", "t", "b", "d"])) for _ in range(n)]
        chart = repair.Chart()
        for row in rows:
            chart.scan(*row)
        assert chart.result() == cheapest(rows), rows


def parse(rows):
    chart = repair.Chart()
    for row in rows:
        chart.scan(*row)
    return chart.result()


def expected(said):
    """The contract's rows from plain lists; repairs by a chart of the whole conversation, which the test above checks."""
    convs: dict = {}
    for conv, turn, role, text in said:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in own if r[0] is not None}
        faults, seen = [], set()
        for _, role, text in own:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = parse(list(zip(initials, faults)))
        lines = [f"{role}:{text}" for role, text, _ in repair.repaired("begun", audit, iter([r[1:] for r in own]))]
        assert _FORM.match("".join(x[:1] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(rng, n):
    said = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "", None, "usr", "tool", "sué"])
            text = rng.choice(["Yes. ", "no", "a?\n", "", None, " \t", "é!", "Yes. ", "x.y", "long " * 300 + "."])
            said.append((conv, rng.choice([turn] * 6 + [None, 2, turn + 3]), role, text))
    return said


def write(spark, at, said):
    frame = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    frame.withColumns({c: F.lit("x") for c in ("number", "stretch", "fault", "salt", "audit")}).repartition(4).write.parquet(f"{at}/conversations.parquet")


@pytest.mark.parametrize("bits", [9, 2])
def test_query_with_odd_rows(spark, tmp_path, monkeypatch, bits):
    """Nulls in every column, ties, repeated rows, blank and long texts, clashing columns; also when every conversation is cut into stretches."""
    monkeypatch.setattr(repair, "STRETCH", bits)
    said = conversations(random.Random(7), 150)
    said += said[:40] + [(900, 1, "user", "Hi.")] * 30 + [(901, None, "assistant", "x!")]
    write(spark, tmp_path, said)
    out = queries.op11_repair(spark, str(tmp_path))
    got = {r.conv_id: tuple(r[c] for c in NAMES) for r in out.collect()}
    want = expected(said)
    assert got == want
    assert {y for x in want.values() for y in x[6]} == set("DKR")  # at these costs no insertion is ever cheapest


def test_one_long_conversation_in_stretches_and_its_turns(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH", 5)
    rng = random.Random(3)
    said = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "so", " ", f"{t}!", f"{t}"])) for t in range(3000)] + [(0, 0, "user", "a."), (2, 0, "system", "b.")]
    fixed = repair.Repair(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))
    want = {}
    for conv in (0, 1, 2):
        seen, rows = set(), []
        own = [(r, t) for c, _, r, t in said if c == conv]
        for role, text in own:
            rows.append((role[0], "b" if not text.strip() else "d" if (role, text) in seen else "" if text[-1] in ".!" else "t"))
            seen.add((role, text))
        want[conv] = (*parse(rows), own)
    assert {r.conv_id: (r.cost, r.audit) for r in fixed.summaries().collect()} == {c: x[:2] for c, x in want.items()}
    turns = fixed.turns().orderBy("conv_id", "stretch", "place").collect()
    for conv, (_, audit, own) in want.items():
        assert [(r.role, r.text, r.letter) for r in turns if r.conv_id == conv] == list(repair.repaired("begun", audit, iter(own)))


def after(state, rows):
    """Per symbol the least (cost, audit) from a symbol over all rows, the last letter a row's: every audit with up to two insertions before a row."""
    best: dict = {}
    for letters in itertools.product("DKR", repeat=len(rows)):
        for inserted in itertools.product(range(3), repeat=len(rows)):
            at, cost, audit = state, 0, ""
            for (initial, fault), letter, n in zip(rows, letters, inserted):
                for _ in range(n):
                    at, cost = "answered" if at == "asked" else "asked", cost + 5
                audit += "I" * n + letter
                if letter == "D":
                    cost += 2
                    continue
                word = "a" if at == "asked" else "u"
                if letter == "K" and initial == "s" and at == "begun":
                    at = "opened"
                elif letter == "R" or initial == word:
                    at = "answered" if at == "asked" else "asked"
                else:
                    break
                if fault in ("b", "d"):
                    break
                cost += (letter == "R") + 5 * (fault == "t")
            else:
                best[at] = min(best.get(at, (cost, audit)), (cost, audit))
    return best


@pytest.mark.parametrize("state", repair.STATES)
def test_ends_from_every_symbol_against_all_edit_sequences(state):
    rng = random.Random(state)
    for n in (1, 2, 3, 4) * 8:
        rows = [(rng.choice(["s", "u", "a", "", "*", "é"]), rng.choice(["", "", "t", "b", "d"])) for _ in range(n)]
        chart = repair.Chart(state)
        for row in rows:
            chart.scan(*row)
        assert chart.ends == after(state, rows), rows


def test_what_a_row_completes_is_found_once_for_each_kind_of_row():
    repair._completed.cache_clear()
    rng = random.Random(1)
    for _ in range(20):
        parse([(rng.choice("suax"), rng.choice(["", "t", "b", "d"])) for _ in range(100)])
    assert repair._completed.cache_info().misses == 16


def test_charts_read_no_texts(spark):
    said = [(c, t, "user", f"{t % 3}.") for c in (1, 2, None) for t in range(9)]
    facts = repair.Repair(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))._facts()
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "role#" not in plan
    assert sorted((str(r.conv_id), r.fault) for r in facts.collect()) == sorted((c, f) for c in ("1", "2", "None") for f in [""] * 3 + ["d"] * 6)


def test_faults_of_texts_by_how_they_end(spark):
    ends = ["", " ", "\t", "\n", "\v", "\f", "\r", " \r\n\t", "\x1f", " ", " ", "é", "."]
    texts = [a + b + c for a in ("", "x", "é", "a. b") for b in ("", ".", "!", "?", ",") for c in ends]
    rows = repair.Repair(spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string"))._facts().collect()
    solid = [x.strip(" \t\n\v\f\r") for x in texts]
    assert {r.conv_id: r.fault for r in rows} == {i: "b" if not x else "" if x[-1] in ".!?" else "t" for i, x in enumerate(solid)}
