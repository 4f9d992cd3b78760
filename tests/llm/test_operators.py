"""Every operator against a brute-force version, an exact round trip or held-out labels, on tables with awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wirechart.llm import chat, decontam, lines, near, packing, quality, sharding, suffixes, tokens
from wirechart.llm.components import components

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, long, empty and null ones; an extra column clashes with a result's."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("the", "on", "é", "ing", "Ar", "to", "u", "ß")) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        kind = i % 6
        text = "\n".join(" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(rng.randint(1, 6)))
        if kind == 1 and out:
            text = rng.choice([x for x in out if x])
        elif kind == 2 and out:
            own = rng.choice([x for x in out if x]).split(" ")
            own[rng.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind == 3:
            text = f"{text}\n{passage}\n{text[:40]}"
        elif kind == 4 and i % 12 == 4:
            text = "a" * 300 + " " + "same words again and again here now " * 9
        out.append(text)
    return [*out, "", None, "one", "x y", "long " * 9000, "\U0001f600" * 40 + "\x1c\x00 <|endoftext|> END"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None, "x") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(corpus()))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(links, items):
    up = {x: x for x in items}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in items}


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "", None, "<s>\n[/INST", "é<s></s>"]
    rows = [(i, t, role, x) for i in range(2) for t, (role, x) in enumerate([*(("user", x) for x in said), *(("assistant", x) for x in said), (None, "z")])]
    rows += [(None, 0, "assistant", "null id"), (7, 1, "b", "tie"), (7, 1, "a", "tie")]
    turns = chat.turns_of_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = chat.formatted(turns).select("conv_id", "turns", chat.read_back(F.col("text")).alias("back"), chat.loss_texts(F.col("text"), F.col("loss_mask")).alias("loss")).collect()
    assert len(out) == 4
    for r in out:
        assert r.back == r.turns and r.loss == [t.text for t in r.turns if t.role == "assistant"]
    assert [t.role for t in next(r for r in out if r.conv_id == 7).turns] == ["a", "b"]


def test_chat_layouts(spark):
    records = {
        '{"prompt": "p", "completion": null}': [("user", "p"), ("assistant", "")],
        '{"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": null}], "id": 7}': [("user", "u"), ("assistant", "")],
        '{"messages": []}': [],
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}': [("user", "ab")],
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": "c"}]}': [("user", "a"), ("assistant", "c")],
        '{"conversations": [{"from": "gpt", "value": "v"}]}': [("assistant", "v")],
        '{"instruction": "i", "input": "", "output": "o", "source": "x"}': [("user", "i"), ("assistant", "o")],
        '{"system": "s", "prompt": "p", "response": null}': [("system", "s"), ("user", "p"), ("assistant", "")],
        '{"other": 1}': None,
    }
    rows = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "j string").select("j", F.parse_json("j").alias("record")))
    assert {r.j: None if r.turns is None else [tuple(t) for t in r.turns] for r in rows.collect()} == records
    assert [(r["shape"], r.n) for r in chat.unknown_layouts(rows).collect()] == [("OBJECT<other:_>", 1)]


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffix_dedup(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    seen, want = set(), {}
    for i, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            own = raw[p : p + 100]
            if own in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(own)
        want[i] = (len(raw), sum(gone), bytes(c for c, g in zip(raw, gone) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffixes.without_repeats(docs).collect()}
    assert got == want


@pytest.mark.parametrize("most", [decontam.MOST, 0])
def test_decontamination(spark, docs, texts, nothing, most):
    items = [(1, " ".join(texts[3].split()[2:20])), (2, "x, Y!"), (3, None), (4, "..."), (5, texts[9]), (6, "not in there at all and so it is not a hit")]
    rule = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    cut = lambda t: rule.findall((t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    want = {}
    for i, t in texts.items():
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p : p + n])):
                    found |= own
                    hit |= set(range(p, p + n))
        want[i] = (len(w), len(hit), sorted(found))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.find_hits(docs, table, most=most)
    assert {r.doc_id: (r.n_words, r.n, sorted(r["items"])) for r in got.select("doc_id", "n_words", decontam.n_hit().alias("n"), "items").collect()} == want
    assert sum(1 for x in want.values() if x[1]) > 2
    assert decontam.find_hits(nothing, table, most=most).count() == 0
    assert {(r.n, len(r["items"])) for r in decontam.find_hits(docs, table.where("item_id < 0"), most=most).select(decontam.n_hit().alias("n"), "items").collect()} == {(0, 0)}
    twice = spark.createDataFrame([(None, "x, Y!"), (None, "x, Y!"), (1, None)], "doc_id bigint, text string")
    assert sorted((r.n_words, tuple(r["items"])) for r in decontam.find_hits(twice, table, most=most).collect()) == [(0, ()), (2, (2,)), (2, (2,))]


def test_sharding(spark, docs, texts, nothing):
    rows = sharding.sharded(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in counts.items())
    again = sharding.sharded(spark.createDataFrame([(1, "x")] * 50, "doc_id bigint, text string")).collect()
    assert len({(r.shard, r.slot) for r in again}) == 50
    assert sharding.sharded(nothing).count() == 0


def test_a_new_shard_moves_few_rows(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.sharded(rows, n).collect()} for n in (8, 9))
    assert sum(a[i] != b[i] for i in a) < 0.4 * len(a)


def test_line_dedup(docs, texts):
    rows = [(i, n, x.strip().lower()) for i, t in sorted(texts.items()) for n, x in enumerate((t or "").split("\n")) if any(c.isalnum() for c in x)]
    sets = {x: {x[p : p + 8] for p in range(len(x) - 7)} or {x} for _, _, x in rows}
    alike = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    group, seen, want = roots(alike, sets), set(), {}
    for i, n, x in rows:
        want[i, n] = group[x] not in seen
        seen.add(group[x])
    assert {(r.doc_id, r.line): r.kept for r in lines.fuzzy_lines(docs).collect()} == want
    assert not all(want.values())
    out = {r.doc_id: r for r in lines.drop_lines(docs).collect()}
    assert set(out) == set(texts) and out[len(texts) - 5].text is None
    for i, t in texts.items():
        if t:
            assert out[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((i, n), True))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = roots(alike, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs, k, 80).collect()}
    assert got == {i: (len(sets[i]), group[i], group[i] == i) for i in sets}
    assert len(set(group.values())) < len(texts)
    assert {r.doc_id for r in near.one_of_each(docs, k, 80).collect()} == set(group.values())


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(80)]
    want = roots(links, {x for p in links for x in p})
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {x: r for x, r in want.items() if x != r}


def test_packing(docs, texts):
    whole = tokens.tokenizer(tokens.resolved("word_bpe_49k.json"))
    rows = packing.pack(docs, "word_bpe_49k.json", most_open=16).collect()
    for i, t in texts.items():
        ids = [*whole.encode([t or ""])[0], 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        cut = [ids[p : p + 4096] for p in range(0, len(ids), 4096)]
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(4096 * j, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))) for j, x in enumerate(cut)]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_few_sequences(spark):
    """Within 2 per cent and a sequence a task of the least number that the lengths allow."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 3000)) for i in range(600)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), "word_bpe_49k.json")
    n, total = out.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert n <= 1.02 * -(-total // 4096) + 1


def test_bins_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (8, 7, 6, 2, 4)] == [(0, 0), (1, 0), (2, 0), (1, 7), (2, 6)]


def test_token_counts(docs, texts, nothing):
    whole = tokens.tokenizer(tokens.resolved("word_bpe_49k.json"))
    want = {i: (len((t or "").encode()), len(whole.encode([t or ""])[0])) for i, t in texts.items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, "word_bpe_49k.json").collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, "word_bpe_49k.json", top=0).collect()} == {i: n for i, (_, n) in want.items()}
    assert tokens.count_tokens(nothing, "word_bpe_49k.json").count() == 0


def test_quality_counts_and_verdicts(spark, docs, texts):
    for r in quality.judged(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORDS.findall(t)
        c = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        covered = {q for p in range(len(w) - 7) if c[tuple(w[p : p + 8])] > 1 for q in range(p, p + 8)}
        real = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(real) - len(set(real)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(1)
    good = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 300))), "en", "s") for i in range(300)]
    bad = [(1000 + i, " ".join(f"{rng.random()}###" for _ in range(200)), "en", "s") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad)


@pytest.mark.parametrize("step", [near.near_duplicates, lines.drop_lines, suffixes.without_repeats, quality.judged])
def test_empty_tables(nothing, step):
    assert step(nothing).count() == 0


def test_rows_that_repeat_or_have_no_id(spark):
    long = " ".join(str(i) for i in range(200))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None)], "doc_id bigint, text string")
    assert sorted(str(r.component_id) for r in near.near_duplicates(rows).collect()) == ["1", "1", "None", "None"]
    assert packing.pack(rows, "word_bpe_49k.json").count() == 4
    assert lines.drop_lines(rows).count() == 4
    assert {(r.doc_id, r.n_removed > 0) for r in suffixes.without_repeats(rows).collect()} == {(None, False), (1, True)}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(30)) for _ in range(4)), "en", "s", 1) for i in range(150)]
    rows += [(500, rows[0][1], "en", "s", 1), (501, "junk", "en", "s", 1), (502, rows[5][1][:200] + " zz " + " ".join(str(x) * 3 for x in range(40)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1].split("\n")[1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    left = {r.doc_id for r in docs.collect()}
    assert 7 not in left and 500 not in left and 501 not in left and set(range(150)) - {7} <= left
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
