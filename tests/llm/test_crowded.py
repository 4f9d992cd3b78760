"""Regions of thousands of texts from one template, against the pairs that brute force finds in them."""

import random

import numpy as np
import pytest

from wirechart.llm import crowded, lines, near, prefixes
from wirechart.llm import kernels as K


def templated(pairs, seed=4):
    """Texts of one template: J = 146 / 202 for any two, 156 / 192 for the two of a pair, in numbers of shingles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    base = [word() for _ in range(150)]
    out = []
    for _ in range(pairs):
        both = base + [word() for _ in range(10)]
        out += [both + [word() for _ in range(18)] for _ in range(2)]
    return out


@pytest.mark.parametrize("hot", [near.HOT, 100])
def test_pairs_in_a_crowd_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(near, "HOT", hot)
    rows = [(i, " ".join(w)) for i, w in enumerate(templated(1000))]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 5, 80).collect()}
    assert got == {i: i - i % 2 for i in range(2000)}


@pytest.mark.parametrize("left", [40, 25])
def test_shared_items_are_counted_exactly(left):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 60)).astype(np.uint64) for _ in range(20)] + [np.unique(rng.integers(0, 9000, 60)).astype(np.uint64) for _ in range(20)]
    got = crowded.shared(sets, left)
    for a in range(left):
        for j in range(got.shape[1]):
            b = j if left == 40 else j + left
            assert got[a, j] == (len(np.intersect1d(sets[a], sets[b])) if a < b else 0)


def test_lines_in_a_crowd(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, rows = word(153), []
    for i in range(400):
        both = base + word(10)
        rows += [(2 * i, both + word(18)), (2 * i + 1, both + word(18))]
    got = {r.doc_id: r.kept for r in lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    items, begin, end = lines._shingles([t for _, t in rows], lines.SHINGLE, True)
    marks = K.signatures(items, begin, lines._FACTORS, end).reshape(800, lines.BANDS, lines.ROWS)
    meet = (marks[0::2] == marks[1::2]).all(axis=2).any(axis=1)
    assert meet.sum() >= 399
    assert got == {i: i % 2 == 0 or not meet[i // 2] for i in range(800)}


def test_short_lines_and_marks(spark):
    rows = [(1, "Yes.\n\n---\nno"), (2, "yes.\n---\n\nNO!"), (3, None), (4, "yes.")]
    out = {r.doc_id: (r.text, r.n_removed) for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {1: ("Yes.\n\n---\nno", 0), 2: ("---\n\nNO!", 1), 3: (None, 0), 4: ("", 1)}


def test_three_thousand_lines_with_one_head(spark):
    """Each has one partner at 0.824 and is at 0.781 to all others: recall by the pairs that brute force finds."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, rows = word(107), []
    for i in range(1500):
        both = head + word(3)
        rows += [(2 * i, both + word(11)), (2 * i + 1, both + word(11))]
    sets = [{t[p : p + 8] for p in range(len(t) - 7)} for _, t in rows]
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = [i for i in range(1500) if alike(sets[2 * i], sets[2 * i + 1])]
    gone = {r.doc_id for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).where("n_removed > 0").collect()}
    assert len(want) == 1500 and len(gone & {2 * i + 1 for i in want}) >= 0.99 * len(want)


def test_a_sieve_in_parts_keeps_all_its_keys(spark, monkeypatch):
    from wirechart.llm import shared

    monkeypatch.setattr(shared, "SIEVE_BYTES", 5000)
    keys = spark.range(9000).selectExpr("xxhash64(id) as key")
    want = np.array([r.key for r in keys.collect()], np.int64)
    assert shared.passes(9000) == 3
    parts = [shared.Sieve(keys, "key", p, 3) for p in range(3)]
    assert np.all(sum(s.keeps(want).astype(int) for s in parts) == 1)
    other = np.random.default_rng(0).integers(1, 1 << 62, 100_000)
    assert sum(s.keeps(other).sum() for s in parts) < 5000
    assert len(lines._texts(spark.createDataFrame([(1, "ab cd")], "doc_id bigint, text string"), shared.stored(keys, "keys")).collect()) == 0


@pytest.mark.parametrize("seed,seldom,block", [(1, 8, 512), (2, 1, 4), (3, 0, 7), (4, 3, 2)])
def test_the_pass_finds_the_components_of_brute_force(spark, monkeypatch, seed, seldom, block):
    monkeypatch.setattr(prefixes, "SELDOM", seldom)
    monkeypatch.setattr(prefixes, "BLOCK", block)
    rng = np.random.default_rng(seed)
    base, sets = rng.integers(1, 1 << 62, 60), []
    for i in range(90):
        n = int(rng.integers(1, 60))
        other = sets[int(rng.integers(0, i))] if i and rng.random() < 0.6 else base[:n]
        sets.append(np.unique(np.concatenate([other[int(rng.integers(0, 4)) :], rng.integers(1, 1 << 62, int(rng.integers(0, 9)))])))
    sets = [x if len(x) else base[:1] for x in sets]
    parent = list(range(90))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in range(90):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    table = spark.createDataFrame([(i, bytearray(x.astype(np.int64).tobytes())) for i, x in enumerate(sets)], "id bigint, items binary")
    known = [(i, root(i)) for i in range(90) if root(i) != i and i % 3 == 0]  # a part of the links is known
    roots = spark.createDataFrame(known, "node bigint, root bigint")
    members = spark.range(90).selectExpr("1L as region", "id")
    got = {r.node: r.root for r in prefixes.joined(members, roots, lambda ids: table.join(ids, "id", "left_semi"), 80).collect()}
    find = lambda x: find(got[x]) if got.get(x, x) != x else x
    assert [find(i) for i in range(90)] == [root(i) for i in range(90)]


def test_work_grows_with_the_rows_of_a_crowd(spark):
    """Sets of one template with own items, each with one partner: pairs and blocks stay in proportion to the rows."""
    sizes = {}
    for n in (2000, 8000):
        # 146 items that all have, 10 of a pair, 18 of one's own
        make = lambda *seed, k: np.random.default_rng(seed).integers(1, 1 << 62, k)
        rows = [(i, bytearray(np.concatenate([make(0, k=146), make(1, i // 2, k=10), make(2, i, k=18)]).tobytes())) for i in range(n)]
        sets = spark.createDataFrame(rows, "id bigint, items binary")
        firsts = prefixes.prefixes(spark.range(n).selectExpr("id", "id as label"), sets, 80)
        pairs, blocks = prefixes.dealt(firsts, 80)
        assert pairs.where("a = b - 1 and a % 2 = 0").count() == n // 2
        sizes[n] = pairs.count() + blocks.count()
    assert sizes[8000] <= 4.2 * sizes[2000] and sizes[8000] <= 8000


def test_suffix_arrays_of_any_size_find_what_brute_force_finds():
    import numpy as np
    import pyarrow as pa

    from wirechart.llm import suffixes

    rng = np.random.default_rng(5)
    for span in (7, 14, 20, 100):
        parts = [bytes(rng.integers(97, 99, span).astype(np.uint8)) for _ in range(4)]
        texts = [b"".join(parts[i] for i in rng.integers(0, 4, 3))[int(rng.integers(0, 9)) :] for _ in range(30)]
        seen, later = set(), set()
        for doc, text in enumerate(texts):
            for i in range(len(text) - span + 1):
                if text[i : i + span] in seen:
                    later.add((doc, i))
                seen.add(text[i : i + span])
        got = suffixes.repeats(texts, np.arange(30), np.zeros(30, np.int64), span)
        assert set(zip(*(x.tolist() for x in got))) == later
        # where only some suffixes are asked for, these stand in the order of all
        body = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, 0) for x in texts])
        asked = rng.random(len(body)) < 0.4
        order, _ = suffixes.suffix_array(body, span)
        some, _ = suffixes.suffix_array(body, span, asked)
        items = body.tolist()
        heads = lambda places: [items[i : i + span] for i in places if asked[i]]
        assert heads(order.tolist()) == heads(some.tolist())
    # an array is made of little text, whatever a task holds, and its size changes nothing
    rows = [(h, doc, 0, bytes(rng.integers(97, 99, 168).astype(np.uint8))) for h in range(2000) for doc in (2 * h, 2 * h + 1)]
    rows = [(h, doc, lo, rows[h * 2][3] if h % 3 else text) for h, doc, lo, text in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "doc", "lo", "text"])
    made = [[tuple(r.values()) for out in suffixes._sorted(iter([batch]), limit) for r in out.to_pylist()] for limit in (1, suffixes.ARRAY, 1 << 20)]
    assert {x[0] for x in made[0]} == {2 * h + 1 for h in range(2000) if h % 3} and made[0] == made[1] == made[2]
    assert suffixes.ARRAY <= 1 << 17 and suffixes.SLAB <= 1 << 17


def test_only_values_that_several_lines_have_are_brought_together(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [word(120) for _ in range(2000)]
    texts += [t[:110] + word(10) for t in texts[:200]] + texts[200:1200]  # near copies, and equal lines in other tasks
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = docs.mapInArrow(lambda it: lines._sketch(it, lines.SHINGLE), "doc_id bigint, line int, key bigint, key_b bigint, bands binary").cache()
    lists, want = {r.key: np.frombuffer(r.bands, np.uint64) for r in rows.where("bands is not null").collect()}, {}
    for key, values in lists.items():
        for b, value in enumerate(values.tolist()):
            want.setdefault(value ^ b, set()).add(key)
    want = {(region, key) for region, keys in want.items() if len(keys) > 1 for key in keys}
    got = {(r.region & (1 << 64) - 1, r.id) for r in lines.meeting(rows).collect()}
    assert want and want <= got and len(got) <= len(want) + 0.01 * lines.BANDS * len(lists)


def test_only_two_tables_of_line_dedup_stay(spark):
    from wirechart.llm import shared

    begun = shared.mark()
    rows = [(i, f"the same line in all of them\nand line {i} of its own {i * i}") for i in range(100)]
    out = lines.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert shared.mark() - begun == 2 and out.where("n_removed > 0").count() >= 99
