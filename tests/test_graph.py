import random

import pytest
from pyspark.sql import functions as F

from wirechart.functions import text as X
from wirechart.operators import graph as G
from wirechart.operators import tables as R

EDGE = "from_service string, to_service string"


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), EDGE)


def test_degrees_count_distinct_other_services(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("a", "c"), ("b", "b"))
    services = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "service string")
    assert {tuple(r) for r in G.degrees(e, services).collect()} == {("a", 2, 0), ("b", 0, 1), ("c", 0, 1), ("d", 0, 0)}


def test_degrees_of_no_edges(spark):
    assert G.degrees(spark.createDataFrame([], EDGE)).count() == 0


def test_cycles_start_at_the_least_name(spark):
    e = edges(spark, ("b", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"))
    assert {r.cycle for r in G.cycles(e).collect()} == {"a>b>a", "a>b>c>a"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blast_radius_is_a_reverse_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    pairs = [(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(14)]
    depth, frontier = {"0": 0}, ["0"]
    while frontier:
        new = sorted({a for a, b in pairs if b in frontier and a not in depth})
        depth |= {a: depth[frontier[0]] + 1 for a in new}
        frontier = new
    got = G.blast_radius(edges(spark, *pairs), spark.createDataFrame([("0",)], "service string"))
    assert {(r.service, r.depth) for r in got.collect()} == {x for x in depth.items() if x[1]}


def test_chain_walk_marks_cycles_and_leaves(spark):
    got = {(r.path, r.is_cycle, r.is_leaf) for r in G.chain_walk(edges(spark, ("a", "b"), ("b", "a"), ("b", "c")), 20).where("root = 'a'").collect()}
    assert got == {("a", False, False), ("a>b", False, False), ("a>b>a", True, True), ("a>b>c", False, True)}


def test_registry_keeps_the_first_position_and_the_last_strong_value(spark):
    rows = [("k", "x", 1, True), ("k", "y", 2, False), ("k", "z", 3, True), ("w", "p", 4, True), ("w", "q", 5, True)]
    got = R.fold_registry(spark.createDataFrame(rows, "map_key string, service string, seq int, weak boolean"))
    assert {tuple(r) for r in got.collect()} == {("k", 1, "y"), ("w", 4, "p")}


def test_a_diff_with_itself_is_empty_and_removed_fields_break(spark):
    a = spark.createDataFrame([("p", {"x": "1", "y": "1"}), ("q", {"x": "1"})], "k string, fields map<string,string>")
    b = spark.createDataFrame([("p", {"x": "1", "z": "1"}), ("r", {"x": "1"})], "k string, fields map<string,string>")
    assert R.diff(a, a, ["k"], "fields").where("change <> 'same'").count() == 0
    got = {(r.k, r.change, r.severity, r.removed_fields, r.added_fields) for r in R.diff(a, b, ["k"], "fields").collect()}
    assert got == {("p", "changed", "breaking", "y", "z"), ("q", "removed", "breaking", "", ""), ("r", "added", "non-breaking", "", "")}


def test_look_back_takes_the_nearest_hit_within_reach(spark):
    lines = spark.createDataFrame([("f", i, "if x" if i in (2, 5) else "") for i in range(1, 15)], "file string, line_no int, line string")
    calls = spark.createDataFrame([("f", 6), ("f", 12)], "file string, call_line int")
    got = {(r.call_line, r.hint_line) for r in R.look_back(lines, calls, ["file"], F.when(F.col("line") != "", F.col("line"))).collect()}
    assert got == {(6, 5), (12, None)}


def test_names_and_paths(spark):
    row = spark.range(1).select(
        X.slug(F.lit("@Acme/Order Service!")).alias("slug"),
        X.norm_path(F.lit("/api//users/:id/${x}/")).alias("path"),
        X.url_host(F.lit("http://Order_Service:80/a?b")).alias("host"),
        X.url_path(F.lit("https://x.y")).alias("bare"),
        X.combine_paths(F.lit("/api/"), F.lit("")).alias("both"),
        X.kebab(F.lit("OrderPlaced")).alias("kebab"),
    ).first()
    assert tuple(row) == ("acme-order-service", "/api/users/{x}/{x}", "order_service", "/", "/api", "order-placed")


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_reach_each_other(spark, seed):
    rng = random.Random(seed)
    pairs = {(str(rng.randrange(16)), str(rng.randrange(16))) for _ in range(24)}
    reach = {n: {b for a, b in pairs if a == n and a != b} for n in map(str, range(16))}
    for _ in range(16):
        reach = {a: own | {c for b in own for c in reach[b]} for a, own in reach.items()}
    want = {(a, min(b for b in own if a in reach[b])) for a, own in reach.items() if a in own}
    assert {tuple(r) for r in G.strong_components(edges(spark, *pairs)).collect()} == want


def test_walks_of_a_dense_graph_without_cycles_end_at_once(spark):
    """Every path of this graph is a walk that can't close: 2 ** 38 of them would be followed without components."""
    dense = edges(spark, *[(f"{a:02}", f"{b:02}") for a in range(40) for b in range(a + 1, 40)], ("39", "40"), ("40", "39"))
    assert [r.cycle for r in G.cycles(dense).collect()] == ["39>40>39"]
    assert G.cycles(edges(spark, ("a", "b"))).count() == 0
