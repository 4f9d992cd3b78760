"""Walks, cycles and reach beyond the former bounds of 4, 7 and 30."""

from wirechart.operators import graph as G


def test_walks_cycles_and_reach_are_not_cut(spark):
    ring = spark.createDataFrame([(f"s{i:02}", f"s{(i + 1) % 9:02}") for i in range(9)], "from_service string, to_service string")
    assert [r.cycle for r in G.cycles(ring).collect()] == [">".join(f"s{i % 9:02}" for i in range(10))]
    assert max(r.depth for r in G.chain_walk(ring).collect()) == 9
    line = spark.createDataFrame([(str(i), str(i + 1)) for i in range(35)], "from_service string, to_service string")
    got = G.blast_radius(line, spark.createDataFrame([("35",)], "service string"))
    assert {(r.service, r.depth) for r in got.collect()} == {(str(i), 35 - i) for i in range(35)}
