"""Analytics over a service graph: edges(from_service, to_service, ...) as DataFrames.

Everything is hash aggregation, equi joins and windows; walks are level-by-level joins, so each level is
one distributed join over edges written once, and no path is built on the driver. Cycles and reach have no bound unless a caller sets one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirechart.storage import written

#: Thresholds of the insights: services called, callers, share and number of calls for tight coupling.
FAN_OUT, FAN_IN, TIGHT_SHARE, TIGHT_CALLS = 3, 4, 0.4, 3


def degrees(edges: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """service, out_degree, in_degree: distinct other services called and calling; with ``services`` all of them."""
    cross = edges.select("from_service", "to_service").where("from_service <> to_service").distinct()
    ends = cross.select(F.explode(F.array(F.struct(F.col("from_service").alias("service"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_service").alias("service"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    out = ends.groupBy("service").agg(F.sum("o").cast("bigint").alias("out_degree"), F.sum("i").cast("bigint").alias("in_degree"))
    if services is None:
        return out
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return services.select("service").distinct().join(out, "service", "left").select("service", zero("out_degree"), zero("in_degree"))


def risk_level(out_degree: Column, in_degree: Column) -> Column:
    return F.when((out_degree >= FAN_OUT) | (in_degree >= FAN_IN), "high").when((out_degree >= 2) | (in_degree >= 2), "medium").otherwise("low")


def risk_scores(edges: DataFrame, services: DataFrame | None = None) -> DataFrame:
    return degrees(edges, services).withColumn("level", risk_level(F.col("out_degree"), F.col("in_degree")))


def pair_counts(calls: DataFrame) -> DataFrame:
    """Calls for each ordered pair of different services."""
    return calls.where("from_service <> to_service").groupBy("from_service", "to_service").agg(F.count("*").alias("calls"))


def top_pairs(calls: DataFrame, k: int = 5) -> DataFrame:
    return pair_counts(calls).orderBy(F.desc("calls"), "from_service", "to_service").limit(k)


def tight_coupling(calls: DataFrame) -> DataFrame:
    """Pairs with at least 0.4 of the caller's cross-service calls and at least 3."""
    counts = pair_counts(calls)
    total = F.sum("calls").over(Window.partitionBy("from_service"))
    return counts.withColumn("total", total).where(f"calls * 10 >= total * {int(TIGHT_SHARE * 10)} and calls >= {TIGHT_CALLS}")


def unresolved(calls: DataFrame, examples: int = 3, salts: int = 64) -> DataFrame:
    """Per service: n unresolved calls (to_service null) and the first raw URLs by call_seq.

    The least examples are taken for each salt of a service first, so no service is sorted in one task.
    """
    rows = calls.where("to_service is null").select("from_service", "call_seq", "raw_url")
    salt = F.pmod(F.xxhash64("call_seq", "raw_url"), F.lit(salts))
    rank = F.row_number().over(Window.partitionBy("from_service", "salt").orderBy("call_seq", "raw_url"))
    part = rows.withColumn("salt", salt).withColumn("r", rank).groupBy("from_service", "salt").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("r") <= examples, F.struct("call_seq", "raw_url"))).alias("first"))
    whole = part.groupBy("from_service").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, examples).alias("first"))
    return whole.select("from_service", "n", F.array_join(F.transform("first", lambda x: x["raw_url"]), ",").alias("examples"))


def isolated(services: DataFrame, edges: DataFrame) -> DataFrame:
    """Services with endpoints that neither call nor are called."""
    touched = edges.where("from_service <> to_service").select(F.explode(F.array("from_service", "to_service")).alias("service")).distinct()
    return services.where("endpoints > 0").join(touched, "service", "left_anti")


def _levels(start: DataFrame, step, depth: int | None) -> DataFrame:
    """The union of start and ``depth`` applications of step, or as many as give rows."""
    found, last = [start], start
    while depth is None or len(found) <= depth:
        last = written(step(last), "level")
        if last.isEmpty():
            break
        found.append(last)
    return reduce(DataFrame.unionByName, found)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that begin at a called service and end at a calling one, again and again until all do: what is left leads from cycles to cycles."""
    left, n = edges, edges.count()
    while n:
        called = left.select(F.col("to_service").alias("from_service")).distinct()
        calling = left.select(F.col("from_service").alias("to_service")).distinct()
        left = written(left.join(called, "from_service", "left_semi").join(calling, "to_service", "left_semi").select("from_service", "to_service"), "trimmed")
        before, n = n, left.count()
        if n == before:
            break
    return left


def strong_components(edges: DataFrame) -> DataFrame:
    """(service, component) of every service on a cycle; a component is all that reach each other, named by its least service.

    Forward and backward colouring: after trimming, each service takes the least name that reaches it; what reaches that
    name within its colour is a component. The rest goes on in the next round, so at least one component leaves in each.
    """
    left = written(edges.where("from_service <> to_service").select("from_service", "to_service").distinct(), "edges")
    found = []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colours = left.select(F.explode(F.array("from_service", "to_service")).alias("service")).distinct().withColumns({"colour": F.col("service"), "moved": F.lit(True)})
        while True:
            given = left.join(colours.where("moved").select(F.col("service").alias("from_service"), "colour"), "from_service").groupBy(F.col("to_service").alias("service")).agg(F.min("colour").alias("new"))
            colours = colours.join(given, "service", "left").select("service", F.least("colour", F.coalesce("new", "colour")).alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("moved"))
            colours = written(colours, "colours")
            if colours.where("moved").isEmpty():
                break
        own = colours.select("service", "colour")
        inner = left.join(own.toDF("from_service", "colour"), "from_service").join(own.toDF("to_service", "end"), "to_service").where("colour = end").select("from_service", "to_service")
        inner = written(inner, "inner")
        members = last = own.where("service = colour")
        while True:
            more = inner.join(last.select(F.col("service").alias("to_service"), "colour"), "to_service").select(F.col("from_service").alias("service"), "colour").distinct()
            last = written(more.join(members, "service", "left_anti"), "members")
            if last.isEmpty():
                break
            members = members.unionByName(last)
        members = written(members.select("service", F.col("colour").alias("component")), "components")
        found.append(members)
        gone = members.select("service")
        left = written(left.join(gone.toDF("from_service"), "from_service", "left_anti").join(gone.toDF("to_service"), "to_service", "left_anti"), "left")
    if not found:
        return left.select(F.col("from_service").alias("service"), F.col("to_service").alias("component")).where(F.lit(False))
    every = reduce(DataFrame.unionByName, found)
    return every.join(every.groupBy("component").count().where("count > 1"), "component", "left_semi").select("service", "component")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """Elementary cycles as 'a>b>..>a' from the least name on; with ``longest``, those of at most so many services.

    Walks begin and stay inside a strong component, so none is followed that can't come back.
    """
    members = strong_components(edges)
    e = edges.where("from_service <> to_service").select("from_service", "to_service").distinct()
    e = e.join(members.toDF("from_service", "component"), "from_service").join(members.toDF("to_service", "other"), "to_service")
    e = written(e.where("component = other").select("from_service", "to_service"), "edges")
    start = e.where("to_service > from_service").select(F.col("from_service").alias("root"), F.col("to_service").alias("at"), F.concat(F.lit(">"), "from_service", F.lit(">"), "to_service", F.lit(">")).alias("path"))

    def step(walk: DataFrame) -> DataFrame:
        nxt = walk.join(e, walk["at"] == e["from_service"]).where("to_service > root").where(F.instr("path", F.concat(F.lit(">"), "to_service", F.lit(">"))) == 0)
        return nxt.select("root", F.col("to_service").alias("at"), F.concat("path", "to_service", F.lit(">")).alias("path"))

    walks = _levels(start, step, None if longest is None else longest - 2)
    closed = walks.join(e, (walks["at"] == e["from_service"]) & (walks["root"] == e["to_service"]), "left_semi")
    return closed.select(F.concat(F.substring("path", F.lit(2), F.length("path") - 2), F.lit(">"), "root").alias("cycle"))


def blast_radius(edges: DataFrame, target: DataFrame) -> DataFrame:
    """Services that reach a target (service) and their least distance; the frontier is anti-joined each level, so cycles end."""
    e = written(edges.where("from_service <> to_service").select("from_service", "to_service").distinct(), "edges")
    seen = target.select("service", F.lit(0).alias("depth"))
    last = seen
    d = 0
    while True:
        d += 1
        nxt = e.join(last.select(F.col("service").alias("to_service")), "to_service").select(F.col("from_service").alias("service")).distinct()
        last = nxt.join(seen.select("service"), "service", "left_anti").withColumn("depth", F.lit(d))
        last = written(last, "frontier")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen.where("depth > 0")


def chain_walk(edges: DataFrame, depth: int = 20) -> DataFrame:
    """Walks from every caller: root, path 'a>b', depth, is_cycle (its end is on the path already; such a node isn't expanded)."""
    e = written(edges.where("from_service <> to_service").select("from_service", "to_service").distinct(), "edges")
    start = e.select(F.col("from_service").alias("root")).distinct().select("root", F.col("root").alias("at"), F.col("root").alias("path"), F.lit(0).alias("depth"), F.lit(False).alias("is_cycle"))

    def step(walk: DataFrame) -> DataFrame:
        nxt = walk.where("not is_cycle").join(e, walk["at"] == e["from_service"])
        again = F.instr(F.concat(F.lit(">"), "path", F.lit(">")), F.concat(F.lit(">"), "to_service", F.lit(">"))) > 0
        return nxt.select("root", F.col("to_service").alias("at"), F.concat("path", F.lit(">"), "to_service").alias("path"), (F.col("depth") + 1).alias("depth"), again.alias("is_cycle"))

    walks = _levels(start, step, depth)
    callers = e.select(F.col("from_service").alias("at")).distinct().withColumn("calls", F.lit(True))
    return walks.join(callers, "at", "left").select("root", "path", "depth", "is_cycle", (F.col("is_cycle") | F.col("calls").isNull()).alias("is_leaf"))


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to): the highest confidence, the first among equals."""
    return edges.groupBy("from_service", "to_service").agg(F.max_by(F.struct("edge_seq", "confidence"), F.struct("confidence", -F.col("edge_seq"))).alias("e")).select("from_service", "to_service", "e.edge_seq", "e.confidence")


def topic_edges(events: DataFrame) -> DataFrame:
    """Publishers joined with subscribers of the same topic: distinct pairs, confidence 0.8; brokers don't matter."""
    side = lambda d, name: events.where(F.col("direction") == d).select("topic", F.col("service").alias(name)).distinct()
    return side("publish", "from_service").join(side("subscribe", "to_service"), "topic").groupBy("from_service", "to_service").agg(F.min("topic").alias("topic")).withColumn("confidence", F.lit(0.8))


def merged_edges(sync: DataFrame, topics: DataFrame, specs: DataFrame) -> DataFrame:
    """Call edges, topic edges, and spec dependencies (0.5) where a pair has no call edge."""
    pair = ["from_service", "to_service"]
    calls = sync.select(*pair).distinct().withColumns({"kind": F.lit("sync"), "confidence": F.lit(1.0)})
    late = specs.select(*pair).distinct().join(calls, pair, "left_anti").withColumns({"kind": F.lit("spec"), "confidence": F.lit(0.5)})
    return calls.unionByName(topics.select(*pair, F.lit("async").alias("kind"), "confidence")).unionByName(late)


def neighbourhood(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """The centre's services and those one edge away in either direction."""
    there = edges.join(centre.select(F.col("service").alias("from_service")), "from_service", "left_semi").select(F.col("to_service").alias("service"))
    back = edges.join(centre.select(F.col("service").alias("to_service")), "to_service", "left_semi").select(F.col("from_service").alias("service"))
    return centre.select("service").unionByName(there).unionByName(back).distinct()


def insights(calls: DataFrame, cycle_rows: DataFrame, missing: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """severity, type, subject, n for cycles, fan-out, fan-in and tight coupling.

    missing(from_service, n), calls that nothing resolved, adds one row for all of them; services(service, endpoints) one for each that
    has endpoints but no edge.
    """
    d = degrees(calls)
    row = lambda df, severity, kind, subject, n: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.col(subject).cast("string").alias("subject"), F.col(n).cast("bigint").alias("n"))
    parts = [
        row(cycle_rows.withColumn("n", F.size(F.split("cycle", ">")) - 1), "error", "circular-dependency", "cycle", "n"),
        row(d.where(F.col("out_degree") >= FAN_OUT), "warning", "high-fan-out", "service", "out_degree"),
        row(d.where(F.col("in_degree") >= FAN_IN), "warning", "high-fan-in", "service", "in_degree"),
    ]
    if missing is not None:
        whole = missing.agg(F.sum("n").alias("n"), F.count("*").alias("of")).where("n > 0").withColumn("of", F.concat("of", F.lit(" services")))
        parts.append(row(whole, "info", "unresolved-calls", "of", "n"))
    parts.append(row(tight_coupling(calls).withColumn("pair", F.concat_ws(">", "from_service", "to_service")), "warning", "tight-coupling", "pair", "calls"))
    if services is not None:
        parts.append(row(isolated(services, calls), "info", "isolated-service", "service", "endpoints"))
    return reduce(DataFrame.unionByName, parts)
