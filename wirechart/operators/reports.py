"""What is read off a resolved graph: diffs of saved documents, listings, subgraphs and the documents that are saved.

Texts are rows of lines with an order, so that reports of any size stay distributed; ``save`` writes each data set of a document
as JSON lines, and ``document`` gives one JSON value for results that are known to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.operators.code import first_of
from wirechart.operators.tables import one_row_a_side

#: Bands of confidence: lower bounds of high and medium.
HIGH, MEDIUM = 0.9, 0.7
_KEY = ["service", "method", "path"]


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def diff_documents(before: DataFrame, after: DataFrame) -> DataFrame:
    """Endpoint changes between two documents' endpoints(service, method, path, seq, body_type, body_fields, response_type, response_fields).

    change: removed, added, changed or same; severity: breaking, non-breaking or none. Of a key that repeats the last
    row counts. Fields are compared where both sides have them: the request's both ways, of the response only those
    that went. A removed field or another type breaks.
    """
    both = before.withColumn("_after", F.lit(False)).unionByName(after.withColumn("_after", F.lit(True)))
    columns = {c: F.col(c) for c in ("body_type", "body_fields", "response_type", "response_fields")}
    rows = one_row_a_side(both, _KEY, columns, F.col("_after"))
    gone = lambda f, a, b: F.coalesce(F.array_except(F.map_keys(f"{a}.{f}"), F.map_keys(f"{b}.{f}")), F.array().cast("array<string>"))
    rows = rows.withColumns({"removed_fields": F.concat(gone("body_fields", "before", "after"), gone("response_fields", "before", "after")), "added_fields": gone("body_fields", "after", "before")})
    other = lambda f: F.coalesce(F.col(f"before.{f}"), F.lit("undefined")) != F.coalesce(F.col(f"after.{f}"), F.lit("undefined"))
    retyped = other("body_type") | other("response_type")
    change = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when((F.size("removed_fields") > 0) | (F.size("added_fields") > 0) | retyped, "changed").otherwise("same")
    severity = F.when(F.col("change") == "same", "none").when((F.col("change") == "removed") | (F.size("removed_fields") > 0) | ((F.col("change") == "changed") & retyped), "breaking").otherwise("non-breaking")
    side = lambda s, f: F.col(f"{s}.{f}").alias(f"{f}_{s}")
    return rows.withColumn("change", change).select(*_KEY, "change", severity.alias("severity"), side("before", "body_type"), side("after", "body_type"), side("before", "response_type"), side("after", "response_type"), F.array_join("removed_fields", ",").alias("removed_fields"), F.array_join("added_fields", ",").alias("added_fields"))


def diff_report(changes: DataFrame) -> DataFrame:
    """(n, text): breaking changes first, then the others, each with its fields."""
    rows = changes.where("change <> 'same'")
    fields = F.concat(F.when(F.col("removed_fields") != "", F.concat(F.lit(" -"), "removed_fields")).otherwise(""), F.when(F.col("added_fields") != "", F.concat(F.lit(" +"), "added_fields")).otherwise(""))
    return rows.select(F.when(F.col("severity") == "breaking", 0).otherwise(1).alias("n"), F.concat(F.upper("severity"), F.lit(" "), "change", F.lit(" "), "service", F.lit(":"), "method", F.lit(" "), "path", fields).alias("text")).orderBy("n", "text")


def exit_code(changes: DataFrame) -> int:
    """1 where a change breaks, else 0."""
    return int(changes.where("severity = 'breaking'").limit(1).count())


def insight_lines(insights: DataFrame) -> DataFrame:
    """(n, text) of insights(severity, type, subject, n): errors, warnings, notes."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return insights.select(rank.alias("n"), F.concat(F.upper("severity"), F.lit(" "), "type", F.lit(": "), "subject", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text")).orderBy("n", "text")


def trace(chains: DataFrame, wanted: str) -> DataFrame:
    """(node_path, text): the call tree of the first endpoint whose label holds a text, whatever its case, indented by depth."""
    first = chains.where((F.col("depth") == 0) & F.contains(F.lower("endpoint"), F.lit(wanted.lower()))).select("root_service", "root_endpoint").orderBy("root_service", "root_endpoint").limit(1)
    mark = F.when(F.col("is_cycle"), " (cycle)").when(F.col("is_unresolved"), " (unresolved)").otherwise("")
    own = chains.join(F.broadcast(first), ["root_service", "root_endpoint"], "left_semi")
    return own.select("node_path", F.concat(F.repeat(F.lit("  "), F.col("depth")), "service", F.lit(" "), "endpoint", mark).alias("text")).orderBy("node_path")


def explain(endpoints: DataFrame, resolved: DataFrame, wanted: str) -> DataFrame:
    """(part, seq, text) about the first endpoint whose label holds a text: itself, its body and response, and each call that it makes."""
    label = F.concat_ws(" ", "method", "full_path")
    first = endpoints.where(F.contains(F.lower(label), F.lit(wanted.lower()))).orderBy("svc_seq", "ep_seq").limit(1)
    said = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))
    own = first.select(F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("seq"), F.concat("service", F.lit(" "), label).alias("text")), F.when(F.col("request").isNotNull(), F.struct(F.lit(1).alias("part"), F.lit(0).alias("seq"), said("body", F.col("request")).alias("text"))), F.when(F.col("response").isNotNull(), F.struct(F.lit(1).alias("part"), F.lit(1).alias("seq"), said("response", F.col("response")).alias("text")))))).alias("x")).select("x.*")
    calls = resolved.join(F.broadcast(first.select("svc_seq", "ep_seq")), ["svc_seq", "ep_seq"], "left_semi")
    made = calls.select(F.lit(2).alias("part"), F.col("call_seq").alias("seq"), F.concat("method", F.lit(" "), "raw_url", F.lit(" → "), F.coalesce("resolved_service", F.lit("unresolved"))).alias("text"))
    return own.unionByName(made).orderBy("part", "seq")


def controller_of(path: Column) -> Column:
    """The controller's name from its file: without folder, ending and what only says its kind."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.\w+$", ""), r"(?i)[._-]?(?:controller|router|routes|handler|handlers|views|resource)$", "")


def controllers(endpoints: DataFrame) -> DataFrame:
    """(service, controller, endpoints, n): endpoints of each controller's file in order."""
    own = endpoints.withColumn("controller", controller_of(F.col("path")))
    return own.groupBy("service", "controller").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "method", "full_path"))), ",").alias("endpoints"), F.count("*").alias("n"))


def controller_edges(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoint edges(from_service, from_endpoint, to_service, to_endpoint) as distinct edges of controllers."""
    own = endpoints.select("service", F.concat_ws(" ", "method", "full_path").alias("endpoint"), controller_of(F.col("path")).alias("controller")).distinct()
    side = lambda s: own.select(F.col("service").alias(f"{s}_service"), F.col("endpoint").alias(f"{s}_endpoint"), F.col("controller").alias(f"{s}_controller"))
    both = edges.join(side("from"), ["from_service", "from_endpoint"]).join(side("to"), ["to_service", "to_endpoint"])
    return both.select("from_service", "from_controller", "to_service", "to_controller").distinct()


def shown_edges(edges: DataFrame, least: float, services: DataFrame | None = None) -> DataFrame:
    """Edges of at least a confidence with an end among the services, where services(service) are given."""
    out = edges.where(F.col("confidence") >= least)
    if services is None:
        return out
    ends = out.withColumn("service", F.explode(F.array_distinct(F.array("from_service", "to_service"))))
    return ends.join(services.select("service").distinct(), "service", "left_semi").drop("service").distinct()


def chain_subgraph(edges: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose pair of services occurs in a chain's edges, the services that they touch)."""
    pairs = chain.select("from_service", "to_service").distinct()
    own = edges.join(pairs, ["from_service", "to_service"], "left_semi")
    return own, own.select(F.explode(F.array("from_service", "to_service")).alias("service")).distinct()


def graph_nodes(scanned: DataFrame, specs: DataFrame) -> DataFrame:
    """(service, language, framework, endpoints, origin): scanned services, and those of specifications where none was scanned."""
    code = scanned.select("service", "language", "framework", "endpoints", F.lit("source").alias("origin"))
    late = specs.join(code.select("service"), "service", "left_anti").select("service", F.lit("unknown").alias("language"), F.lit("unknown").alias("framework"), "endpoints", F.lit("specification").alias("origin"))
    return code.unionByName(late)


def chain_context(edges: DataFrame) -> DataFrame:
    """(root_service, root_endpoint, hops, percent, text): a chain's edges as lines and their average confidence in per cent."""
    line = F.concat("from_service", F.lit(" → "), "to_service", F.lit(" "), "to_endpoint")
    return edges.groupBy("root_service", "root_endpoint").agg(F.count("*").alias("hops"), F.round(F.avg("confidence") * 100).cast("int").alias("percent"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("edge_seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def search(endpoints: DataFrame, wanted: str) -> DataFrame:
    """Endpoints that hold a text in service, path, method, summary or controller, whatever its case; all of a service whose name holds it."""
    text = F.lit(wanted.lower())
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), text), F.lit(False)) for c in ("service", "full_path", "method", "summary", "controller")])
    return endpoints.where(hit)


def markdown(services: DataFrame, endpoints: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(part, service, seq, text): lines of a report with a table of endpoints for each service and a list of dependencies."""
    head = services.select(F.lit(0).alias("part"), "service", F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("## "), "service", F.lit("\n\n| Method | Path | Request | Response |\n| --- | --- | --- | --- |")).alias("text"))
    cell = lambda c: F.coalesce(F.replace(F.col(c), F.lit("|"), F.lit("\\|")), F.lit(""))
    rows = endpoints.select(F.lit(0).alias("part"), "service", (F.col("ep_seq") + 1).cast("bigint").alias("seq"), F.concat(F.lit("| "), "method", F.lit(" | "), cell("full_path"), F.lit(" | "), cell("request"), F.lit(" | "), cell("response"), F.lit(" |")).alias("text"))
    tail = dependencies.select(F.lit(1).alias("part"), F.col("from_service").alias("service"), F.xxhash64("to_service").alias("seq"), F.concat(F.lit("- "), "from_service", F.lit(" → "), "to_service", F.lit(" ("), "detected_via", F.lit(")")).alias("text"))
    return head.unionByName(rows).unionByName(tail).orderBy("part", "service", "seq")


def summary(services: DataFrame, endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: services, endpoints, calls, resolved calls, distinct cross-service edges."""
    n = services.agg(F.count("*").alias("services"))
    e = endpoints.agg(F.count("*").alias("endpoints"))
    cross = (F.col("resolved_service").isNotNull()) & (F.col("resolved_service") != F.col("service"))
    c = calls.agg(F.count("*").alias("calls"), F.count("resolved_service").alias("resolved"), F.count_distinct(F.when(cross, F.struct("service", "resolved_service"))).alias("edges"))
    return n.join(e).join(c)


def call_sites(calls: DataFrame, target: str, most: int = 10) -> DataFrame:
    """The first places that call the first service whose name equals or holds a text: service, path, line, raw_url."""
    name = F.lower("resolved_service")
    fits = calls.where(F.contains(name, F.lit(target.lower())))
    best = fits.select("resolved_service").orderBy(name != target.lower(), "resolved_service").limit(1)
    return fits.join(F.broadcast(best), "resolved_service", "left_semi").orderBy("service", "path", "line").limit(most).select("service", "path", "line", "raw_url", "resolved_service")


#: Version of the saved documents' layout.
VERSION = "1.0"


def document(**tables: DataFrame) -> DataFrame:
    """One row (document): all tables of a small result as one JSON value with its version; rows are in the order of their text."""
    parts = [df.agg(F.array_sort(F.collect_list(F.to_json(F.struct("*")))).alias("rows")).select(F.concat(F.lit(f'"{name}":['), F.array_join("rows", ","), F.lit("]")).alias(name)) for name, df in tables.items()]
    whole = reduce(lambda a, b: a.join(b), parts)
    return whole.select(F.concat(F.lit(f'{{"meta":{{"schemaVersion":"{VERSION}"}},'), F.concat_ws(",", *tables), F.lit("}")).alias("document"))


def save(path: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its own below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def export(path: str, kind: str, services: DataFrame, endpoints: DataFrame, dependencies: DataFrame, **others: DataFrame) -> None:
    """json, markdown or all: the saved document, the report's lines in order, or both."""
    if kind not in ("json", "markdown", "all"):
        raise ValueError(f"unknown kind of export: {kind}")
    if kind != "markdown":
        save(f"{path}/json", services=services, endpoints=endpoints, dependencies=dependencies, **others)
    if kind != "json":
        markdown(services, endpoints, dependencies).select("text").write.mode("overwrite").text(f"{path}/markdown")
