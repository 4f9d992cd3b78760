"""Saved output documents as tables, and tables as documents: one nested schema, read with ``inline`` and written with grouped structs.

A document holds scan results of services (``codeScanResults``), chains, dependencies and libraries. Whole documents of one
object are read as they are; scans are written as JSON lines, a line for each service and at most ``ROWS`` of its rows of a
kind, so no row holds a whole table: ``page`` numbers the lines of a service. Reading what was written gives equal tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a kind that one line of a service holds at most (of kinds without an order: about so many).
ROWS = 10_000
_FIELD = "struct<name: string, type: string, required: boolean, description: string>"
_SHAPE = f"struct<typeName: string, fields: array<{_FIELD}>, source: string>"
_CALL = "struct<rawUrl: string, resolvedService: string, resolvedPath: string, method: string, callPattern: string, sourceFile: string, line: int, confidence: double, conditional: boolean, conditionHint: string>"
_ENDPOINT = f"struct<service: string, method: string, path: string, fullPath: string, controllerClass: string, handlerMethod: string, summary: string, requestBody: {_SHAPE}, response: {_SHAPE}, sourceFile: string, line: int, outboundCalls: array<{_CALL}>>"
_HINT = "struct<key: string, value: string, sourceFile: string>"
_MESSAGE = "struct<topic: string, direction: string, pattern: string, payloadType: string, sourceFile: string, line: int>"
_STORE = "struct<name: string, dbType: string, accessPattern: string, sourceFile: string, line: int>"
_LANGUAGE = "struct<language: string, framework: string, detectedFrom: string, confidence: double>"
_RESULT = f"struct<projectPath: string, language: {_LANGUAGE}, serviceName: string, endpoints: array<{_ENDPOINT}>, dtos: array<{_SHAPE}>, serviceUrlHints: array<{_HINT}>, hasOpenApiSpec: boolean, specFile: string, messageEvents: array<{_MESSAGE}>, dbUsage: array<{_STORE}>>"
_EDGE = "struct<`from`: string, `to`: string, fromService: string, toService: string, rawUrl: string, confidence: double, conditional: boolean, conditionHint: string>"
#: A document; what else it holds is left alone.
SCHEMA = f"page int, codeScanResults array<{_RESULT}>, callChains array<struct<rootService: string, rootEndpoint: string, edges: array<{_EDGE}>>>, dependencies array<struct<`from`: string, `to`: string, detectedVia: string, evidence: string>>, sharedLibraries array<struct<importPath: string, name: string, usedByServices: array<string>, sourceFile: string>>"
#: What a column of a table is called inside a document, by kind of row.
NAMES = {
    "endpoints": {"method": "method", "path": "path", "full_path": "fullPath", "controller": "controllerClass", "handler": "handlerMethod", "summary": "summary", "request_body": "requestBody", "response_body": "response", "file": "sourceFile", "line": "line"},
    "calls": {"raw_url": "rawUrl", "resolved_service": "resolvedService", "resolved_path": "resolvedPath", "method": "method", "rule": "callPattern", "file": "sourceFile", "line": "line", "confidence": "confidence", "conditional": "conditional", "condition_hint": "conditionHint"},
    "hints": {"key": "key", "value": "value", "file": "sourceFile"},
    "types": {"type_name": "typeName", "fields": "fields", "source": "source"},
    "messages": {"topic": "topic", "direction": "direction", "pattern": "pattern", "payload_type": "payloadType", "file": "sourceFile", "line": "line"},
    "stores": {"name": "name", "db_type": "dbType", "access": "accessPattern", "file": "sourceFile", "line": "line"},
}
_PLACES = {"endpoints": "endpoints", "hints": "serviceUrlHints", "types": "dtos", "messages": "messageEvents", "stores": "dbUsage"}


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved documents: files of one object each, or with ``lines`` one object a line."""
    return spark.read.schema(SCHEMA).json(path, multiLine=not lines)


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """services, endpoints, calls, hints, types, messages, stores, edges, dependencies and libraries of documents; places in arrays become sequence numbers."""
    page = F.coalesce("page", F.lit(0)).cast("bigint") * ROWS
    results = documents.select(page.alias("begin"), F.inline("codeScanResults")).withColumnRenamed("serviceName", "service")
    out = {"services": results.select("service", F.col("projectPath").alias("project"), "language.language", "language.framework", F.col("language.detectedFrom").alias("detected_from"), "language.confidence", F.col("hasOpenApiSpec").alias("has_spec"), F.col("specFile").alias("spec_file")).distinct()}
    own = lambda kind: [F.col(f"x.{theirs}").alias(ours) for ours, theirs in NAMES[kind].items()]
    for kind, place in _PLACES.items():
        rows = results.select("service", "begin", F.posexplode(place).alias("at", "x")).withColumn("seq", F.col("begin") + F.col("at"))
        if kind == "endpoints":
            calls = rows.select("service", F.col("seq").alias("ep_seq"), F.posexplode("x.outboundCalls").alias("call_seq", "x"))
            out["calls"] = calls.select("service", "ep_seq", "call_seq", *own("calls"))
        seq = {"endpoints": ["ep_seq"], "hints": ["hint_seq"]}.get(kind, [])
        out[kind] = rows.select("service", *[F.col("seq").alias(s) for s in seq], *own(kind))
    chains = documents.select(F.inline("callChains")).select("rootService", "rootEndpoint", F.posexplode("edges").alias("edge_seq", "e"))
    out["edges"] = chains.select(F.col("rootService").alias("root_service"), F.col("rootEndpoint").alias("root_endpoint"), "edge_seq", F.col("e.fromService").alias("from_service"), F.col("e.from").alias("from_endpoint"), F.col("e.toService").alias("to_service"), F.col("e.to").alias("to_endpoint"), F.col("e.rawUrl").alias("raw_url"), "e.confidence")
    out["dependencies"] = documents.select(F.inline("dependencies")).toDF("from_service", "to_service", "detected_via", "evidence")
    out["libraries"] = documents.select(F.inline("sharedLibraries")).toDF("import_path", "name", "used_by", "file")
    return out


def _paged(rows: DataFrame, kind: str) -> DataFrame:
    """rows with page: by their own number where they have one, else dealt by a hash into as many as their service needs."""
    seq = {"endpoints": "ep_seq", "hints": "hint_seq"}.get(kind)
    if seq:
        return rows.withColumn("page", F.floor(F.col(seq) / ROWS).cast("int"))
    counts = rows.groupBy("service").agg(F.ceil(F.count("*") / ROWS).alias("pages"))
    return rows.join(counts, "service").withColumn("page", F.pmod(F.xxhash64(*[F.col(c) for c in NAMES[kind]]), F.col("pages")).cast("int")).drop("pages")


def documents(found: dict[str, DataFrame]) -> DataFrame:
    """Tables as documents, a row for each service and page; chains, dependencies and libraries are documents of one row each."""
    packed = lambda kind: F.struct(*[F.col(ours).alias(theirs) for ours, theirs in NAMES[kind].items()])
    calls = found["calls"].groupBy("service", "ep_seq").agg(F.sort_array(F.collect_list(F.struct("call_seq", packed("calls").alias("x")))).alias("c"))
    calls = calls.select("service", "ep_seq", F.transform("c", lambda c: c["x"]).alias("outboundCalls"))
    parts = []
    for kind in _PLACES:
        rows = _paged(found[kind], kind)
        if kind == "endpoints":
            rows = rows.join(calls, ["service", "ep_seq"], "left").withColumn("x", F.struct("ep_seq", F.struct("service", *[F.col(o).alias(t) for o, t in NAMES[kind].items()], "outboundCalls").alias("x")))
        else:
            order = "hint_seq" if kind == "hints" else F.lit(0).alias("o")
            rows = rows.withColumn("x", F.struct(order, packed(kind).alias("x")))
        one = rows.groupBy("service", "page").agg(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["x"]).alias(kind))
        parts.append(one)
    pages = reduce(DataFrame.unionByName, [found["services"].select("service", F.lit(0).alias("page")), *[p.select("service", "page") for p in parts]]).distinct()
    whole = pages.join(found["services"], "service")
    for p in parts:
        whole = whole.join(p, ["service", "page"], "left")
    language = F.struct("language", "framework", F.col("detected_from").alias("detectedFrom"), "confidence")
    result = F.struct(F.col("project").alias("projectPath"), language.alias("language"), F.col("service").alias("serviceName"), *[F.col(k).alias(t) for k, t in _PLACES.items()], F.col("has_spec").alias("hasOpenApiSpec"), F.col("spec_file").alias("specFile"))
    out = [whole.select("page", F.array(result).alias("codeScanResults"))]
    edge = F.struct(F.col("from_endpoint").alias("from"), F.col("to_endpoint").alias("to"), F.col("from_service").alias("fromService"), F.col("to_service").alias("toService"), F.col("raw_url").alias("rawUrl"), "confidence")
    chains = found["edges"].groupBy("root_service", "root_endpoint").agg(F.sort_array(F.collect_list(F.struct("edge_seq", edge.alias("e")))).alias("es"))
    out.append(chains.select(F.array(F.struct(F.col("root_service").alias("rootService"), F.col("root_endpoint").alias("rootEndpoint"), F.transform("es", lambda x: x["e"]).alias("edges"))).alias("callChains")))
    out.append(found["dependencies"].select(F.array(F.struct(F.col("from_service").alias("from"), F.col("to_service").alias("to"), F.col("detected_via").alias("detectedVia"), "evidence")).alias("dependencies")))
    out.append(found["libraries"].select(F.array(F.struct(F.col("import_path").alias("importPath"), "name", F.col("used_by").alias("usedByServices"), F.col("file").alias("sourceFile"))).alias("sharedLibraries")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def of_scan(scanned: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a scan under the names and columns of saved documents."""
    nothing = F.lit(None).cast("string")
    ends = scanned["numbered_endpoints"]
    services = scanned["services"].select("service", nothing.alias("project"), "language", "framework", "detected_from", F.col("confidence").cast("double").alias("confidence"), F.lit(False).alias("has_spec"), nothing.alias("spec_file"))
    file = F.col("path").alias("file")
    within = Window.partitionBy("service", "ep_seq").orderBy("path", "call_seq", "raw_url")  # a document's calls are counted within their endpoint
    return {
        "services": services,
        "endpoints": ends.select("service", "ep_seq", "method", "path", "full_path", "controller", "handler", "summary", "request_body", "response_body", "file", "line"),
        "calls": scanned["resolved"].withColumn("call_seq", F.row_number().over(within) - 1).select("service", "ep_seq", "call_seq", "raw_url", "resolved_service", "resolved_path", "method", "rule", file, "line", "confidence", "conditional", "condition_hint"),
        "hints": scanned["numbered_hints"].select("service", "hint_seq", "key", "value", file),
        "types": scanned["types"].select("service", "type_name", "fields", "source"),
        "messages": scanned["messages"].select("service", "topic", "direction", "pattern", "payload_type", file, "line"),
        "stores": scanned["stores"].select("service", "name", "db_type", F.col("access_pattern").alias("access"), file, "line"),
        "edges": scanned["edges"].select("root_service", "root_endpoint", (F.col("edge_seq") - 1).alias("edge_seq"), "from_service", "from_endpoint", "to_service", "to_endpoint", "raw_url", "confidence"),
        "dependencies": scanned["dependencies"],
        "libraries": scanned["libraries"].select("import_path", nothing.alias("name"), "used_by", F.col("first_file").alias("file")),
    }


def save_documents(found: dict[str, DataFrame], path: str) -> None:
    """Tables, as ``tables`` or ``of_scan`` give them, as JSON lines below path."""
    documents(found).write.json(path)
