"""Queries over source files, registries and chains, with DuckDB SQL for the facts that were written into the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirechart.operators import calls as C
from wirechart.operators import detect as D
from wirechart.operators import endpoints as E
from wirechart.operators import facts as T
from wirechart.operators import graph as G
from wirechart.operators import interfaces as I
from wirechart.operators import payloads as B
from wirechart.operators import reports as P
from wirechart.operators import resolve as S
from wirechart.operators import usage as U
from wirechart.plans import trees
from wirechart.plans.catalog import query
from wirechart.plans.trees import CALLS, HANDLER, HANDLERS, LINES, RESOLVED
from wirechart.sources import saved
from wirechart.sources.files import service_roots
from wirechart.storage import written


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, CAST({LINES} AS INTEGER) AS line, 'GET' AS method, '/nation-' || n || '/supplier/' || s AS full_path, {HANDLER} AS handler,
  'Supplier' || s || 'Dto' AS request, 'Reply' || s AS response FROM h""")
def source_endpoints(spark, d):
    rows = trees.every(trees.controllers, spark, d, E.endpoints)
    return E.richest(rows).select("service", "line", "method", "full_path", "handler", "request", "response")


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, CAST({CALLS} AS INTEGER) AS line, CAST(i + 1 AS INTEGER) AS call_seq, 'POST' AS method, 'http://nation-' || t || '/supplier/' || s AS raw_url, CAST(0.9 AS DOUBLE) AS confidence FROM h")
def source_calls(spark, d):
    return trees.every(trees.controllers, spark, d, C.outbound_calls).select("service", "line", "call_seq", "method", "raw_url", "confidence")


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, CAST({CALLS} AS INTEGER) AS line, CAST({LINES} AS INTEGER) AS head FROM h")
def calls_by_handler(spark, d):
    def placed(files, language):
        return C.by_handler(C.outbound_calls(files, language), E.endpoints(files, language), files, language)

    return trees.every(trees.controllers, spark, d, placed).select("service", "line", "head")


_BASE = "'http://nation-' || t"


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, CAST(CASE n % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 2 END + i AS INTEGER) AS line, 'GET' AS method, {_BASE} || '/supplier/' || s AS raw_url, CAST(0.9 AS DOUBLE) AS confidence FROM h
  UNION ALL SELECT DISTINCT 'nation-' || n, 1, 'GET', {_BASE}, 0.9 FROM h WHERE n % 5 IN (3, 4)""")
def client_base_urls(spark, d):
    """The only host of these sources stands where a client is made; in Python and Go that place counts as a call too."""
    return trees.every(trees.clients, spark, d, C.outbound_calls).select("service", "line", "method", "raw_url", "confidence")


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, 'src/used' AS path, CAST(i + 1 AS INTEGER) AS line, 'grpc-method://Nation' || n || '/Get' || s AS raw_url FROM h
  UNION ALL SELECT DISTINCT 'nation-' || n, 'src/made', 1, 'grpc-service://Nation' || n FROM h""")
def grpc_stub_calls(spark, d):
    return trees.every(trees.stubs, spark, d, C.grpc_calls).select("service", "path", "line", "raw_url")


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, CASE WHEN n % 5 < 3 THEN 'src/sent.ts' ELSE 'app/sent.py' END AS path, CAST(i + 1 AS INTEGER) AS line, CASE WHEN s % 2 = 1 THEN 'GRAPHQL_MUTATION' ELSE 'GRAPHQL_QUERY' END AS method, 'graphql-operation://Find' || s AS raw_url FROM h""")
def graphql_operation_calls(spark, d):
    return C.graphql_calls(trees.graphql_clients(spark, d)).select("service", "path", "line", "method", "raw_url")


_SIMPLE = "CASE n % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'decimal' WHEN 3 THEN 'integer[]' ELSE 'datetime' END"


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, 'Nation' || n || 'Dto' AS type_name, count(*) AS n_fields, {_SIMPLE} AS type, n % 5 IN (1, 2, 3) AS required,
  string_agg('supplier' || s, ',' ORDER BY s) AS names FROM h GROUP BY n""")
def payload_types(spark, d):
    rows = trees.every(trees.dtos, spark, d, T.payload_types)
    return rows.select("service", "type_name", F.size("fields").cast("bigint").alias("n_fields"), F.element_at("fields.type", 1).alias("type"), F.element_at("fields.required", 1).alias("required"), F.array_join("fields.name", ",").alias("names"))


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, 'NationSerializer' AS type_name, coalesce(string_agg('supplier' || s || ':decimal', ',' ORDER BY s) FILTER (WHERE n % 3 = 0 OR s % 2 = 0), '') AS fields FROM h GROUP BY n""")
def serializer_fields(spark, d):
    """Serializers that list their fields in Meta take types from the model's class in another file."""
    rows = T.payload_types(written(trees.serializers(spark, d), "sources"), "python").where("source = 'serializer'")
    return rows.select("service", "type_name", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"])), ",").alias("fields"))


_NUMBER = "CASE n % 5 WHEN 0 THEN 'number' ELSE 'integer' END"
_AFTER = f"{HANDLERS}, x AS (SELECT a.n, a.s, b.s AS after FROM h a JOIN h b ON a.n = b.n AND b.i = (a.i + 1) % a.k)"


@query(f"""WITH {_AFTER} SELECT 'nation-' || n AS service, '/nation-' || n || '/supplier/' || s AS full_path, 'Supplier' || s || 'Dto' AS body_type, CASE WHEN s % 2 = 0 THEN 'size:' || {_NUMBER} || ',next:Supplier' || after || 'Dto!' ELSE '' END AS body_fields,
  'Reply' || s AS response_type, 0 AS response_fields FROM x""")
def endpoint_payloads(spark, d):
    """Shapes of request and response types: declared ones with their fields, all others as placeholders."""
    ends = E.richest(trees.every(trees.controllers, spark, d, E.endpoints))
    rows = B.with_payloads(ends, trees.every(trees.payloads, spark, d, T.payload_types))
    said = F.transform("request_body.fields", lambda f: F.concat(f["name"], F.lit(":"), f["type"], F.when(f["required"], "!").otherwise("")))
    return rows.select("service", "full_path", F.col("request_body.type_name").alias("body_type"), F.array_join(said, ",").alias("body_fields"), F.col("response_body.type_name").alias("response_type"), F.size("response_body.fields").alias("response_fields"))


@query(f"""WITH RECURSIVE {_AFTER}, w AS (
  SELECT n, s AS root, s, 1 AS depth, '' AS up, [s] AS seen FROM x WHERE s % 2 = 0
  UNION ALL SELECT w.n, w.root, x.after, depth + 1, up || 'next.', list_append(seen, x.after) FROM w JOIN x ON x.s = w.s WHERE x.after % 2 = 0 AND NOT list_contains(seen, x.after) AND depth < {B.LEVELS}
) SELECT 'nation-' || w.n AS service, 'Supplier' || root || 'Dto' AS root, up || f AS place, depth, CASE f WHEN 'size' THEN CASE w.n % 5 WHEN 0 THEN 'number' ELSE 'integer' END ELSE 'Supplier' || after || 'Dto' END AS type, f = 'next' AND list_contains(seen, after) AS is_cycle
  FROM w JOIN x ON x.s = w.s, (VALUES ('size'), ('next')) AS v(f)""")
def nested_payloads(spark, d):
    return B.nested(trees.every(trees.payloads, spark, d, T.payload_types)).select("service", "root", "place", "depth", "type", "is_cycle")


@query(f"""WITH {HANDLERS} SELECT 'nation-' || n AS service, 'SUPPLIER_' || s || CASE WHEN n % 5 = 2 THEN '_Url' ELSE '_URL' END AS key, 'http://nation-' || t AS value, CAST(i + 1 AS INTEGER) AS line FROM h""")
def url_hints(spark, d):
    return trees.every(trees.hints, spark, d, T.url_hints).select("service", "key", "value", "line")


_USES = f"WITH {HANDLERS}, u AS (SELECT 'nation-' || n AS service, s % 3 AS j, n, CAST(3 * min(i) AS INTEGER) AS ln FROM h GROUP BY n, s % 3)"


@query(f"{_USES} SELECT service, 'topic-' || j AS topic, 'publish' AS direction, 'kafka' AS pattern, ln + 1 AS line FROM u UNION ALL SELECT service, 'reply-' || j, 'subscribe', 'kafka', ln + 1 FROM u")
def source_messages(spark, d):
    return trees.every(trees.usages, spark, d, U.messages).select("service", "topic", "direction", "pattern", "line")


@query(f"{_USES}, e AS (SELECT *, 'topic-' || j AS topic FROM u) SELECT a.service AS from_service, b.service AS to_service, min('reply-' || a.j) AS topic, CAST(0.8 AS DOUBLE) AS confidence FROM u a JOIN u b ON a.j = b.j GROUP BY 1, 2")
def source_topic_edges(spark, d):
    found = trees.every(trees.usages, spark, d, U.messages)
    # a reply is published where its topic is: both sides of a conversation use one name
    return G.topic_edges(found.withColumn("topic", F.replace("topic", F.lit("topic-"), F.lit("reply-"))))


@query(f"{_USES} SELECT service, 'table_' || j AS name, 'sql' AS db_type, ln + 2 AS line FROM u")
def source_stores(spark, d):
    return trees.every(trees.usages, spark, d, U.stores).select("service", "name", "db_type", "line")


@query(f"WITH {trees.said(trees.MESSAGES, ['topic', 'direction', 'pattern', 'payload_type'])} SELECT service, line, topic, direction, pattern, payload_type FROM r WHERE topic <> 'b' UNION ALL SELECT service, min(line), 'b', 'subscribe', 'kafka', NULL FROM r JOIN nation ON service = 'nation-' || n_nationkey WHERE n_nationkey % 5 = 1 AND s % 6 = 0 GROUP BY service")
def messages_by_rule(spark, d):
    """Each supplier's line is for one rule; a listener of two topics names a second one that all of its service share."""
    found = trees.every(lambda spark, d, x: trees.by_rule(trees.MESSAGES, spark, d, x), spark, d, U.messages)
    return found.select("service", "line", "topic", "direction", "pattern", "payload_type")


@query(f"WITH {trees.said(trees.STORES, ['name', 'db_type', 'access_pattern'])} SELECT service, line, name, db_type, access_pattern FROM r")
def stores_by_rule(spark, d):
    found = trees.every(lambda spark, d, x: trees.by_rule(trees.STORES, spark, d, x), spark, d, U.stores)
    return found.select("service", "line", "name", "db_type", "access_pattern")


@query(f"""{_USES}, i AS (SELECT service, CASE n % 5 WHEN 0 THEN '@own/lib-' || j WHEN 1 THEN 'org.own.lib' || j || '.Thing' WHEN 2 THEN 'Own.Lib' || j WHEN 3 THEN 'own.lib' || j ELSE 'example.org/own/lib' || j END AS import_path FROM u)
  SELECT import_path, count(DISTINCT service) AS n, string_agg(DISTINCT service, ',' ORDER BY service) AS used_by, min(service) || '/src/use' AS first_file FROM i GROUP BY import_path HAVING count(DISTINCT service) >= 2""")
def shared_libraries(spark, d):
    found = trees.every(trees.usages, spark, d, lambda files, language: U.imports(files, language).where(U.internal(F.col("import_path"), language)))
    named = U.shared_libraries(found)
    return named.select("import_path", F.col("n").cast("bigint").alias("n"), F.array_join("used_by", ",").alias("used_by"), F.concat(F.element_at("used_by", 1), F.lit("/"), "first_file").alias("first_file"))


_KIND = "n % 8"


@query(f"""WITH {HANDLERS}, m AS (SELECT DISTINCT n FROM h) SELECT 'nation-' || n AS service, CASE WHEN {_KIND} < 3 THEN 'typescript' WHEN {_KIND} < 5 THEN 'go' WHEN {_KIND} = 5 THEN 'java' WHEN {_KIND} = 6 THEN 'python' ELSE 'csharp' END AS language,
  CASE {_KIND} WHEN 0 THEN 'nestjs' WHEN 1 THEN 'express' WHEN 3 THEN 'gin' WHEN 5 THEN 'spring-boot' WHEN 6 THEN 'flask' WHEN 7 THEN 'aspnet' ELSE 'unknown' END AS framework,
  CAST(CASE {_KIND} WHEN 0 THEN 0.98 WHEN 1 THEN 0.92 WHEN 2 THEN 0.7 WHEN 5 THEN 0.97 WHEN 7 THEN 0.97 ELSE 0.95 END AS DOUBLE) AS confidence FROM m""")
def detect_services(spark, d):
    return D.detect(trees.markers(spark, d)).select("service", "language", "framework", F.col("confidence").cast("double").alias("confidence"))


@query(f"WITH {HANDLERS} SELECT DISTINCT 'nation-' || n AS folder, 1 AS depth, CASE WHEN {_KIND} < 3 THEN 'package.json' WHEN {_KIND} < 5 THEN 'go.mod' WHEN {_KIND} = 5 THEN 'pom.xml' WHEN {_KIND} = 6 THEN 'requirements.txt' ELSE 'Nation.csproj' END AS marker FROM h")
def discover_roots(spark, d):
    files = trees.markers(spark, d).select("root", F.col("whole").alias("path"), "content")
    return service_roots(files).select("folder", "depth", "marker")


@query(f"WITH {HANDLERS} SELECT DISTINCT 'nation-' || n AS service, CASE WHEN n % 8 = 0 THEN 'own-nation-' || n WHEN n % 8 = 2 THEN 'x' ELSE 'nation-' || n END AS name FROM h")
def service_names(spark, d):
    return D.service_names(trees.markers(spark, d))


@query(f"WITH {HANDLERS} SELECT n || '.proto' AS path, '/own.n' || n || '.Nation/Get' || s AS endpoint, 'stream Ask' || s || ' → Answer' || s AS summary, 'Ask' || s AS request, 'Answer' || s AS response FROM h")
def grpc_endpoints(spark, d):
    return I.grpc_endpoints(trees.interface_files(spark, d, "proto")).select("path", "endpoint", "summary", "request", "response")


@query(f"WITH {HANDLERS} SELECT n || '.graphql' AS path, CASE WHEN n % 3 = 0 THEN 'GRAPHQL_QUERY' ELSE 'GRAPHQL_MUTATION' END AS method, '/graphql/supplier' || s AS endpoint, 'Filter' || s AS request, 'Supplier' || s AS response FROM h")
def graphql_endpoints(spark, d):
    return I.graphql_endpoints(trees.interface_files(spark, d, "graphql"))


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, 'POST' AS method, '/supplier/' || s AS endpoint, 'object' AS body_type, 'a' || s || ':string,b:object' AS body_fields, 'array' AS response_type, 'id:integer' AS response_fields FROM h")
def openapi_endpoints(spark, d):
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",").alias(c)
    rows = I.openapi_endpoints(trees.interface_files(spark, d, "openapi"))
    return rows.select("service", "method", "endpoint", "body_type", listed("body_fields"), "response_type", listed("response_fields"))


@query(f"WITH {HANDLERS}, x AS (SELECT DISTINCT n, t FROM h) SELECT 'nation-' || n AS from_service, 'nation-' || t AS to_service, 'description' AS detected_via, 'https://nation-' || t || '.example.org/x' AS evidence FROM x UNION ALL SELECT 'nation-' || n, 'nation-' || CAST(n // 10 AS INTEGER), 'server-url', 'https://nation-' || n || '.example.org/v1' FROM (SELECT DISTINCT n FROM x) WHERE n >= 10 AND n // 10 <> (n + 1) % 25")
def spec_dependencies(spark, d):
    return I.spec_dependencies(I.openapi_specs(trees.interface_files(spark, d, "openapi")))


def _inputs(spark, d):
    return {name: written(table, name) for name, table in trees.graph_inputs(spark, d).items()}


def _resolved(spark, d):
    t = _inputs(spark, d)
    maps = S.registry(S.registry_writes(t["services"], t["hints"], t["endpoints"]))
    return t, S.resolve(t["calls"], t["services"], t["hints"], t["endpoints"], maps)


@query(f"WITH {HANDLERS}, {RESOLVED} SELECT call_id, service, resolved_service, resolved_path, confidence, rank FROM v")
def resolve_calls(spark, d):
    return _resolved(spark, d)[1].select("call_id", "service", "resolved_service", "resolved_path", "confidence", "rank")


@query(f"WITH {HANDLERS} SELECT 'NEXT_NATION_' || lpad(CAST(t AS VARCHAR), 2, '0') || '_URL' AS key, 'nation-' || t AS target FROM h WHERE i = 0 AND t >= 10")
def guess_by_key(spark, d):
    t = trees.graph_inputs(spark, d)
    keys = t["hints"].select(F.col("key").alias("id"), "svc_seq", "service", "key")
    return S.guess_by_key(keys, t["services"].where("svc_seq >= 10"), every=True).select(F.col("id").alias("key"), "target").where("target <> 'nation-0'")


_CHAIN = f"""WITH RECURSIVE {HANDLERS}, {RESOLVED}, w AS (
  SELECT n AS rn, i AS ri, 0 AS depth, n, i, service, 'GET /nation-' || n || '/supplier/' || i AS endpoint, CAST(1.0 AS DOUBLE) AS confidence, false AS is_unresolved FROM v
  UNION ALL SELECT rn, ri, depth + 1, CASE WHEN v.f IN (0, 1, 3) OR v.f = 4 AND v.n = 0 THEN v.t END, CASE WHEN v.f IN (0, 1, 3) OR v.f = 4 AND v.n = 0 THEN 0 END, coalesce(resolved_service, 'unknown'),
    CASE v.f WHEN 2 THEN 'GET ' || resolved_path WHEN 5 THEN 'GET ???' WHEN 4 THEN CASE WHEN v.n = 0 THEN 'GET /nation-1/supplier/0' ELSE 'GET /0' END ELSE 'GET /nation-' || v.t || '/supplier/0' END, v.confidence, v.f = 5 FROM w JOIN v ON v.n = w.n AND v.i = w.i)"""


@query(f"{_CHAIN} SELECT 'nation-' || rn AS root_service, 'GET /nation-' || rn || '/supplier/' || ri AS root_endpoint, depth, service, endpoint, confidence, is_unresolved FROM w")
def call_chains(spark, d):
    t, resolved = _resolved(spark, d)
    chains = S.call_chains(t["endpoints"], resolved, S.target_endpoints(resolved, t["endpoints"]))
    return chains.select("root_service", "root_endpoint", "depth", "service", "endpoint", "confidence", "is_unresolved")


@query(f"{_CHAIN} SELECT 'nation-' || rn AS root_service, 'GET /nation-' || rn || '/supplier/' || ri AS root_endpoint, count(*) AS hops, CAST(round(avg(confidence) * 100) AS INTEGER) AS percent FROM w WHERE depth > 0 GROUP BY rn, ri")
def chain_context(spark, d):
    t, resolved = _resolved(spark, d)
    chains = S.call_chains(t["endpoints"], resolved, S.target_endpoints(resolved, t["endpoints"]))
    return P.chain_context(S.chain_edges(chains)).select("root_service", "root_endpoint", "hops", "percent")


@query(f"WITH {HANDLERS}, {RESOLVED} SELECT 'nation-' || n AS service, 'nation-' || n || '.controller' AS file, count(*) AS n, string_agg('GET /nation-' || n || '/supplier/' || i, ',' ORDER BY 'GET /nation-' || n || '/supplier/' || i) AS endpoints FROM h GROUP BY n")
def endpoint_groups(spark, d):
    rows = trees.graph_inputs(spark, d)["endpoints"].withColumn("path", F.concat(F.lit("src/"), "service", F.lit(".controller.ts")))
    return P.controllers(rows).select("service", F.concat("controller", F.lit(".controller")).alias("file"), "n", "endpoints")


@query(f"WITH {HANDLERS}, {RESOLVED} SELECT (SELECT count(DISTINCT n) FROM h) AS services, (SELECT count(*) FROM h) AS endpoints, count(*) AS calls, count(resolved_service) AS resolved, count(DISTINCT service || '>' || resolved_service) AS edges FROM v")
def scan_summary(spark, d):
    t, resolved = _resolved(spark, d)
    return P.summary(t["services"], t["endpoints"], resolved)


@query(f"WITH {HANDLERS} SELECT 0 AS part, 'nation-' || n AS service, CAST(i + 1 AS BIGINT) AS seq, '| GET | /nation-' || n || '/supplier/' || i || ' |  |  |' AS text FROM h")
def markdown_rows(spark, d):
    t = trees.graph_inputs(spark, d)
    nothing = F.lit(None).cast("string")
    rows = P.markdown(t["services"], t["endpoints"].withColumns({"request": nothing, "response": nothing}), spark.createDataFrame([], "from_service string, to_service string, detected_via string"))
    return rows.where("seq > 0")


_SIDES = """x AS (SELECT o_orderkey % 50 AS a, o_orderkey AS seq, 'T' || o_orderstatus AS t, o_orderkey % 7 AS f, o_orderkey % 3 = 0 AS old, o_orderkey % 3 = 1 AS new, o_orderkey % 50 % 11 AS g FROM orders),
  b AS (SELECT a, arg_max(t, seq) AS t, arg_max(f, seq) AS f FROM x WHERE old AND g <> 1 GROUP BY a), c AS (SELECT a, arg_max(t, seq) AS t, arg_max(f, seq) AS f FROM x WHERE new AND g <> 2 GROUP BY a),
  j AS (SELECT coalesce(b.a, c.a) AS a, b.a IS NULL AS nb, c.a IS NULL AS nc, b.t AS tb, c.t AS tc, b.f AS fb, c.f AS fc FROM b FULL JOIN c ON b.a = c.a)"""


@query(f"""WITH {_SIDES} SELECT 's' AS service, 'POST' AS method, '/' || a AS path, CASE WHEN nc THEN 'removed' WHEN nb THEN 'added' WHEN fb <> fc OR tb <> tc THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN nc THEN 'breaking' WHEN nb THEN 'non-breaking' WHEN fb <> fc OR tb <> tc THEN 'breaking' ELSE 'none' END AS severity, CASE WHEN NOT nb AND NOT nc AND fb <> fc THEN 'f' || fb ELSE '' END AS removed_fields, CASE WHEN NOT nb AND NOT nc AND fb <> fc THEN 'f' || fc ELSE '' END AS added_fields FROM j""")
def diff_documents(spark, d):
    return _document_changes(spark, d).select("service", "method", "path", "change", "severity", "removed_fields", "added_fields")


def _document_changes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    rows = o.select(F.lit("s").alias("service"), F.lit("POST").alias("method"), F.concat(F.lit("/"), (k % 50).cast("string")).alias("path"), k.alias("seq"), F.concat(F.lit("T"), "o_orderstatus").alias("body_type"), F.create_map(F.concat(F.lit("f"), (k % 7).cast("string")), F.lit("string")).alias("body_fields"), F.lit(None).cast("string").alias("response_type"), F.lit(None).cast("map<string, string>").alias("response_fields"), (k % 3).alias("m"), (k % 50 % 11).alias("g"))
    before, after = rows.where("m = 0 and g <> 1").drop("m", "g"), rows.where("m = 1 and g <> 2").drop("m", "g")
    return P.diff_documents(before, after)


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, CAST(3 * i + 2 AS INTEGER) AS line, s % 4 <> 3 AS conditional, CASE WHEN s % 4 <> 3 THEN 'if x' || s END AS condition_hint FROM h WHERE n % 5 = 1")
def conditional_calls(spark, d):
    body = F.when(F.col("s") % 4 == 3, "public void f<s>() {\n  call();\n}\n").otherwise("if (x<s>) {\n  call();\n}\n")
    h = trees.handlers(spark, d).where("n % 5 = 1")
    text = F.replace(body, F.lit("<s>"), F.col("s").cast("string"))
    name = F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service")
    files = h.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", text.alias("a")))), lambda x: x["a"]), "").alias("content")).withColumn("path", F.lit("A.java"))
    made = h.select(name, F.lit("A.java").alias("path"), (3 * F.col("i") + 2).alias("line"))
    return C.conditional(made, files).select("service", "line", "conditional", "condition_hint")


def _registry(spark, d):
    t = _inputs(spark, d)
    return t, S.registry(S.registry_writes(t["services"], t["hints"], t["endpoints"]))


@query(f"""WITH {HANDLERS}, m AS (SELECT DISTINCT n, t FROM h), k AS (SELECT n, t, 'NEXT_NATION_' || lpad(CAST(t AS VARCHAR), 2, '0') || '_URL' AS key FROM m WHERE t // 10 <> n)
  SELECT 'client' AS map, 'nation-' || n AS map_key, 'nation-' || n AS service FROM m UNION ALL SELECT 'client', 'nation' || n, 'nation-' || n FROM m UNION ALL SELECT 'host', 'inner-' || t, 'nation-' || (t // 10) FROM k UNION ALL SELECT 'env', key, 'nation-' || (t // 10) FROM k""")
def registry_maps(spark, d):
    return _registry(spark, d)[1].where("map <> 'fragment'").select("map", "map_key", "service")


@query(f"""WITH {HANDLERS}, c AS (SELECT *, s % 5 AS f, 'nation-' || (t // 10) AS up FROM h WHERE t // 10 <> n) SELECT s AS call_id, CASE f WHEN 0 THEN '2b' WHEN 1 THEN '4a' WHEN 2 THEN '5a' WHEN 3 THEN '3c' ELSE '3b' END AS rank,
  CASE WHEN f < 3 THEN up ELSE 'nation-' || t END AS resolved_service, CASE f WHEN 0 THEN '/x' WHEN 1 THEN '/y' WHEN 2 THEN '/z/{{x}}' WHEN 4 THEN '/w' END AS resolved_path, CAST(CASE f WHEN 1 THEN 0.95 ELSE 0.85 END AS DOUBLE) AS confidence FROM c""")
def resolve_by_hints(spark, d):
    t, maps = _registry(spark, d)
    h = trees.handlers(spark, d).where("cast(t div 10 as int) <> n")
    form, key, to = F.col("s") % 5, F.concat(F.lit("NEXT_NATION_"), F.lpad(F.col("t").cast("string"), 2, "0"), F.lit("_URL")), F.col("t").cast("string")
    url = F.when(form == 0, key).when(form == 1, F.concat(F.lit("http://inner-"), to, F.lit("/y"))).when(form == 2, F.concat(F.lit("${"), key, F.lit("}/z/${id}"))).when(form == 3, F.concat(F.lit("nation"), to)).otherwise(F.concat(F.lit("lb://Nation"), to, F.lit("Service/w")))
    made = h.select(F.col("s").alias("call_id"), F.col("n").alias("svc_seq"), F.col("i").alias("ep_seq"), F.lit(1).alias("call_seq"), F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service"), F.lit("GET").alias("method"), url.alias("raw_url"), F.lit(None).cast("string").alias("pre_service"), F.lit(None).cast("string").alias("pre_path"))
    out = S.resolve(made, t["services"], t["hints"], t["endpoints"], maps)
    return out.select("call_id", "rank", "resolved_service", "resolved_path", "confidence")


_LATE = f"""WITH {HANDLERS}, c AS (SELECT *, s % 3 AS f FROM h)
  SELECT s AS call_id, CASE f WHEN 0 THEN '5c' WHEN 1 THEN '7' ELSE '8' END AS rank, CASE f WHEN 0 THEN 'depot-' || t WHEN 1 THEN 'depot-' || t ELSE 'depot-' || CASE WHEN n = 0 THEN 1 ELSE 0 END END AS resolved_service,
    CASE f WHEN 0 THEN '/z/{{x}}' WHEN 1 THEN '/tail' ELSE '/common/' || ':id' END AS resolved_path, CAST(CASE f WHEN 0 THEN 0.8 ELSE 0.55 END AS DOUBLE) AS confidence FROM c"""


@query(_LATE)
def resolve_late_ranks(spark, d):
    """Calls that only a variable's value, a client's name inside the URL or a path that another service declares can resolve."""
    h = trees.handlers(spark, d)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = lambda c: F.concat(F.lit("depot-"), c.cast("string"))
    services = written(h.select(F.col("n").alias("svc_seq"), name(F.col("n")).alias("service")).distinct(), "services")
    # each nation says where the next one is under a key that names no service
    hints = h.where("i = 0").select(F.col("n").alias("svc_seq"), F.lit(0).alias("hint_seq"), name(F.col("n")).alias("service"), F.concat(F.lit("PEER_"), two(F.col("t")), F.lit("_AT")).alias("key"), F.concat(F.lit("http://host-"), two(F.col("t")), F.lit("/v")).alias("value"))
    ends = h.where("i = 0").select(F.col("n").alias("svc_seq"), F.lit(0).alias("ep_seq"), name(F.col("n")).alias("service"), F.lit("GET").alias("method"), F.lit("/common/{id}").alias("path"), F.lit("/common/{id}").alias("full_path"))
    known = services.select(F.lit("host").alias("map"), F.concat(F.lit("host-"), two(F.col("svc_seq"))).alias("map_key"), "service", S.place(F.col("svc_seq"), F.lit(0), F.lit(0)).alias("position"))
    clients = services.select(F.lit("client").alias("map"), F.concat(F.lit("peer_"), two(F.col("svc_seq"))).alias("map_key"), "service", S.place(F.col("svc_seq"), F.lit(1), F.lit(0)).alias("position"))
    form = F.col("s") % 3
    url = F.when(form == 0, F.concat(F.lit("${"), F.lit("PEER_"), two(F.col("t")), F.lit("_AT}/z/${id}"))).when(form == 1, F.concat(F.lit("x:PEER_"), two(F.col("t")), F.lit("/tail"))).otherwise(F.lit("/common/:id"))
    nothing = F.lit(None).cast("string")
    calls = h.select(F.col("s").alias("call_id"), F.col("n").alias("svc_seq"), F.col("i").alias("ep_seq"), F.lit(1).alias("call_seq"), name(F.col("n")).alias("service"), F.lit("GET").alias("method"), url.alias("raw_url"), nothing.alias("pre_service"), nothing.alias("pre_path"))
    out = S.resolve(calls, services, written(hints, "hints"), written(ends, "ends"), known.unionByName(clients))
    return out.select("call_id", "rank", "resolved_service", "resolved_path", "confidence")


def _endpoint_edges(spark, d):
    h = trees.handlers(spark, d)
    name = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    label = lambda c, i: F.concat(F.lit("GET /"), name(c), F.lit("/supplier/"), i.cast("string"))
    return h.select(name("n").alias("from_service"), label("n", F.col("i")).alias("from_endpoint"), name("t").alias("to_service"), label("t", F.lit(0)).alias("to_endpoint"), F.when(F.col("s") % 2 == 0, 0.95).otherwise(0.6).alias("confidence"), F.col("i").alias("edge_seq"))


@query(f"WITH {HANDLERS}, n AS (SELECT DISTINCT n FROM h) SELECT DISTINCT 'nation-' || h.n AS from_service, 'nation' || h.n AS from_controller, 'nation-' || t AS to_service, 'nation' || t AS to_controller FROM h JOIN n ON n.n = h.t")
def controller_edges(spark, d):
    ends = trees.graph_inputs(spark, d)["endpoints"].withColumn("path", F.concat(F.lit("src/nation"), F.col("svc_seq").cast("string"), F.lit(".controller.ts")))
    return P.controller_edges(_endpoint_edges(spark, d), ends)


@query(f"WITH {HANDLERS}, m AS (SELECT n, count(*) AS k FROM h GROUP BY n) SELECT 'nation-' || n AS service, CASE WHEN n % 2 = 0 THEN 'go' ELSE 'unknown' END AS language, CASE WHEN n % 2 = 0 THEN 'gin' ELSE 'unknown' END AS framework, k AS endpoints, CASE WHEN n % 2 = 0 THEN 'source' ELSE 'specification' END AS origin FROM m")
def graph_nodes(spark, d):
    both = trees.graph_inputs(spark, d)["endpoints"].groupBy("service", "svc_seq").agg(F.count("*").alias("endpoints")).withColumns({"language": F.lit("go"), "framework": F.lit("gin")})
    return P.graph_nodes(both.where("svc_seq % 2 = 0"), both)


@query(f"WITH {HANDLERS}, e AS (SELECT 'nation-' || n AS from_service, 'nation-' || t AS to_service, n, s FROM h) SELECT from_service, to_service, count(*) AS n FROM e WHERE (from_service, to_service) IN (SELECT from_service, to_service FROM e WHERE n % 4 = 0) GROUP BY 1, 2")
def chain_subgraph(spark, d):
    edges = _endpoint_edges(spark, d)
    chain = edges.where(F.regexp_extract("from_service", r"(\d+)$", 1).cast("int") % 4 == 0)
    return P.chain_subgraph(edges, chain)[0].groupBy("from_service", "to_service").agg(F.count("*").alias("n"))


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, 'nation-' || t AS to_service, s % 2 = 0 AS sure FROM h WHERE s % 2 = 0 AND (n % 3 = 0 OR t % 3 = 0)")
def shown_edges(spark, d):
    chosen = trees.graph_inputs(spark, d)["services"].where("svc_seq % 3 = 0")
    return P.shown_edges(_endpoint_edges(spark, d), 0.7, chosen).select(F.col("from_service").alias("service"), "to_service", (F.col("confidence") > 0.9).alias("sure"))


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, 'GET' AS method, '/nation-' || n || '/supplier/' || i AS full_path FROM h WHERE contains('/nation-' || n || '/supplier/' || i, 'n-1')")
def search_endpoints(spark, d):
    nothing = F.lit(None).cast("string")
    return P.search(trees.graph_inputs(spark, d)["endpoints"].withColumns({"summary": nothing, "controller": nothing}), "N-1").select("service", "method", "full_path")


@query(f"""WITH {_SIDES}, r AS (SELECT a, nb, nc, fb, fc, CASE WHEN nc THEN 'removed' WHEN nb THEN 'added' WHEN fb <> fc OR tb <> tc THEN 'changed' END AS change FROM j)
  SELECT CASE WHEN change = 'added' THEN 1 ELSE 0 END AS n, CASE WHEN change = 'added' THEN 'NON-BREAKING ' ELSE 'BREAKING ' END || change || ' s:POST /' || a || CASE WHEN change = 'changed' AND fb <> fc THEN ' -f' || fb || ' +f' || fc ELSE '' END AS text FROM r WHERE change IS NOT NULL""")
def diff_report(spark, d):
    return P.diff_report(_document_changes(spark, d))


@query("SELECT 0 AS n, 'ERROR circular-dependency: ' || n_name || ' (' || n_regionkey || ')' AS text FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 2, 'INFO isolated: ' || n_name || ' (' || n_regionkey || ')' FROM nation WHERE n_nationkey % 3 <> 0")
def insight_lines(spark, d):
    third = F.col("n_nationkey") % 3 == 0
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.when(third, "error").otherwise("info").alias("severity"), F.when(third, "circular-dependency").otherwise("isolated").alias("type"), F.col("n_name").alias("subject"), F.col("n_regionkey").cast("bigint").alias("n"))
    return P.insight_lines(rows)


@query(f"WITH {HANDLERS}, f AS (SELECT n, t FROM h WHERE i = 0 ORDER BY 'nation-' || n LIMIT 1) SELECT '' AS place, 'nation-' || n || ' GET /nation-' || n || '/supplier/0' AS text FROM f UNION ALL SELECT '1', '  nation-' || t || ' GET /nation-' || t || '/supplier/0' FROM f")
def trace_lines(spark, d):
    e = _endpoint_edges(spark, d)
    node = lambda depth, place, service, endpoint: e.select(F.col("from_service").alias("root_service"), F.col("from_endpoint").alias("root_endpoint"), place.cast("array<int>").alias("node_path"), F.lit(depth).alias("depth"), F.col(service).alias("service"), F.col(endpoint).alias("endpoint"), F.lit(False).alias("is_cycle"), F.lit(False).alias("is_unresolved"))
    chains = node(0, F.array(), "from_service", "from_endpoint").unionByName(node(1, F.array(F.lit(1)), "to_service", "to_endpoint"))
    return P.trace(chains, "SUPPLIER/0").select(F.array_join("node_path", ".").alias("place"), "text")


def _plain_calls(spark, d):
    h = trees.handlers(spark, d)
    name = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    return h.select(F.col("n").alias("svc_seq"), F.col("i").alias("ep_seq"), F.lit(1).alias("call_seq"), name("n").alias("service"), F.lit("a.go").alias("path"), F.col("s").alias("line"), F.lit("GET").alias("method"), F.concat(F.lit("http://"), name("t"), F.lit("/x")).alias("raw_url"), name("t").alias("resolved_service"))


@query(f"WITH {HANDLERS}, f AS (SELECT n, t FROM h WHERE i = 0 ORDER BY n LIMIT 1) SELECT 0 AS part, 0 AS seq, 'nation-' || n || ' GET /nation-' || n || '/supplier/0' AS text FROM f UNION ALL SELECT 2, 1, 'GET http://nation-' || t || '/x → nation-' || t FROM f")
def explain_lines(spark, d):
    nothing = F.lit(None).cast("string")
    ends = trees.graph_inputs(spark, d)["endpoints"].withColumns({"request": nothing, "response": nothing})
    return P.explain(ends, _plain_calls(spark, d), "supplier/0")


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, 'a.go' AS path, s AS line, 'http://nation-' || t || '/x' AS raw_url, 'nation-' || t AS resolved_service FROM h WHERE t = 1 ORDER BY service, path, line LIMIT 10")
def call_sites(spark, d):
    return P.call_sites(_plain_calls(spark, d), "NATION-1")


@query("""WITH j AS (SELECT '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS r FROM nation) SELECT '{"meta":{"schemaVersion":"1.0"},"nations":[' || string_agg(r, ',' ORDER BY r) || ']}' AS document FROM j""")
def saved_document(spark, d):
    return P.document(nations=spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey"))


@query(f"WITH {HANDLERS} SELECT 'nation-' || n AS service, i AS ep_seq, 0 AS call_seq, 'http://nation-' || t || '/x' AS raw_url, CAST(CASE WHEN s % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence, s % 3 = 0 AS conditional, '/supplier/' || s AS path FROM h")
def saved_calls(spark, d):
    """Documents as their JSON text, read back into tables: calls with the endpoints that they belong to."""
    h = trees.handlers(spark, d)
    name = lambda c: F.concat(F.lit("nation-"), c.cast("string"))
    call = F.struct(F.concat(F.lit("http://"), name(F.col("t")), F.lit("/x")).alias("rawUrl"), F.lit("GET").alias("method"), F.when(F.col("s") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"), (F.col("s") % 3 == 0).alias("conditional"), F.lit("kept out").alias("unknown"))
    end = F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/supplier/"), F.col("s").cast("string")).alias("path"), F.array(call).alias("outboundCalls"))
    result = h.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", end.alias("e")))), lambda x: x["e"]).alias("endpoints"))
    text = F.to_json(F.struct(F.struct(F.lit("1.0").alias("schemaVersion")).alias("meta"), F.array(F.struct(name(F.col("n")).alias("serviceName"), "endpoints")).alias("codeScanResults")))
    found = saved.tables(result.select(F.from_json(text, saved.SCHEMA).alias("d")).select("d.*"))
    ends = found["endpoints"].select("service", "ep_seq", "path")
    return found["calls"].select("service", "ep_seq", "call_seq", "raw_url", "confidence", "conditional").join(ends, ["service", "ep_seq"])
