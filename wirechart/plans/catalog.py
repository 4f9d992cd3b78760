"""Every query of the library by name, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wirechart.functions import text as X
from wirechart.operators import graph as G
from wirechart.operators import reports as P
from wirechart.operators import tables as R
from wirechart.plans.bindings import EVENTS, NATIONS, PAGES, ROLES, SPARSE, TOPICS, event_calls, nation_calls, page_endpoints, role_calls, supplier_calls, table, topic_events
from wirechart.storage import written
from wirechart.streaming import watch as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DEGREES = """x AS (SELECT DISTINCT from_service, to_service FROM {0} WHERE from_service <> to_service), d AS (
  SELECT service, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT from_service AS service, 1 AS o, 0 AS i FROM x UNION ALL SELECT to_service, 0, 1 FROM x) GROUP BY service)"""
_LEVEL = "CASE WHEN out_degree >= 3 OR in_degree >= 4 THEN 'high' WHEN out_degree >= 2 OR in_degree >= 2 THEN 'medium' ELSE 'low' END AS level"


@query(f"WITH {NATIONS}, {_DEGREES.format('g')} SELECT service, out_degree, in_degree FROM d")
def service_degrees(spark, d):
    return G.degrees(nation_calls(spark, d))


@query(f"WITH {NATIONS}, {_DEGREES.format('g')} SELECT n_name AS service, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, {_LEVEL} FROM (SELECT n_name, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree FROM nation LEFT JOIN d ON n_name = service)")
def risk_scores(spark, d):
    return G.risk_scores(nation_calls(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("service")))


@query(f"WITH {NATIONS}, {_DEGREES.format('g')} SELECT service, in_degree FROM d WHERE in_degree >= 4")
def high_fan_in(spark, d):
    return G.degrees(nation_calls(spark, d)).where(F.col("in_degree") >= G.FAN_IN).select("service", "in_degree")


@query(f"WITH {EVENTS}, {_DEGREES.format('t')} SELECT service, out_degree FROM d WHERE out_degree >= 3")
def high_fan_out(spark, d):
    return G.degrees(event_calls(spark, d)).where(F.col("out_degree") >= G.FAN_OUT).select("service", "out_degree")


@query(f"WITH {EVENTS} SELECT from_service, to_service, count(*) AS calls FROM t WHERE from_service <> to_service GROUP BY ALL")
def pair_counts(spark, d):
    return G.pair_counts(event_calls(spark, d))


@query(f"WITH {EVENTS} SELECT from_service, to_service, count(*) AS calls FROM t WHERE from_service <> to_service GROUP BY ALL ORDER BY calls DESC, from_service, to_service LIMIT 5")
def top_dependencies(spark, d):
    return G.top_pairs(event_calls(spark, d))


@query(f"WITH {ROLES} SELECT * FROM (SELECT from_service, to_service, calls, CAST(sum(calls) OVER (PARTITION BY from_service) AS BIGINT) AS total FROM (SELECT from_service, to_service, count(*) AS calls FROM c WHERE from_service <> to_service GROUP BY ALL)) WHERE calls * 10 >= total * 4 AND calls >= 3")
def tight_coupling(spark, d):
    return G.tight_coupling(role_calls(spark, d))


_CYCLES = """x AS (SELECT DISTINCT from_service AS a, to_service AS b FROM g WHERE from_service <> to_service), walk AS (
  SELECT a AS root, b AS cur, '>' || a || '>' || b || '>' AS path, 2 AS n FROM x WHERE b > a
  UNION ALL SELECT root, b, path || b || '>', n + 1 FROM walk JOIN x ON cur = a WHERE b > root AND position('>' || b || '>' IN path) = 0),
  cyc AS (SELECT substring(path, 2, length(path) - 2) || '>' || root AS cycle FROM walk JOIN x ON cur = a AND root = b)"""


@query(f"WITH RECURSIVE {SPARSE}, {_CYCLES} SELECT cycle FROM cyc")
def circular_deps(spark, d):
    return G.cycles(supplier_calls(spark, d))


@query("""WITH e AS (SELECT o_custkey AS f, o_custkey * 7 % 1500 AS t FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), c AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer)
  SELECT c_custkey AS service, c_nationkey AS endpoints FROM c WHERE c_nationkey > 0 AND c_custkey NOT IN (SELECT f FROM e WHERE f <> t) AND c_custkey NOT IN (SELECT t FROM e WHERE f <> t)""")
def isolated_services(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    edges = urgent.select(F.col("o_custkey").alias("from_service"), (F.col("o_custkey") * 7 % 1500).alias("to_service"))
    return G.isolated(table(spark, d, "customer").select(F.col("c_custkey").alias("service"), F.col("c_nationkey").alias("endpoints")), edges)


@query("WITH r AS (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS r FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) SELECT source AS from_service, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 3) AS examples FROM r GROUP BY source")
def unresolved_summary(spark, d):
    known = table(spark, d, "labels").select("doc_id", F.lit("label").alias("to_service")).distinct()
    calls = table(spark, d, "documents").select("doc_id", F.col("source").alias("from_service"), F.col("doc_id").alias("call_seq"), F.col("doc_id").cast("string").alias("raw_url")).join(known, "doc_id", "left")
    return G.unresolved(calls)


@query(f"""WITH RECURSIVE {SPARSE}, {_DEGREES.format('g')}, target AS (SELECT service FROM d ORDER BY in_degree DESC, service LIMIT 1),
  reach AS (SELECT service, 0 AS depth FROM target UNION SELECT from_service, depth + 1 FROM reach JOIN x ON to_service = service WHERE depth < 26)
  SELECT service, min(depth) AS depth FROM reach WHERE service NOT IN (SELECT service FROM target) GROUP BY service""")
def blast_radius(spark, d):
    edges = supplier_calls(spark, d)
    target = G.degrees(edges).orderBy(F.desc("in_degree"), "service").limit(1).select("service")
    return G.blast_radius(edges, target)


_WALK = """x AS (SELECT DISTINCT from_service AS a, to_service AS b FROM g WHERE from_service <> to_service), walk AS (
  SELECT DISTINCT a AS root, a AS cur, a AS path, 0 AS depth, false AS is_cycle FROM x
  UNION ALL SELECT root, b, path || '>' || b, depth + 1, position('>' || b || '>' IN '>' || path || '>') > 0 FROM walk JOIN x ON cur = a WHERE NOT is_cycle AND depth < 20)"""


@query(f"WITH RECURSIVE {SPARSE}, {_WALK} SELECT root, path, depth, is_cycle, is_cycle OR cur NOT IN (SELECT a FROM x) AS is_leaf FROM walk")
def chain_walk(spark, d):
    return G.chain_walk(supplier_calls(spark, d))


@query(f"WITH {EVENTS}, c AS (SELECT from_service, to_service, event_id AS edge_seq, CAST(CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN event_id % 3 = 1 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY from_service, to_service ORDER BY confidence DESC, edge_seq) AS r FROM c) SELECT from_service, to_service, edge_seq, confidence FROM r WHERE r = 1")
def chain_edges_best(spark, d):
    scored = event_calls(spark, d).select("from_service", "to_service", F.col("event_id").alias("edge_seq"), F.when(F.col("event_id") % 3 == 0, 0.9).when(F.col("event_id") % 3 == 1, 0.7).otherwise(0.5).alias("confidence"))
    return G.best_edges(scored)


@query(f"WITH {EVENTS} SELECT from_service, to_service, min(event_id) AS event_id FROM t GROUP BY ALL")
def flatten_edges(spark, d):
    return R.first_by(event_calls(spark, d), ["from_service", "to_service"], ["event_id"]).select("from_service", "to_service", "event_id")


_SURE = "CAST(CASE WHEN r = 1 THEN 0.95 WHEN r <= 4 THEN 0.7 ELSE 0.6 END AS DOUBLE)"


def _scored(spark, d):
    r = F.col("r")
    return nation_calls(spark, d).withColumn("confidence", F.when(r == 1, 0.95).when(r <= 4, 0.7).otherwise(0.6))


@query(f"WITH {NATIONS}, c AS (SELECT from_service, to_service, {_SURE} AS confidence FROM g) SELECT * FROM c WHERE confidence >= 0.7")
def min_confidence(spark, d):
    return P.shown_edges(_scored(spark, d).select("from_service", "to_service", "confidence"), 0.7)


_TOPIC = "SELECT p.service AS from_service, s.service AS to_service, min(p.topic) AS topic, CAST(0.8 AS DOUBLE) AS confidence FROM e p JOIN e s ON p.topic = s.topic AND p.direction = 'publish' AND s.direction = 'subscribe' GROUP BY ALL"


@query(f"WITH {TOPICS} {_TOPIC.replace('FROM e p JOIN e s', 'FROM (SELECT DISTINCT * FROM e) p JOIN (SELECT DISTINCT * FROM e) s').replace('GROUP BY ALL', 'GROUP BY p.service, s.service')}")
def async_topic_edges(spark, d):
    return G.topic_edges(topic_events(spark, d))


_SPECS = "s AS (SELECT n_name AS from_service, r_name AS to_service FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {NATIONS}, {TOPICS}, {_SPECS}, a AS (SELECT DISTINCT from_service, to_service FROM g), q AS (SELECT DISTINCT p.service AS from_service, s.service AS to_service FROM (SELECT DISTINCT * FROM e) p JOIN (SELECT DISTINCT * FROM e) s ON p.topic = s.topic AND p.direction = 'publish' AND s.direction = 'subscribe')
  SELECT *, 'sync' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM a UNION ALL SELECT *, 'async', 0.8 FROM q UNION ALL SELECT DISTINCT *, 'spec', 0.5 FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.from_service = s.from_service AND a.to_service = s.to_service)""")
def graph_edges_merged(spark, d):
    specs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from_service"), F.col("r_name").alias("to_service"))
    return G.merged_edges(nation_calls(spark, d), G.topic_edges(topic_events(spark, d)), specs)


@query(f"""WITH RECURSIVE {SPARSE}, {_CYCLES.replace('x AS', 'y AS').replace('FROM x', 'FROM y').replace('JOIN x', 'JOIN y')}, {_DEGREES.format('g')}, pc AS (SELECT from_service, to_service, count(*) AS calls, CAST(sum(count(*)) OVER (PARTITION BY from_service) AS BIGINT) AS total FROM g WHERE from_service <> to_service GROUP BY 1, 2)
  SELECT 'error' AS severity, 'circular-dependency' AS type, cycle AS subject, CAST(length(cycle) - length(replace(cycle, '>', '')) AS BIGINT) AS n FROM cyc UNION ALL SELECT 'warning', 'high-fan-out', service, out_degree FROM d WHERE out_degree >= 3 UNION ALL SELECT 'warning', 'high-fan-in', service, in_degree FROM d WHERE in_degree >= 4
  UNION ALL SELECT 'warning', 'tight-coupling', from_service || '>' || to_service, calls FROM pc WHERE calls * 10 >= total * 4 AND calls >= 3""")
def insights_union(spark, d):
    calls = supplier_calls(spark, d)
    return G.insights(calls, G.cycles(calls))


@query(f"""WITH RECURSIVE {SPARSE}, x AS (SELECT DISTINCT from_service AS a, to_service AS b FROM g WHERE from_service <> to_service), reach AS (SELECT a, b FROM x UNION SELECT reach.a, x.b FROM reach JOIN x ON reach.b = x.a)
  SELECT f.a AS service, min(f.b) AS component FROM reach f JOIN reach r ON f.a = r.b AND f.b = r.a GROUP BY f.a""")
def strong_components(spark, d):
    return G.strong_components(supplier_calls(spark, d))


_SERVED = "v AS (SELECT CAST(o_custkey AS VARCHAR) AS from_service, CAST(o_custkey * 7 % 1500 AS VARCHAR) AS to_service, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"


@query(f"""WITH {_SERVED}, g AS (SELECT * FROM v WHERE o_orderkey % 4 > 0 AND CAST(from_service AS INTEGER) < CAST(to_service AS INTEGER)), {_DEGREES.format('g')}, m AS (SELECT from_service, count(*) AS n FROM v WHERE o_orderkey % 4 = 0 GROUP BY 1),
  pc AS (SELECT from_service, to_service, count(*) AS calls, CAST(sum(count(*)) OVER (PARTITION BY from_service) AS BIGINT) AS total FROM g WHERE from_service <> to_service GROUP BY 1, 2)
  SELECT 'warning' AS severity, 'high-fan-out' AS type, service AS subject, out_degree AS n FROM d WHERE out_degree >= 3 UNION ALL SELECT 'warning', 'high-fan-in', service, in_degree FROM d WHERE in_degree >= 4
  UNION ALL SELECT 'warning', 'tight-coupling', from_service || '>' || to_service, calls FROM pc WHERE calls * 10 >= total * 4 AND calls >= 3
  UNION ALL SELECT 'info', 'unresolved-calls', count(*) || ' services', CAST(sum(n) AS BIGINT) FROM m HAVING sum(n) > 0
  UNION ALL SELECT 'info', 'isolated-service', CAST(c_custkey AS VARCHAR), c_nationkey FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer) WHERE c_nationkey > 0 AND CAST(c_custkey AS VARCHAR) NOT IN (SELECT from_service FROM g WHERE from_service <> to_service UNION SELECT to_service FROM g WHERE from_service <> to_service)""")
def insights_in_full(spark, d):
    """All six kinds of findings over a graph without cycles: a fourth of its calls is resolved by nothing, and some services have no edge."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    rows = urgent.select(F.col("o_custkey").cast("string").alias("from_service"), (F.col("o_custkey") * 7 % 1500).cast("string").alias("to_service"), F.col("o_orderkey").alias("call_seq"), F.lit("?").alias("raw_url"))
    calls = rows.where(F.col("call_seq") % 4 > 0).where(F.col("from_service").cast("int") < F.col("to_service").cast("int"))
    missing = G.unresolved(rows.where(F.col("call_seq") % 4 == 0).withColumn("to_service", F.lit(None).cast("string")))
    services = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("service"), F.col("c_nationkey").alias("endpoints"))
    return G.insights(calls, G.cycles(calls), missing, services)


@query(f"WITH {SPARSE} SELECT service FROM (SELECT 'NATION_10' AS service UNION SELECT to_service FROM g WHERE from_service = 'NATION_10' UNION SELECT from_service FROM g WHERE to_service = 'NATION_10')")
def one_hop_neighbourhood(spark, d):
    return G.neighbourhood(supplier_calls(spark, d), spark.range(1).select(F.lit("NATION_10").alias("service")))


@query(f"WITH {NATIONS} SELECT CAST(round(avg({_SURE}), 6) AS DOUBLE) AS avg_confidence, count(*) AS hops FROM g")
def avg_confidence(spark, d):
    return _scored(spark, d).agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count("*").alias("hops"))


@query(f"WITH {NATIONS} SELECT CASE WHEN {_SURE} >= 0.9 THEN 'high' WHEN {_SURE} >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM g GROUP BY 1")
def confidence_bands(spark, d):
    return _scored(spark, d).groupBy(P.band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {PAGES} SELECT page_id, host, path, norm FROM p")
def endpoint_projection(spark, d):
    return page_endpoints(spark, d)


@query(f"WITH {PAGES} SELECT norm, count(*) AS n, count(DISTINCT host) AS hosts FROM p GROUP BY norm")
def path_normalize(spark, d):
    return page_endpoints(spark, d).groupBy("norm").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


_HREF = """href="([^"]*)\""""


@query(f"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL")
def link_extraction(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"WITH l AS (SELECT page_id, unnest(m) AS href, unnest(range(len(m))) AS seq FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS m FROM pages)) SELECT page_id, href, CAST(min(seq) AS INTEGER) AS seq FROM l GROUP BY ALL")
def call_dedup(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("seq", "href"))
    return R.first_by(rows, ["page_id", "href"], ["seq"])


@query(f"WITH {PAGES} SELECT host, split_part(path, '/', 2) AS controller, count(*) AS n FROM p GROUP BY ALL")
def controller_groups(spark, d):
    return page_endpoints(spark, d).groupBy("host", F.split_part("path", F.lit("/"), F.lit(2)).alias("controller")).agg(F.count("*").alias("n"))


@query(f"WITH {PAGES} SELECT norm AS map_key, min(page_id) AS position, arg_min(host, page_id) AS service FROM p GROUP BY norm")
def registry_first_wins(spark, d):
    writes = page_endpoints(spark, d).select(F.col("norm").alias("map_key"), F.col("host").alias("service"), F.col("page_id").alias("seq"), F.lit(True).alias("weak"))
    return R.fold_registry(writes)


@query(f"WITH {PAGES} SELECT norm AS map_key, min(page_id) AS position, coalesce(arg_max(host, page_id) FILTER (WHERE page_id % 2 = 1), arg_min(host, page_id)) AS service FROM p GROUP BY norm")
def registry_last_wins(spark, d):
    writes = page_endpoints(spark, d).select(F.col("norm").alias("map_key"), F.col("host").alias("service"), F.col("page_id").alias("seq"), (F.col("page_id") % 2 == 0).alias("weak"))
    return R.fold_registry(writes)


@query(f"""WITH {PAGES}, b AS (SELECT DISTINCT host FROM p WHERE NOT regexp_matches(host, '^(www|m|blog)\\.')), c AS (SELECT page_id, host, regexp_replace(host, '^(www|m|blog)\\.', '') AS bare FROM p)
  SELECT page_id, coalesce(x.host, y.host) AS target, CASE WHEN x.host IS NOT NULL THEN 1 WHEN y.host IS NOT NULL THEN 2 ELSE 0 END AS rank, CAST(CASE WHEN x.host IS NOT NULL THEN 0.95 WHEN y.host IS NOT NULL THEN 0.85 ELSE 0.0 END AS DOUBLE) AS confidence
  FROM c LEFT JOIN b x ON x.host = c.host LEFT JOIN b y ON y.host = c.bare""")
def resolve_cascade(spark, d):
    calls = page_endpoints(spark, d).select("page_id", "host").withColumn("bare", F.regexp_replace("host", r"^(www|m|blog)\.", ""))
    base = calls.where("host = bare").select("host").distinct()
    joined = calls.join(base.select("host", F.col("host").alias("exact")), "host", "left").join(base.select(F.col("host").alias("bare"), F.col("host").alias("short")), "bare", "left")
    one = lambda t, r, c: {"target": t, "rank": F.lit(r), "confidence": F.lit(c)}
    rules = [(F.col("exact").isNotNull(), one(F.col("exact"), 1, 0.95)), (F.col("short").isNotNull(), one(F.col("short"), 2, 0.85))]
    return R.ranked(joined, "page_id", rules, one(F.lit(None).cast("string"), 0, 0.0)).select("page_id", "target", "rank", "confidence")


@query(f"WITH {PAGES} SELECT a.page_id, min(b.page_id) AS target FROM p a JOIN p b ON a.norm = b.norm AND a.host <> b.host GROUP BY a.page_id")
def target_endpoint_lookup(spark, d):
    # the least page of each template and the least of any other host decide: no pairs within a template
    p = page_endpoints(spark, d)
    hosts = p.groupBy("norm", "host").agg(F.min("page_id").alias("least"))
    two = hosts.withColumn("r", F.row_number().over(Window.partitionBy("norm").orderBy("least"))).where("r <= 2")
    best = two.groupBy("norm").agg(F.max(F.when(F.col("r") == 1, F.struct("host", "least"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("least"))).alias("two"))
    out = p.join(best, "norm").select("page_id", F.when(F.col("one.host") != F.col("host"), F.col("one.least")).otherwise(F.col("two")).alias("target"))
    return out.where("target is not null")


_MARKS = [("### ", "markdown", 0.98), ("!!", "shouting", 0.92), (" | ", "table", 0.85), ("password", "config", 0.7)]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(text, '{m}') THEN '{k}'" for m, k, _ in _MARKS) + " ELSE 'unknown' END AS kind, CAST(CASE " + " ".join(f"WHEN contains(text, '{m}') THEN {c}" for m, _, c in _MARKS) + " ELSE 0 END AS DOUBLE) AS confidence FROM documents")
def detect_language_ranked(spark, d):
    rules = [(F.contains("text", F.lit(m)), {"kind": F.lit(k), "confidence": F.lit(c)}) for m, k, c in _MARKS]
    return R.ranked(table(spark, d, "documents"), "doc_id", rules, {"kind": F.lit("unknown"), "confidence": F.lit(0.0)}).select("doc_id", "kind", "confidence")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug_names(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS parser, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1")
def polyglot_choice(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.first_by(n, ["user_id"], [F.desc("n"), "event_type"]).select("user_id", F.col("event_type").alias("parser"), "n")


@query(f"WITH {PAGES}, r AS (SELECT DISTINCT host || path AS root FROM p) SELECT root FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE starts_with(r.root, q.root || '/'))")
def nested_root_dedup(spark, d):
    # each root is joined with its own ancestors, so the prefix test is an equi join
    r = page_endpoints(spark, d).select(F.concat("host", "path").alias("root")).distinct()
    parts = F.split("root", "/")
    above = r.select("root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up")).where("up <> root")
    nested = above.join(r.select(F.col("root").alias("up")), "up", "left_semi").select("root")
    return r.join(nested, "root", "left_anti")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def file_cap(spark, d):
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", "doc_id").withColumn("r", rank).where("r <= 20").drop("r")


@query("WITH l AS (SELECT doc_id, unnest(m) AS line, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)) SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS n FROM l")
def line_table(spark, d):
    return R.line_table(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "line_no", F.length("line").cast("bigint").alias("n"))


_LINES = "l AS (SELECT doc_id, unnest(m) AS line, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents))"


@query(f"WITH {_LINES}, h AS (SELECT doc_id, line_no, substring(line, 1, 20) AS hint FROM l WHERE contains(line, '!!')), c AS (SELECT doc_id, line_no AS call_line FROM l WHERE length(line) > 200) SELECT c.doc_id, call_line, arg_max(hint, line_no) AS hint, max(line_no) AS hint_line FROM c LEFT JOIN h ON c.doc_id = h.doc_id AND line_no BETWEEN call_line - 6 AND call_line GROUP BY ALL")
def conditional_lookback(spark, d):
    lines = R.line_table(table(spark, d, "documents"), ["doc_id"])
    calls = lines.where(F.length("line") > 200).select("doc_id", F.col("line_no").alias("call_line"))
    return R.look_back(lines, calls, ["doc_id"], F.when(F.contains("line", F.lit("!!")), F.substring("line", 1, 20)))


@query(f"WITH {_LINES}, b AS (SELECT doc_id, line_no AS first, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), 1000000) - 1 AS last FROM l WHERE length(line) < 30) SELECT b.doc_id, first, count(line_no) AS n FROM b LEFT JOIN l ON l.doc_id = b.doc_id AND line_no BETWEEN first AND last AND length(line) >= 100 GROUP BY ALL")
def body_range_join(spark, d):
    # bodies don't overlap, so the body of a line is the last one that began: a window in place of a range join
    lines = R.line_table(table(spark, d, "documents"), ["doc_id"])
    begin = F.last(F.when(F.length("line") < 30, F.col("line_no")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no"))
    rows = lines.select("doc_id", begin.alias("first"), (F.length("line") >= 100).alias("inside")).where("first is not null")
    return rows.groupBy("doc_id", "first").agg(F.count_if("inside").alias("n"))


@query("SELECT p_brand AS db_type, lower(p_type) AS name, min(p_partkey) AS seq FROM part GROUP BY ALL")
def db_usage_dedup(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("db_type"), F.lower("p_type").alias("name"), F.col("p_partkey").alias("seq"))
    return R.first_by(rows, ["db_type", "name"], ["seq"])


@query(f"WITH {TOPICS} SELECT DISTINCT service, direction, topic FROM e")
def message_dedup(spark, d):
    return topic_events(spark, d).dropDuplicates(["service", "direction", "topic"])


@query("SELECT l_partkey AS library, count(DISTINCT s_nationkey) AS n, string_agg(DISTINCT CAST(s_nationkey AS VARCHAR), ',' ORDER BY CAST(s_nationkey AS VARCHAR)) AS used_by FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey HAVING count(DISTINCT s_nationkey) >= 2")
def shared_dependencies(spark, d):
    uses = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("library")).agg(F.array_sort(F.collect_set(F.col("s_nationkey").cast("string"))).alias("u"))
    return uses.where(F.size("u") >= 2).select("library", F.size("u").cast("bigint").alias("n"), F.array_join("u", ",").alias("used_by"))


_DIFF = """k AS (SELECT l_suppkey AS s, l_partkey AS p, o_orderdate < TIMESTAMP '1996-01-01' AS old, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  b AS (SELECT s, p, list_sort(list_distinct(list(f))) AS b FROM k WHERE old GROUP BY ALL), a AS (SELECT s, p, list_sort(list_distinct(list(f))) AS a FROM k WHERE NOT old GROUP BY ALL),
  j AS (SELECT s, p, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') ELSE '' END AS removed_fields, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') ELSE '' END AS added_fields FROM b FULL JOIN a USING (s, p)),
  x AS (SELECT s, p, CASE WHEN a IS NULL THEN 'removed' WHEN b IS NULL THEN 'added' WHEN removed_fields <> '' OR added_fields <> '' THEN 'changed' ELSE 'same' END AS change,
  CASE WHEN a IS NULL OR removed_fields <> '' THEN 'breaking' WHEN b IS NOT NULL AND added_fields = '' THEN 'none' ELSE 'non-breaking' END AS severity, removed_fields, added_fields FROM j)"""


def _diffed(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    fields = F.map_from_entries(F.transform(F.collect_set("l_returnflag"), lambda x: F.struct(x, x)))
    # both sides come from one aggregation, written once
    sides = written(rows.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), old.alias("old")).agg(fields.alias("fields")), "sides")
    return R.diff(sides.where("old").drop("old"), sides.where("not old").drop("old"), ["s", "p"], "fields")


@query(f"WITH {_DIFF} SELECT s, p, change, severity FROM x")
def diff_endpoints(spark, d):
    return _diffed(spark, d).select("s", "p", "change", "severity")


@query(f"WITH {_DIFF} SELECT s, p, removed_fields, added_fields FROM x WHERE change = 'changed'")
def diff_fields(spark, d):
    return _diffed(spark, d).where("change = 'changed'").select("s", "p", "removed_fields", "added_fields")


@query(f"WITH {_DIFF} SELECT severity, change, count(*) AS n FROM x GROUP BY ALL")
def diff_summary(spark, d):
    return _diffed(spark, d).groupBy("severity", "change").agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, CAST(round(sum(value), 6) AS DOUBLE) AS total FROM events GROUP BY ALL")
def json_properties(spark, d):
    return table(spark, d, "events").groupBy(F.try_variant_get(F.parse_json("props"), "$.k", "string").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS begin_us, count(*) AS n FROM s GROUP BY user_id, k")
def debounce_sessions(spark, d):
    rows = table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("begin_us"), "n")


_SNAPSHOTS = """b AS (SELECT CAST(l_orderkey AS VARCHAR) AS service, CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) AS path,
    CAST(count(*) AS BIGINT) AS bytes, CAST(max(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))) AS BIGINT) AS modified_ns
  FROM lineitem WHERE {1} GROUP BY 1, 2)"""


@query(
    f"WITH {_SNAPSHOTS.format('l_shipdate', 'l_linenumber > 1')}, a AS (SELECT * FROM (WITH {_SNAPSHOTS.format('l_shipdate', 'l_linenumber <> 3')} SELECT * FROM b)) "
    "SELECT service, path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'altered' END AS change, coalesce(a.bytes, b.bytes) AS bytes, coalesce(a.modified_ns, b.modified_ns) AS modified_ns "
    "FROM b FULL JOIN (SELECT *, service AS s FROM a) a USING (service, path) WHERE b.bytes IS DISTINCT FROM a.bytes OR b.modified_ns IS DISTINCT FROM a.modified_ns"
)
def manifest_changes(spark, d):
    """Two listings of all orders' items: one made before their first lines came, one after their third lines went."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("service"), F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("path"), F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"), "l_linenumber")
    listing = lambda wanted: rows.where(wanted).groupBy("service", "path").agg(F.count("*").alias("bytes"), F.max("day").alias("modified_ns"))
    return W.changed_files(listing("l_linenumber > 1"), listing("l_linenumber <> 3"))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE contains(lower(event_type), 'c') GROUP BY ALL")
def sidebar_search(spark, d):
    return table(spark, d, "events").where(F.contains(F.lower("event_type"), F.lit("c"))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS} SELECT from_service, to_service, count(*) AS calls, CAST(round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY from_service) AS DOUBLE), 6) AS DOUBLE) AS share FROM t GROUP BY 1, 2")
def call_shares(spark, d):
    counts = event_calls(spark, d).groupBy("from_service", "to_service").agg(F.count("*").alias("calls"))
    return counts.withColumn("share", F.round(F.col("calls") / F.sum("calls").over(Window.partitionBy("from_service")), 6))
