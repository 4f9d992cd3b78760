"""From calls to services: the registry's writers, the ranked resolution of calls, targets and endpoint-level chains.

Inputs: services(svc_seq, service), hints(svc_seq, hint_seq, service, key, value), endpoints(svc_seq, ep_seq, service,
method, path, full_path), calls(call_id, svc_seq, ep_seq, call_seq, service, method, raw_url and, where a call came
resolved, pre_service, pre_path). Whether a text holds a name is an equi join of the text's three-letter pieces with the name's
first three letters, then a test of the whole name, so no table is joined with another row by row and names of any length
count; each rank gives candidate rows and the least rank of a call wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirechart.functions.text import kebab, template_path, url_host
from wirechart.operators.code import first_of
from wirechart.operators.tables import fold_registry
from wirechart.storage import written

#: Hosts of well-known services and the names they go by, in the order in which they are tried.
EXTERNAL = [
    ("api.anthropic.com", "anthropic-api"),
    ("api.openai.com", "openai-api"),
    ("api.stripe.com", "stripe-api"),
    ("api.twilio.com", "twilio-api"),
    ("api.sendgrid.com", "sendgrid-api"),
    ("api.mailgun.net", "mailgun-api"),
    ("api.github.com", "github-api"),
    ("graph.microsoft.com", "microsoft-graph-api"),
    ("api.slack.com", "slack-api"),
    ("hooks.slack.com", "slack-api"),
    ("api.segment.io", "segment-api"),
    ("api.mixpanel.com", "mixpanel-api"),
    ("api.amplitude.com", "amplitude-api"),
    ("api.hubapi.com", "hubspot-api"),
    ("api.salesforce.com", "salesforce-api"),
    ("s3.amazonaws.com", "aws-s3"),
    ("sns.amazonaws.com", "aws-sns"),
    ("sqs.amazonaws.com", "aws-sqs"),
    ("storage.googleapis.com", "gcp-storage"),
]
#: Confidence of each rank.
CONFIDENCE = {"1": 0.95, "2a": 0.90, "2b": 0.85, "3a": 0.95, "3b": 0.85, "3c": 0.85, "4a": 0.95, "4b": 0.95, "4c": 0.95, "5a": 0.85, "5b": 0.70, "5c": 0.80, "6": 0.60, "7": 0.55, "8": 0.55}
#: Endings that are taken off an environment key, in order, and path segments that say nothing.
KEY_ENDS = ["-url", "-host", "-endpoint", "-base-url", "-service"]
EMPTY_SEGMENTS = ["api", "v1", "v2", "v3", "rest", "service"]
#: Letters that a name and a text must share before the whole name is looked for; shorter names are never looked for.
PIECE = 3
_WRITE = ["map", "map_key", "service", "seq", "weak"]


def flat(name: Column) -> Column:
    return F.replace(name, F.lit("-"), F.lit(""))


def core(name: Column) -> Column:
    """A name without what only says that it is a service."""
    return F.regexp_replace(name, "-?(?:service|client|svc)$", "")


def upper_snake(name: Column) -> Column:
    return F.upper(F.replace(kebab(name), F.lit("-"), F.lit("_")))


def holding(texts: DataFrame, text: str, names: DataFrame, name: str, least: int = PIECE) -> DataFrame:
    """Rows of texts with each row of names whose name, of ``least`` characters or more, the text holds."""

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))

    # a name goes by its first letters, a shorter one by itself
    cut = texts.withColumn("_piece", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(min(least, PIECE), PIECE + 1)]))))
    own = names.where(F.length(name) >= least).withColumn("_piece", F.substring(name, 1, PIECE))
    return cut.join(own, "_piece").where(F.contains(text, name)).drop("_piece")


def _forms(services: DataFrame) -> DataFrame:
    """(form, svc, target): a service's name as it may stand in a key, with and without hyphens."""
    return services.select(F.explode(F.array_distinct(F.array("service", flat(F.col("service"))))).alias("form"), F.col("svc_seq").alias("svc"), F.col("service").alias("target"))


def guess_by_key(keys: DataFrame, services: DataFrame, every: bool = False) -> DataFrame:
    """(id, target): the service that an environment key names, for keys(id, svc_seq, service, key).

    First a service whose name the key holds; else, after one of KEY_ENDS is taken off, one that holds what is left.
    Services up to the key's own are visible, or with ``every`` all; a service never names itself.
    """
    rows = keys.withColumn("k", kebab(F.col("key")))
    seen = F.lit(True) if every else F.col("svc") <= F.col("svc_seq")
    forms = _forms(services)
    holds = holding(rows.select("id", "svc_seq", "service", "k"), "k", forms, "form").where(seen & (F.col("target") != F.col("service")))
    stem = reduce(lambda later, e: F.when(F.col("k").endswith(e), F.substring(F.col("k"), F.lit(1), F.length("k") - len(e))).otherwise(later), reversed(KEY_ENDS), F.col("k"))
    held = holding(forms, "form", rows.select("id", "svc_seq", "service", stem.alias("stem")), "stem").where(seen & (F.col("target") != F.col("service")))
    both = holds.select("id", F.lit(0).alias("way"), "svc", "target").unionByName(held.select("id", F.lit(1).alias("way"), "svc", "target"))
    return both.groupBy("id").agg(F.min(F.struct("way", "svc", "target")).alias("g")).select("id", F.col("g.target").alias("target"))


def guess_by_name(names: DataFrame, services: DataFrame, every: bool = False) -> DataFrame:
    """(id, target): the service that a client's name means, for names(id, svc_seq, service, name).

    Equal names first, whatever the case, hyphens and a closing "service"; else a name that holds a service's core.
    """
    rows = names.withColumn("k", kebab(F.col("name")))
    seen = F.lit(True) if every else F.col("svc") <= F.col("svc_seq")
    known = services.select(F.col("svc_seq").alias("svc"), F.col("service").alias("target"), flat(core(F.col("service"))).alias("form"), core(F.col("service")).alias("core"))
    same = rows.withColumn("form", flat(core(F.col("k")))).where("form <> ''").join(known, "form").where(seen & (F.col("target") != F.col("service")))
    parts = holding(rows.select("id", "svc_seq", "service", "k"), "k", known, "core").where(seen & (F.col("target") != F.col("service")))
    both = same.select("id", F.lit(0).alias("way"), "svc", "target").unionByName(parts.select("id", F.lit(1).alias("way"), "svc", "target"))
    return both.groupBy("id").agg(F.min(F.struct("way", "svc", "target")).alias("g")).select("id", F.col("g.target").alias("target"))


def place(service: Column, phase: Column, n: Column) -> Column:
    """A place in the order of writes: services, what they write, and the places of that."""
    return F.struct(service.cast("bigint").alias("svc"), phase.cast("int").alias("phase"), n.cast("bigint").alias("n"))


def registry_writes(services: DataFrame, hints: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(map, map_key, service, seq, weak): every write of the five maps in its place in the order of services."""
    at = lambda phase, n=F.lit(0): place(F.col("svc_seq"), F.lit(phase), n)
    write = lambda df, name, key, service, seq, weak=False: df.select(F.lit(name).alias("map"), key.alias("map_key"), service.alias("service"), seq.alias("seq"), F.lit(weak).alias("weak"))
    c = F.col
    h = hints.withColumn("id", F.concat_ws("/", "svc_seq", "hint_seq"))
    client = F.regexp_extract("value", r"^(?:feign|lb)://([^/]+)", 1)
    named = h.where(client != "").select("svc_seq", "hint_seq", "service", F.explode(F.array_distinct(F.array(client, F.lower(client)))).alias("k"))
    by_key = guess_by_key(h.select("id", "svc_seq", "service", "key"), services)
    guessed = h.join(by_key, "id")
    host = url_host(c("value"))
    urls = guessed.where(host != "").select("svc_seq", "hint_seq", "target", F.explode(F.array_distinct(F.array(host, F.element_at(F.split(host, r"\."), 1)))).alias("k"))
    short = F.coalesce(F.nullif(F.regexp_extract(host, r"^([^.]+)\.[^.]+\.svc(?:\.cluster\.local)?$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"^([^.]+)\.service\.consul$", 1), F.lit("")))
    inner = h.where(short.isNotNull()).select("svc_seq", "hint_seq", short.alias("k"), host.alias("host"), "service")
    inner_to = guess_by_name(inner.select(F.concat_ws("/", "svc_seq", "hint_seq").alias("id"), "svc_seq", "service", c("k").alias("name")), services)
    inner = inner.withColumn("id", F.concat_ws("/", "svc_seq", "hint_seq")).join(inner_to, "id").select("svc_seq", "hint_seq", "target", F.explode(F.array("k", "host")).alias("k"))
    plain = h.where(c("value").isNotNull() & ~c("value").rlike("^[a-z]+://")).select("svc_seq", "hint_seq", "service", F.regexp_replace(F.lower("value"), "[^a-z0-9-]", "-").alias("k"))
    env = guessed.select("svc_seq", "hint_seq", "target", F.explode(F.array_distinct(F.array(c("key"), F.upper("key"), upper_snake(c("key"))))).alias("k"))
    client_keys = guessed.where(c("key").startswith("HTTP_CLIENT_")).select("svc_seq", "hint_seq", "target", F.lower(F.regexp_replace("key", "^HTTP_CLIENT_", "")).alias("k"))
    own = services.select("svc_seq", "service", F.explode(F.array_distinct(F.array(c("service"), F.lower("service"), flat(c("service")), F.lower(flat(c("service")))))).alias("k"))
    pieces = services.select("svc_seq", "service", F.explode(F.array_distinct(F.array(c("service"), flat(c("service"))))).alias("k"))
    says = lambda x: (F.length(x) > 2) & ~x.startswith("{") & ~x.startswith(":") & ~F.lower(x).isin(EMPTY_SEGMENTS)
    segment = F.get(F.filter(F.split("full_path", "/"), says), F.lit(0))
    second = F.get(F.filter(F.array(F.get(F.split("path", "/"), F.lit(1))), lambda x: x.isNotNull() & says(x)), F.lit(0))
    paths = endpoints.select("svc_seq", "ep_seq", "service", F.explode(F.array(segment, second)).alias("k")).where("k is not null")
    parts = [
        write(named, "client", c("k"), c("service"), at(0, c("hint_seq"))),
        write(urls, "host", c("k"), c("target"), at(1, c("hint_seq"))),
        write(inner, "host", c("k"), c("target"), at(2, c("hint_seq"))),
        write(inner, "client", c("k"), c("target"), at(2, c("hint_seq"))),
        write(plain, "fragment", c("k"), c("service"), at(3, c("hint_seq"))),
        write(env, "env", c("k"), c("target"), at(4, c("hint_seq"))),
        write(client_keys, "client", c("k"), c("target"), at(5, c("hint_seq"))),
        write(own, "client", c("k"), c("service"), at(6)),
        write(pieces, "fragment", c("k"), c("service"), at(7)),
        write(paths, "fragment", c("k"), c("service"), at(8, c("ep_seq")), True),
    ]
    return reduce(DataFrame.unionByName, parts).where("map_key <> ''")


def registry(writes: DataFrame) -> DataFrame:
    """(map, map_key, position, service): the maps after all writes."""
    keyed = writes.select(F.struct("map", "map_key").alias("map_key"), "service", "seq", "weak")
    return fold_registry(keyed).select("map_key.map", F.col("map_key.map_key").alias("map_key"), "position", "service")


def external_name(host: Column) -> Column:
    """The well-known service of a host: an exact one, else the first that it ends with or whose first label it holds."""
    exact = reduce(lambda later, x: F.when(host == x[0], x[1]).otherwise(later), reversed(EXTERNAL), F.lit(None).cast("string"))
    loose = reduce(lambda later, x: F.when(host.endswith(x[0]) | F.contains(host, F.lit(x[0].split(".")[0] + ".")), x[1]).otherwise(later), reversed(EXTERNAL), F.lit(None).cast("string"))
    return F.coalesce(exact, loose)


def _after(url: Column) -> Column:
    """The path of a URL, '/' where it has none; templates count as one segment each."""
    place = F.regexp_extract(F.regexp_replace(url, r"\$?\{[^}]*\}", "placeholder"), r"^\w+://[^/?#]+([^?#]*)", 1)
    return F.when(place == "", "/").otherwise(place)


def _variable(url: Column) -> Column:
    """The name that a URL begins with: ${NAME}, {NAME}, NAME + '..' or '..' + NAME."""
    forms = [r"^\$\{\s*(?:\w+\.)*(\w+)[^}]*\}", r"^\{\s*(?:\w+\.)*(\w+)[^}]*\}", r"^(?:\w+\.)*(\w+)\s*\+", r"\+\s*(?:\w+\.)*(\w+)\s*$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms])


def _rest(url: Column) -> Column:
    """What follows the variable, as a normal path."""
    tail = F.regexp_replace(F.regexp_replace(url, r"^\$?\{[^}]*\}|^[\w.]+\s*\+\s*", ""), "[\"'`]", "")
    return template_path(F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))


def resolve(calls: DataFrame, services: DataFrame, hints: DataFrame, endpoints: DataFrame, maps: DataFrame) -> DataFrame:
    """calls with resolved_service, resolved_path, confidence and rank; 0 and nulls where no rank finds a service.

    The ranks by equality are tried on all calls, those by containment only on what is left after them.
    """
    c = F.col
    maps = written(maps, "registry")  # every rank looks it up
    # every rank reads the calls again, so host and variable are found once
    calls = written(calls.withColumns({"url_host": url_host(F.regexp_replace("raw_url", r"\$?\{[^}]*\}", "placeholder")), "var": _variable(c("raw_url"))}), "calls")
    at = lambda name, key: maps.where(c("map") == name).select(c("map_key").alias(key), c("service").alias("target"), "position")
    other = lambda df: df.where(c("target") != c("service"))
    first_ = place(F.lit(0), F.lit(0), F.lit(0))
    give = lambda df, rank, path, tie=first_: df.select("call_id", F.lit(rank).alias("rank"), tie.alias("tie"), c("target"), path.cast("string").alias("resolved_path"))
    web = calls.where(c("raw_url").startswith("http"))
    out = [give(calls.where(c("pre_service").isNotNull()).withColumn("target", c("pre_service")), "0", c("pre_path"))]
    out.append(give(web.withColumn("target", external_name(c("url_host"))).where("target is not null"), "1", _after(c("raw_url"))))
    bare = calls.where(c("raw_url").rlike(r"^[A-Za-z_$][A-Za-z0-9_.]*$"))
    values = hints.select("svc_seq", "hint_seq", F.explode(F.array_distinct(F.array(F.upper("key"), upper_snake(c("key"))))).alias("k"), "value").where("value is not null")
    values = first_of(values, ["k"], ["svc_seq", "hint_seq"]).select("k", "value")
    last = F.element_at(F.split("raw_url", r"\."), -1)
    said = bare.withColumn("k", F.explode(F.array_distinct(F.array(upper_snake(last), F.upper(last))))).join(values, "k").where(c("value").startswith("http"))
    said = said.withColumn("value_host", url_host(c("value")))
    out.append(give(said.withColumn("target", external_name(c("value_host"))).where("target is not null"), "2a", _after(c("value"))))
    out.append(give(other(said.join(at("host", "value_host"), "value_host")), "2b", _after(c("value"))))
    scheme = calls.withColumn("name", F.regexp_extract("raw_url", r"^(?:feign|lb)://([^/]+)", 1)).where("name <> ''")
    where = F.regexp_extract("raw_url", r"^\w+://[^/]+([^?#]*)", 1)
    where = template_path(F.when(where == "", "/").otherwise(where))
    clients = at("client", "k")
    out.append(give(other(scheme.withColumn("k", F.explode(F.array_distinct(F.array("name", F.lower("name"))))).join(clients, "k")), "3a", where))
    guessed = guess_by_name(scheme.select(c("call_id").alias("id"), "svc_seq", "service", "name"), services, every=True)
    out.append(give(scheme.join(guessed.withColumnRenamed("id", "call_id"), "call_id"), "3b", where))
    out.append(give(other(calls.where(~c("raw_url").rlike(r"[/{]|^http")).withColumn("k", c("raw_url")).join(clients, "k")), "3c", F.lit(None)))
    path = F.when(~_after(c("raw_url")).startswith("/placeholder"), _after(c("raw_url")))
    hosts = at("host", "url_host")
    out.append(give(other(web.join(hosts, "url_host")), "4a", path))
    for rank, pattern in (("4b", r"^([^.]+)\.[^.]+\.svc(?:\.cluster\.local)?$"), ("4c", r"^([^.]+)\.service\.consul$")):
        short = web.withColumn("k", F.regexp_extract("url_host", pattern, 1)).where("k <> ''")
        out.append(give(other(short.join(clients, "k")), rank, _after(c("raw_url"))))
    variable = calls.where("var is not null").withColumn("k", F.explode(F.array_distinct(F.array(F.upper("var"), upper_snake(c("var"))))))
    out.append(give(other(variable.join(at("env", "k"), "k")), "5a", _rest(c("raw_url"))))
    keys = guess_by_key(calls.where("var is not null").select(c("call_id").alias("id"), "svc_seq", "service", c("var").alias("key")), services, every=True)
    out.append(give(calls.join(keys.withColumnRenamed("id", "call_id"), "call_id"), "5b", _rest(c("raw_url"))))
    valued = variable.join(values, "k").withColumn("value_host", url_host(c("value")))
    out.append(give(other(valued.join(at("host", "value_host"), "value_host")), "5c", _rest(c("raw_url"))))
    first = written(reduce(DataFrame.unionByName, out), "candidates")
    left = calls.join(first, "call_id", "left_anti")
    late = []
    for rank, name, least in (("6", "fragment", 3), ("7", "client", 4)):
        held = holding(left.select("call_id", "service", "raw_url", F.lower("raw_url").alias("url")), "url", at(name, "k"), "k", least)
        tail = F.substring(c("raw_url"), F.instr(F.lower("raw_url"), c("k")) + F.length("k"), F.length("raw_url"))
        late.append(give(other(held), rank, F.when(tail == "", "/").otherwise(tail), c("position")))
    same = endpoints.select(template_path(c("path")).alias("n"), c("service").alias("target"), "svc_seq", "ep_seq")
    own = left.where(c("raw_url").startswith("/")).withColumn("n", template_path(c("raw_url"))).drop("svc_seq", "ep_seq").join(same, "n")
    late.append(give(other(own), "8", c("raw_url"), place(c("svc_seq"), F.lit(0), c("ep_seq"))))
    best = reduce(DataFrame.unionByName, [first, *late])
    best = best.groupBy("call_id").agg(F.min(F.struct("rank", "tie", "target", "resolved_path")).alias("b"))
    sure = F.create_map(*[F.lit(x) for pair in ({"0": 0.95} | CONFIDENCE).items() for x in pair])
    found = best.select("call_id", c("b.target").alias("resolved_service"), c("b.resolved_path").alias("resolved_path"), F.element_at(sure, c("b.rank")).alias("confidence"), c("b.rank").alias("rank"))
    return calls.drop("url_host", "var", "confidence", "rank").join(found, "call_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def target_endpoints(resolved: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call_id, to_svc, to_ep, to_label): the endpoint that a resolved call means: same method first, then order; by path or full path."""
    places = endpoints.select("service", "svc_seq", "ep_seq", F.col("method").alias("to_method"), "full_path", F.explode(F.array_distinct(F.array(template_path(F.col("path")), template_path(F.col("full_path"))))).alias("n"))
    wanted = resolved.where("resolved_service is not null and resolved_path is not null").select("call_id", "method", F.col("resolved_service").alias("service"), template_path(F.col("resolved_path")).alias("n"))
    both = wanted.join(places, ["service", "n"])
    best = first_of(both, ["call_id"], [F.col("to_method") != F.col("method"), "svc_seq", "ep_seq"])
    return best.select("call_id", F.col("svc_seq").alias("to_svc"), F.col("ep_seq").alias("to_ep"), F.concat_ws(" ", "to_method", "full_path").alias("to_label"))


#: Depth at which a chain ends.
DEPTH = 20


def call_chains(endpoints: DataFrame, resolved: DataFrame, targets: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Nodes of the chains from every endpoint with a call: root, node_path, depth, service, endpoint, raw_url, kind flags.

    A node that is on its own path already is a cycle and isn't expanded; a call without a service is an unresolved
    leaf; one without an endpoint is a leaf that counts as unresolved below 0.5. Each level is a written table.
    """
    c = F.col
    label = F.concat_ws(" ", "method", "full_path")
    nodes = endpoints.select(F.struct("svc_seq", "ep_seq").alias("ep"), "service", label.alias("endpoint"))
    edges = resolved.join(targets, "call_id", "left").select(
        F.struct("svc_seq", "ep_seq").alias("ep"), "call_seq", "raw_url", F.coalesce("resolved_service", F.lit("unknown")).alias("to_service"),
        F.when(c("to_ep").isNotNull(), F.struct(c("to_svc").alias("svc_seq"), c("to_ep").alias("ep_seq"))).alias("to"),
        F.coalesce("to_label", F.concat_ws(" ", "method", F.coalesce("resolved_path", "raw_url"))).alias("to_label"), c("confidence"),
    )
    edges = written(edges, "chain-edges")
    roots = nodes.join(edges.select("ep").distinct(), "ep", "left_semi")
    level = roots.select(c("ep").alias("root"), F.array().cast("array<int>").alias("node_path"), F.lit(0).alias("depth"), "ep", F.array("ep").alias("seen"), "service", "endpoint", F.lit(None).cast("string").alias("raw_url"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_cycle"), F.lit(False).alias("is_unresolved"))
    levels = [written(level, "chain-level")]
    while len(levels) <= depth:
        open_ = levels[-1].where("ep is not null and not is_cycle").select("root", "node_path", "depth", "ep", "seen")
        step = open_.join(edges, "ep")
        again = F.coalesce(F.array_contains("seen", c("to")), F.lit(False))
        step = step.select("root", F.concat("node_path", F.array("call_seq")).alias("node_path"), (c("depth") + 1).alias("depth"), c("to").alias("ep"), F.concat("seen", F.array("to")).alias("seen"), c("to_service").alias("service"), c("to_label").alias("endpoint"), "raw_url", "confidence", again.alias("is_cycle"), (c("to").isNull() & ((c("to_service") == "unknown") | (c("confidence") < 0.5))).alias("is_unresolved"))
        step = written(step, "chain-level")
        if step.isEmpty():
            break
        levels.append(step)
    out = reduce(DataFrame.unionByName, levels)
    parents = out.where("depth > 0").select("root", F.slice("node_path", 1, F.size("node_path") - 1).alias("node_path"), F.lit(True).alias("calls")).distinct()
    out = out.join(parents, ["root", "node_path"], "left").withColumn("is_leaf", c("calls").isNull())
    names = nodes.select(c("ep").alias("root"), c("service").alias("root_service"), c("endpoint").alias("root_endpoint"))
    return out.join(names, "root").select("root_service", "root_endpoint", "node_path", "depth", "service", "endpoint", "raw_url", "confidence", "is_cycle", "is_unresolved", "is_leaf")


def chain_edges(chains: DataFrame) -> DataFrame:
    """One edge of a chain for each (calling endpoint, called service): the most confident, at the place of the first."""
    node = ["root_service", "root_endpoint"]
    up = chains.select(*node, F.col("node_path").alias("up_path"), F.col("service").alias("from_service"), F.col("endpoint").alias("from_endpoint"))
    down = chains.where("depth > 0").select(*node, "node_path", F.slice("node_path", 1, F.size("node_path") - 1).alias("up_path"), F.col("service").alias("to_service"), F.col("endpoint").alias("to_endpoint"), "raw_url", "confidence")
    both = down.join(up, [*node, "up_path"])
    # arrays order by their items, so the first visit of the walk is the least path, and a later one must be surer to win
    best = F.max_by(F.struct("to_endpoint", "raw_url", "confidence"), F.struct("confidence", F.transform("node_path", lambda x: -x)))
    out = both.groupBy(*node, "from_service", "from_endpoint", "to_service").agg(F.min("node_path").alias("place"), best.alias("b"))
    rank = F.row_number().over(Window.partitionBy(*node).orderBy("place"))
    return out.select(*node, rank.alias("edge_seq"), "from_service", "from_endpoint", "to_service", "b.to_endpoint", "b.raw_url", "b.confidence")
