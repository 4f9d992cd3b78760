"""A whole scan: from the folders of services to every table of the model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirechart.operators import calls as C
from wirechart.operators import detect as D
from wirechart.operators import endpoints as E
from wirechart.operators import facts as T
from wirechart.operators import interfaces as I
from wirechart.operators import payloads as B
from wirechart.operators import reports as P
from wirechart.operators import resolve as S
from wirechart.operators import usage as U
from wirechart.plugins import Registry, registry
from wirechart.sources import files as sources
from wirechart.storage import written

#: Express handlers are often passed by name: their calls are looked for so many lines after the route.
EXPRESS_REACH = 20


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Languages that a TypeScript service without endpoints is tried in, by the files at its root that speak for them; the first counts.
OTHERS = [("java", ["pom.xml", "build.gradle", "build.gradle.kts"]), ("go", ["go.mod"]), ("python", ["requirements.txt", "pyproject.toml"])]
#: Fixed value: the confidence of a language that a service is read by after all.
SECOND = 0.9


def candidates(files: DataFrame, detected: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(service, language, detected_from): TypeScript services without endpoints and what else their root speaks for, one language each."""
    rules = F.create_map(*[F.lit(x) for i, (language, names) in enumerate(OTHERS) for j, n in enumerate(names) for x in (n, f"{i}{j} {language}")])
    empty = detected.where("language = 'typescript'").select("service").join(endpoints.select("service").distinct(), "service", "left_anti")
    said = files.where(F.col("path").isin([n for _, names in OTHERS for n in names])).join(empty, "service", "left_semi")
    best = said.groupBy("service").agg(F.min(F.struct(F.element_at(rules, F.col("path")).alias("rule"), F.col("path").alias("detected_from"))).alias("b"))
    return best.select("service", F.element_at(F.split("b.rule", " "), 2).alias("language"), "b.detected_from")


def _of(files: DataFrame, services: DataFrame, language: str) -> DataFrame:
    own = files.join(services.where(F.col("language") == language).select("service"), "service", "left_semi")
    return sources.of_language(own, language).select("service", "path", "content")


def languages(files: DataFrame, detected: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(services with the language that each is read by, endpoints of all).

    A TypeScript service without endpoints may be a repository of several languages: it is read a second time by the language
    that ``candidates`` names, and goes over to it if that finds endpoints. Only such services are read twice.
    """
    present = {r.language for r in detected.select("language").distinct().collect()}
    found = [written(E.richest(E.endpoints(_of(files, detected, x), x)), "endpoints") for x in sources.LANGUAGES if x in present]
    if "typescript" not in present:
        return detected, _all(found) if found else None
    again = written(candidates(files, detected, _all(found)), "candidates")
    named = {r.language for r in again.select("language").distinct().collect()}
    more = [written(E.richest(E.endpoints(_of(files, again, x), x)), "endpoints") for x, _ in OTHERS if x in named]
    if not more:
        return detected, _all(found)
    over = again.join(_all(more).groupBy("service").agg(F.first("framework").alias("framework")), "service")
    over = over.select("service", F.col("language").alias("_language"), F.col("framework").alias("_framework"), F.col("detected_from").alias("_from"))
    out = detected.join(over, "service", "left")
    moved = F.col("_language").isNotNull()
    news = {"language": F.coalesce("_language", "language"), "framework": F.coalesce("_framework", "framework"), "confidence": F.when(moved, F.lit(SECOND)).otherwise(F.col("confidence"))}
    if "detected_from" in detected.columns:
        news["detected_from"] = F.coalesce("_from", "detected_from")
    return written(out.withColumns(news).select(*detected.columns), "services"), _all([*found, *more])


def extract(files: DataFrame, plugins: Registry = registry) -> dict[str, DataFrame]:
    """services, endpoints, calls, hints, types, messages, stores and imports of files(service, path, content).

    Every service is read by the language that detection finds, or by another if that has no endpoints; GraphQL and, in Go, proto
    files add endpoints. Endpoints come with the shapes of their request and response types.
    """
    detected = written(D.detect(files, plugins.rules()), "services")
    tables: dict[str, list[DataFrame]] = {x: [] for x in ("endpoints", "calls", "hints", "types", "messages", "stores", "imports")}
    detected, every = languages(files, detected)
    present = {r.language for r in detected.select("language").distinct().collect()}
    # without any known language one stands for the columns of the empty tables
    for language in [x for x in sources.LANGUAGES if x in present] or ["typescript"]:
        own = _of(files, detected, language)
        if every is None:
            every = E.richest(E.endpoints(own, language))
        found = every.join(detected.where(F.col("language") == language).select("service"), "service", "left_semi")
        tables["endpoints"].append(found)
        made = [C.outbound_calls(own, language), C.grpc_calls(own, language), C.graphql_calls(own)]
        if language == "java":
            made.append(C.feign_calls(own))
        made = written(_all(made), "made")
        near = C.by_handler(made, found.where("framework <> 'express'"), own, language)
        if language == "typescript":
            near = near.unionByName(C.by_handler(made, found.where("framework = 'express'"), own, language, EXPRESS_REACH), allowMissingColumns=True)
        tables["calls"].append(C.conditional(near, own))
        tables["hints"].append(T.url_hints(own, language))
        tables["types"].append(T.payload_types(own, language))
        tables["messages"].append(U.messages(own, language))
        tables["stores"].append(U.stores(sources.capped(own), language))
        tables["imports"].append(U.imports(own, language).where(U.internal(F.col("import_path"), language)))
    schemas = sources.of_kind(files, sources.GRAPHQL)
    declared = I.graphql_endpoints(schemas).withColumnRenamed("endpoint", "full_path").withColumn("route", F.col("full_path"))
    rpcs = I.grpc_endpoints(sources.of_kind(files, sources.PROTOS)).withColumnRenamed("endpoint", "full_path").withColumn("route", F.col("full_path"))
    places = files.select("service", "path")
    tables["endpoints"].append(declared.join(places, "path").withColumn("line", F.lit(0)))
    tables["endpoints"].append(rpcs.join(places, "path").withColumn("line", F.lit(0)).join(detected.where("language = 'go'").select("service"), "service", "left_semi"))
    if (more := plugins.endpoints(files, detected)) is not None:
        tables["endpoints"].append(more)
    types = written(_all(tables.pop("types")), "types")
    ends = B.with_payloads(_all(tables.pop("endpoints")), types)
    return {"services": detected, "types": types, "endpoints": written(ends, "endpoints")} | {name: written(_all(parts), name) for name, parts in tables.items()}


def connect(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """resolved calls, chains, their edges and shared libraries of extracted tables."""
    order = F.row_number().over(Window.orderBy("service")) - 1  # services are few; calls and endpoints are numbered within them
    services = written(tables["services"].select("service").withColumn("svc_seq", order), "numbered")
    own = Window.partitionBy("service").orderBy("path", "line", "method", "full_path")
    ends = tables["endpoints"].withColumn("ep_seq", F.row_number().over(own) - 1).join(services, "service").withColumn("path_", F.concat(F.lit("/"), F.regexp_replace("route", "^/", "")))
    place = ends.select("service", F.col("path").alias("head_path"), F.col("line").alias("head"), "svc_seq", "ep_seq")
    # a function may serve several routes: its calls belong to each
    calls = tables["calls"].join(first_at(place), ["service", "head_path", "head"]).withColumn("call_id", F.xxhash64("service", "path", "line", "call_seq", "raw_url", "ep_seq"))
    for c in ("pre_service", "pre_path"):
        if c not in calls.columns:
            calls = calls.withColumn(c, F.lit(None).cast("string"))
    ends = written(ends.select("svc_seq", "ep_seq", "service", "method", F.col("path_").alias("path"), "full_path", F.col("path").alias("file"), "line", "controller", "handler", "request", "response", "request_body", "response_body", "summary"), "ends")
    hints = tables["hints"].join(services, "service").withColumn("hint_seq", F.row_number().over(Window.partitionBy("service").orderBy("path", "line", "key")) - 1)
    hints = written(hints, "hints")
    maps = S.registry(S.registry_writes(services, hints, ends))
    resolved = written(S.resolve(written(calls, "calls"), services, hints, ends, maps), "resolved")
    chains = written(S.call_chains(ends, resolved, S.target_endpoints(resolved, ends)), "chains")
    return {"numbered_endpoints": ends, "numbered_hints": hints, "resolved": resolved, "chains": chains, "edges": S.chain_edges(chains), "libraries": U.shared_libraries(tables["imports"])}


def first_at(place: DataFrame) -> DataFrame:
    """One endpoint for each place: several methods of one handler share its calls."""
    return place.groupBy("service", "head_path", "head").agg(F.min(F.struct("svc_seq", "ep_seq")).alias("e")).select("service", "head_path", "head", "e.svc_seq", "e.ep_seq")


def scan(spark: SparkSession, roots: dict[str, str], plugins: Registry = registry) -> dict[str, DataFrame]:
    """All tables for the folders of named services; specifications come with their endpoints and dependencies."""
    files = written(sources.source_files(spark, roots).where("error is null"), "files")
    tables = extract(files.select("service", "path", "content"), plugins)
    documents = sources.of_kind(files, sources.SPECS).select(F.concat_ws("/", "service", "path").alias("path"), "content")
    specs = I.openapi_specs(documents)
    return tables | connect(tables) | {"specs": specs, "spec_endpoints": I.openapi_endpoints(documents), "dependencies": I.spec_dependencies(specs), "files": files.drop("content")}


def save_scan(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a scan as JSON lines below path."""
    P.save(path, **{n: t for n, t in tables.items() if n != "files"})
