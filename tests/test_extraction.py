"""Extraction, detection and resolution on small sources written here, with rows expected by hand."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from wirechart.operators import calls, detect, endpoints, facts, reports, resolve, usage
from wirechart.plugins import Plugin, Registry
from wirechart.sources import files as sources


def files(spark, *rows):
    return spark.createDataFrame([("svc", p, c) for p, c in rows], "service string, path string, content string")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_express_routes_and_their_calls(spark):
    text = "const router = express.Router();\n// lists things\nrouter.get('/things', async (req, res) => {\n  const r = await fetch('http://other/api', { method: 'POST' });\n});\n\nrouter.delete(\"/things/:id\", auth, removeThing);\n"
    f = files(spark, ("src/things.router.ts", text), ("null.ts", None))
    found = endpoints.express(f)
    assert got(found, "line", "method", "full_path", "handler", "summary") == [(3, "GET", "/things", None, "lists things"), (7, "DELETE", "/things/:id", "removeThing", "lists things")]
    out = calls.by_handler(calls.outbound_calls(f, "typescript"), found, f, "typescript", reach=20)
    assert got(out, "line", "head", "method", "raw_url") == [(4, 3, "POST", "http://other/api")]


def test_spring_prefix_verbs_and_bodies(spark):
    text = '@RestController\n@RequestMapping("/api/stock")\npublic class StockController {\n  /** Finds one. */\n  @GetMapping("/{sku}")\n  public ResponseEntity<StockDto> one(@PathVariable String sku) {\n    if (sku.isEmpty()) {\n      restTemplate.getForObject(baseUrl + "/x", X.class);\n    }\n    return null;\n  }\n  @RequestMapping(value = "/all", method = RequestMethod.PUT)\n  public void all(@RequestBody StockDto dto) {\n  }\n}\n'
    f = files(spark, ("StockController.java", text))
    found = endpoints.spring(f)
    assert got(found, "line", "method", "full_path", "controller", "handler", "request", "response") == [(5, "GET", "/api/stock/{sku}", "StockController", "one", None, "StockDto"), (12, "PUT", "/api/stock/all", "StockController", "all", "StockDto", None)]
    out = calls.conditional(calls.by_handler(calls.outbound_calls(f, "java"), found, f, "java"), f)
    assert got(out, "line", "head", "raw_url", "confidence", "conditional", "condition_hint") == [(8, 5, 'baseUrl + "/x"', 0.7, True, "if sku.isEmpty()")]


def test_aspnet_fills_the_controller_in(spark):
    text = '[ApiController]\n[Route("api/[controller]")]\npublic class MailController : ControllerBase\n{\n    [HttpGet]\n    public IActionResult All()\n    {\n    }\n    [HttpPost("send")]\n    public async Task<ActionResult<MailDto>> Send([FromBody] MailRequest m)\n    {\n    }\n}\n'
    assert got(endpoints.aspnet(files(spark, ("M.cs", text))), "method", "full_path", "handler", "request", "response") == [("GET", "/api/mail", "All", None, None), ("POST", "/api/mail/send", "Send", "MailRequest", "MailDto")]


def test_python_frameworks(spark):
    fast = 'router = APIRouter(prefix="/old")\n@router.post("/e", response_model=Out)\nasync def make(body: In, db: Session = Depends(get)) -> Out:\n    """Makes one."""\n    return 1\n'
    main = 'app.include_router(router, prefix="/api")\n'
    flask = '@bp.route("/x", methods=["GET", "post"])\ndef x():\n    pass\n\n@bp.route("/y")\ndef y():\n    pass\n'
    urls = 'urlpatterns = [path("mails/bulk/", views.bulk), path("z/", views.Z.as_view())]\nrouter.register(r"mails", MailViewSet)\n'
    views = '@api_view(["POST"])\ndef bulk(request):\n    pass\n\nclass MailViewSet(viewsets.ViewSet):\n    def list(self, request):\n        pass\n    def retrieve(self, request, pk):\n        pass\n'
    assert got(endpoints.fastapi(files(spark, ("a.py", fast), ("main.py", main))), "method", "full_path", "handler", "request", "response", "summary") == [("POST", "/api/e", "make", "In", "Out", "Makes one.")]
    assert got(endpoints.flask(files(spark, ("f.py", flask))), "method", "full_path", "handler") == [("GET", "/x", "x"), ("GET", "/y", "y"), ("POST", "/x", "x")]
    assert got(endpoints.django(files(spark, ("urls.py", urls), ("views.py", views))), "method", "full_path", "handler") == [("GET", "/api/mails", "list"), ("GET", "/api/mails/{id}", "retrieve"), ("POST", "/mails/bulk", "bulk")]


def test_go_groups_blocks_and_mux(spark):
    text = 'v1 := r.Group("/api")\no := v1.Group("/orders")\no.GET("/:id", h.Get)\no.POST("", create)\nr.Route("/chi", func(r chi.Router) {\n\tr.Get("/a", listA)\n})\nm.HandleFunc("/m", show).Methods("GET", "PUT")\nhttp.HandleFunc("/p", plain)\nfunc create(c *gin.Context) {\n\tvar in OrderIn\n\tc.ShouldBindJSON(&in)\n\tout := OrderOut{}\n\tc.JSON(200, out)\n}\n'
    found = got(endpoints.go_routes(files(spark, ("m.go", text))), "method", "full_path", "handler", "request", "response")
    assert found == [("GET", "/api/orders/:id", "Get", None, None), ("GET", "/chi/a", "listA", None, None), ("GET", "/chi/a", "listA", None, None), ("GET", "/m", "show", None, None), ("GET", "/p", "plain", None, None), ("POST", "/api/orders/", "create", "OrderIn", "OrderOut"), ("PUT", "/m", "show", None, None)]


def test_feign_grpc_and_graphql_calls(spark):
    feign = '@FeignClient(name = "stock")\npublic interface Stock {\n  @GetMapping("/s/{id}")\n  S get(String id);\n}\n'
    assert got(calls.feign_calls(files(spark, ("S.java", feign))), "method", "raw_url", "pre_service", "confidence") == [("GET", "feign://stock/s/{id}", "stock", 0.95)]
    go = 'conn, _ := grpc.Dial("stock:50051")\nc := pb.NewStockClient(conn)\n'
    assert got(calls.grpc_calls(files(spark, ("g.go", go)), "go"), "raw_url", "confidence") == [("grpc-service://Stock", 0.75), ("grpc://stock:50051", 0.9)]
    assert got(calls.graphql_calls(files(spark, ("q.ts", "const q = gql`query GetThings { a }`;\n"))), "raw_url") == [("graphql-operation://GetThings",)]


def test_payload_types_and_hints(spark):
    java = "public record Ask(@NotNull String id, List<Long> ids) {}\n"
    rows = facts.payload_types(files(spark, ("Ask.java", java)), "java").collect()
    assert [(f.name, f.type, f.required) for f in rows[0].fields] == [("id", "string", True), ("ids", "long[]", False)]
    py = "@dataclass\nclass A:\n    x: Optional[int] = None\n    y: datetime\n\nclass Plain:\n    z: int\n"
    rows = facts.payload_types(files(spark, ("a.py", py)), "python").collect()
    assert [(r.type_name, [(f.name, f.type, f.required) for f in r.fields]) for r in rows] == [("A", [("x", "integer", False), ("y", "datetime", True)])]
    assert got(facts.url_hints(files(spark, ("a.py", 'U = os.getenv("STOCK_URL", "http://stock:1")\n'), (".env", "STOCK_URL=http://env:2\n")), "python"), "key", "value") == [("STOCK_URL", "http://env:2")]


def test_messages_stores_and_libraries(spark):
    ts = "@EventPattern('made')\nawait prisma.user.findMany();\nclient.emit('done', x);\nconst q = `SELECT * FROM orders`;\n"
    f = files(spark, ("a.ts", ts))
    assert got(usage.messages(f, "typescript"), "topic", "direction") == [("done", "publish"), ("made", "subscribe")]
    assert got(usage.stores(f, "typescript"), "name", "db_type", "access") == [("orders", "sql", "raw"), ("users", "sql", "prisma")]
    entity = "@Entity\npublic class OrderItem {\n"
    assert got(usage.stores(files(spark, ("O.java", entity)), "java"), "name") == [("order_item",)]


def test_detection_names_and_plugins(spark):
    f = spark.createDataFrame([("a", "go.mod", "module x"), ("b", "inner/go.mod", ""), ("c", "Cargo.toml", ""), ("d", "main.py", None)], "service string, path string, content string")
    plugins = Registry()
    plugins.register(Plugin("rust", "rust", lambda: F.col("path") == "Cargo.toml", lambda own: own.select("service", "path", F.lit("GET").alias("method"))))
    found = detect.detect(f, plugins.rules())
    assert got(found, "service", "language", "confidence") == [("a", "go", 0.95), ("b", "unknown", 0.0), ("c", "rust", 0.5), ("d", "python", 0.6)]
    assert got(plugins.endpoints(f, found), "service", "method") == [("c", "GET")]
    plugins.unregister("rust")
    assert plugins.endpoints(f, found) is None


def test_trees_keep_dot_names_and_report_what_fails(spark, tmp_path):
    root = tmp_path / "build" / "svc"
    (root / "node_modules").mkdir(parents=True)
    (root / "app").mkdir()
    (root / "node_modules" / "x.py").write_text("no")
    (root / ".env").write_text("A_URL=http://a")
    (root / "app" / "__init__.py").write_text("")
    (root / "app" / "bad.py").write_bytes(b"\xff\xfe\xfa")
    found = sources.source_files(spark, {"svc": str(root)})
    assert got(found, "path", F.col("error").isNull().alias("ok")) == [(".env", True), ("app/__init__.py", True), ("app/bad.py", False)]
    assert got(sources.of_language(found, "python"), "path") == [(".env",), ("app/__init__.py",), ("app/bad.py",)]
    (root / ".wirechart.json").write_text('{"depth": 2, "out": "x"}')
    assert sources.settings(str(root), {"depth": 5, "out": None}) == {"depth": 5, "out": "x"}


def test_roots_skip_workspaces_and_what_lies_below(spark):
    rows = [("package.json", '{"workspaces": []}'), ("a/go.mod", ""), ("a/b/pom.xml", ""), ("x/y/z/w/go.mod", ""), ("c/requirements.txt", ""), ("c/package.json", "{}")]
    f = spark.createDataFrame([("r", p, c) for p, c in rows], "root string, path string, content string")
    assert got(sources.service_roots(f), "folder", "marker", "language") == [("a", "go.mod", "go"), ("c", "requirements.txt", "python")]


@pytest.fixture(scope="module")
def graph(spark):
    services = spark.createDataFrame([(0, "user-service"), (1, "order-service"), (2, "mail")], "svc_seq int, service string")
    hints = spark.createDataFrame([(1, 0, "order-service", "USER_SERVICE_URL", "http://users.internal:80"), (1, 1, "order-service", "PAY_URL", "https://api.stripe.com/v1/x"), (2, 0, "mail", "ORDER_BASE", "http://user-service/a")], "svc_seq int, hint_seq int, service string, key string, value string")
    ends = spark.createDataFrame([(0, 0, "user-service", "GET", "/users/{id}", "/users/{id}"), (1, 0, "order-service", "POST", "/orders", "/api/orders"), (2, 0, "mail", "POST", "/mails", "/mails")], "svc_seq int, ep_seq int, service string, method string, path string, full_path string")
    urls = ["http://user-service/users/1", "feign://UserService/users/{id}", "user-service", "PAY_URL", "USER_SERVICE_URL", "http://users.internal/users/2", "http://user-service.ns.svc.cluster.local/users", "http://user-service.service.consul/u", "${USER_SERVICE_URL}/users/${id}", "{cfg.userServiceHost}/users", "gw://x/user-service/z", "/mails", "https://api.github.com/repos", "http://nowhere/", "http://order-service/orders"]
    rows = [(i, 1, 0, i, "order-service", "GET", u, None, None) for i, u in enumerate(urls)]
    c = spark.createDataFrame(rows, "call_id int, svc_seq int, ep_seq int, call_seq int, service string, method string, raw_url string, pre_service string, pre_path string")
    maps = resolve.registry(resolve.registry_writes(services, hints, ends))
    return services, hints, ends, c, maps, resolve.resolve(c, services, hints, ends, maps)


def test_ranks(graph):
    found = {r.raw_url: (r["rank"], r.resolved_service, r.resolved_path) for r in graph[5].collect()}
    assert found == {
        "http://user-service/users/1": ("6", "user-service", "/users/1"),
        "feign://UserService/users/{id}": ("3a", "user-service", "/users/{x}"),
        "user-service": ("3c", "user-service", None),
        "PAY_URL": ("2a", "stripe-api", "/v1/x"),
        "USER_SERVICE_URL": ("2b", "user-service", "/"),
        "http://users.internal/users/2": ("4a", "user-service", "/users/2"),
        "http://user-service.ns.svc.cluster.local/users": ("4b", "user-service", "/users"),
        "http://user-service.service.consul/u": ("4c", "user-service", "/u"),
        "${USER_SERVICE_URL}/users/${id}": ("5a", "user-service", "/users/{x}"),
        "{cfg.userServiceHost}/users": ("5b", "user-service", "/users"),
        "gw://x/user-service/z": ("6", "user-service", "/z"),
        "/mails": ("6", "mail", "s"),
        "https://api.github.com/repos": ("1", "github-api", "/repos"),
        "http://nowhere/": (None, None, None),
        "http://order-service/orders": (None, None, None),
    }


def test_chains_with_a_cycle_and_unresolved_leaves(spark, graph):
    services, hints, ends, c, maps, _ = graph
    rows = [(0, 1, 0, 1, "order-service", "GET", "http://user-service/users/{id}", None, None), (1, 0, 0, 1, "user-service", "POST", "http://order-service/orders", None, None), (2, 0, 0, 2, "user-service", "GET", "http://nowhere/", None, None)]
    own = spark.createDataFrame(rows, c.schema)
    resolved = resolve.resolve(own, services, hints, ends, maps)
    chains = resolve.call_chains(ends, resolved, resolve.target_endpoints(resolved, ends))
    first = chains.where("root_service = 'order-service'")
    assert [tuple(r) for r in first.orderBy("node_path").select("node_path", "service", "is_cycle", "is_unresolved", "is_leaf").collect()] == [([], "order-service", False, False, False), ([1], "user-service", False, False, False), ([1, 1], "order-service", True, False, True), ([1, 2], "unknown", False, True, True)]
    assert got(resolve.chain_edges(first), "edge_seq", "from_service", "to_service") == [(1, "order-service", "user-service"), (2, "user-service", "order-service"), (3, "user-service", "unknown")]
    assert [r.text for r in reports.trace(chains, "POST /api/orders").collect()][2] == "    order-service POST /api/orders (cycle)"


def test_diffs_by_type_and_repeated_keys(spark, tmp_path):
    schema = "service string, method string, path string, seq int, body_type string, body_fields map<string,string>, response_type string, response_fields map<string,string>"
    row = lambda path, seq, body, response: ("s", "POST", path, seq, "object", body, response, None)
    before = spark.createDataFrame([row("/a", 0, {"x": "s"}, "object"), row("/a", 1, {"y": "s"}, "object"), row("/b", 0, None, "object"), row("/c", 0, {"k": "s"}, "array")], schema)
    after = spark.createDataFrame([row("/a", 0, {"y": "s", "n": "s"}, "object"), row("/c", 0, {"k": "s"}, "object"), row("/d", 0, None, None)], schema)
    changes = reports.diff_documents(before, after)
    assert got(changes, "path", "change", "severity", "removed_fields", "added_fields") == [("/a", "changed", "non-breaking", "", "n"), ("/b", "removed", "breaking", "", ""), ("/c", "changed", "breaking", "", ""), ("/d", "added", "non-breaking", "", "")]
    assert reports.exit_code(changes) == 1 and reports.exit_code(changes.where("severity <> 'breaking'")) == 0
    saved = json.loads(reports.document(changes=changes.select("path", "change")).first().document)
    assert saved["meta"]["schemaVersion"] == "1.0" and len(saved["changes"]) == 4


def test_a_burst_of_changes_is_one_rescan(spark, tmp_path):
    import os
    import time

    from wirechart.streaming.watch import watch

    root = tmp_path / "svc"
    root.mkdir()
    seen = []
    (root / "a.py").write_text("1")
    (root / "b.txt").write_text("1")
    at = time.time() - 5
    os.utime(root / "a.py", (at, at))
    query = watch(spark, {"svc": str(root)}, lambda _, services: seen.append(services), str(tmp_path / "checkpoint"), quiet_ms=200, since=0)
    try:
        end = time.time() + 60
        while not seen and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen == [["svc"]]


_DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["source_endpoints", "source_calls", "payload_types", "url_hints", "detect_services", "resolve_calls", "call_chains", "diff_documents"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__

    con = duckdb.connect()
    for table in ("nation", "supplier", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{_DATA}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, _DATA)
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in found.collect()))) == sorted(map(str, cursor.fetchall()))
