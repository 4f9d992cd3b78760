"""Clients by their variables, Go handlers by their names, payloads of endpoints and services in another language."""

from pyspark.sql import functions as F

import wirechart
from wirechart.operators import calls, endpoints

from test_extraction import files, got


def test_a_handler_in_another_file_has_its_calls(spark):
    """Handlers are found by name over the files of a service, first in the route's own; one function may serve two routes."""
    main = 'package main\nfunc routes(r *gin.Engine) {\n\tr.GET("/a", h.List)\n\tr.GET("/b", own)\n\tr.POST("/c", h.List)\n}\nfunc own(c *gin.Context) {\n\thttp.Get("http://own/b")\n}\n'
    body = 'package handlers\nfunc (h *H) List(c *gin.Context) {\n\tif x {\n\t\thttp.Get("http://stock/a")\n\t}\n}\nfunc own(c *gin.Context) {\n\thttp.Get("http://other/b")\n}\nfunc helper() {\n\thttp.Get("http://nobody/x")\n}\n'
    f = files(spark, ("main.go", main), ("handlers/h.go", body))
    found = endpoints.go_routes(f)
    out = calls.by_handler(calls.outbound_calls(f, "go"), found, f, "go")
    assert got(out, "path", "line", "head_path", "head", "raw_url") == [("handlers/h.go", 4, "main.go", 3, "http://stock/a"), ("handlers/h.go", 4, "main.go", 5, "http://stock/a"), ("main.go", 8, "main.go", 4, "http://own/b")]


def test_grpc_calls_of_a_go_file_belong_to_its_endpoints(spark):
    text = 'func routes(r *gin.Engine) {\n\tr.GET("/a", one)\n\tr.GET("/b", two)\n}\nvar conn, _ = grpc.Dial("stock:50051")\n'
    f = files(spark, ("main.go", text))
    out = calls.by_handler(calls.grpc_calls(f, "go"), endpoints.go_routes(f), f, "go")
    assert got(out, "line", "head", "raw_url") == [(5, 2, "grpc://stock:50051"), (5, 3, "grpc://stock:50051")]


def test_a_scan_of_a_go_service_has_chains(spark, tmp_path):
    for name, other in (("front", "back"), ("back", "none")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "go.mod").write_text("module x\nrequire github.com/gin-gonic/gin v1\n")
        (tmp_path / name / "main.go").write_text(f'package main\nfunc routes(r *gin.Engine) {{\n\tr.GET("/{name}", handle)\n}}\n')
        (tmp_path / name / "handle.go").write_text(f'package main\nfunc handle(c *gin.Context) {{\n\thttp.Get("http://{other}/{other}")\n}}\n' if name == "front" else "package main\nfunc handle(c *gin.Context) {\n}\n")
    tables = wirechart.scan(spark, {x: str(tmp_path / x) for x in ("front", "back")})
    assert got(tables["edges"], "from_service", "from_endpoint", "to_service", "to_endpoint") == [("front", "GET /front", "back", "GET /back")]


def test_the_last_definition_before_a_call_counts(spark):
    text = 'c = httpx.Client(base_url="http://a")\nc.get("/1")\nc = httpx.Client(base_url=ORDERS_URL)\nc.post("2")\nd.get("/3")\nwith httpx.Client(timeout=1, base_url=os.environ["D_URL"]) as d:\n    d.get("/4")\n    d.get("http://else/5")\n'
    out = calls.outbound_calls(files(spark, ("a.py", text)), "python")
    assert got(out, "line", "method", "raw_url") == [(1, "GET", "http://a"), (2, "GET", "http://a/1"), (4, "POST", "${ORDERS_URL}/2"), (5, "GET", "${D_URL}/3"), (7, "GET", "${D_URL}/4"), (8, "GET", "http://else/5")]


def test_forms_of_clients(spark):
    sharp = 'var c = _factory.CreateClient("order-service");\nawait c.GetAsync("/x");\nvar m = new HttpRequestMessage(HttpMethod.Post, "http://a/y");\nawait z.SendAsync(m);\nvar o = new Orders.OrdersClient(channel);\nvar p = new Orders.OtherClient(channel);\n'
    f = files(spark, ("A.cs", sharp))
    assert got(calls.outbound_calls(f, "csharp"), "line", "method", "raw_url") == [(1, "GET", "order-service"), (2, "GET", "lb://order-service/x"), (3, "POST", "http://a/y")]
    assert got(calls.grpc_calls(f, "csharp"), "line", "raw_url") == [(5, "grpc-service://Orders")]
    java = 'this.web = RestClient.create("http://a/");\nweb.post()\n  .accept(JSON)\n  .uri("/x");\nnew Request.Builder().url(this.ordersUrl).build();\n'
    assert got(calls.outbound_calls(files(spark, ("A.java", java)), "java"), "line", "method", "raw_url") == [(2, "POST", "http://a/x"), (5, "GET", "ordersUrl")]
    assert got(calls.outbound_calls(files(spark, ("a.py", 'u = f"{ORDER_URL}/api/{i}"\n')), "python"), "method", "raw_url", "confidence") == [("GET", "{ORDER_URL}/api/{i}", 0.75)]


def test_stubs_and_documents_over_files(spark):
    f = files(spark, ("a.go", "var stock = pb.NewStockClient(conn)\n"), ("b.go", "stock.Take(ctx, in)\nmailClient.Send(context.Background(), m)\nother.Take(ctx, in)\n"))
    assert got(calls.grpc_calls(f, "go"), "path", "line", "raw_url") == [("a.go", 1, "grpc-service://Stock"), ("b.go", 1, "grpc-method://Stock/Take"), ("b.go", 2, "grpc-method://mailClient/Send")]
    q = files(spark, ("q.ts", "const A = gql`mutation MakeIt { a }`;\n"), ("r.ts", "useMutation(A);\nuseQuery(UNKNOWN);\n"), ("s.ts", "const z = gql`query Alone { b }`;\n"), ("t.go", 'c := graphql.NewClient("http://g/graphql")\nc.Run(ctx, req, &out)\n'))
    assert got(calls.graphql_calls(q), "path", "line", "method", "raw_url") == [
        ("r.ts", 1, "GRAPHQL_MUTATION", "graphql-operation://MakeIt"), ("r.ts", 2, "GRAPHQL_QUERY", "graphql-operation://UNKNOWN"), ("s.ts", 1, "GRAPHQL_QUERY", "graphql-operation://Alone"),
        ("t.go", 1, "GRAPHQL_QUERY", "http://g/graphql"), ("t.go", 2, "GRAPHQL_QUERY", "graphql-operation://req"),
    ]


def test_a_frontend_at_the_root_hides_no_backend(spark, tmp_path):
    """A service whose TypeScript has no endpoints is read by the language that its other marker names; payloads come with their fields."""
    shop = tmp_path / "shop"
    shop.mkdir()
    (shop / "package.json").write_text('{"dependencies": {"react": "1"}}')
    (shop / "page.ts").write_text("export const x = 1;\n")
    (shop / "requirements.txt").write_text("fastapi\n")
    (shop / "api.py").write_text('router = APIRouter()\nclass Ask(BaseModel):\n    n: int\n\n@router.post("/ask")\ndef ask(body: Ask) -> Answer:\n    httpx.get("http://stock/x")\n')
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "package.json").write_text("{}")
    (plain / "requirements.txt").write_text("")
    tables = wirechart.scan(spark, {"shop": str(shop), "plain": str(plain)})
    assert got(tables["services"], "service", "language", "confidence") == [("plain", "typescript", 0.7), ("shop", "python", 0.9)]
    assert got(tables["endpoints"], "service", "full_path", "request_body.type_name", F.element_at("request_body.fields.type", 1).alias("t"), "response_body.type_name", F.size("response_body.fields").alias("k")) == [("shop", "/ask", "Ask", "integer", "Answer", 0)]
    assert got(tables["resolved"], "service", "raw_url") == [("shop", "http://stock/x")]


def test_nested_types_end_at_cycles(spark):
    from wirechart.operators import payloads

    t = spark.createDataFrame([("s", "A", [("b", "B[]", True), ("x", "string", False)], "dto-class"), ("s", "B", [("a", "A", True)], "dto-class"), ("s", "C", [], "dto-class")], "service string, type_name string, fields array<struct<name: string, type: string, required: boolean>>, source string")
    assert got(payloads.nested(t), "root", "place", "depth", "is_cycle") == [("A", "b", 1, False), ("A", "b.a", 2, True), ("A", "x", 1, False), ("B", "a", 1, False), ("B", "a.b", 2, True), ("B", "a.x", 2, False)]


def test_several_topics_brokers_and_hidden_roots(spark):
    from wirechart.operators import facts, usage
    from wirechart.sources import files as sources

    java = '@KafkaListener(groupId = "g", topics = {"a", "b"})\n@SendTo("c")\n'
    assert got(usage.messages(files(spark, ("A.java", java)), "java"), "topic", "direction", "pattern") == [("a", "subscribe", "kafka"), ("b", "subscribe", "kafka"), ("c", "publish", "kafka")]
    python = '@app.task(name="mails.send")\ndef f():\n    pass\nconsumer.subscribe(["x", "y"])\n'
    assert got(usage.messages(files(spark, ("a.py", python)), "python"), "topic", "pattern") == [("mails.send", "redis-pubsub"), ("x", "kafka"), ("y", "kafka")]
    assert got(usage.messages(files(spark, ("a.ts", "await consumer.subscribe({ fromBeginning: true, topics: ['p', 'q'] });\n")), "typescript"), "topic") == [("p",), ("q",)]
    go = 'db.Model(&models.Order{}).Where()\n'
    assert got(usage.stores(files(spark, ("a.go", go)), "go"), "name", "access") == [("Order", "gorm-model")]
    roots = spark.createDataFrame([("r", p, "{}") for p in (".github/x/package.json", "node_modules/y/package.json", "z/package.json")], "root string, path string, content string")
    assert got(sources.service_roots(roots), "folder") == [("z",)]
    settings = '{\n  "Stock": {\n    "BaseUrl": "http://stock",\n    "Level": "info"\n  }\n}\n'
    sharp = 'services.AddHttpClient("mail-api", c => c.BaseAddress = new Uri("http://mail:1"));\nservices.AddHttpClient("plain");\n'
    assert got(facts.url_hints(files(spark, ("appsettings.json", settings), ("S.cs", sharp)), "csharp"), "key", "value") == [("BaseUrl", "http://stock"), ("HTTP_CLIENT_MAIL_API", "http://mail:1"), ("HTTP_CLIENT_PLAIN", "http://plain")]


def test_serializers_list_fields_of_models(spark):
    from wirechart.operators import facts

    models = "class Thing(models.Model):\n    name = models.CharField(max_length=9)\n    size = models.IntegerField(null=True)\n"
    own = 'class A(serializers.ModelSerializer):\n    class Meta:\n        model = models.Thing\n        fields = ["size", "extra"]\n\nclass B(serializers.ModelSerializer):\n    code = serializers.IntegerField()\n    class Meta:\n        model = Thing\n        fields = "__all__"\n\nclass C(serializers.ModelSerializer):\n    class Meta:\n        model = Thing\n        exclude = ("size",)\n'
    rows = facts.payload_types(files(spark, ("models.py", models), ("s.py", own)), "python").collect()
    assert {r.type_name: [(f.name, f.type, f.required) for f in r.fields] for r in rows if r.source == "serializer"} == {"A": [("size", "integer", False), ("extra", "any", False)], "B": [("code", "integer", True)], "C": [("name", "string", True)]}


def test_lists_of_serializers_have_no_longest_length(spark):
    from wirechart.operators import facts

    names = [f"f{i}" for i in range(60)]
    models = "class Thing(models.Model):\n" + "".join(f"    {x} = models.IntegerField()\n" for x in [*names, "last"])
    many = ",\n".join(f"            '{x}'" for x in names)
    own = f"class A(serializers.ModelSerializer):\n    class Meta:\n        model = Thing\n        fields = [\n{many},\n        ]\n        read_only_fields = ['last']\n\nclass B(serializers.ModelSerializer):\n    class Meta:\n        exclude = (\n{many})\n        model = Thing\n"
    rows = facts.payload_types(files(spark, ("models.py", models), ("s.py", own)), "python").collect()
    assert {r.type_name: [f.name for f in r.fields] for r in rows if r.source == "serializer"} == {"A": names, "B": ["last"]}


def test_messages_and_stores_name_what_is_sent_and_kept(spark):
    from wirechart.operators import usage

    sharp = 'channel.BasicPublish("", "jobs", null, body);\nchannel.BasicPublish(exchange: "all", routingKey: key);\nawait _bus.Publish(new OrderPaid(x));\n'
    assert got(usage.messages(files(spark, ("A.cs", sharp)), "csharp"), "topic", "pattern", "payload_type") == [("all", "rabbitmq", None), ("jobs", "rabbitmq", None), ("order-paid", "rabbitmq", "OrderPaid")]
    python = '@shared_task\ndef first():\n    def second():\n        pass\n@app.task(bind=True)\n\n\n\ndef far():\n    pass\nchannel.basic_publish(exchange="", routing_key="jobs")\n'
    assert got(usage.messages(files(spark, ("a.py", python)), "python"), "topic", "direction") == [("first", "subscribe"), ("jobs", "publish")]
    go = 'ch.Publish("", "jobs", false)\nch.Consume(q.Name, "")\nt, topics := consumer.Topics(), topics{[]string{\n"a.b", "c.d",\n"e",\n"f.g"}\n\n"h.i"\n'
    assert got(usage.messages(files(spark, ("a.go", go)), "go"), "topic", "line", "direction") == [("a.b", 4, "subscribe"), ("c.d", 4, "subscribe"), ("f.g", 6, "subscribe"), ("jobs", 1, "publish"), ("queue", 2, "subscribe")]
    plain, search = "const a = { index: 'x' };\n", "import { Client } from '@elastic/elasticsearch';\nclient.search({ index: 'y' });\nredis.get('whole'); redis.set('part:1', v);\n"
    assert got(usage.stores(files(spark, ("a.ts", plain), ("b.ts", search), ("n.ts", None)), "typescript"), "name", "db_type", "access_pattern") == [("part", "redis", "cache-key"), ("y", "elasticsearch", "raw-query")]
