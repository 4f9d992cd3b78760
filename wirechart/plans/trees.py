"""Source files written from the given tables, so that extraction and resolution run and can be checked on them.

A nation is a service, its suppliers are its handlers; the nation's key chooses the language. The SQL beside each binding
says what was written, so an extraction is checked against facts and not against itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirechart.storage import written

LANGUAGES = ["typescript", "java", "csharp", "python", "go"]
#: Columns of handlers: n the nation, s the supplier, i its place in the nation, k how many there are, t the nation after n.
HANDLERS = "h AS (SELECT n_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY n_nationkey) AS k, (n_nationkey + 1) % 25 AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def handlers(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("nation", "supplier"))
    own = Window.partitionBy("n")
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("n"), F.col("s_suppkey").alias("s"))
    return rows.withColumns({"i": F.row_number().over(own.orderBy("s")) - 1, "k": F.count("*").over(own), "t": (F.col("n") + 1) % 25})


def _fill(template: str | Column) -> Column:
    """A text with <n>, <s>, <t> and <i> filled in."""
    out = F.lit(template) if isinstance(template, str) else template
    for c in ("n", "s", "t", "i"):
        out = F.replace(out, F.lit(f"<{c}>"), F.col(c).cast("string"))
    return out


def _files(rows: DataFrame, language: str, path: str, head: str, body: str, tail: str, more: str = "") -> DataFrame:
    """files(service, path, content) of the nations of a language: head, a block for each supplier, more blocks, tail."""
    own = rows.where(F.col("n") % 5 == LANGUAGES.index(language))
    each = own.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", _fill(body).alias("a"), _fill(more).alias("b")))).alias("x"))
    text = F.concat(_fill_n(head), F.array_join(F.transform("x", lambda x: x["a"]), ""), F.lit(tail), F.array_join(F.transform("x", lambda x: x["b"]), ""))
    return each.select(F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service"), F.lit(path).alias("path"), text.alias("content"))


def _fill_n(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("<n>"), F.col("n").cast("string")), F.lit("<t>"), ((F.col("n") + 1) % 25).cast("string"))


def controllers(spark: SparkSession, d: str, language: str) -> DataFrame:
    """One controller for each nation of a language, with a handler and a call for each supplier."""
    h = handlers(spark, d)
    url = "http://nation-<t>/supplier/<s>"
    if language == "typescript":
        return _files(h, language, "src/nation.controller.ts", "@Controller('nation-<n>')\nexport class NationController {\n", f"  @Get('supplier/<s>')\n  async supplier<s>(@Body() body: Supplier<s>Dto): Promise<Reply<s>> {{\n    return axios.post('{url}');\n  }}\n", "}\n")
    if language == "java":
        return _files(h, language, "src/main/java/NationController.java", '@RestController\n@RequestMapping("/nation-<n>")\npublic class NationController {\n', f'    @GetMapping("/supplier/<s>")\n    public Reply<s> supplier<s>(@RequestBody Supplier<s>Dto body) {{\n        restTemplate.postForObject("{url}", body, Reply.class);\n    }}\n', "}\n")
    if language == "csharp":
        return _files(h, language, "Controllers/NationController.cs", '[Route("nation-<n>")]\npublic class NationController : ControllerBase\n{\n', f'    [HttpGet("supplier/<s>")]\n    public async Task<Reply<s>> Supplier<s>([FromBody] Supplier<s>Dto body)\n    {{\n        await client.PostAsync("{url}", body);\n    }}\n', "}\n")
    if language == "python":
        return _files(h, language, "app/nation.py", 'router = APIRouter(prefix="/nation-<n>")\n\n', f'@router.get("/supplier/<s>", response_model=Reply<s>)\ndef supplier<s>(body: Supplier<s>Dto):\n    httpx.post("{url}")\n\n', "")
    return _files(h, language, "nation.go", 'package main\nfunc routes(r *gin.Engine) {\n\tg := r.Group("/nation-<n>")\n', '\tg.GET("/supplier/<s>", supplier<s>)\n', "}\n", f'func supplier<s>(c *gin.Context) {{\n\tvar in Supplier<s>Dto\n\tc.ShouldBindJSON(&in)\n\thttp.Post("{url}", "json", nil)\n\tc.JSON(200, Reply<s>{{}})\n}}\n')


def clients(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A client for each nation whose base URL names the next one, and a call for each supplier that holds a path only."""
    base, h = "http://nation-<t>", handlers(spark, d)
    heads = {
        "typescript": f"const stock<n> = axios.create({{\n  timeout: 5,\n  baseURL: '{base}/',\n}});\n",
        "java": f'WebClient stock<n> = WebClient.builder()\n    .baseUrl("{base}")\n    .build();\n',
        "csharp": f'var stock<n> = new HttpClient();\nstock<n>.BaseAddress = new Uri("{base}");\n',
        "python": f'stock<n> = httpx.AsyncClient(timeout=5, base_url="{base}")\n',
        "go": f'stock<n> := resty.New().SetBaseURL("{base}")\n',
    }
    uses = {
        "typescript": "const r<s> = await stock<n>.get<Reply>('supplier/<s>');\n",
        "java": 'Object r<s> = stock<n>.get().uri("/supplier/<s>").retrieve();\n',
        "csharp": 'var r<s> = await stock<n>.GetAsync("/supplier/<s>");\n',
        "python": 'r<s> = await stock<n>.get("/supplier/<s>")\n',
        "go": 'r<s>, _ := stock<n>.R().SetBody(x).Get("/supplier/<s>")\n',
    }
    return _files(h, language, "src/client", heads[language], uses[language], "")


def stubs(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A gRPC stub for each nation, made in one file, and a method of it for each supplier, called in another."""
    h = handlers(spark, d)
    made = {
        "typescript": "this.stock<n> = this.client.getService<Nation>('Nation<n>');\n",
        "java": "Stub stock<n> = Nation<n>Grpc.newBlockingStub(channel);\n",
        "csharp": "var stock<n> = new Nation<n>.Nation<n>Client(channel);\n",
        "python": "stock<n> = nation_pb2_grpc.Nation<n>Stub(channel)\n",
        "go": "stock<n> := pb.NewNation<n>Client(conn)\n",
    }
    used = {"typescript": "await this.stock<n>.Get<s>(ask);\n", "java": "var r<s> = stock<n>.Get<s>(ask);\n", "csharp": "var r<s> = await stock<n>.Get<s>Async(ask);\n", "python": "r<s> = stock<n>.Get<s>(ask)\n", "go": "r<s>, err := stock<n>.Get<s>(ctx, ask)\n"}
    return _files(h, language, "src/made", made[language], "", "").unionByName(_files(h, language, "src/used", "", used[language], ""))


def graphql_clients(spark: SparkSession, d: str) -> DataFrame:
    """A document for each supplier, held by a constant in one file and sent from another, in TypeScript or Python."""
    h = handlers(spark, d)
    odd = F.col("s") % 2 == 1
    script, python = h.where("n % 5 < 3"), h.where("n % 5 >= 3")
    kind = lambda rows: rows.withColumn("i", F.when(odd, "mutation").otherwise("query"))
    verb = lambda rows: rows.withColumn("i", F.when(odd, "mutate({ mutation").otherwise("query({ query"))
    each = lambda rows, path, body: rows.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", _fill(body).alias("a")))).alias("x")).select(F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service"), F.lit(path).alias("path"), F.array_join(F.transform("x", lambda x: x["a"]), "").alias("content"))
    parts = [
        each(kind(script), "src/documents.ts", "export const FIND_<s> = gql`\n  <i> Find<s> { a }\n`;\n"), each(verb(script), "src/sent.ts", "await client.<i>: FIND_<s> });\n"),
        each(kind(python), "app/documents.py", 'FIND_<s> = gql("""\n  <i> Find<s> { a }\n""")\n'), each(python, "app/sent.py", "await session.execute(FIND_<s>)\n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


#: Where a handler and its call stand, and what the handler is named.
LINES = """CASE n % 5 WHEN 0 THEN 3 + 4 * i WHEN 1 THEN 4 + 4 * i WHEN 2 THEN 4 + 5 * i WHEN 3 THEN 3 + 4 * i ELSE 4 + i END"""
CALLS = """CASE n % 5 WHEN 0 THEN 5 + 4 * i WHEN 1 THEN 6 + 4 * i WHEN 2 THEN 7 + 5 * i WHEN 3 THEN 5 + 4 * i ELSE 8 + k + 6 * i END"""
HANDLER = "CASE WHEN n % 5 = 2 THEN 'Supplier' ELSE 'supplier' END || s"


def dtos(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A payload type for each nation with a field for each supplier."""
    h = handlers(spark, d)
    if language == "typescript":
        return _files(h, language, "src/nation.dto.ts", "export interface Nation<n>Dto {\n", "  supplier<s>?: string;\n", "}\n")
    if language == "java":
        return _files(h, language, "src/main/java/NationDto.java", "public class Nation<n>Dto {\n", "    @NotNull\n    private Integer supplier<s>;\n", "}\n")
    if language == "csharp":
        return _files(h, language, "Models/NationDto.cs", "public class Nation<n>Dto\n{\n", "    public decimal supplier<s> { get; set; }\n", "}\n")
    if language == "python":
        return _files(h, language, "app/schemas.py", "class Nation<n>Dto(BaseModel):\n", "    supplier<s>: List[int]\n", "")
    return _files(h, language, "types.go", "package main\ntype Nation<n>Dto struct {\n", '\tSupplier<s> *time.Time `json:"supplier<s>,omitempty"`\n', "}\n")


def payloads(spark: SparkSession, d: str, language: str) -> DataFrame:
    """The body type of every supplier with an even key, with a number and the body type of the next supplier of its nation.

    The last one of a nation names the first, so types nest in a circle.
    """
    h = handlers(spark, d)
    after = h.select("n", (F.col("i") - 1).alias("i"), F.col("s").alias("t")).unionByName(h.where("i = 0").select("n", (F.col("k") - 1).cast("int").alias("i"), F.col("s").alias("t")))
    h = h.drop("t").join(after, ["n", "i"])
    body = {
        "typescript": "export interface Supplier<s>Dto {\n  size?: number;\n  next: Supplier<t>Dto;\n}\n",
        "java": "public class Supplier<s>Dto {\n    private Integer size;\n    @NotNull\n    private Supplier<t>Dto next;\n}\n",
        "csharp": "public class Supplier<s>Dto\n{\n    public int? size { get; set; }\n    [Required]\n    public Supplier<t>Dto next { get; set; }\n}\n",
        "python": "class Supplier<s>Dto(BaseModel):\n    size: Optional[int] = None\n    next: Supplier<t>Dto\n\n",
        "go": "type Supplier<s>Dto struct {\n\tSize *int `json:\"size\"`\n\tNext Supplier<t>Dto `json:\"next\"`\n}\n",
    }
    return _files(h.where("s % 2 = 0"), language, "src/payloads.dto", "", body[language], "")


def serializers(spark: SparkSession, d: str) -> DataFrame:
    """A model for each nation in one file, with a field for each supplier, and a serializer in another that lists all, the even or all but the odd ones."""
    h = handlers(spark, d)
    head = F.concat(F.lit("class Nation"), F.col("n").cast("string"), F.lit("(models.Model):\n"))
    even = F.array_join(F.transform(F.filter("x", lambda x: x["s"] % 2 == 0), lambda x: F.concat(F.lit("'supplier"), x["s"].cast("string"), F.lit("'"))), ", ")
    odd = F.array_join(F.transform(F.filter("x", lambda x: x["s"] % 2 == 1), lambda x: F.concat(F.lit('"supplier'), x["s"].cast("string"), F.lit('"'))), ",\n            ")
    listed = F.when(F.col("n") % 3 == 0, F.lit("        fields = '__all__'\n")).when(F.col("n") % 3 == 1, F.concat(F.lit("        fields = ["), even, F.lit("]\n"))).otherwise(F.concat(F.lit("        exclude = (\n            "), odd, F.lit(")\n")))
    each = h.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", _fill("    supplier<s> = models.DecimalField(null=True)\n").alias("a")))).alias("x"))
    name = F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service")
    models = each.select(name, F.lit("models.py").alias("path"), F.concat(head, F.array_join(F.transform("x", lambda x: x["a"]), "")).alias("content"))
    own = F.concat(F.lit("class NationSerializer(serializers.ModelSerializer):\n    class Meta:\n        model = Nation"), F.col("n").cast("string"), F.lit("\n"), listed)
    return models.unionByName(each.select(name, F.lit("serializers.py").alias("path"), own.alias("content")))


def usages(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A line for each supplier that publishes on a topic, subscribes to another, uses a table and imports a library."""
    h = handlers(spark, d).withColumn("i", F.col("s") % 3)
    lines = {
        "typescript": "producer.send({ topic: 'topic-<i>' }); consumer.subscribe({ topic: 'reply-<i>' });\nknex('table_<i>').select();\nimport { x } from '@own/lib-<i>';\n",
        "java": 'kafkaTemplate.send("topic-<i>"); // @KafkaListener(topics = "reply-<i>")\n@Table(name = "table_<i>")\nimport org.own.lib<i>.Thing;\n',
        "csharp": 'producer.ProduceAsync("topic-<i>", m); consumer.Subscribe("reply-<i>");\nmodelBuilder.ToTable("table_<i>");\nusing Own.Lib<i>;\n',
        "python": "producer.send('topic-<i>', m); KafkaConsumer('reply-<i>')\n__tablename__ = 'table_<i>'\nimport own.lib<i>\n",
        "go": 'kafka.Writer{Topic: "topic-<i>"}; kafka.ReaderConfig{Topic: "reply-<i>"}\ndb.Table("table_<i>")\n"example.org/own/lib<i>"\n',
    }
    return _files(h, language, "src/use", "", lines[language], "")


#: A line for every rule of messages: what is written, and the line in it, topic, direction, broker and payload type that it says.
MESSAGES = {
    "typescript": [
        ("@EventPattern('a<s>')", 1, "a<s>", "subscribe", "kafka", None),
        ("@MessagePattern(`b<s>`)", 1, "b<s>", "subscribe", "kafka", None),
        ("this.bus.emit('c.<s>', body);", 1, "c.<s>", "publish", "kafka", None),
        ("await kafkaConsumer.subscribe({ topic: 'd<s>' }); consumer.subscribe({ topic: 'd<s>' });", 1, "d<s>", "subscribe", "kafka", None),
        ("await producer.send({\n  acks: 1,\n  topic: 'e<s>' });", 1, "e<s>", "publish", "kafka", None),
        ("channel.consume('f<s>', work);", 1, "f<s>", "subscribe", "rabbitmq", None),
        ("channel.sendToQueue('g<s>', body);", 1, "g<s>", "publish", "rabbitmq", None),
        ("redis.subscribe('h<s>');", 1, "h<s>", "subscribe", "redis-pubsub", None),
        ("redis.publish('i<s>', body);", 1, "i<s>", "publish", "redis-pubsub", None),
    ],
    "java": [
        ('@KafkaListener(topics = "a<s>, b")', 1, "a<s>", "subscribe", "kafka", None),
        ('@KafkaListener(groupId = "g",\n  topics = {"c<s>"})', 1, "c<s>", "subscribe", "kafka", None),
        ('@RabbitListener(queues = "d<s>")', 1, "d<s>", "subscribe", "rabbitmq", None),
        ('orderKafkaTemplate.send("e<s>", m);', 1, "e<s>", "publish", "kafka", None),
        ('rabbitTemplate.convertAndSend("f<s>", "key", m);', 1, "f<s>", "publish", "rabbitmq", None),
        ('@SendTo("g<s>")', 1, "g<s>", "publish", "kafka", None),
    ],
    "csharp": [
        ('[EventSubscribe("a<s>")]', 1, "a<s>", "subscribe", "kafka", None),
        ('await producer.ProduceAsync("b<s>", m);', 1, "b<s>", "publish", "kafka", None),
        ('channel.BasicPublish(exchange: "c", routingKey: "<s>", body: b);', 1, "c:<s>", "publish", "rabbitmq", None),
        ('channel.BasicConsume(queue: "d<s>", autoAck: true);', 1, "d<s>", "subscribe", "rabbitmq", None),
        ("await _bus.Publish(new SaleMade<s>(x));", 1, "sale-made<s>", "publish", "rabbitmq", "SaleMade<s>"),
        ('consumer.Subscribe(new[] { "e<s>" });', 1, "e<s>", "subscribe", "kafka", None),
        ('cfg.ReceiveEndpoint("f<s>", e => e);', 1, "f<s>", "subscribe", "rabbitmq", None),
    ],
    "python": [
        ("@shared_task\n@timed\ndef a<s>(x):", 1, "a<s>", "subscribe", "redis-pubsub", None),
        ('@app.task(name="b<s>")\ndef other(x):', 1, "b<s>", "subscribe", "redis-pubsub", None),
        ("app.send_task('c<s>', args)", 1, "c<s>", "publish", "redis-pubsub", None),
        ('consumer.subscribe(["d<s>"])', 1, "d<s>", "subscribe", "kafka", None),
        ('producer.produce("e<s>", value=v)', 1, "e<s>", "publish", "kafka", None),
        ('channel.basic_consume(queue="f<s>", auto_ack=True)', 1, "f<s>", "subscribe", "rabbitmq", None),
        ('channel.basic_publish(exchange="g", routing_key="<s>", body=b)', 1, "g:<s>", "publish", "rabbitmq", None),
        ('channel.basic_publish(exchange="",\n    routing_key="h<s>")', 1, "h<s>", "publish", "rabbitmq", None),
    ],
    "go": [
        ('names, topics := consumer.Topics(), topics[:0], []string{\n\t"a.<s>",', 2, "a.<s>", "subscribe", "kafka", None),
        ('p.Input() <- &sarama.ProducerMessage{Topic: "b<s>"}', 1, "b<s>", "publish", "kafka", None),
        ('ch.Consume("c<s>", "", true)', 1, "c<s>", "subscribe", "rabbitmq", None),
        ('ch.Publish("d<s>", q.Name, false)', 1, "d<s>", "publish", "rabbitmq", None),
        ('ch.Publish("", queue<s>.Name, false)', 1, "queue<s>.Name", "publish", "rabbitmq", None),
        ('group.Consume(ctx, []string{"e<s>"}, h)', 1, "e<s>", "subscribe", "kafka", None),
    ],
}
#: A line for every rule of stores: what is written, and the line in it, name, kind and access pattern that it says.
STORES = {
    "typescript": [
        ("@Entity('a<s>')", 1, "a<s>", "sql", "orm-model"),
        ("await prisma.b<s>.findMany();", 1, "b<s>s", "sql", "orm-model"),
        ("sequelize.define('c<s>', {});", 1, "c<s>", "sql", "orm-model"),
        ("  tableName: 'd<s>',", 1, "d<s>", "sql", "orm-model"),
        ("await knex('own.e-<s>').select();", 1, "own.e-<s>", "sql", "raw-query"),
        ("await db.query('delete from f<s> where id = 1');", 1, "f<s>", "sql", "raw-query"),
        ("mongoose.model<Thing>('g-<s>', schema);", 1, "g-<s>", "mongodb", "collection"),
        ("db.collection('h-<s>').find();", 1, "h-<s>", "mongodb", "collection"),
        ("await redis.set(`i-<s>:${id}`, 1);", 1, "i-<s>", "redis", "cache-key"),
        ("  TableName: 'j-<s>',", 1, "j-<s>", "dynamodb", "raw-query"),
        ("elastic.search({ index: 'k-<s>' });", 1, "k-<s>", "elasticsearch", "raw-query"),
    ],
    "java": [
        ('@Table(name = "a<s>")', 1, "a<s>", "sql", "orm-model"),
        ("@Entity\npublic class StockItem<s> {", 1, "stock_item<s>", "sql", "orm-model"),
        ('@Document(collection = "b-<s>")', 1, "b-<s>", "mongodb", "collection"),
        ('jdbcTemplate.query("SELECT id FROM c<s> WHERE x = 1", m);', 1, "c<s>", "sql", "raw-query"),
        ('TableRef.builder().tableName("d-<s>").build();', 1, "d-<s>", "dynamodb", "raw-query"),
    ],
    "csharp": [
        ('[Table("a<s>")]', 1, "a<s>", "sql", "orm-model"),
        ("public DbSet<Item<s>> Things { get; set; }", 1, "Item<s>", "sql", "orm-model"),
        ('connection.Query<Row>("SELECT * FROM b<s>");', 1, "b<s>", "sql", "raw-query"),
        ('[Collection("c-<s>")]', 1, "c-<s>", "mongodb", "collection"),
        ('db.GetCollection<Row>("d-<s>");', 1, "d-<s>", "mongodb", "collection"),
        ('cache.StringSet($"e-<s>:{id}", v);', 1, "e-<s>", "redis", "cache-key"),
        ('  TableName = "f-<s>",', 1, "f-<s>", "dynamodb", "raw-query"),
    ],
    "python": [
        ("    __tablename__ = 'a<s>'", 1, "a<s>", "sql", "orm-model"),
        ('        db_table = "b<s>"', 1, "b<s>", "sql", "orm-model"),
        ("things = Table('c<s>', metadata)", 1, "c<s>", "sql", "orm-model"),
        ("session.query(Item<s>).all()", 1, "Item<s>", "sql", "orm-model"),
        ('cursor.execute("INSERT INTO d<s> VALUES (1)")', 1, "d<s>", "sql", "raw-query"),
        ('db["e-<s>"]', 1, "e-<s>", "mongodb", "collection"),
        ("db.f<s>.find_one({})", 1, "f<s>", "mongodb", "collection"),
        ('r.get(f"g-<s>:{key}")', 1, "g-<s>", "redis", "cache-key"),
        ("client.put_item(TableName='h-<s>')", 1, "h-<s>", "dynamodb", "raw-query"),
    ],
    "go": [
        ('db.QueryContext(ctx, "SELECT x FROM a<s>")', 1, "a<s>", "sql", "raw-query"),
        ('db.Table("b_<s>")', 1, "b_<s>", "sql", "orm-model"),
        ("db.Model(&Item<s>{}).Where()", 1, "Item<s>", "sql", "orm-model"),
        ('db.Collection("c-<s>")', 1, "c-<s>", "mongodb", "collection"),
        ('rdb.Set(ctx, "d-<s>:key", v, 0)', 1, "d-<s>", "redis", "cache-key"),
        ('  TableName: aws.String("e-<s>"),', 1, "e-<s>", "dynamodb", "raw-query"),
    ],
}
#: Lines of a file that one supplier has.
HEIGHT = 6


def by_rule(rules: dict[str, list[tuple]], spark: SparkSession, d: str, language: str) -> DataFrame:
    """A line for each supplier by the rule that its key chooses, and blank ones up to HEIGHT."""
    h = handlers(spark, d).where(F.col("n") % 5 == LANGUAGES.index(language))
    texts = F.array(*[F.lit(x[0] + "\n" * (HEIGHT - x[0].count("\n"))) for x in rules[language]])
    chosen = F.get(texts, (F.col("s") % len(rules[language])).cast("int"))
    each = h.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", _fill(chosen).alias("a")))).alias("x"))
    return each.select(F.concat(F.lit("nation-"), F.col("n").cast("string")).alias("service"), F.lit("src/use").alias("path"), F.array_join(F.transform("x", lambda x: x["a"]), "").alias("content"))


def said(rules: dict[str, list[tuple]], names: list[str]) -> str:
    """SQL of what the lines by rule say: r(s, service, line, names)."""
    text = lambda x: "NULL" if x is None else "'" + x + "'"
    rows = [f"({LANGUAGES.index(lang)}, {k}, {len(own)}, {r[1]}, {', '.join(text(x) for x in r[2:])})" for lang, own in rules.items() for k, r in enumerate(own)]
    filled = ", ".join(f"replace({x}, '<s>', CAST(s AS VARCHAR)) AS {x}" for x in names)
    return f"{HANDLERS}, w(l, nr, m, ln, {', '.join(names)}) AS (VALUES {', '.join(rows)}), r AS (SELECT s, 'nation-' || n AS service, CAST({HEIGHT} * i + ln AS INTEGER) AS line, {filled} FROM h JOIN w ON n % 5 = l AND s % m = nr)"


def hints(spark: SparkSession, d: str, language: str) -> DataFrame:
    """A place for each supplier where the URL of the next nation is written down under a key of its own."""
    h = handlers(spark, d)
    lines = {
        "typescript": "const SUPPLIER_<s>_URL = 'http://nation-<t>';\n",
        "java": "supplier.<s>.url=http://nation-<t>\n",
        "csharp": '  "SUPPLIER_<s>_Url": "http://nation-<t>",\n',
        "python": "SUPPLIER_<s>_URL=http://nation-<t>\n",
        "go": 'const SUPPLIER_<s>_URL = "http://nation-<t>"\n',
    }
    return _files(h, language, "src/settings", "", lines[language], "")


def every(binding, spark: SparkSession, d: str, extract) -> DataFrame:
    """The union of extract(files, language) over all languages; the files are written once and read by each."""
    files = reduce(DataFrame.unionByName, [binding(spark, d, x).withColumn("language", F.lit(x)) for x in LANGUAGES])
    files = written(files, "sources")
    return reduce(DataFrame.unionByName, [extract(files.where(F.col("language") == x).drop("language"), x) for x in LANGUAGES])


def markers(spark: SparkSession, d: str) -> DataFrame:
    """files(service, root, path, content): a marker file for each nation, chosen by its key, in its folder and in one below."""
    h = handlers(spark, d).select("n").distinct()
    kind = F.col("n") % 8
    name = F.when(kind < 3, "package.json").when(kind < 5, "go.mod").when(kind == 5, "pom.xml").when(kind == 6, "requirements.txt").otherwise("Nation.csproj")
    text = (
        F.when(kind == 0, '{"name": "@own/Nation <n>", "dependencies": {"@nestjs/core": "1"}}').when(kind == 1, '{"devDependencies": {"express": "4"}}').when(kind == 2, '{"name": "x"}')
        .when(kind == 3, "require github.com/gin-gonic/gin v1").when(kind == 4, "module x").when(kind == 5, "<parent>spring-boot-starter</parent>").when(kind == 6, "Flask==2").otherwise("<Project/>")
    )
    content = F.replace(text, F.lit("<n>"), F.col("n").cast("string"))
    folder = F.concat(F.lit("nation-"), F.col("n").cast("string"))
    places = F.array(F.struct(F.concat(folder, F.lit("/"), name).alias("whole"), name.alias("path")), F.struct(F.concat(folder, F.lit("/inner/"), name).alias("whole"), F.concat(F.lit("inner/"), name).alias("path")))
    return h.select(folder.alias("service"), F.lit("r").alias("root"), F.inline(places), content.alias("content"))


def interface_files(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """files(path, content): a proto, GraphQL or OpenAPI file for each nation, with a method for each supplier."""
    h = handlers(spark, d)
    each = lambda body: h.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("s", _fill(body).alias("a")))).alias("x"))
    body = lambda join: F.array_join(F.transform("x", lambda x: x["a"]), join)
    if kind == "proto":
        rows = each("  /* one of <n> } */ rpc Get<s>(stream\n    own.v1.Ask<s>) returns (.own.Answer<s>) { option (x) = { get: \"/s\" }; }\n")
        return rows.select(F.concat(F.col("n").cast("string"), F.lit(".proto")).alias("path"), F.concat(F.lit('syntax = "proto3"; // package wrong;\npackage own.n'), F.col("n").cast("string"), F.lit(";\nmessage service_x { string a = 1; }\nservice Nation {\n"), body(""), F.lit("}\n")).alias("content"))
    if kind == "graphql":
        rows = each("  # field: No\n  supplier<s>(\n    filter: Filter<s>!\n    limit: Int = 3): [Supplier<s>!]!\n")
        root = F.when(F.col("n") % 3 == 0, "Query").when(F.col("n") % 3 == 1, "Mutation").otherwise("Subscription")
        return rows.select(F.concat(F.col("n").cast("string"), F.lit(".graphql")).alias("path"), F.concat(F.lit('"""type Query { no: No }"""\ntype Other { a: B }\nextend type '), root, F.lit(" @key(fields: 1) {\n"), body(""), F.lit("}\ninput I { x: Y }\n")).alias("content"))
    rows = each('"/supplier/<s>": {"post": {"summary": "see https://nation-<t>.example.org/x", "requestBody": {"content": {"application/json": {"schema": {"properties": {"a<s>": {"type": "string"}, "b": {}}}}}}, "responses": {"201": {"content": {"application/json": {"schema": {"type": "array", "items": {"properties": {"id": {"type": "integer"}}}}}}}}}}')
    return rows.select(F.concat(F.lit("n/"), F.col("n").cast("string"), F.lit("/openapi.json")).alias("path"), F.concat(F.lit('{"openapi": "3.0.3", "info": {"title": "Nation '), F.col("n").cast("string"), F.lit('"}, "servers": [{"url": "https://nation-'), F.col("n").cast("string"), F.lit('.example.org/v1"}], "paths": {'), body(", "), F.lit("}}")).alias("content"))


def graph_inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """services, hints, endpoints and calls of the nations: each supplier is an endpoint with one call, whose form follows its key.

    The call of a nation's supplier goes to the first supplier of the next nation.
    """
    h = handlers(spark, d)
    name = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    services = h.select(F.col("n").alias("svc_seq"), name("n").alias("service")).distinct()
    endpoints = h.select(F.col("n").alias("svc_seq"), F.col("i").alias("ep_seq"), name("n").alias("service"), F.lit("GET").alias("method"), F.concat(F.lit("/supplier/"), F.col("i").cast("string")).alias("path"), F.concat(F.lit("/"), name("n"), F.lit("/supplier/"), F.col("i").cast("string")).alias("full_path"))
    hints_ = h.where("i = 0").select(F.col("n").alias("svc_seq"), F.lit(0).alias("hint_seq"), name("n").alias("service"), F.concat(F.lit("NEXT_NATION_"), F.lpad(F.col("t").cast("string"), 2, "0"), F.lit("_URL")).alias("key"), F.concat(F.lit("http://inner-"), F.col("t").cast("string"), F.lit(":80/x")).alias("value"))
    form = F.col("s") % 6
    place = F.lit("/supplier/0")
    url = (
        F.when(form == 0, F.concat(F.lit("http://"), name("t"), F.lit(".prod.svc.cluster.local"), place)).when(form == 1, F.concat(F.lit("feign://"), name("t"), place)).when(form == 2, F.concat(F.lit("https://api.stripe.com/v1/"), F.col("s").cast("string")))
        .when(form == 3, F.concat(F.lit("http://"), name("t"), F.lit(".service.consul"), place)).when(form == 4, F.concat(F.lit("gateway:"), name("t"), place)).otherwise(F.lit("???"))
    )
    calls = h.select(F.col("s").alias("call_id"), F.col("n").alias("svc_seq"), F.col("i").alias("ep_seq"), F.lit(1).alias("call_seq"), name("n").alias("service"), F.lit("GET").alias("method"), url.alias("raw_url"), F.lit(None).cast("string").alias("pre_service"), F.lit(None).cast("string").alias("pre_path"))
    return {"services": services, "hints": hints_, "endpoints": endpoints, "calls": calls}


#: What ``graph_inputs`` resolves to. By containment the first fragment in the order of writes wins, which is the first
#: nation's path segment "supplier", but for calls of that nation itself.
RESOLVED = """v AS (SELECT s AS call_id, n, i, t, 'nation-' || n AS service, s % 6 AS f,
  CASE WHEN s % 6 = 2 THEN 'stripe-api' WHEN s % 6 = 5 THEN NULL WHEN s % 6 = 4 AND n <> 0 THEN 'nation-0' ELSE 'nation-' || t END AS resolved_service,
  CASE WHEN s % 6 = 2 THEN '/v1/' || s WHEN s % 6 = 5 THEN NULL WHEN s % 6 = 4 AND n <> 0 THEN '/0' ELSE '/supplier/0' END AS resolved_path,
  CAST(CASE s % 6 WHEN 4 THEN 0.6 WHEN 5 THEN 0.0 ELSE 0.95 END AS DOUBLE) AS confidence,
  CASE s % 6 WHEN 0 THEN '4b' WHEN 1 THEN '3a' WHEN 2 THEN '1' WHEN 3 THEN '4c' WHEN 4 THEN '6' END AS rank FROM h)"""
