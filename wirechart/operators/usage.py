"""What services share: message topics, data stores and libraries, from rules over lines of their sources.

All take files(service, path, content). Messages and stores are listed once for each service, the first place winning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirechart.operators.code import Rule, apply, first_of, lines, with_context

_Q = "[\"'`]([^\"'`\\n]+)[\"'`]"


def _message(name: str, pattern: str, direction: str, groups: dict[str, int] | None = None, fixed: dict[str, str] | None = None) -> Rule:
    return Rule(name, pattern, groups or ({} if fixed else {"topic": 1}), {"direction": direction} | (fixed or {}), near=True)


#: An exchange and a routing key, either of which may be empty, as arguments by name.
_ROUTED = {"topic": 1, "key": 2}


#: By language: broker, pattern of a topic and direction. A routing key follows its exchange after a colon; a message sent
#: without a name has that of its payload's class.
MESSAGES = {
    "java": [
        _message("kafka", r"@KafkaListener\([^)]*\b(?:topics|value)\s*=\s*(\{[^}]*\}|\"[^\"]+\")", "subscribe"),
        _message("kafka", r"\b\w*[kK]afkaTemplate\.send\(\s*\"([^\"]+)\"", "publish"),
        _message("rabbitmq", r"@RabbitListener\([^)]*\bqueues\s*=\s*(\{[^}]*\}|\"[^\"]+\")", "subscribe"),
        _message("rabbitmq", r"\b\w*[rR]abbitTemplate\.(?:convertAndSend|send)\(\s*\"([^\"]+)\"", "publish"),
        _message("kafka", r"@SendTo\(\s*(\{[^}]*\}|\"[^\"]+\")", "publish"),
    ],
    "csharp": [
        _message("kafka", r"\.Subscribe\(\s*\"([^\"]+)\"", "subscribe"),
        _message("kafka", r"\.Subscribe\(\s*new\s*(?:List<string>|\[\]|string\[\])?\s*(?:\(\))?\s*(\{[^}]*\})", "subscribe"),
        _message("rabbitmq", r"\.ReceiveEndpoint\(\s*\"([^\"]+)\"", "subscribe"),
        _message("kafka", r"\.ProduceAsync\(\s*\"([^\"]+)\"", "publish"),
        _message("rabbitmq", r"\.BasicConsume\(\s*(?:queue:\s*)?\"([^\"]+)\"", "subscribe"),
        _message("rabbitmq", r"\.BasicConsume\([^)]*?\bqueue:\s*\"([^\"]+)\"", "subscribe"),
        _message("rabbitmq", r"\.BasicPublish(?:Async)?\(\s*(?:exchange:\s*)?\"([^\"]*)\"\s*,\s*(?:routingKey:\s*)?\"([^\"]*)\"", "publish", _ROUTED),
        _message("rabbitmq", r"\.BasicPublish(?:Async)?\(\s*(?:exchange:\s*)?\"([^\"]+)\"\s*,\s*(?:routingKey:\s*+)?+[^\s\"]", "publish"),
        _message("kafka", r"\[(?:Event)?Subscribe\(\s*\"([^\"]+)\"", "subscribe"),
        _message("rabbitmq", r"\b_?[bB]us\.Publish(?:<\w+>)?\(\s*new\s+(\w+)", "publish", {"payload": 1}),
    ],
    "python": [
        _message("kafka", r"\bKafkaConsumer\(\s*[\"']([^\"']+)", "subscribe"),
        _message("kafka", r"\bconsumer\.subscribe\(\s*(\[[^\]]*\])", "subscribe"),
        _message("kafka", r"\bproducer\.send(?:_and_wait)?\(\s*[\"']([^\"']+)", "publish"),
        _message("rabbitmq", r"\.basic_consume\([^)]*queue\s*=\s*[\"']([^\"']+)", "subscribe"),
        _message("rabbitmq", r"\.basic_publish\(\s*exchange\s*=\s*[\"']([^\"']*)[\"']\s*,\s*routing_key\s*=\s*[\"']([^\"']*)", "publish", _ROUTED),
        _message("rabbitmq", r"\.basic_publish\((?!\s*exchange\s*=\s*[\"'][^\"']*[\"']\s*,\s*routing_key\s*=\s*[\"'])[^)]*(?:routing_key|exchange)\s*=\s*[\"']([^\"']+)", "publish"),
        _message("kafka", r"\bproducer\.produce\(\s*[\"']([^\"']+)", "publish"),
        # a task without a name of its own is called by that of its function, at most two lines below
        _message("redis-pubsub", r"@(?:\w+\.)?(?:shared_)?task\b(?![^\n]*\bname\s*=)[^\n]*\n(?:[^\n]*\n)??[ \t]*(?:async\s+)?def\s+(\w+)", "subscribe"),
        _message("redis-pubsub", r"@(?:\w+\.)?task\([^)]*name\s*=\s*[\"']([^\"']+)", "subscribe"),
        _message("redis-pubsub", r"\.send_task\(\s*[\"']([^\"']+)", "publish"),
        _message("redis-pubsub", r"\.subscribe\(\s*[\"']([^\"']+)", "subscribe"),
        _message("redis-pubsub", r"\bredis\w*\.publish\(\s*[\"']([^\"']+)", "publish"),
    ],
    "typescript": [
        _message("kafka", rf"@(?:MessagePattern|EventPattern)\(\s*{_Q}", "subscribe"),
        _message("kafka", rf"\bconsumer\.subscribe\(\s*\{{[^}}]*?\btopics?\s*:\s*(\[[^\]]*\]|[\"'`][^\"'`]+[\"'`])", "subscribe"),
        _message("kafka", rf"\bproducer\.send\(\s*\{{[^}}]*topic\s*:\s*{_Q}", "publish"),
        _message("kafka", rf"\b\w*[cC]lient\.(?:emit|send)\(\s*{_Q}", "publish"),
        _message("kafka", r"\.emit\(\s*[\"'`]([^\"'`\n]+)[\"'`]", "publish"),
        _message("rabbitmq", rf"\bchannel\.consume\(\s*{_Q}", "subscribe"),
        _message("rabbitmq", rf"\bchannel\.(?:sendToQueue|publish)\(\s*{_Q}", "publish"),
        _message("redis-pubsub", rf"\b(?:redis|subscriber)\w*\.subscribe\(\s*{_Q}", "subscribe"),
        _message("redis-pubsub", rf"\b(?:redis|publisher)\w*\.publish\(\s*{_Q}", "publish"),
    ],
    "go": [
        _message("kafka", r"kafka\.ReaderConfig\{[^}]*Topic:\s*\"([^\"]+)\"", "subscribe"),
        _message("kafka", r"kafka\.(?:Writer|WriterConfig|Message)\{[^}]*Topic:\s*\"([^\"]+)\"", "publish"),
        _message("kafka", r"ConsumePartition\(\s*\"([^\"]+)\"", "subscribe"),
        _message("kafka", r"ProducerMessage\{[^}]*Topic:\s*\"([^\"]+)\"", "publish"),
        _message("rabbitmq", r"\.Consume\(\s*\"([^\"]+)\"", "subscribe"),
        _message("rabbitmq", r"\.Publish(?:WithContext)?\(\s*(?:ctx\s*,\s*)?\"([^\"]+)\"", "publish"),
        # the default exchange delivers to the queue that the routing key names
        _message("rabbitmq", r"\.Publish(?:WithContext)?\(\s*(?:ctx\s*,\s*)?\"\"\s*,\s*\"?([^\s,\"]+)", "publish"),
        _message("rabbitmq", r"\.Consume\(\s*(?:q|queue)\.Name\b", "subscribe", fixed={"topic": "queue"}),
        _message("kafka", r"\.Consume\(\s*ctx\s*,\s*\[\]string(\{[^}]*\})", "subscribe"),
    ],
}


#: A consumer's own list of topics in Go, which the lines after it may go on with.
_LISTED = r"\bTopics\(\)[^\n]*\btopics\b[^\n]*\["


def messages(files: DataFrame, language: str) -> DataFrame:
    """(service, path, line, topic, direction, pattern, payload_type): once for each broker, direction and topic of a service."""
    rows = with_context(lines(files), ahead=4, back=4)
    marks = apply(rows, MESSAGES[language], ["topic", "direction", "key", "payload"], ["service", "path", "line"])
    if language == "go":
        # texts with a dot, on the line that begins a list or on one of four after it
        listed = rows.where(F.concat_ws("\n", "back", "text").rlike(_LISTED)).select("service", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"[\"']([^\"']*\.[\w.-]+)[\"']"), F.lit(1))).alias("topic"))
        nothing = F.lit(None).cast("string")
        marks = marks.unionByName(listed.select("*", F.lit(len(MESSAGES["go"])).alias("rank"), F.lit("kafka").alias("rule"), F.lit("subscribe").alias("direction"), nothing.alias("key"), nothing.alias("payload")))
    named = F.lower(F.regexp_replace("payload", "(?<!^)([A-Z])", "-$1"))
    marks = marks.withColumn("topic", F.coalesce(F.nullif(F.concat_ws(":", "topic", "key"), F.lit("")), named)).where("topic is not null")
    # a list of topics in brackets, or one in its quotes, is as many messages as it has texts
    every = F.regexp_extract_all("topic", F.lit("[\"'`]([^\"'`]+)[\"'`]"), F.lit(1))
    marks = marks.withColumn("topic", F.explode(F.when(F.col("topic").rlike("^[{\\[\"'`]"), every).otherwise(F.array("topic"))))
    if language == "java":
        # a listener may name several in one text
        several = F.filter(F.split("topic", r"[,\s]+"), lambda x: x != "")
        marks = marks.withColumn("topic", F.explode(F.when(F.col("direction") == "subscribe", several).otherwise(F.array("topic"))))
    once = first_of(marks, ["service", "rule", "direction", "topic"], ["path", "line", "rank"])
    return once.select("service", "path", "line", "topic", "direction", F.col("rule").alias("pattern"), F.col("payload").alias("payload_type"))


def _store(db_type: str, access: str, pattern: str) -> Rule:
    return Rule(access, pattern, {"name": 1}, {"db_type": db_type})


def _keys(*callees: str, context: str = "") -> Rule:
    """A call whose first text is a key: the part up to its first colon names what is kept."""
    return _store("redis", "cache-key", rf"(?:{'|'.join(callees)})\(\s*{context}[$@f]?[\"'`]([^\"'`:{{}}\n]+):")


_SQL = r"(?i:\b(?:from|into|update|join)\s+[`\"\[]?(\w+))"
_STATEMENT = r"[\"'`]\s*(?i:select\b[^\"'`\n]*?\bfrom|insert\s+into|update|delete\s+from)\s+[`\"\[]?(\w+)"
#: By language: kind of store, access and pattern of the table, collection, key prefix or index.
STORES = {
    "typescript": [
        _store("sql", "orm-entity", r"@Entity\(\s*[\"'`{]?\s*(?:name:\s*)?[\"'`]?(\w+)"),
        _store("sql", "prisma", r"\bprisma\.(?!\$)(\w+)\.\w+\("),
        _store("sql", "sequelize", r"\bsequelize\.define\(\s*[\"'`](\w+)"),
        _store("sql", "sequelize-table", r"\btableName\s*:\s*[\"'`](\w+)"),
        _store("sql", "knex", r"\b(?:knex|db|queryBuilder)\(\s*[\"'`]([^\"'`\n]+)[\"'`]\s*\)"),
        _store("sql", "raw", _STATEMENT),
        _store("mongodb", "mongoose", r"(?:(?<![.\w])|\b(?:mongoose|conn|connection|db)\.)model(?:<[^()\n]*>)?\(\s*[\"'`]([^\"'`\n]+)"),
        _store("mongodb", "driver", r"\.collection(?:<\w+>)?\(\s*[\"'`]([^\"'`\n]+)"),
        _keys(r"\b(?:redis\w*|client)\.(?:get|set|hget|hset|lpush|rpush|del|setex|expire)"),
        _store("dynamodb", "table", r"\bTableName\s*:\s*[\"'`]([^\"'`\n]+)"),
        _store("elasticsearch", "index", r"\bindex\s*:\s*[\"'`]([\w.-]+)"),
    ],
    "python": [
        _store("sql", "orm-model", r"__tablename__\s*=\s*[\"'](\w+)"),
        _store("sql", "orm-table", r"(?<![.\w])Table\(\s*[\"'](\w+)"),
        _store("sql", "orm-query", r"\b(?:session|db)\.query\(\s*(?:\w+\.)*([A-Z]\w*)"),
        _store("sql", "django-table", r"\bdb_table\s*=\s*[\"'](\w+)"),
        _store("sql", "django-model", r"^class\s+(\w+)\(\s*models\.Model\s*\)"),
        _store("sql", "raw", _STATEMENT),
        _store("mongodb", "driver", r"\b(?:db|mongo\w*)(?:\.|\[[\"'])(\w+)(?:[\"']\])?\.(?:find|find_one|insert_one|insert_many|update_one|update_many|delete_one|aggregate)\("),
        _store("mongodb", "item", r"\b(?:db|database)\[\s*[\"']([^\"'\n]+)[\"']\s*\]"),
        _keys(r"\b(?:redis\w*|r|cache|client)\.(?:get|set|hget|hset|lpush|sadd|delete|setex|expire)"),
        _store("dynamodb", "table", r"\.Table\(\s*[\"']([\w.-]+)"),
        _store("dynamodb", "table-name", r"\bTableName\s*=\s*[\"']([^\"'\n]+)"),
        _store("elasticsearch", "index", r"\bindex\s*=\s*[\"']([\w.-]+)"),
    ],
    "go": [
        _store("sql", "raw", _STATEMENT),
        _store("sql", "gorm", r"\.Table\(\s*\"([^\"\n]+)\""),
        _store("sql", "gorm-model", r"\.Model\(\s*&?(?:\w+\.)*([A-Z]\w*)\{"),
        _store("dynamodb", "table", r"\bTableName\s*:\s*(?:aws\.String\(\s*)?\"([^\"\n]+)"),
        _store("sql", "gorm-name", r"TableName\(\)\s*string\s*\{\s*return\s*\"(\w+)\""),
        _store("mongodb", "driver", r"\.Collection\(\s*\"([^\"\n]+)\""),
        _keys(r"\b(?:rdb|redis\w*|client)\.(?:Get|Set|HGet|HSet|LPush|SAdd|Del)", context=r"\w+\s*,\s*(?:fmt\.Sprintf\()?"),
    ],
    "java": [
        _store("sql", "table", r"@Table\((?:[^()]*\bname\s*=)?\s*\"(\w+)\""),
        _store("sql", "query", r"@Query\([^\"]*\"[^\"]*?" + _SQL),
        _store("sql", "raw", _STATEMENT),
        _store("mongodb", "document", r"@Document\(\s*(?:collection\s*=\s*|value\s*=\s*)?\"([^\"\n]+)\""),
        _store("dynamodb", "table", r"@DynamoDBTable\(\s*tableName\s*=\s*\"([\w.-]+)"),
        _store("dynamodb", "table-name", r"\.tableName\(\s*\"([^\"\n]+)\""),
        _store("redis", "hash", r"@RedisHash\(\s*\"(\w+)\""),
        _store("elasticsearch", "index", r"@Document\(\s*indexName\s*=\s*\"([\w-]+)\""),
    ],
    "csharp": [
        _store("sql", "db-set", r"\bDbSet<\s*(?:\w+\.)*(\w+)\s*>"),
        _store("sql", "table", r"\[Table\(\s*\"(\w+)\""),
        _store("sql", "to-table", r"\.ToTable\(\s*\"(\w+)\""),
        _store("sql", "raw", _STATEMENT),
        _store("mongodb", "driver", r"\.GetCollection<[^>\n]+>\(\s*\"([^\"\n]+)\""),
        _store("mongodb", "attribute", r"\[(?:Bson)?Collection\(\s*\"([^\"\n]+)\""),
        _store("dynamodb", "table", r"\[DynamoDBTable\(\s*\"([\w.-]+)\""),
        _store("dynamodb", "table-name", r"\bTableName\s*=\s*\"([^\"\n]+)\""),
        _keys(r"\.(?:String(?:Get|Set)|(?:Get|Set)String|Hash(?:Get|Set))(?:Async)?"),
    ],
}
#: How each rule reaches its store, where it isn't by a statement or a plain request.
ACCESS = {
    "orm-model": ["orm-entity", "prisma", "sequelize", "sequelize-table", "orm-model", "orm-table", "orm-query", "django-table", "django-model", "gorm", "gorm-model", "gorm-name", "db-set", "to-table"],
    "collection": ["mongoose", "driver", "item", "document", "attribute"],
    "cache-key": ["cache-key", "hash"],
}
#: Words that stand after FROM in prose and code but name no table.
NO_TABLES = ["where", "set", "id", "select", "the", "values"]


def stores(files: DataFrame, language: str) -> DataFrame:
    """(service, path, line, name, db_type, access, access_pattern): once for each kind and name, whatever its case.

    access is the rule that saw it, access_pattern one of ``ACCESS`` or raw-query. An index counts where its file speaks of Elasticsearch.
    """
    rows = with_context(lines(files), ahead=3, back=0)
    rows = rows.withColumn("_elastic", F.max(F.col("text").rlike("(?i)elastic")).over(Window.partitionBy("service", "path")))
    marks = apply(rows, STORES[language], ["name", "db_type"], ["service", "path", "line", "text", "ahead", "_elastic"]).where("name is not null")
    if language in ("typescript", "python"):
        marks = marks.where("db_type <> 'elasticsearch' or _elastic")
    marks = marks.drop("_elastic")
    marks = marks.where(~((F.col("rule") == "raw") & F.lower("name").isin(NO_TABLES)))
    marks = marks.withColumn("name", F.when(F.col("rule") == "prisma", F.concat(F.lower("name"), F.lit("s"))).when(F.col("rule") == "django-model", F.lower("name")).otherwise(F.col("name")))
    if language == "java":
        # an entity without a table's name is its class in snake case
        entity = rows.where(F.col("text").rlike(r"@Entity\b") & ~F.concat_ws("\n", "text", "ahead").rlike(r"@Table\("))
        name = F.regexp_extract("ahead", r"\bclass\s+(\w+)", 1)
        own = entity.where(name != "").select("service", "path", "line", "text", "ahead", F.lit(-1).alias("rank"), F.lit("orm-entity").alias("rule"), F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")).alias("name"), F.lit("sql").alias("db_type"))
        marks = marks.unionByName(own)
    once = first_of(marks.withColumn("_k", F.lower("name")), ["service", "db_type", "_k"], ["path", "line", "rank"])
    pattern = F.lit("raw-query")
    for word, rules in ACCESS.items():
        # a table is a model's where a class is annotated with it, and a plain request's elsewhere
        pattern = F.when(F.col("rule").isin(rules) | (F.lit(word == "orm-model") & (F.col("rule") == "table") & (F.col("db_type") == "sql")), word).otherwise(pattern)
    return once.select("service", "path", "line", "name", "db_type", F.col("rule").alias("access"), pattern.alias("access_pattern"))


IMPORTS = {
    "typescript": [Rule("from", r"\bfrom\s+[\"']([^\"']+)", {"name": 1}), Rule("require", r"\brequire\(\s*[\"']([^\"']+)", {"name": 1})],
    "java": [Rule("import", r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;", {"name": 1})],
    "csharp": [Rule("using", r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", {"name": 1})],
    "python": [Rule("from", r"^\s*from\s+([\w.]+)\s+import\b", {"name": 1}), Rule("import", r"^\s*import\s+([\w.]+)", {"name": 1})],
    "go": [Rule("import", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", {"name": 1})],
}
#: Packages that everybody uses: what begins so isn't shared by two services of one owner.
PUBLIC = {
    "typescript": ["@nestjs/", "@types/", "express", "axios", "rxjs", "class-", "typeorm", "node:", "react", "lodash", "fs", "path", "http", "crypto", "util"],
    "java": ["java.", "javax.", "jakarta.", "org.springframework", "org.apache", "org.slf4j", "com.fasterxml", "lombok", "io.swagger", "com.google", "org.junit", "kotlin."],
    "csharp": ["System", "Microsoft", "Newtonsoft", "Serilog", "AutoMapper", "MediatR", "Xunit"],
    "python": ["os", "sys", "re", "json", "typing", "datetime", "logging", "fastapi", "flask", "django", "rest_framework", "pydantic", "sqlalchemy", "requests", "httpx", "asyncio", "dataclasses", "uuid", "collections", "redis", "celery"],
    "go": [],
}


def imports(files: DataFrame, language: str) -> DataFrame:
    """(service, path, line, import_path)."""
    return apply(lines(files), IMPORTS[language], ["name"], ["service", "path", "line"]).where("name is not null").select("service", "path", "line", F.col("name").alias("import_path"))


def internal(path: Column, language: str) -> Column:
    """Whether an import may be a library of one's own: not relative, not of a public package."""
    if language == "go":
        # a module path names a host and an owner; the standard library doesn't
        return (F.size(F.split(path, "/")) >= 3) & F.contains(F.element_at(F.split(path, "/"), 1), F.lit("."))
    ends = r"($|[./-])" if language != "typescript" else ""
    public = "|".join("\\Q" + x + "\\E" + ("" if x[-1] in "./-:" else ends) for x in PUBLIC[language])
    return ~path.startswith(".") & ~path.rlike(f"^(?:{public})")


def shared_libraries(found: DataFrame) -> DataFrame:
    """(import_path, name, used_by, n, first_file) of imports that two services or more use, most used first."""
    least = F.min(F.struct("service", "path", "line"))
    uses = found.groupBy("import_path").agg(F.array_sort(F.collect_set("service")).alias("used_by"), least.alias("first")).where(F.size("used_by") >= 2)
    name = F.element_at(F.split("import_path", "[/.]"), -1)
    return uses.select("import_path", name.alias("name"), "used_by", F.size("used_by").alias("n"), F.col("first.path").alias("first_file")).orderBy(F.desc("n"), "import_path")
