"""Clients that are made in one place and used in another: base URLs, gRPC stubs and GraphQL documents by their variables.

Definitions and uses are rows of one table. Within a file the last definition before a use counts, else the file's first: a
window over both kinds of rows in order of lines, so nothing is joined line by line. Across the files of a service a name's
definition is looked up by an equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirechart.operators.code import Rule, apply, arguments, first_of, found, keyword, literal

#: How the variable is written that a statement assigns to, up to the expression that makes the client.
_ASSIGNED = r"([A-Za-z_$][\w$]*)\s*(?::\s*[\w<>\[\]. ,|]+)?\s*:?=\s*(?:await\s+|new\s+)?[\w.()]*$"
#: What makes a client, by language: a pattern of the expression, and the calls and settings that may hold its base URL.
MAKERS = {
    "typescript": (r"\b(?:axios\.create|got\.extend|ky\.create|request\.defaults)\(", r"axios\.create|got\.extend|ky\.create|request\.defaults", "baseURL|prefixUrl|baseUrl"),
    "java": (r"\b(?:WebClient|RestClient)\.(?:create|builder)\(|\.(?:baseUrl|rootUri)\(", r"(?:WebClient|RestClient)\.create|baseUrl|rootUri", None),
    "csharp": (r"\bnew\s+(?:HttpClient|RestClient)\b|\.BaseAddress\s*=|\bCreateClient\(", "new Uri|new RestClient", None),
    "python": (r"\b(?:AsyncClient|Client|ClientSession|Session)\(", "AsyncClient|Client|ClientSession|Session", "base_url"),
    "go": (r"\bresty\.New\(\)|\.Set(?:HostURL|BaseURL)\(", "SetHostURL|SetBaseURL", None),
}
#: Uses of a variable as a client: its name, the verb and what follows the call's bracket.
USES = {
    "typescript": Rule("use", r"([\w$]+)\.(get|post|put|delete|patch|head|options)(?:<[^(\n]*>)?\(([^\n]*)", {"name": 1, "verb": 2, "rest": 3}),
    "java": Rule("use", r"(\w+)\s*\.(get|post|put|delete|patch|head|options)\(\)(?:\s*\.\w+\([^()\n]*\))*?\s*\.uri\(([^\n]*)", {"name": 1, "verb": 2, "rest": 3}, near=True),
    "csharp": Rule("use", r"(\w+)\.(Get|Post|Put|Delete|Patch)\w*(?:<[^(\n]*>)?\(([^\n]*)", {"name": 1, "verb": 2, "rest": 3}),
    "python": Rule("use", r"(\w+)\.(get|post|put|delete|patch|head|options)\((?:\s*url\s*=)?([^\n]*)", {"name": 1, "verb": 2, "rest": 3}),
    "go": Rule("use", r"(\w+)\.R\(\)[^\n]*?\.(Get|Post|Put|Delete|Patch|Head)\(([^\n]*)", {"name": 1, "verb": 2, "rest": 3}),
}


def value(expression: Column) -> Column:
    """A base URL as it is written: a literal's text, else ${NAME} for the last name of a constant or of an environment variable."""
    env = F.coalesce(found(expression, r"(?:[gG]et[eE]nv|environ\.get|GetEnvironmentVariable)\(\s*[\"'](\w+)"), found(expression, r"environ\[\s*[\"'](\w+)"))
    name = F.coalesce(env, found(expression, r"^(?:\w+\.)*([A-Za-z_]\w*)\s*$"))
    return F.coalesce(F.nullif(literal(expression), F.lit("")), F.when(name.isNotNull(), F.concat(F.lit("${"), name, F.lit("}"))))


def bindings(rows: DataFrame, language: str) -> DataFrame:
    """(service, path, line, name, base): variables that hold clients with a base URL; rows: lines with what lies ahead."""
    maker, calls, setting = MAKERS[language]
    statement = F.concat_ws("\n", "text", "ahead")
    if language in ("java", "csharp", "typescript"):
        statement = F.element_at(F.split(statement, ";", 2), 1)
    rows = rows.where(F.col("text").rlike(maker)).withColumn("statement", statement)
    head = F.element_at(F.split("text", maker, 2), 1)
    name = F.coalesce(found("text", r"\bas\s+(\w+)\s*:"), found("text", r"(\w+)\.(?:BaseAddress\s*=|Set(?:HostURL|BaseURL)\()"), found(head, _ASSIGNED))
    said = [F.get(arguments("statement", calls), F.lit(0))]
    if setting:
        # named arguments, and the entries of an object of options
        entries = F.split(F.regexp_extract("statement", rf"(?s)\b(?:{calls})\(\s*\{{(.*)", 1), r"[,}]")
        said = [keyword(arguments("statement", calls), setting), keyword(F.transform(entries, lambda x: F.trim(F.translate(x, "\n\t", "  "))), setting)]
    base = F.get(F.filter(F.transform(F.array(*said), value), lambda x: x.isNotNull()), F.lit(0))
    if language == "csharp":
        named = F.concat(F.lit("lb://"), literal(F.get(arguments("statement", "CreateClient"), F.lit(0))))
        base = F.coalesce(named, base)
    return rows.select("service", "path", "line", name.alias("name"), base.alias("base")).where("name is not null and base is not null")


def as_of(definitions: DataFrame, uses: DataFrame, column: str) -> DataFrame:
    """uses(service, path, line, name, ..) with the column of the last definition before them, else of the file's first; without one they go."""
    both = definitions.select("service", "path", "line", "name", column, F.lit(0).alias("kind")).unionByName(uses.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    over = Window.partitionBy("service", "path", "name").orderBy("line", "kind")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(over), F.first(column, ignorenulls=True).over(whole)))
    return both.where(F.col("kind").eqNullSafe(1) & F.col(column).isNotNull()).drop("kind")


def joined(base: Column, place: Column) -> Column:
    """A base URL and a path with one slash between; a whole URL stands for itself."""
    return F.when(place.rlike(r"^[a-z]+://"), place).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.when(place == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(place, "^/+", "")))))


def based_calls(rows: DataFrame, language: str) -> DataFrame:
    """(service, path, line, rank, rule, method, url, said): calls of clients whose base URL their variable holds; said is the path as written."""
    made = bindings(rows, language)
    uses = apply(rows, [USES[language]], ["name", "verb", "rest"], ["service", "path", "line"]).withColumn("said", literal(F.trim("rest"))).where("said is not null and name is not null")
    out = as_of(made, uses.drop("rest", "rule", "rank"), "base").select("service", "path", "line", F.lit(-1).alias("rank"), F.lit("base-url").alias("rule"), F.upper("verb").alias("method"), joined(F.col("base"), F.col("said")).alias("url"), "said")
    if language in ("python", "go"):  # the place where a client gets a literal base counts as a call of it
        own = made.where(F.col("base").rlike("^[a-z]+://")).select("service", "path", "line", F.lit(-1).alias("rank"), F.lit("base-url").alias("rule"), F.lit("GET").alias("method"), F.col("base").alias("url"), F.col("base").alias("said"))
        out = out.unionByName(own)
    return out.distinct()


#: Variables that hold gRPC stubs: the service's name in the expression that makes one.
STUBS = {
    "go": Rule("stub", r"(\w+)\s*(?:,\s*\w+\s*)?:?=\s*\w+\.New(\w+)Client\(", {"name": 1, "of": 2}),
    "typescript": Rule("stub", r"(\w+)\s*=\s*[\w.]+\.getService(?:<[^>]*>)?\(\s*['\"`](\w+)", {"name": 1, "of": 2}),
    "python": Rule("stub", r"(\w+)\s*=\s*(?:\w+\.)*(\w+)Stub\(", {"name": 1, "of": 2}),
    "java": Rule("stub", r"(\w+)\s*=\s*(?:\w+\.)*(\w+)Grpc\.new\w*Stub\(", {"name": 1, "of": 2}),
    "csharp": Rule("stub", r"(\w+)\s*=\s*new\s+(?:\w+\.)*?(\w+)\.\2Client\s*\(", {"name": 1, "of": 2}),
}
#: A method of a variable: Go's take the context first, other languages' anything.
METHODS = {
    "go": Rule("method", r"(\w+)\.([A-Z]\w*)\(\s*(?:ctx|context\.\w+\(\))", {"name": 1, "verb": 2}),
    "csharp": Rule("method", r"(\w+)\.([A-Z]\w*?)(?:Async)?\(", {"name": 1, "verb": 2}),
}
_METHOD = Rule("method", r"(\w+)\.([a-zA-Z]\w*)\(", {"name": 1, "verb": 2})


def stub_calls(rows: DataFrame, language: str) -> DataFrame:
    """(service, path, line, rank, rule, url, confidence): methods called on gRPC stubs.

    A variable is one if its name says so (Go only: ..Client, ..Stub), or if any file of the service makes it one; the URL then names the stub's service.
    """
    keep = ["service", "path", "line"]
    made = apply(rows, [STUBS[language]], ["name", "of"], keep)
    made = first_of(made, ["service", "name"], ["path", "line"]).select("service", "name", "of")
    uses = apply(rows, [METHODS.get(language, _METHOD)], ["name", "verb"], keep).join(made, ["service", "name"], "left")
    plain = F.col("name").rlike(r"(?:Client|[sS]tub)$") if language == "go" else F.lit(False)
    uses = uses.where(plain | F.col("of").isNotNull())
    what = F.when(plain, F.col("name")).otherwise(F.col("of"))
    return uses.select(*keep, F.lit(100).alias("rank"), F.lit("grpc-method").alias("rule"), F.concat(F.lit("grpc-method://"), what, F.lit("/"), "verb").alias("url"), F.lit(0.75).alias("confidence")).distinct()


#: Variables that hold GraphQL documents: the operation's kind and name in the text that is assigned.
_DOCUMENT = Rule("document", r"(\w+)(?:\s*:\s*[\w.]+)?\s*:?=\s*(?:await\s+|new\s+)?(?:[\w.]+\(\s*)*(?:\w+\s*(?=`)|[rf])?[\"'`]{1,3}\s*(query|mutation|subscription)\s+(\w+)", {"name": 1, "kind": 2, "operation": 3}, near=True)


def documents(rows: DataFrame) -> DataFrame:
    """(service, name, kind, operation): the last definition of each variable of a service that holds a named operation."""
    found_ = apply(rows, [_DOCUMENT], ["name", "kind", "operation"], ["service", "path", "line"])
    return first_of(found_, ["service", "name"], [F.desc("path"), F.desc("line")]).select("service", "name", "kind", "operation")
