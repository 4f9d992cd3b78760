"""Languages and frameworks of services, by ranked rules over their root's files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.functions.text import slug
from wirechart.operators.code import first_of


def _named(*names: str) -> Column:
    return F.col("path").isin(*names)


def _says(word: str) -> Column:
    return F.contains(F.lower("content"), F.lit(word))


def _depends(name: str) -> Column:
    at = lambda part: F.get_json_object("content", f"$.{part}['{name}']").isNotNull()
    return at("dependencies") | at("devDependencies")


def _node() -> Column:
    return _named("package.json")


def _pom() -> Column:
    return _named("pom.xml")


_PY = ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"]
#: (condition on a file of the root, language, framework, confidence) in the order in which they are tried.
RULES: list[tuple] = [
    (lambda: _node() & (_depends("@nestjs/core") | _depends("@nestjs/common")), "typescript", "nestjs", 0.98),
    (lambda: _node() & _depends("express"), "typescript", "express", 0.92),
    (lambda: _node() & F.try_parse_json("content").isNotNull(), "typescript", "unknown", 0.70),
    (lambda: _named("go.mod") & _says("gin-gonic/gin"), "go", "gin", 0.95),
    (lambda: _named("go.mod") & _says("go-chi/chi"), "go", "chi", 0.95),
    (lambda: _named("go.mod"), "go", "unknown", 0.95),
    (lambda: _pom() & _says("spring-boot"), "java", "spring-boot", 0.97),
    (lambda: _named("build.gradle", "build.gradle.kts") & _says("spring-boot"), "java", "spring-boot", 0.95),
    (lambda: _pom(), "java", "unknown", 0.80),
    (lambda: F.col("path").startswith("src/main/java/"), "java", "unknown", 0.75),
    (lambda: F.col("path").rlike(r"^[^/]+\.csproj$"), "csharp", "aspnet", 0.97),
    (lambda: F.col("path").rlike(r"^[^/]+\.sln$"), "csharp", "unknown", 0.85),
    *[(lambda f=f, w=w: _named(f) & _says(w), "python", w, 0.95) if w else (lambda f=f: _named(f), "python", "unknown", 0.70) for f in _PY for w in ("fastapi", "django", "flask", "")],
    (lambda: _named("main.py", "app.py"), "python", "unknown", 0.60),
]


def detect(files: DataFrame, plugins: list[tuple] = ()) -> DataFrame:
    """(service, language, framework, detected_from, confidence) of every service of files(service, path, content).

    The first rule that a file of the root satisfies decides; then the first plugin's; else unknown, 0.
    plugins: (condition on a file, language, framework, confidence), tried after RULES.
    """
    rules = [*RULES, *plugins]
    rank = reduce(lambda later, i: F.when(rules[i][0](), i).otherwise(later), reversed(range(len(rules))), F.lit(None).cast("int"))
    # rules on one file's path cascade on each file; the least rank of a service wins
    best = files.withColumn("rank", rank).groupBy("service").agg(F.min(F.struct(F.coalesce("rank", F.lit(len(rules))).alias("rank"), "path")).alias("m"))
    column = lambda k: F.get(F.array(*[F.lit(r[k]) for r in rules]), F.col("m.rank"))
    return best.select("service", F.coalesce(column(1), F.lit("unknown")).alias("language"), F.coalesce(column(2), F.lit("unknown")).alias("framework"), F.when(F.col("m.rank") < len(rules), F.col("m.path")).alias("detected_from"), F.coalesce(column(3), F.lit(0.0)).alias("confidence"))


def service_names(files: DataFrame) -> DataFrame:
    """(service, name): the slug of package.json's name, else of the folder's."""
    title = F.max(F.when(_node(), F.get_json_object("content", "$.name")))
    return files.groupBy("service").agg(title.alias("title")).select("service", slug(F.coalesce("title", "service")).alias("name"))


def polyglot(candidates: DataFrame, order: list[str]) -> DataFrame:
    """(service, parser, n): the parser that finds the most endpoints in a service, the first in order among equals.

    candidates: (service, parser) with a row for each endpoint that a parser found.
    """
    rank = F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, i)])
    counts = candidates.groupBy("service", "parser").agg(F.count("*").alias("n"))
    return first_of(counts, ["service"], [F.desc("n"), F.coalesce(F.try_element_at(rank, F.col("parser")), F.lit(len(order))), "parser"])
