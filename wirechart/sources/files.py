"""Source trees as DataFrames: files of a language, interface files, service roots, configuration and saved documents.

Spark's own file sources leave out names that begin with a dot or an underscore, so trees are listed by a Python data
source: the driver opens only the uppermost folders, until there are parts enough; tasks walk the rest. The names are
then dealt by their hash, so one huge folder is read by all tasks. A file that can't be read or decoded, or a folder that
can't be listed, is a row with an error and without content, so nothing is lost silently.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Folders below a root that are never read.
SKIPPED = ["node_modules", "vendor", "dist", "build", ".git", "__pycache__", ".venv", "venv", "env", ".env", "target", "bin", "obj", ".gradle", "coverage", ".nyc_output", ".next", ".nuxt", "out"]
#: The files that mark the root of a service, in the order in which a folder is judged, with their language.
MARKERS = [
    ("go.mod", "go"),
    ("pom.xml", "java"),
    ("build.gradle", "java"),
    ("build.gradle.kts", "java"),
    ("*.csproj", "csharp"),
    ("*.sln", "csharp"),
    ("pyproject.toml", "python"),
    ("requirements.txt", "python"),
    ("Pipfile", "python"),
    ("setup.py", "python"),
    ("setup.cfg", "python"),
    ("package.json", "typescript"),
]
#: What is read of a language, sources and configuration alike, as patterns of a path below the root.
LANGUAGES = {
    "typescript": r"\.(?:ts|tsx|js|mjs)$|(?:^|/)\.env[^/]*$|(?:^|/)package\.json$",
    "java": r"\.(?:java|kt)$|(?:^|/)(?:application|bootstrap)[^/]*\.(?:properties|ya?ml)$",
    "csharp": r"\.cs$|(?:^|/)appsettings[^/]*\.json$",
    "python": r"\.py$|(?:^|/)\.env[^/]*$|(?:^|/)(?:settings|config)[^/]*\.(?:toml|ini|cfg)$",
    "go": r"\.go$|\.proto$",
}
#: Sources that are left out of extraction: tests and generated code.
TESTS = r"(?:^|/)(?:tests?|__tests__|spec|testdata|migrations)/|\.(?:spec|test|d)\.[jt]sx?$|_test\.go$|(?:^|/)test_[^/]*\.py$|Tests?\.(?:java|kt|cs)$|\.pb\.go$|_pb2(?:_grpc)?\.py$"
#: Interface files by kind.
SPECS = r"(?i)(?:^|/)(?:[^/]*\.)?(?:openapi|swagger)\.(?:json|ya?ml)$|(?:^|/)(?:openapi|swagger)/.*\.(?:json|ya?ml)$|(?:^|/)api-(?:spec|docs)\.(?:json|ya?ml)$"
PROTOS, GRAPHQL = r"\.proto$", r"\.(?:graphql|gql)$|(?:^|/)schema\.(?:ts|js)$"
#: The driver opens folders until it has so many parts, or has seen so many entries; tasks walk what is left.
PARTS, LOOKS = 256, 4096
#: Contents leave a task in batches of about so many bytes.
BATCH = 32 << 20
#: A longer file isn't a text that Spark can hold.
LONGEST = (1 << 31) - 1
NAMES = "service string, root string, path string, bytes bigint, modified_ns bigint, error string"
SCHEMA = "service string, root string, path string, content string, bytes bigint, modified double, error string"


@dataclass
class _Part(InputPartition):
    #: service, root, folder below it, and whether the folders below belong to the part
    places: list[tuple[str, str, str, bool]]


class SourceNames(DataSource):
    """Format ``source_names``: options roots (JSON list of [service, folder]), pattern (of paths below a root), skipped (JSON list).

    A batch gives NAMES once; a stream gives the whole listing again for each trigger.
    """

    @classmethod
    def name(cls) -> str:
        return "source_names"

    def schema(self) -> str:
        return NAMES

    def reader(self, schema) -> DataSourceReader:
        return _Names(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NameStream(self.options)


class _Names(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.pattern = re.compile(options.get("pattern", ""))
        self.skipped = set(json.loads(options.get("skipped", json.dumps(SKIPPED))))

    def partitions(self) -> list[_Part]:
        places = opened([(service, root, "", True) for service, root in self.roots], self.skipped)
        n = max(1, min(len(places), PARTS))
        return [_Part(places[i::n]) for i in range(n)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for service, root, folder, deep in part.places:
            failed: list[OSError] = []
            for path in walked(root, self.skipped, folder, deep, failed.append):
                if self.pattern.search(path):
                    try:
                        at = os.stat(os.path.join(root, path))
                        yield service, root, path, at.st_size, at.st_mtime_ns, None
                    except OSError as e:
                        yield service, root, path, None, None, _said(e)
            for e in failed:
                yield service, root, _below(root, str(e.filename)), None, None, _said(e)


class _NameStream(DataSourceStreamReader):
    """Offsets only count triggers: what a batch holds is the state of the trees when its tasks ran."""

    def __init__(self, options):
        self.names = _Names(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        return self.names.partitions()

    def read(self, part: _Part) -> Iterator[tuple]:
        return self.names.read(part)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _below(root: str, path: str) -> str:
    return os.path.relpath(path, root).replace(os.sep, "/")


def opened(places: list[tuple[str, str, str, bool]], skipped: set[str]) -> list[tuple[str, str, str, bool]]:
    """The same trees in more parts, uppermost folders first, for at most LOOKS entries and about PARTS parts."""
    waiting, done, looks = deque(places), [], 0
    while waiting and len(waiting) + len(done) < PARTS and looks < LOOKS:
        service, root, folder, _ = waiting.popleft()
        below = []
        try:
            with os.scandir(os.path.join(root, folder)) as entries:
                for e in entries:
                    looks += 1
                    if e.name not in skipped and e.is_dir(follow_symlinks=False):
                        below.append((service, root, f"{folder}/{e.name}" if folder else e.name, True))
                    if looks >= LOOKS:
                        break
                else:
                    done.append((service, root, folder, False))
                    waiting.extend(sorted(below))
                    continue
        except OSError:
            pass  # the task that walks it says so
        done.append((service, root, folder, True))
    return [*done, *waiting]


def walked(root: str, skipped: set[str], folder: str = "", deep: bool = True, onerror=None) -> Iterator[str]:
    """Paths of a folder below a root in order, without folders of those names; the root's own name doesn't count."""
    for at, folders, files in os.walk(os.path.join(root, folder) if folder else root, onerror=onerror):
        folders[:] = sorted(x for x in folders if x not in skipped) if deep else []
        for name in sorted(files):
            yield _below(root, os.path.join(at, name))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form = pa.schema([("service", pa.string()), ("root", pa.string()), ("path", pa.string()), ("content", pa.string()), ("bytes", pa.int64()), ("modified", pa.float64()), ("error", pa.string())])
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            content, size, error = None, row["bytes"], row["error"]
            if error is None:
                try:
                    if size > LONGEST:
                        raise ValueError(f"{size} bytes are too many for one text")
                    with open(os.path.join(row["root"], row["path"]), "rb") as f:
                        raw = f.read()
                    size, content = len(raw), raw.decode("utf-8-sig")
                except (OSError, ValueError) as e:
                    error = _said(e)
            modified = None if row["modified_ns"] is None else row["modified_ns"] / 1e9
            rows.append({"service": row["service"], "root": row["root"], "path": row["path"], "content": content, "bytes": size, "modified": modified, "error": error})
            held += size or 0
            if held >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, form)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, form)


def options_of(roots: str | dict[str, str], pattern: str = "", skipped: list[str] = SKIPPED) -> dict[str, str]:
    """Options of the format for one root, or for the root of each service."""
    named = roots if isinstance(roots, dict) else {os.path.basename(os.path.normpath(roots)): roots}
    return {"roots": json.dumps(list(named.items())), "pattern": pattern, "skipped": json.dumps(skipped)}


def source_names(spark: SparkSession, roots: str | dict[str, str], pattern: str = "", skipped: list[str] = SKIPPED) -> DataFrame:
    """NAMES of the files below the roots: sizes and times without contents."""
    spark.dataSource.register(SourceNames)
    return spark.read.format("source_names").options(**options_of(roots, pattern, skipped)).load()


def source_files(spark: SparkSession, roots: str | dict[str, str], pattern: str = "", skipped: list[str] = SKIPPED) -> DataFrame:
    """SCHEMA for the files below a root, or below the root of each service; one that fails has an error in place of content."""
    names = source_names(spark, roots, pattern, skipped)
    # a count of its own: adaptive plans would read all files in one task, as their names are few bytes
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return names.repartition(tasks, "service", "path").mapInArrow(_contents, SCHEMA)


def of_language(files: DataFrame, language: str, tests: bool = False) -> DataFrame:
    """The files that a language's extraction reads."""
    out = files.where(F.col("path").rlike(LANGUAGES[language]))
    return out if tests else out.where(~F.col("path").rlike(TESTS))


def of_kind(files: DataFrame, pattern: str) -> DataFrame:
    """Interface files: SPECS, PROTOS or GRAPHQL."""
    return files.where(F.col("path").rlike(pattern))


def capped(files: DataFrame, most: int = 200) -> DataFrame:
    """The first files of each service, by path: what data stores and libraries are looked for in."""
    from pyspark.sql import Window

    return files.withColumn("_r", F.row_number().over(Window.partitionBy("service").orderBy("path"))).where(F.col("_r") <= most).drop("_r")


def _rank(name: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, (marker, _) in reversed(list(enumerate(MARKERS))):
        fits = name.endswith(marker[1:]) if marker.startswith("*") else name == marker
        rank = F.when(fits, i).otherwise(rank)
    return rank


def service_roots(files: DataFrame, depth: int = 3) -> DataFrame:
    """(root, folder, depth, marker, language): the uppermost folders with a marker, at most ``depth`` below a root.

    files(root, path, content). A workspace's package.json in the root itself marks nothing. Each folder is joined with
    its own ancestors, so what lies below a claimed folder is found by an equi join.
    """
    parts = F.split("path", "/")
    rows = files.select("root", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), "content")
    workspace = (F.col("depth") == 0) & (F.col("name") == "package.json") & F.get_json_object("content", "$.workspaces").isNotNull()
    marked = rows.withColumn("rank", _rank(F.col("name"))).where(F.col("rank").isNotNull() & (F.col("depth") <= depth) & ~F.coalesce(workspace, F.lit(False)))
    # hidden folders and those that are never read mark nothing, nor does what lies in them
    hidden = lambda x: x.startswith(".") | x.isin(SKIPPED)
    marked = marked.where(~F.exists(F.split("folder", "/"), hidden))
    best = marked.groupBy("root", "folder", "depth").agg(F.min(F.struct("rank", "name")).alias("m"))
    names = F.array(*[F.lit(x) for _, x in MARKERS])
    best = best.select("root", "folder", "depth", F.col("m.name").alias("marker"), F.get(names, F.col("m.rank")).alias("language"))
    steps = F.split("folder", "/")
    above = best.where("depth > 0").select("root", F.col("folder").alias("own"), F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "/")))).alias("folder")).where("folder <> own")
    nested = above.join(best.select("root", "folder"), ["root", "folder"], "left_semi").select("root", F.col("own").alias("folder"))
    return best.join(nested, ["root", "folder"], "left_anti").orderBy("root", "depth", "folder")


#: Where a specification of a service is looked for, in order.
SPEC_PLACES = ["openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json", "docs/openapi.yaml", "docs/swagger.yaml", "docs/swagger.json", "api/openapi.yaml"]


def spec_presence(files: DataFrame) -> DataFrame:
    """(service, spec_file): the first of SPEC_PLACES that a service has; null without any."""
    places = F.create_map(*[F.lit(x) for i, p in enumerate(SPEC_PLACES) for x in (p, i)])
    rank = F.try_element_at(places, F.col("path"))
    return files.groupBy("service").agg(F.min_by("path", rank).alias("spec_file"))


def saved_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A saved output document as one row; without a schema, as a variant column ``document``."""
    if schema:
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("document"))


def settings(folder: str, given: dict, names: tuple[str, ...] = (".wirechart.json", "wirechart.config.json")) -> dict:
    """The first configuration file of a folder that parses, overlaid with the given values that aren't None."""
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, ValueError):
            continue
        return found | {k: v for k, v in given.items() if v is not None}
    return {k: v for k, v in given.items() if v is not None}
