"""Stored tables of a scan, kept up to date: a rescan reads and overwrites only the services that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirechart.plugins import Registry, registry
from wirechart.scanning import connect, extract
from wirechart.sources import files as sources
from wirechart.storage import written


#: Tables that ``extract`` gives, by service.
TABLES = ["services", "types", "endpoints", "calls", "hints", "messages", "stores", "imports"]


def replace(rows: DataFrame, services: list[str], path: str) -> None:
    """Overwrites these services' partitions of the table at path with rows(service, ...) and leaves all others.

    A dynamic overwrite touches only partitions that get rows, so each service gets a row that only says that it was read:
    one without any row left is emptied, too.
    """
    own = rows.where(F.col("service").isin(services)).withColumn("_mark", F.lit(False))
    marks = rows.sparkSession.createDataFrame([(s, True) for s in services], "service string, _mark boolean")
    both = own.unionByName(marks, allowMissingColumns=True).withColumn("_part", F.concat(F.lit("s_"), "service"))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table at path; services that were read at different times may have different columns."""
    return spark.read.option("mergeSchema", True).parquet(path).where(~F.col("_mark")).drop("_mark", "_part")


def refresh(spark: SparkSession, roots: dict[str, str], services: list[str], path: str, plugins: Registry = registry) -> dict[str, DataFrame]:
    """Extracts the services anew, replaces their rows below path, and connects the stored tables of all services.

    A service whose folder is gone loses its rows. What is resolved depends on all services, so ``connect`` runs over the
    whole stored tables, which are small beside the sources; its tables are overwritten.
    """
    files = written(sources.source_files(spark, {s: roots[s] for s in services if s in roots}).where("error is null"), "files")
    for name, table in extract(files.select("service", "path", "content"), plugins).items():
        replace(table, services, f"{path}/{name}")
    tables = {name: stored(spark, f"{path}/{name}") for name in TABLES}
    joined = connect(tables)
    for name, table in joined.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return tables | {name: spark.read.schema(t.schema).parquet(f"{path}/{name}") for name, t in joined.items()}


def rescanner(roots: dict[str, str], path: str, plugins: Registry = registry) -> Callable[[SparkSession, list[str]], None]:
    """A rescan for ``watch`` that keeps the tables below path up to date."""

    def rescan(spark: SparkSession, services: list[str]) -> None:
        refresh(spark, roots, services, path, plugins)

    return rescan
