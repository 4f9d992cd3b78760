"""Watching source trees: listings as a stream, what differs between two of them, and a rescan for each settled burst of changes.

A listing (path, size, time of every file) is made by tasks and kept as a table of the shared folder, a manifest. Changes
are a full outer join of two manifests, so files that were added, altered, removed, renamed or set to an older time all
count. A burst has settled when two listings in a row are equal, and differ from the manifest of the last rescan.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wirechart.sources.files import NAMES, SourceNames, options_of

#: Endings of files whose changes count.
SOURCES = r"\.(?:ts|tsx|js|jsx|java|kt|cs|py|go)$"
#: A burst of changes has settled when nothing changed for so long.
QUIET_MS = 500
#: Columns of a manifest, and those by which a file is judged altered.
KEYS, STATE = ["service", "path"], ["bytes", "modified_ns"]


def listings(spark: SparkSession, roots: dict[str, str], pattern: str = SOURCES) -> DataFrame:
    """The stream of whole listings of the roots, one for each trigger."""
    spark.dataSource.register(SourceNames)
    return spark.readStream.format("source_names").options(**options_of(roots, pattern)).load()


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(service, path, change, bytes, modified_ns): files ``added``, ``altered`` or ``removed`` between two manifests, with their newest state.

    Both are manifests(service, path, bytes, modified_ns), one row a file; a renamed file is one removed and one added.
    """
    old = before.select(*KEYS, F.struct(*STATE).alias("old"))
    new = after.select(*KEYS, F.struct(*STATE).alias("new"))
    both = old.join(new, KEYS, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("altered")
    state = F.coalesce("new", "old")
    return both.select(*KEYS, change.alias("change"), *[state[c].alias(c) for c in STATE])


class Manifests:
    """Tables of a folder: the last two listings, and the manifest of the last rescan in two places by turns.

    A place is overwritten only while the other holds, and counts only when it was written to its end, so a driver that dies
    between two steps finds the listing before.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _done(self, place: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self, place: str) -> DataFrame:
        return self.spark.read.schema(f"{NAMES}, version bigint").parquet(f"{self.folder}/{place}")

    def keep(self, rows: DataFrame, place: str, version: int) -> DataFrame:
        # the version is a row of its own: a listing may be empty
        mark = self.spark.createDataFrame([(None,) * 6 + (version,)], f"{NAMES}, version bigint").coalesce(1)
        rows.select(*[c.split()[0] for c in NAMES.split(", ")], F.lit(version).cast("bigint").alias("version")).unionByName(mark).write.mode("overwrite").parquet(f"{self.folder}/{place}")
        return self.files(place)

    def files(self, place: str) -> DataFrame:
        return self.read(place).where("service is not null").drop("version")

    def version(self, place: str) -> int:
        return self.read(place).where("service is null").first().version if self._done(place) else -1

    def settled(self) -> tuple[str, int]:
        """The place of the newest manifest of a rescan and its version; -1 where there is none."""
        return max((("settled-0", self.version("settled-0")), ("settled-1", self.version("settled-1"))), key=lambda x: x[1])


def settle(held: Manifests, listing: DataFrame, number: int, since: int, rescan: Callable[[SparkSession, list[str]], None]) -> list[str]:
    """One listing's turn: keeps it and, where it ends a burst, calls rescan(spark, services) and makes it the manifest; returns the services.

    A turn may be repeated after a failure: then the rescan may be called twice for one burst, never not at all. Services
    whose trees couldn't be listed in full wait for a listing that is.
    """
    seen, last = f"seen-{number % 2}", f"seen-{(number + 1) % 2}"
    found = held.keep(listing, seen, number)
    place, version = held.settled()
    if version < 0:
        place = "settled-0"
        held.keep(found.where(F.col("error").isNull() & (F.col("modified_ns") <= since)), place, number)
    # a root that is gone has no files; one that can't be read says nothing about them
    torn = found.where("error is not null and not startswith(error, 'FileNotFoundError')").select("service").distinct()
    whole = found.where("error is null")
    now = changed_files(held.files(place), whole).join(torn, "service", "left_anti")
    services = [r.service for r in now.select("service").distinct().orderBy("service").collect()]
    if not services or number == 0 or held.version(last) != number - 1 or not changed_files(held.files(last).where("error is null"), whole).isEmpty():
        return []  # nothing yet, or the burst goes on
    rescan(held.spark, services)
    kept = whole.join(torn, "service", "left_anti").unionByName(held.files(place).join(torn, "service", "left_semi"))
    held.keep(kept, "settled-1" if place == "settled-0" else "settled-0", number)
    return services


def watch(spark: SparkSession, roots: dict[str, str], rescan: Callable[[SparkSession, list[str]], None], checkpoint: str, quiet_ms: int = QUIET_MS, since: int | None = None, pattern: str = SOURCES) -> StreamingQuery:
    """Calls rescan(spark, services) once for each settled burst, with the services that changed.

    ``since`` (nanoseconds; now by default) says which files the first listing takes as known; 0: none of them.
    """
    held, begin = Manifests(spark, f"{checkpoint}/manifests"), time.time_ns() if since is None else since
    turn = lambda batch, number: settle(Manifests(batch.sparkSession, held.folder), batch, number, begin, rescan)
    return listings(spark, roots, pattern).writeStream.foreachBatch(lambda b, n: (turn(b, n), None)[1]).option("checkpointLocation", checkpoint).trigger(processingTime=f"{quiet_ms} milliseconds").start()


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Batch or stream events(service, modified) as sessions: service, begin, end and how many changes each burst had."""
    window = F.session_window("modified", f"{quiet_ms} milliseconds")
    return events.groupBy("service", window.alias("w")).agg(F.count("*").alias("n")).select("service", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
