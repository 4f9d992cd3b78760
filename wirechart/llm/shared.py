"""Places, identities and small steps that several operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key of a sieve at least, and the most bytes that one may have; more keys take several passes.
SIEVE_BITS, SIEVE_BYTES = 10, 128 << 20
#: Rows of whole texts that go to a Python task at once.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set and all runs on one machine, as in tests, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='wirechart-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, what: str, batch: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, and lost executors lose nothing.

    batch: rows that go to Python tasks at once while it is written.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of written tables, for ``release``."""
    return len(_written)


def release(since: int, keep: int = 0) -> None:
    """Delete the tables written since a mark but the last ``keep``, once nothing reads them any more."""
    end = len(_written) - keep
    for spark, path in _written[since:end]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since:end]


def swept(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over deleted: Spark does so when the plans are collected that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)  # the first collection lets go of what holds the files, the second finds them free
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sieve:
    """A bitmap with two places for each 64-bit key of one part of all keys: keeps every key that it was built from and few others.

    Only keys whose ``by`` (the key itself unless given) falls in the part are built from and kept. The size follows the
    keys and is bounded by SIEVE_BYTES through the number of parts.
    """

    def __init__(self, keys: DataFrame, column: str, part: int = 0, parts: int = 1, by: str | None = None):
        spark = keys.sparkSession
        self.part, self.parts = np.uint64(part), np.uint64(parts)
        own = keys.where(F.shiftrightunsigned(by or column, 40) % parts == part) if parts > 1 else keys
        size = 1 << max(15, (own.count() * SIEVE_BITS - 1).bit_length())
        low = F.col(column).bitwiseAND(F.lit(size - 1))
        high = F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(size - 1))
        places = own.select(F.explode(F.array(low + 1, high + 1)).alias("at"))  # bitmap buckets begin at 1
        rows = places.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        whole = np.zeros(size // 8, np.uint8)
        for row in rows.toLocalIterator():
            begin = (row.part - 1) * 4096
            whole[begin : begin + 4096] |= np.frombuffer(row.bits, np.uint8)
        self.mask = np.uint64(size - 1)
        self.bits = spark.sparkContext.broadcast(whole)

    def keeps(self, keys: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        keys = keys.view(np.uint64)
        out = np.ones(len(keys), bool)
        if self.parts > 1:
            out &= ((keys if by is None else by.view(np.uint64)) >> np.uint64(40)) % self.parts == self.part
        for at in (keys & self.mask, (keys >> np.uint64(32)) & self.mask):
            out &= (self.bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def passes(n: int, most: int | None = None) -> int:
    """How many sieves n keys need."""
    return max(1, -(-n * SIEVE_BITS // (8 * (most or SIEVE_BYTES))))


def sieved(tables: list[tuple[DataFrame, str]], by: str | None, task: Callable[..., DataFrame], what: str, batch: int | None = TEXTS) -> DataFrame:
    """The union of task(sieve, ..) over bounded parts of the keys, each written before the next: one sieve of a part for each (keys, column).

    by: the column whose parts all tables are dealt by; without it the keys themselves.
    """
    parts, out = max(passes(keys.count()) for keys, _ in tables), []
    for part in range(parts):
        sieves = [Sieve(keys, column, part, parts, by) for keys, column in tables]
        out.append(stored(task(*sieves), what, batch))
        for sieve in sieves:
            sieve.bits.destroy()
    return reduce(DataFrame.unionByName, out)


