"""Ordered folds, diffs and text steps over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def fold_registry(writes: DataFrame) -> DataFrame:
    """(map_key, position, service) from writes(map_key, service, seq, weak): a weak write only fills an empty key.

    A later unconditional write replaces the value and keeps the key's first position.
    """
    return writes.groupBy("map_key").agg(F.min("seq").alias("position"), F.coalesce(F.max_by(F.when(~F.col("weak"), F.col("service")), F.when(~F.col("weak"), F.col("seq"))), F.min_by("service", "seq")).alias("service"))


def ranked(df: DataFrame, key: str, rules: list[tuple[Column, dict[str, Column]]], otherwise: dict[str, Column]) -> DataFrame:
    """Columns of the first rule whose condition holds: an ordered cascade as one CASE for each column."""
    out = {}
    for name, last in otherwise.items():
        value = last
        for condition, columns in reversed(rules):
            value = F.when(condition, columns[name]).otherwise(value)
        out[name] = value
    return df.withColumns(out)


def one_row_a_side(rows: DataFrame, keys: list[str], columns: dict[str, Column], is_after: Column) -> DataFrame:
    """(keys, before, after): the last row of each key on either side as a struct, null where a side has none; one shuffle, no join."""
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    side = lambda c: F.max_by(F.when(c, row), F.when(c, seq))
    return rows.groupBy(*keys).agg(side(~is_after).alias("before"), side(is_after).alias("after"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], fields: str) -> DataFrame:
    """Full outer diff of two tables (keys, fields map<string,string>): change, severity, removed and added fields.

    A key that repeats on a side counts with its last row: the greatest seq where the table has that column.
    """
    both = one_row_a_side(before.withColumn("_after", F.lit(False)).unionByName(after.withColumn("_after", F.lit(True)), allowMissingColumns=True), keys, {"f": F.col(fields)}, F.col("_after"))
    both = both.withColumns({"b": F.col("before.f"), "a": F.col("after.f"), "in_b": F.when(F.col("before").isNotNull(), True), "in_a": F.when(F.col("after").isNotNull(), True)})
    gone = F.array_sort(F.array_except(F.map_keys("b"), F.map_keys("a")))
    new = F.array_sort(F.array_except(F.map_keys("a"), F.map_keys("b")))
    both = both.withColumn("removed_fields", F.when(F.col("in_a") & F.col("in_b"), gone)).withColumn("added_fields", F.when(F.col("in_a") & F.col("in_b"), new))
    change = F.when(F.col("in_a").isNull(), "removed").when(F.col("in_b").isNull(), "added").when((F.size("removed_fields") > 0) | (F.size("added_fields") > 0), "changed").otherwise("same")
    both = both.withColumn("change", change)
    severity = F.when((F.col("change") == "removed") | (F.size("removed_fields") > 0), "breaking").when(F.col("change") == "same", "none").otherwise("non-breaking")
    return both.select(*keys, "change", severity.alias("severity"), F.coalesce(F.array_join("removed_fields", ","), F.lit("")).alias("removed_fields"), F.coalesce(F.array_join("added_fields", ","), F.lit("")).alias("added_fields"))


def line_table(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no from 1, line)."""
    return df.select(*keys, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(*keys, (F.col("p") + 1).alias("line_no"), "line")


def look_back(lines: DataFrame, calls: DataFrame, keys: list[str], hit: Column, lines_back: int = 6) -> DataFrame:
    """Per call(keys, call_line): the nearest line at most ``lines_back`` before it where ``hit`` isn't null, and its value.

    Each hit is copied to the few lines that it can serve, so the range join is an equi join.
    """
    hits = lines.withColumn("hint", hit).where("hint is not null").select(*keys, "line_no", "hint", F.explode(F.sequence(F.col("line_no"), F.col("line_no") + lines_back)).alias("call_line"))
    near = hits.groupBy(*keys, "call_line").agg(F.max_by("hint", "line_no").alias("hint"), F.max("line_no").alias("hint_line"))
    return calls.join(near, [*keys, "call_line"], "left")
