"""Source code as a table of lines: rules over lines, and the lines that belong to a body.

files(service, path, content) become lines(service, path, line, text, before, depth, opens, indent): before and depth are the
open braces ahead of a line and after it, outside of strings and line comments; opens: it has an opening one. Everything is native: one shuffle by
file for all windows, rules as arrays of structs in one pass over the lines. A body is found by windows too, so no join
of calls with handlers is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that a rule sees after and before its own.
AHEAD, BACK = 12, 5
_STRINGS = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"


def _file():
    return Window.partitionBy("service", "path").orderBy("line")


def lines(files: DataFrame) -> DataFrame:
    """One row for each line; null contents have none."""
    rows = files.select("service", "path", F.posexplode(F.split("content", "\r?\n")).alias("at", "text"))
    rows = rows.select("service", "path", (F.col("at") + 1).alias("line"), "text")
    bare = F.regexp_replace(F.regexp_replace("text", _STRINGS, ""), r"//.*$", "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    rows = rows.withColumn("bare", bare).withColumn("turn", count(F.col("bare"), "{") - count(F.col("bare"), "}")).withColumn("opens", F.contains("bare", F.lit("{")))
    rows = rows.withColumn("depth", F.sum("turn").over(_file()).cast("int"))
    indent = F.length("text") - F.length(F.ltrim("text"))
    return rows.select("service", "path", "line", "text", (F.col("depth") - F.col("turn")).cast("int").alias("before"), "depth", "opens", indent.alias("indent"))


def with_context(rows: DataFrame, ahead: int = AHEAD, back: int = BACK) -> DataFrame:
    """Adds ahead, the lines after each one, and back, those before it."""
    near = lambda a, b: F.array_join(F.collect_list("text").over(_file().rowsBetween(a, b)), "\n")
    return rows.withColumn("ahead", near(1, ahead)).withColumn("back", near(-back, -1))


def here(rows: DataFrame, name: str, value: Column, backwards: bool = True) -> DataFrame:
    """Adds the value of the nearest line up to this one that has it; with backwards off, of the file's first line that has it."""
    over = _file() if backwards else Window.partitionBy("service", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(name, (F.last if backwards else F.first)(value, ignorenulls=True).over(over))


def found(text: str | Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def scoped(rows: DataFrame, starts: Column, indented: bool = False) -> DataFrame:
    """Adds head: the line that begins the body which holds a line, null outside of bodies.

    Braces: a body ends with the line on which depth falls back to that before its head. With ``indented`` it ends
    before the first line, after its ``def``, that isn't indented more than the head.
    """
    rows = rows.withColumn("head", F.last(F.when(starts, F.col("line")), ignorenulls=True).over(_file()))
    own = Window.partitionBy("service", "path", "head").orderBy("line")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    any_ = lambda c, over: F.coalesce(F.max(c.cast("int")).over(over), F.lit(0)) > 0
    rows = rows.withColumn("_base", F.first("indent" if indented else "before").over(own))
    if indented:
        rows = rows.withColumn("_begun", any_(F.col("text").rlike(r"^\s*(?:async\s+)?def\s"), earlier))
        ends = F.col("_begun") & (F.trim("text") != "") & (F.col("indent") <= F.col("_base")) & ~F.col("text").rlike(r"^\s*[)\]}]")
    else:
        rows = rows.withColumn("_begun", F.lit(True))
        ends = (F.col("depth") <= F.col("_base")) & ((F.col("before") > F.col("_base")) | F.col("opens"))
    rows = rows.withColumn("_ends", ends)
    over = any_(F.col("_ends"), own if indented else earlier)
    return rows.withColumn("_over", over).withColumn("head", F.when(~F.col("_over"), F.col("head"))).drop("_base", "_begun", "_ends", "_over")


@dataclass(frozen=True)
class Rule:
    """What one pattern says about a line: groups of the match, or fixed values, by name."""

    name: str
    pattern: str
    groups: dict[str, int] = field(default_factory=dict)
    fixed: dict[str, str] = field(default_factory=dict)
    near: bool = False  # the match begins on the line and may go on in the lines after it


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def apply(rows: DataFrame, rules: list[Rule], names: list[str], keep: list[str]) -> DataFrame:
    """(keep, rank, rule, *names): every match of every rule on each line, in one pass; rank is the rule's place in the list."""

    def matches(rank: int, rule: Rule) -> str:
        values = [f"nullif(regexp_extract(m, {_quoted(rule.pattern)}, {rule.groups[n]}), '')" if n in rule.groups else f"cast({_quoted(rule.fixed[n]) if n in rule.fixed else 'null'} as string)" for n in names]
        row = f"struct({rank} as rank, {_quoted(rule.name)} as rule, " + ", ".join(f"{v} as `{n}`" for v, n in zip(values, names)) + ")"
        if rule.near:
            first = f"regexp_extract(concat_ws('\\n', text, ahead), {_quoted(f'^[^' + chr(92) + f'n]*?({rule.pattern})')}, 1)"
            return f"transform(filter(array({first}), m -> m <> ''), m -> {row})"
        return f"transform(regexp_extract_all(text, {_quoted(rule.pattern)}, 0), m -> {row})"

    # one expression as text: hundreds of columns made one by one would take longer than the matching
    return rows.select(*keep, F.expr(f"inline(flatten(array({', '.join(matches(i, r) for i, r in enumerate(rules))})))"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def arguments(text: str | Column, callee: str) -> Column:
    """The arguments of the first call of ``callee`` (a pattern) in a text, as texts; brackets nest to two levels. One empty text without such a call."""
    text = F.col(text) if isinstance(text, str) else text
    nested = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*"
    inside = F.regexp_extract(text, rf"(?s)\b(?:{callee})\s*\(({nested})", 1)
    return F.transform(F.split(inside, r",(?![^(\[{]*[)\]}])"), lambda x: F.trim(F.translate(x, "\n\t", "  ")))


def keyword(args: Column, name: str) -> Column:
    """The value of the first argument ``name=value`` or ``name: value``, null without one; name is a pattern."""
    mark = rf"^\{{?\s*(?:{name})\s*[=:]"
    return F.trim(F.regexp_replace(F.get(F.filter(args, lambda x: x.rlike(mark)), F.lit(0)), mark, ""))


def literal(text: Column) -> Column:
    """What a string literal holds with which a text begins, whatever its prefix; null for anything else."""
    return F.when(text.rlike("^[A-Za-z$@]{0,2}[\"'`]"), F.regexp_extract(text, "^[A-Za-z$@]{0,2}[\"'`]([^\"'`\\n]*)", 1))
