"""Payload shapes of endpoints: declared types by name, placeholders for unknown ones, and nested types level by level.

endpoints(service, .., request, response) name types; types(service, type_name, fields, source) declare them, a service's last
declaration winning. A name without a declaration gets a placeholder without fields, so every named type has a shape. Types are
looked up by an equi join of at most one row for each name of a service.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.operators.code import first_of
from wirechart.storage import written

SHAPE = "struct<type_name: string, fields: array<struct<name: string, type: string, required: boolean>>, source: string>"
#: Types that are written down as they are: their shape is said to be inferred.
PLAIN = ["String", "Integer", "Long", "Boolean", "Double", "Float", "Object", "string", "number", "boolean", "any", "int", "str", "bool", "float", "dict", "object"]
#: How deep nested types are followed unless a cycle ends it first.
LEVELS = 8


def declared(types: DataFrame) -> DataFrame:
    """(service, type_name, shape): one shape for each name of a service, its last declaration."""
    last = first_of(types, ["service", "type_name"], [F.desc("path"), F.desc("line")]) if {"path", "line"} <= set(types.columns) else types
    return last.select("service", "type_name", F.struct("type_name", "fields", "source").cast(SHAPE).alias("shape"))


def _shape(name: Column, shape: Column) -> Column:
    """The declared shape, else a placeholder; none without a name."""
    source = F.when(name.isin(PLAIN), "inferred").otherwise("dto-class")
    nothing = F.array().cast("array<struct<name: string, type: string, required: boolean>>")
    return F.when(name.isNotNull(), F.coalesce(shape, F.struct(name.alias("type_name"), nothing.alias("fields"), source.alias("source")).cast(SHAPE)))


def with_payloads(endpoints: DataFrame, types: DataFrame) -> DataFrame:
    """endpoints with request_body and response_body, the shapes of the types that request and response name."""
    known = declared(types)
    out = endpoints
    for name, column in (("request", "request_body"), ("response", "response_body")):
        own = known.select("service", F.col("type_name").alias(name), F.col("shape").alias("_shape"))
        out = out.join(own, ["service", name], "left").withColumn(column, _shape(F.col(name), F.col("_shape"))).drop("_shape")
    return out.select(*endpoints.columns, "request_body", "response_body")


def bare(kind: Column) -> Column:
    """The name of a field's type without list marks, wrappers and nulls."""
    one = F.regexp_replace(F.regexp_replace(kind, r"\s*\|.*$", ""), r"^[\[\]*\s]+|(?:\[\]|[?*\s])+$", "")
    return F.regexp_replace(F.regexp_replace(one, r"^\w+\s*[<\[]\s*(?:\w+\s*,\s*)?", ""), r"[>\]?*\s]+$", "")


def nested(types: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(service, root, place, depth, name, type, required, is_cycle): all fields below each declared type, by their dotted places.

    A field whose type is on its own path is a cycle and isn't followed. Each level is a join on (service, type) and a written
    table; the walk ends when no field names a declared type.
    """
    fields = written(declared(types).select("service", "type_name", F.posexplode("shape.fields").alias("seq", "f")).select("service", "type_name", "f.name", "f.type", "f.required", bare(F.col("f.type")).alias("of")), "fields")
    names = fields.select("service", F.col("type_name").alias("of"), F.lit(True).alias("known")).distinct()
    edges = written(fields.join(names, ["service", "of"], "left"), "nesting")
    level = edges.select("service", F.col("type_name").alias("root"), F.col("name").alias("place"), F.lit(1).alias("depth"), "name", "type", "required", F.array("type_name").alias("path"), "of", "known")
    done = []
    while True:
        level = level.withColumn("is_cycle", F.coalesce(F.array_contains("path", F.col("of")), F.lit(False)))
        level = written(level, "nested")
        done.append(level)
        open_ = level.where("known and not is_cycle").select("service", "root", F.col("place").alias("up"), "depth", F.concat("path", F.array("of")).alias("path"), F.col("of").alias("type_name"))
        if len(done) == levels or open_.isEmpty():
            break
        level = open_.join(edges, ["service", "type_name"]).select("service", "root", F.concat_ws(".", "up", "name").alias("place"), (F.col("depth") + 1).alias("depth"), "name", "type", "required", "path", "of", "known")
    return reduce(DataFrame.unionByName, done).select("service", "root", "place", "depth", "name", "type", "required", "is_cycle")
