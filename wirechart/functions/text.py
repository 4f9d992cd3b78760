"""Names, paths and URLs as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower case; other runs become one hyphen, none at an end."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def url_host(url: Column) -> Column:
    """Lower-case host of an http URL, '' without one; names with an underscore count."""
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    """Path of an http URL without query, '/' for a bare host."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def template_path(path: Column) -> Column:
    """Template values and ``:id`` become {x}, slashes collapse, none at the end; the root stays."""
    out = F.regexp_replace(F.regexp_replace(path, r"\$?\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{x}"), "/+", "/")
    return F.when(out == "/", out).otherwise(F.regexp_replace(out, "/$", ""))


def norm_path(path: Column) -> Column:
    """``template_path`` with runs of digits as {x} too: for paths that were seen in use."""
    return template_path(F.regexp_replace(F.regexp_replace(path, r"\$?\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{x}"), "[0-9]+", "{x}"))


def combine_paths(prefix: Column, route: Column) -> Column:
    """A prefix and a route with one slash between; an empty route leaves the prefix."""
    trim = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    both = F.concat_ws("/", F.nullif(trim(prefix), F.lit("")), F.nullif(trim(route), F.lit("")))
    return F.concat(F.lit("/"), both)


def kebab(name: Column) -> Column:
    """Lower case words with hyphens between, from camel case, snake case and dots."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "[^A-Za-z0-9]+", "-"))


def referenced_urls(text: Column) -> Column:
    """The distinct http URLs of a text in their order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>)}\]]+"), F.lit(0)))
