"""Service graphs seen in the given tables, so that the operators run and can be checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirechart.functions.text import norm_path, url_host, url_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_service, to_service, calls, r: nations of customers and of the suppliers they buy from; r ranks a caller's callees."""
    t = lambda n: table(spark, sf_dir, n)
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    items = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    counts = items.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("calls"))
    n = t("nation").select("n_nationkey", "n_name")
    named = counts.join(n.toDF("c_nationkey", "from_service"), "c_nationkey").join(n.toDF("s_nationkey", "to_service"), "s_nationkey")
    rank = F.row_number().over(Window.partitionBy("from_service").orderBy(F.desc("calls"), "to_service"))
    return named.withColumn("r", rank).select("from_service", "to_service", "calls", "r")


def supplier_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, from_service, to_service: a call of each supplier's nation to another, and of some suppliers to a second one; a sparse graph with cycles."""
    n, name = F.col("s_nationkey"), lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    second = F.when((n % 5 == 0) & (F.col("s_suppkey") % 3 == 0), (n + 3) % 25)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), name(n).alias("from_service"), F.explode(F.array_compact(F.array((n * n + 1) % 25, second))).alias("to"))
    return rows.select("s", "from_service", name(F.col("to")).alias("to_service"))


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event type that a user's next event follows."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("from_service"), F.lead("event_type").over(own).alias("to_service"))
    return rows.where("to_service is not null")


def role_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each role that the next turn of its conversation follows."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("from_service"), F.lead("role").over(own).alias("to_service"))
    return rows.where("to_service is not null")


def page_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, norm: pages as endpoints of the services that serve them."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("norm", norm_path(F.col("path")))


def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as publishing (purchases, clicks) and subscribing (views) of user groups on topics."""
    rows = table(spark, sf_dir, "events").where("event_type in ('purchase', 'click', 'view')")
    return rows.select(F.concat(F.lit("group"), (F.col("user_id") % 7).cast("string")).alias("service"), F.when(F.col("event_type") == "view", "subscribe").otherwise("publish").alias("direction"), F.get_json_object("props", "$.k").alias("topic"))


NATIONS = """g AS (SELECT from_service, to_service, calls, r FROM (
  SELECT cn.n_name AS from_service, sn.n_name AS to_service, count(*) AS calls, row_number() OVER (PARTITION BY cn.n_name ORDER BY count(*) DESC, sn.n_name) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""
SPARSE = """g AS (SELECT 'NATION_' || s_nationkey AS from_service, 'NATION_' || ((s_nationkey * s_nationkey + 1) % 25) AS to_service, s_suppkey AS s FROM supplier
  UNION ALL SELECT 'NATION_' || s_nationkey, 'NATION_' || ((s_nationkey + 3) % 25), s_suppkey FROM supplier WHERE s_nationkey % 5 = 0 AND s_suppkey % 3 = 0)"""
EVENTS = "t AS (SELECT * FROM (SELECT event_id, event_type AS from_service, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_service FROM events) WHERE to_service IS NOT NULL)"
ROLES = "c AS (SELECT * FROM (SELECT conv_id, turn, role AS from_service, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS to_service FROM conversations) WHERE to_service IS NOT NULL)"
PAGES = r"""p AS (SELECT page_id, host, path, CASE WHEN n = '/' THEN n ELSE regexp_replace(n, '/$', '') END AS norm FROM (SELECT page_id, host, path,
  regexp_replace(regexp_replace(regexp_replace(path, '\$?\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*', '{x}', 'g'), '[0-9]+', '{x}', 'g'), '/+', '/', 'g') AS n FROM (
  SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages)))"""
TOPICS = "e AS (SELECT 'group' || CAST(user_id % 7 AS VARCHAR) AS service, CASE WHEN event_type = 'view' THEN 'subscribe' ELSE 'publish' END AS direction, json_extract_string(props, '$.k') AS topic FROM events WHERE event_type IN ('purchase', 'click', 'view'))"
