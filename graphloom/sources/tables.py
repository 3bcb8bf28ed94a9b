"""The given tables as a typed property graph, and as facts, snapshots and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _method(status):
    return F.when(status == "F", "GET").when(status == "O", "POST").otherwise("PUT")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name, file, area: customers are methods, orders requests, parts tables, suppliers external services,
    nations routes, regions modules."""
    t = lambda n: table(spark, sf_dir, n)

    def part(df, kind, prefix, key, name, file, area):
        return df.select(F.concat(F.lit(prefix + ":"), F.col(key)).alias("id"), F.lit(kind).alias("type"), name.alias("name"), file.alias("file"), F.lit(area).alias("area"))

    none = F.lit("")
    # Slugs are made once for each priority, not in every expression that asks for a name.
    priorities = t("orders").select(F.col("o_orderpriority").alias("_priority")).distinct().withColumn("_slug", T.slugify(F.col("_priority")))
    orders = t("orders").join(priorities, F.col("o_orderpriority").eqNullSafe(F.col("_priority")))
    path = F.concat(F.lit("/Orders//"), F.col("_slug"), F.lit("/"))
    return (
        part(t("customer"), "method", "customer", "c_custkey", F.col("c_name"), F.concat_ws("/", "c_mktsegment", "c_name"), "frontend")
        .union(part(orders, "request", "order", "o_orderkey", F.concat_ws(" ", _method(F.col("o_orderstatus")), path), none, "contract"))
        .union(part(t("part"), "table", "part", "p_partkey", F.col("p_name"), F.concat_ws("/", "p_brand", "p_type"), "data"))
        .union(part(t("supplier"), "external-service", "supplier", "s_suppkey", F.col("s_name"), none, "backend"))
        .union(part(t("nation"), "route", "nation", "n_nationkey", F.col("n_name"), none, "backend"))
        .union(part(t("region"), "module", "region", "r_regionkey", F.col("r_name"), none, "shared"))
    )


def edges(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """src, dst, type, operation. Distinct only where the tables repeat a pair, and not at all if ``repeated``: what
    joins few nodes with the edges drops repeats afterwards."""
    once = (lambda df: df) if repeated else (lambda df: df.distinct())
    of = lambda df, *columns: df.select(*columns).transform(once)  # noqa: E731, repeats go while keys are numbers
    t = lambda n: table(spark, sf_dir, n)

    def link(df, a, ac, b, bc, kind, operation=None):
        return df.select(F.concat(F.lit(a + ":"), F.col(ac)).alias("src"), F.concat(F.lit(b + ":"), F.col(bc)).alias("dst"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("type"), (F.lit("") if operation is None else operation).alias("operation"))

    lines = t("lineitem")
    access = F.when(F.col("l_returnflag") == "R", "writes").otherwise("reads").alias("access")
    return (
        link(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "requests")
        .union(link(of(lines, "l_orderkey", "l_partkey", access, "l_linestatus"), "order", "l_orderkey", "part", "l_partkey", F.col("access"), F.col("l_linestatus")))
        .union(link(of(lines, "l_partkey", "l_suppkey"), "part", "l_partkey", "supplier", "l_suppkey", "depends_on"))
        .union(link(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "binds"))
        .union(link(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "contains"))
    )


def message_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor, message, role, state, value, seq from events: who handles, sends or dispatches which message."""
    role = F.when(F.col("event_type").isin("view", "click"), "handler").when(F.col("event_type").isin("purchase", "signup"), "sender").otherwise("dispatcher")
    state = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("actor"), F.col("event_type").alias("message"), role.alias("role"), state.alias("state"), "value", F.col("event_id").alias("seq"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, task, outcome: each user turn and the assistant turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("task"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("outcome"))
    return a.join(b, ["conv_id", "turn"], "left")


NODES_SQL = r"""
n AS (
 SELECT 'customer:'||c_custkey AS id, 'method' AS type, c_name AS name, c_mktsegment||'/'||c_name AS file, 'frontend' AS area FROM customer
 UNION ALL SELECT 'order:'||o_orderkey, 'request', CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END||' /Orders//'||
   lower(regexp_replace(regexp_replace(regexp_replace(trim(o_orderpriority), '[^\w.-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'))||'/', '', 'contract' FROM orders
 UNION ALL SELECT 'part:'||p_partkey, 'table', p_name, p_brand||'/'||p_type, 'data' FROM part
 UNION ALL SELECT 'supplier:'||s_suppkey, 'external-service', s_name, '', 'backend' FROM supplier
 UNION ALL SELECT 'nation:'||n_nationkey, 'route', n_name, '', 'backend' FROM nation
 UNION ALL SELECT 'region:'||r_regionkey, 'module', r_name, '', 'shared' FROM region)"""
EDGES_SQL = """
e AS (
 SELECT 'customer:'||o_custkey AS src, 'order:'||o_orderkey AS dst, 'requests' AS type, '' AS operation FROM orders
 UNION ALL (SELECT DISTINCT 'order:'||l_orderkey, 'part:'||l_partkey, CASE WHEN l_returnflag = 'R' THEN 'writes' ELSE 'reads' END, l_linestatus FROM lineitem)
 UNION ALL (SELECT DISTINCT 'part:'||l_partkey, 'supplier:'||l_suppkey, 'depends_on', '' FROM lineitem)
 UNION ALL SELECT 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'binds', '' FROM supplier
 UNION ALL SELECT 'region:'||n_regionkey, 'nation:'||n_nationkey, 'contains', '' FROM nation)"""
