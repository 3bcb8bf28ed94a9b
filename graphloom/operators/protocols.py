"""Protocols that a project's methods follow: routes of messages, their context, event-gated timing, and learned messages
written back into a published graph.

Messages have a name and a protocol; methods an id, name, file and area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written
from . import lifecycle
from .learn import confidence

#: Fixed value: where a server keeps its methods: kind of server, layer and service of a file.
_SERVED = r"(?:^|/)app/servers/([^/]+)/(handler|remote)/([^/]+)\.[^.]+$"
#: Fixed value: a handler that a table registers for a message.
_REGISTERED = r"""\bthis\.regHandler\(\s*['"]([^'"]+)['"]\s*,\s*this\.([A-Za-z_$][\w$]*)\s*\)"""
#: Fixed value: the method that hands out what is registered.
DISPATCH = "handleMsg"


def message_routes(texts: DataFrame, methods: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """file, method, kind, protocol, route, handler, role: the messages that reach a method.

    A method below a server's handlers or remotes has three spellings of its route; a method that its file registers for
    a message handles it, and the file's ``DISPATCH`` method, if it has one, dispatches every message registered there.
    """
    m = methods.select("file", "method").distinct()
    layer = F.regexp_extract("file", _SERVED, 2)
    base = F.concat_ws(".", F.regexp_extract("file", _SERVED, 1), F.regexp_extract("file", _SERVED, 3), "method")
    served = m.where(F.col("file").rlike(_SERVED)).select("file", "method", F.when(layer == "handler", "pinus-handler").otherwise("pinus-remote").alias("kind"), F.when(layer == "handler", "pinus").otherwise("pinus-rpc").alias("protocol"), F.explode(F.array(base, F.concat(F.lit("app.rpc."), base), F.concat(layer, F.lit("."), base))).alias("route"), F.col("method").alias("handler"), F.lit("handler").alias("role"))
    each = texts.select(F.col(file).alias("file"), F.explode(F.regexp_extract_all(text, F.lit(_REGISTERED), F.lit(0))).alias("r"))
    bound = each.select("file", F.regexp_extract("r", _REGISTERED, 1).alias("route"), F.regexp_extract("r", _REGISTERED, 2).alias("handler")).distinct()
    row = lambda df, method, role: df.select("file", method.alias("method"), F.lit("table-msg").alias("kind"), F.lit("table-msg").alias("protocol"), "route", "handler", F.lit(role).alias("role"))
    handled = row(bound.join(m.withColumnRenamed("method", "handler"), ["file", "handler"]), F.col("handler"), "handler")
    dispatched = row(bound.join(m.where(F.col("method") == DISPATCH).select("file"), "file"), F.lit(DISPATCH), "dispatcher")
    return served.unionByName(handled).unionByName(dispatched)


def message_context(actors: DataFrame) -> DataFrame:
    """method, handled, emitted: sorted names of the messages (message, role, method) that a method handles or dispatches,
    and sends (J24)."""
    of = lambda *roles: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("role").isin(*roles), F.col("message")))))
    return actors.groupBy("method").agg(of("handler", "dispatcher").alias("handled"), of("sender").alias("emitted"))


def event_gated(inline: DataFrame, context: DataFrame) -> DataFrame:
    """method, event, bus, next, writes, handled, confidence: what a method does once an event has come.

    ``inline``: method, file, bus, event, calls (array), writes (array) of functions that are subscribed in place;
    ``context`` as ``message_context``. Calls of the method's own class are named after it.
    """
    owner = F.when(F.contains("method", F.lit(".")), F.regexp_replace("method", r"\.[^.]*$", "")).otherwise(F.col("method"))
    following = F.transform("calls", lambda c: F.when(F.startswith(c, F.lit("this.")), F.concat(owner, F.substring(c, 5, 1 << 20))).otherwise(F.regexp_replace(c, "^global:", "")))
    g = inline.select("method", "event", "bus", following.alias("calls"), "writes", "file").join(context.select("method", "handled"), "method", "left")
    none = F.array().cast("array<string>")
    g = g.select("method", "event", "bus", F.array_sort(F.array_distinct(F.filter("calls", lambda c: c != ""))).alias("next"), F.coalesce("writes", none).alias("writes"), F.coalesce("handled", none).alias("handled"), "file")
    has = lambda c: F.size(c) > 0
    return g.withColumn("confidence", confidence(0.9, 0.45, (has("next"), 0.2), (has("writes"), 0.15), (has("handled"), 0.1)))


def message_id(protocol: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("message"), T.slugify(F.when(F.coalesce(protocol, F.lit("")) != "", protocol).otherwise("message")), T.slugify(name))


def learned_delta(patterns: DataFrame, actors: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that learned messages add to a graph.

    ``patterns``: message, protocol, confidence, file; ``actors``: message, role, id, name, callee. A message is one node,
    in the area of its first handler, sender or dispatcher that has one. Senders emit it, dispatchers bind it, and it
    binds its handlers; an actor is the method of its id if it has one, else the last method of its name, and one that is
    no method of the graph is left out.
    """
    m = nodes.where("type = 'method'")
    by_id, by_name = m.select(F.col("id").alias("_id"), F.col("area").alias("_area")), m.groupBy(F.col("name").alias("_name")).agg(F.max(F.struct(F.col("id").alias("id"), F.col("area").alias("area"))).alias("_m"))
    has = F.coalesce(F.col("id"), F.lit("")) != ""
    a = actors.select("message", "role", "id", "name", F.coalesce("callee", F.lit("")).alias("callee"))
    a = a.join(by_id, F.col("id") == F.col("_id"), "left").join(by_name, ~has & (F.col("name") == F.col("_name")), "left")
    a = a.select("message", "role", "callee", F.when(has, F.col("_id")).otherwise(F.col("_m.id")).alias("method"), F.when(has, F.col("_area")).otherwise(F.col("_m.area")).alias("area")).where("method IS NOT NULL")
    order = F.when(F.col("role") == "handler", 0).when(F.col("role") == "sender", 1).otherwise(2)
    areas = a.where("area <> ''").groupBy("message").agg(F.min_by("area", F.struct(order, "method")).alias("area"))
    p = patterns.where(F.trim(F.coalesce("message", F.lit(""))) != "").select("message", F.coalesce("protocol", F.lit("")).alias("protocol"), "confidence", "file").withColumn("id", message_id(F.col("protocol"), F.col("message")))
    new = p.join(areas, "message", "left").select("id", F.lit("message").alias("type"), F.col("message").alias("name"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("area", F.lit("unknown")).alias("area"), F.create_map(F.lit("protocol"), "protocol", F.lit("confidence"), F.col("confidence").cast("string"), F.lit("learned"), F.lit("true")).alias("meta"))
    e = a.join(p.select("message", "protocol", F.col("id").alias("node")), "message")
    out = F.col("role") != "handler"
    edges = e.select(F.when(out, F.col("method")).otherwise(F.col("node")).alias("src"), F.when(out, F.col("node")).otherwise(F.col("method")).alias("dst"), F.when(F.col("role") == "sender", "emits").otherwise("binds").alias("type"), F.lit("message").alias("source_kind"), F.concat_ws("|", "protocol", "message", "role", "callee").alias("meta_key"))
    return new.dropDuplicates(["id"]), edges.distinct()


def added(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a delta adds to a graph: a node's or edge's first one stays; edges are told apart by their ends,
    type and ``meta_key``; ends that are no nodes become nodes of type 'unknown' (B7, B2)."""
    like = lambda df, of, **given: df.select(*[given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in of.dtypes])
    n = like(new_nodes, nodes).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns)
    key = ["src", "dst", "type", "meta_key"]
    own = edges if "meta_key" in edges.columns else edges.withColumn("meta_key", F.lit(""))
    # Stored, as both edges and their ends are asked for, and to find them all known edges move.
    fresh = written(new_edges.dropDuplicates(key).join(own.select(*key), key, "left_anti"), "fresh-edges")
    ends = fresh.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id").union(n.select("id")), "id", "left_anti")
    return n.unionByName(like(ends, nodes, type=F.lit("unknown"), name=F.col("id"))), like(fresh, own)


def augmented(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph with what ``added`` gives."""
    n, e = added(nodes, edges, new_nodes, new_edges)
    own = edges if "meta_key" in edges.columns else edges.withColumn("meta_key", F.lit(""))
    return nodes.unionByName(n), own.unionByName(e)


def write_back(spark: SparkSession, root: str, version: int, patterns: DataFrame, actors: DataFrame) -> None:
    """Publishes the newest version below ``root`` with learned messages as the next one; the old one stays as it is."""
    nodes, edges = lifecycle.current(spark, root, "nodes"), lifecycle.current(spark, root, "edges")
    delta = learned_delta(patterns, actors, nodes)
    onto = lifecycle.newest(spark, root, "nodes", "edges") if "meta_key" in edges.columns else None
    n, e = augmented(nodes, edges, *delta) if onto is None else added(nodes, edges, *delta)
    lifecycle.publish({"nodes": n, "edges": e}, root, version, onto)
