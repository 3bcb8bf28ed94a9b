"""Joins that link facts: mounts, imported calls, routes, schema tables, messages, callers and callees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def import_names(imports: DataFrame) -> DataFrame:
    """file, specifier, identifier, imported, kind: what each import clause binds.

    ``imports`` has file, clause and specifier. 'x' binds the default, '* as x' the whole, '{a, b as c}' parts.
    """
    clause = F.trim(F.regexp_replace("clause", r"^type\s+", ""))
    inner = F.regexp_extract(clause, r"\{([^}]*)\}", 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"^type\s+", ""))), lambda p: p != "")
    named = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"([\w$]+)$", 1).alias("identifier"), F.regexp_extract(p, r"^([\w$]+)", 1).alias("imported"), F.lit("named").alias("kind")))
    one = lambda name, imported, kind: F.struct(name.alias("identifier"), F.lit(imported).alias("imported"), F.lit(kind).alias("kind"))
    default, whole = F.regexp_extract(clause, r"^([\w$]+)\s*(?:,|$)", 1), F.regexp_extract(clause, r"\*\s+as\s+([\w$]+)", 1)
    every = F.concat(F.array(one(default, "default", "default")), F.array(one(whole, "*", "namespace")), named)
    return imports.select("file", "specifier", F.explode(F.filter(every, lambda x: x["identifier"] != "")).alias("x")).select("file", "specifier", "x.*")


def mounted(endpoints: DataFrame, mounts: DataFrame) -> DataFrame:
    """Endpoints (file, method, path) once for each base that mounts (file, base) give their file, else as they are;
    a path that already has its base keeps it (J3, J3b)."""
    m = mounts.select(T.path_kept(F.col("file")).alias("_file"), "base").distinct()
    joined = endpoints.join(m, T.path_kept(F.col("file")) == F.col("_file"), "left")
    full = T.join_path(F.col("base"), F.col("path"))
    has = T.route(F.col("path")) == T.route(full)
    below = F.startswith(T.route(F.col("path")), F.concat(T.route(F.col("base")), F.lit("/")))
    return joined.select("file", "method", F.when(F.col("base").isNull() | has | below, F.col("path")).otherwise(full).alias("path"), F.col("path").alias("original"), "base")


def imported_calls(calls: DataFrame, methods: DataFrame, namespaces: DataFrame) -> DataFrame:
    """caller_file, caller, identifier, member, method, file, via: what calls of imported things reach.

    ``calls``: caller_file, caller, identifier, member (path behind it, or empty), method, source, kind;
    ``methods``: file, name, owner; ``namespaces``: file, identifier, member, source (of repeats the last by ``seq``).
    In order: a member of a namespace; a function or handler; anything of an api file; a static method of its owner or
    of a class. A call with a member is nothing but the first.
    """
    ns = namespaces.groupBy(F.col("file").alias("source"), "identifier", F.col("member").alias("first")).agg(F.max_by(F.col("source"), "seq").alias("ns_source"))
    c = calls.withColumn("first", F.split("member", r"\.")[0]).join(ns, ["source", "identifier", "first"], "left")
    spaced = F.col("member") != ""
    c = c.withColumn("target", F.when(spaced, F.col("ns_source")).otherwise(F.col("source"))).where("target IS NOT NULL")
    m = methods.groupBy(F.col("file").alias("target"), F.col("name").alias("method")).agg(F.max("owner").alias("owner"))
    c = c.join(m, ["target", "method"])
    static = (F.col("kind") == "static-method") & ((F.lower("owner") == F.lower("identifier")) | F.col("identifier").rlike("^[A-Z]"))
    via = F.when(spaced, "namespace").when(F.col("kind").isin("function", "handler-reference"), "function").when(F.lower("source").rlike(r"api\.(ts|tsx|js|jsx)$"), "api").when(static, "static")
    return c.withColumn("via", via).where("via IS NOT NULL").select("caller_file", "caller", "identifier", "member", "method", F.col("target").alias("file"), "via")


def route_methods(requests: DataFrame, methods: DataFrame) -> DataFrame:
    """Requests (id, route) with the server method (file, name) that one of its three route spellings names."""
    spelled = methods.select("file", "name", F.explode(T.service_routes(F.col("file"), F.col("name"))).alias("r")).groupBy(F.lower("r").alias("r")).agg(F.max(F.struct("file", "name")).alias("m"))
    return requests.withColumn("r", F.lower(F.trim("route"))).join(spelled, "r").select("id", "route", "m.file", "m.name")


def schema_tables(access: DataFrame, names: DataFrame, schema: str = r"(^|/)db/schema(/|\.|$)") -> DataFrame:
    """file, identifier, table, operation: accesses of things imported from the schema."""
    own = names.where(F.col("specifier").rlike(schema)).select("file", "identifier", F.when(F.col("kind") == "named", F.col("imported")).otherwise(F.col("identifier")).alias("table")).distinct()
    return access.join(own, ["file", "identifier"]).select("file", "identifier", "table", "operation")


def message_methods(actors: DataFrame, methods: DataFrame) -> DataFrame:
    """Actors (message, role, id, name) with their method: by id, else by name, of one name the last id."""
    by_id, by_name = methods.select(F.col("id").alias("a")), methods.groupBy(F.col("name").alias("_name")).agg(F.max("id").alias("b"))
    joined = actors.join(by_id, F.col("id") == F.col("a"), "left").join(by_name, F.col("name") == F.col("_name"), "left")
    has = F.coalesce(F.col("id"), F.lit("")) != ""
    method = F.when(has, F.col("a")).otherwise(F.col("b"))
    edge = F.when(F.col("role") == "sender", "emits").otherwise("binds")
    to_message = F.col("role") != "handler"
    return joined.withColumn("method", method).where("method IS NOT NULL").select("message", "role", "method", edge.alias("type"), F.when(to_message, F.col("method")).otherwise(F.concat(F.lit("message:"), "message")).alias("src"), F.when(to_message, F.concat(F.lit("message:"), "message")).otherwise(F.col("method")).alias("dst"))


def unresolved(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Member calls (file, owner, member) whose first owner and member are in no known signature (file, identifier,
    member) (J18, E8)."""
    c = calls.withColumn("identifier", F.split("owner", r"\.")[0])
    return c.join(known.select("file", "identifier", "member").distinct(), ["file", "identifier", "member"], "left_anti").select("file", "owner", "member")


def calls_between(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """caller, callee, how: for each pair the kinds of calls between them, or 'none' (J25, G13).

    ``calls`` has caller, callee and kind (local, imported or field).
    """
    found = calls.groupBy("caller", "callee").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("how"))
    return pairs.join(found, ["caller", "callee"], "left").withColumn("how", F.coalesce("how", F.lit("none")))


def field_flow(facts: DataFrame, field: str) -> DataFrame:
    """side, kind, file, method, field: reads, writes and transfers of fields that hold the text.

    ``facts``: file, method, kind (read, write, request), field, area.
    """
    side = F.when(F.col("area") == "frontend", "frontend").when(F.col("area") == "backend", "backend").otherwise("other")
    return facts.where(T.contains(F.col("field"), field)).select(F.when(F.col("kind") == "request", "network").otherwise(side).alias("side"), "kind", "file", "method", "field").distinct()


def handler_states(handlers: DataFrame, methods: DataFrame) -> DataFrame:
    """message, states: the states that a message's handlers read or write."""
    touched = F.array_union(F.coalesce("reads", F.array().cast("array<string>")), F.coalesce("writes", F.array().cast("array<string>")))
    return handlers.join(methods, ["file", "method"]).select("message", F.explode(touched).alias("state")).groupBy("message").agg(F.array_sort(F.collect_set("state")).alias("states"))


def missing(required: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """What is required and not found."""
    return required.join(found.select(*on).distinct(), on, "left_anti")


def split_candidate(candidates: DataFrame, nodes: DataFrame, column: str = "candidate") -> DataFrame:
    """Nodes of ambiguous candidates 'type:name', by the exact name, else by its normal form."""
    kind, name = F.regexp_extract(column, r"^([^:]*):", 1), F.regexp_replace(column, r"^[^:]*:", "")
    c = candidates.select(column, kind.alias("type"), T.normal(name).alias("_n"), name.alias("_name"))
    joined = c.join(nodes.select("id", "type", "name", T.normal(F.col("name")).alias("_n")), ["type", "_n"])
    best = F.min(F.struct((F.col("name") != F.col("_name")).alias("loose"), "id")).alias("b")
    return joined.groupBy(column).agg(best).select(column, "b.id", (~F.col("b.loose")).alias("exact"))
