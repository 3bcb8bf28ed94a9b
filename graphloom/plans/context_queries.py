"""Queries on selectors, context, links, scopes and candidates over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import discovery as D
from ..operators import execution as X
from ..operators import graph as G
from ..operators import linking as L
from ..operators import selectors as S
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, outcomes, table
from .graph_queries import START, _bfs_sql, _starts

DOWN, UP = ("downstream", "src", "dst"), ("upstream", "dst", "src")


def rich_nodes(spark, d):
    """The nodes with tags and meta: methods have their own name, requests method and target, tables a kind and tags,
    services a host, routes a route."""
    n = nodes(spark, d)
    parts, key, empty = F.split("name", " ", 2), F.split("id", ":")[1], F.array().cast("array<string>")
    keep = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    meta = (
        F.when(F.col("type") == "method", keep("methodName", F.split("file", "/")[0]))
        .when(F.col("type") == "request", keep("protocol", F.lit("http"), "httpMethod", parts[0], "target", parts[1]))
        .when(F.col("type") == "table", keep("kind", F.split("file", "/")[1]))
        .when(F.col("type") == "external-service", keep("host", F.concat(F.lit("s"), key, F.lit(".example.org")), "serviceKind", F.lit("http-api")))
        .when(F.col("type") == "route", keep("route", F.col("name")))
    )
    tags = F.when(F.col("type") == "table", F.array(F.split("file", "/")[0], F.concat(F.lit("k"), F.length("name")))).otherwise(empty)
    return n.withColumn("tags", tags).withColumn("meta", meta)


RICH_SQL = f"""{NODES_SQL}, rn AS (SELECT *, CASE WHEN type = 'method' THEN split_part(file, '/', 1) ELSE '' END AS own, CASE WHEN type = 'request' THEN 'http' ELSE '' END AS protocol,
 CASE WHEN type = 'request' THEN split_part(name, ' ', 1) ELSE '' END AS http_method, CASE WHEN type = 'request' THEN substr(name, instr(name, ' ') + 1) ELSE '' END AS target, CASE WHEN type = 'table' THEN split_part(file, '/', 2) ELSE '' END AS kind,
 CASE WHEN type = 'external-service' THEN 's'||split_part(id, ':', 2)||'.example.org' ELSE '' END AS host, CASE WHEN type = 'external-service' THEN 'http-api' ELSE '' END AS service_kind, CASE WHEN type = 'route' THEN name ELSE '' END AS route,
 CASE WHEN type = 'table' THEN [split_part(file, '/', 1), 'k'||length(name)] ELSE [] END AS tags FROM n)"""
_HAS = lambda c, x: f"contains(lower(trim({c})), '{x}')"
_FUZZY = lambda x: "(" + " OR ".join(_HAS(c, x) for c in ("name", "file", "own", "route", "kind", "protocol", "service_kind", "target", "host")) + f" OR len(list_filter(tags, lambda t: {_HAS('t', x)})) > 0)"
_START = lambda q, where: f"""WITH {RICH_SQL}, t AS (SELECT *, CASE WHEN id = '{q}' THEN 1 WHEN name = '{q}' THEN 2 WHEN type = 'method' AND own = '{q}' THEN 3 WHEN {_FUZZY(q.lower())} THEN 4 END AS tier FROM rn WHERE {where}),
b AS (SELECT tier, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY 1 QUALIFY tier = min(tier) OVER ())
SELECT id, type, name, tier, n > 1 AS ambiguous FROM t JOIN b USING (tier)"""  # noqa: E731


def selector_start(spark, d):
    """The start that a bare selector means: here all methods of one name, so it is ambiguous."""
    return S.start(rich_nodes(spark, d), "BUILDING")


def typed_start(spark, d):
    """A request by a part of its target, among those of one area and protocol."""
    return S.start(rich_nodes(spark, d), "1-urgent", "request", protocol="http", area="contract")


def faceted_search(spark, d):
    """tables by a word in any field, a tag and without a module."""
    return S.search(rich_nodes(spark, d), kind="table", name="red", tag="brand#", area="data", without="brand#1").select("id", "name", "file")


def not_found_suggestions(spark, d):
    """The first three nodes of each type that a name finds."""
    return S.suggestions(rich_nodes(spark, d), "11", ("method", "request", "route", "table", "external-service"))


def business_groups(spark, d):
    """The first five nodes of each business group."""
    return S.business_group(rich_nodes(spark, d), (("orders", True), ("brand", False)))


def http_mainline(spark, d):
    """what of a traversal leads to requests, routes or methods of other files."""
    n = nodes(spark, d)
    found = S.http_mainline(S.resolved_only(G.traverse(edges(spark, d, repeated=True), _starts(spark, START), 3, "both"), n), n)
    return found.select("depth", "direction", "src", "dst", "type")


def typed_detail(spark, d):
    """Who reads and writes each table, who binds each route."""
    return C.detail(edges(spark, d), nodes(spark, d).where("type IN ('table', 'route', 'external-service', 'request')"))


def node_summary(spark, d):
    """Degrees, the first eight bindings and a label of each node."""
    return C.node_summary(rich_nodes(spark, d), edges(spark, d))


def compact_nodes(spark, d):
    """The meta that a compact node keeps, a row a key."""
    return C.compact(rich_nodes(spark, d)).select("id", F.explode("meta").alias("key", "value"))


def edge_evidence(spark, d):
    """All edges as evidence, by what of their ends is a method or request, with the names of the ends."""
    return C.edge_evidence(edges(spark, d), nodes(spark, d), "linked", "high", named=True).drop("reason")


def feature_card(spark, d):
    """Types, core methods and tables of the whole graph; feature_cards and feature_flows are of every feature."""
    return C.feature_card(nodes(spark, d), edges(spark, d))


CHANGED = "p_size = 50"


def _changed(spark, d):
    return table(spark, d, "part").where(CHANGED).select(F.concat_ws("/", "p_brand", "p_type").alias("file")).distinct()


def change_impact(spark, d):
    """How many nodes of each type the files of the largest parts touch, themselves or two edges away."""
    related, _ = C.impact(nodes(spark, d), edges(spark, d, repeated=True), _changed(spark, d), 2, stored=False)
    return related.groupBy("type", "matched").agg(F.count(F.lit(1)).alias("n"))


def impact_report(spark, d):
    """One answer on the changed files: related nodes, the features they touch, and the risk."""
    p = table(spark, d, "part").select("p_brand", "p_type")
    none = F.array().cast("array<struct<name:string,file:string>>")
    features = p.groupBy(F.col("p_brand").alias("key")).agg(F.collect_set(F.concat_ws("/", "p_brand", "p_type")).alias("roots")).select("key", "roots", none.alias("evidence"))
    return C.impact_report(nodes(spark, d), edges(spark, d, repeated=True), features, _changed(spark, d), 1)


def relevant_rules(spark, d):
    """The conversations' turns as rules: the most relevant for some terms and files."""
    r = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("t"), F.col("turn") % 4).alias("title"), F.col("text").alias("body"), "role", F.array(F.concat(F.lit("src/c"), "conv_id", F.lit(".ts"))).alias("files"))
    return C.relevant_rules(r.select("id", "title", "body", F.col("role").alias("category"), F.array(F.lit("tag")).alias("tags"), "files"), ["the", "user", "src/c1"], ["c7.ts", "src/C12.ts"], 40)


def memory_summary(spark, d):
    """What the best turns have in common: their files, roles and first words."""
    o = outcomes(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", F.coalesce("task", F.lit("")).alias("task"))
    best = o.where("length(task) > 0").orderBy(F.desc(F.length("task")), "id").limit(50).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.length("task")), "id")))
    rows = best.select("place", F.array(F.concat(F.lit("f"), F.col("conv_id") % 9)).alias("files"), F.array(F.concat(F.lit("turn"), F.col("turn") % 3)).alias("validation"), F.array(F.substring_index("task", " ", 1)).alias("observations"))
    return C.recall_summary(rows)


def task_context(spark, d):
    """The best nodes for a task's terms and the first of each type that lie near them."""
    return C.task_context(nodes(spark, d), edges(spark, d, repeated=True), ["promo", "steel", "data"], 5, 2)


def affected_features(spark, d):
    """Brands as features with their types as roots; changed files lie below some of them."""
    p = table(spark, d, "part").select("p_brand", F.regexp_replace("p_type", " ", "/").alias("t"), "p_size")
    root = F.concat_ws("/", "p_brand", F.substring_index("t", "/", 1))
    none = F.array().cast("array<struct<name:string,file:string>>")
    features = p.groupBy(F.col("p_brand").alias("key")).agg(F.collect_set(root).alias("roots")).select("key", "roots", none.alias("evidence"))
    files = lambda where: p.where(where).select(F.concat_ws("/", "p_brand", "t").alias("file"))
    return C.changed_features(features, files("p_size = 50"), files("p_size >= 45"))


def mounted_endpoints(spark, d):
    """Endpoints of each order status, under every base that mounts their file."""
    o = table(spark, d, "orders").select("o_orderstatus", T.slugify(F.col("o_orderpriority")).alias("p")).distinct()
    endpoints = o.select(F.concat(F.lit("routes/"), "o_orderstatus", F.lit(".ts")).alias("file"), F.lit("GET").alias("method"), F.concat(F.lit("/list/"), "p").alias("path"))
    mounts = table(spark, d, "nation").select(F.concat(F.lit("routes/"), F.when(F.col("n_regionkey") == 3, "O").otherwise("F"), F.lit(".ts")).alias("file"), F.concat(F.lit("/api/"), F.lower("n_name")).alias("base"))
    return L.mounted(endpoints, mounts)


def service_routes(spark, d):
    """Requests for suppliers' methods by any of the three spellings of their routes."""
    methods = table(spark, d, "supplier").select(F.concat(F.lit("x/app/servers/n"), "s_nationkey", F.lit("/remote/S"), "s_suppkey", F.lit(".ts")).alias("file"), F.lit("go").alias("name"))
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("n"), "s_nationkey", F.lit(".s"), "s_suppkey", F.lit(".GO")).alias("base"))
    asked = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_linenumber").distinct().join(n, "k")
    route = F.when(F.col("l_linenumber") == 1, F.col("base")).when(F.col("l_linenumber") == 2, F.concat(F.lit("app.rpc."), "base")).when(F.col("l_linenumber") == 3, F.concat(F.lit("remote."), "base")).otherwise(F.concat(F.lit("else."), "base"))
    return L.route_methods(asked.select(F.concat_ws("-", "k", "l_linenumber").alias("id"), route.alias("route")), methods)


def call_links(spark, d):
    """How parts and suppliers call each other, for each pair of a part and the supplier after it."""
    line = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), "l_suppkey").alias("callee"), F.when(F.col("l_returnflag") == "R", "field").when(F.col("l_returnflag") == "A", "imported").otherwise("local").alias("kind"))
    after = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), F.col("l_suppkey") + F.col("l_linenumber") % 2).alias("callee")).distinct()
    return L.calls_between(line, after)


def unresolved_calls(spark, d):
    """Member calls that no known signature explains."""
    line = table(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_linenumber").alias("file"), F.concat(F.lit("s"), "l_suppkey", F.lit(".x")).alias("owner"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("member"), "l_returnflag")
    known = line.where("l_returnflag = 'R'").select("file", F.split("owner", r"\.")[0].alias("identifier"), "member")
    return L.unresolved(line, known).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def message_links(spark, d):
    """Senders by id, dispatchers by name, of the messages in the events."""
    e = table(spark, d, "events").select(F.col("event_type").alias("message"), F.when(F.col("event_type") == "click", "sender").when(F.col("event_type") == "view", "handler").otherwise("dispatcher").alias("role"), "user_id").distinct()
    actors = e.select("message", "role", F.when(F.col("role") != "dispatcher", F.concat(F.lit("customer:"), "user_id")).alias("id"), F.concat(F.lit("m"), F.col("user_id") % 20).alias("name"))
    methods = table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"), F.concat(F.lit("m"), F.col("c_custkey") % 10).alias("name"))
    return L.message_methods(actors, methods)


def field_flow(spark, d):
    """Reads, writes and transfers of a field in the events."""
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_type").alias("method"), F.when(F.col("event_type") == "purchase", "request").when(F.col("value") > 50, "write").otherwise("read").alias("kind"), F.concat(F.lit("State.k"), F.get_json_object("props", "$.k")).alias("field"), F.when(F.col("user_id") % 2 == 0, "frontend").otherwise("backend").alias("area"))
    return L.field_flow(e, "state.K1").groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))


def _tasks(spark, d):
    files = F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit("src/C"), "conv_id", F.lit(".tsx")))).otherwise(F.array(F.concat(F.lit("src/c"), "conv_id", F.lit(".ts"))))
    return outcomes(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "task", files.alias("files"))


def task_gate(spark, d):
    """Decisions and numbers of signals for the users' turns, each with one file."""
    return X.gated(_tasks(spark, d)).groupBy("decision", F.size("signals").alias("signals")).agg(F.count(F.lit(1)).alias("n"))


def execution_plan(spark, d):
    """How often each step has which place in the plans of the users' turns."""
    return X.plan(X.gated(_tasks(spark, d))).groupBy("place", "step").agg(F.count(F.lit(1)).alias("n"))


def inferred_rules(spark, d):
    """Rules that the conversations' turns suggest."""
    return X.inferred_rules(_tasks(spark, d).select("id", F.col("task").alias("text"), "files")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _scopes(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"), F.lit(None).cast("array<string>").alias("files"))
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("parts/M"), "l_linenumber", F.lit("/"), "l_partkey", F.lit(".ts")).alias("file"))
    modes = ("m1", "m2", "m3", "m4", "m5", "m6")
    boundary = table(spark, d, "orders").where("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("id"), F.array().cast("array<string>").alias("primary"), F.array(*[F.lit(f"parts/{m}/") for m in modes]).alias("roots"))
    critical = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("lib/chat"), "o_custkey", F.lit(".ts")).alias("file"))
    return X.validate(tasks, changes, boundary, critical)


def scope_verdicts(spark, d):
    """Verdicts on orders as tasks: lines outside their boundary, critical files not changed."""
    return _scopes(spark, d).groupBy("decision", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("outside").alias("outside"), F.sum("missing").alias("missing"))


def patch_reviews(spark, d):
    """Reviews of these scopes; the risk is the order's priority."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("risk"), (F.col("o_orderstatus") == "F").alias("rebuild"))
    return X.reviewed(_scopes(spark, d).select("id", "verdict").join(o, "id")).groupBy("verdict", F.size("findings").alias("findings")).agg(F.count(F.lit(1)).alias("n"))


def feature_candidates(spark, d):
    """Candidates from server and game folders of the parts."""
    p = table(spark, d, "part")
    n = p.select(F.concat(F.lit("m"), "p_partkey").alias("id"), F.when(F.col("p_size") > 25, "message").otherwise("route").alias("type"), F.col("p_name").alias("name"), F.concat(F.lit("x/servers/"), F.substring_index("p_type", " ", 1), F.lit("/handler/"), "p_partkey", F.lit(".ts")).alias("file"), F.lit("backend").alias("area"))
    n = n.union(p.select(F.concat(F.lit("g"), "p_partkey"), F.when(F.col("p_size") > 25, "script").otherwise("asset"), "p_name", F.concat(F.lit("a/Game/common/"), "p_brand", F.lit("/"), "p_partkey", F.lit(".ts")), F.lit("frontend")))
    per, _ = D.candidates(D.seeds(n.withColumn("meta", F.lit(None).cast("map<string,string>"))))
    return per.select("key", "score", "nodes", "confidence")


def recalled_outcomes(spark, d):
    """The best of all turns by terms, files and age."""
    r = outcomes(spark, d).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "task", F.col("outcome").alias("text"), F.array(F.concat(F.lit("src/app/c"), "conv_id", F.lit(".ts"))).alias("files"), F.timestamp_seconds(F.col("conv_id") * 86400).alias("recorded"))
    return C.recall(r, ["the", "of", "and"], ["app/c7.ts", "src/app/c2/x.ts"], F.lit("1970-02-20").cast("timestamp"), 25)


def workspace_matches(spark, d):
    """Which nations' workspaces the customers mean, by remote and, for some, by id."""
    known = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.lit("").alias("hash"), F.lit("").alias("root"), F.concat(F.lit("r"), F.col("n_nationkey") % 5).alias("remote"), F.lit("").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    asked = table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("ask"), F.lit("").alias("hash"), F.lit("").alias("root"), F.concat(F.lit("r"), F.col("c_nationkey") % 5).alias("remote"), F.lit("").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise("").alias("want"))
    return X.resolve_workspace(known, asked).groupBy("score", "ambiguous").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ask").alias("asked"))


def text_scalars(spark, d):
    """Scalars over the parts."""
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", T.workspace_id(name).alias("workspace"), T.workspace_hash(F.concat(F.lit("/W/"), "p_brand", F.lit("/"))).alias("hash"), T.synthetic_name("cb", name).alias("synthetic"), T.title(F.col("p_type")).alias("title"),
        T.request_name(F.lit("http"), F.lit("get"), F.concat(F.lit("/"), "p_brand"), F.lit("fetch")).alias("request"), T.clamp(F.col("p_size") - 10, 20, 30).alias("limit"), T.area_root(F.concat_ws("/", F.lit("packages"), "p_brand", "p_type")).alias("root"), T.reads_like_a_question(name).alias("prose"),
    )


_OC = """o AS (SELECT a.conv_id, a.turn, a.text AS task, b.text AS outcome FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn - 1 = a.turn AND b.role = 'assistant' WHERE a.role = 'user')"""
_BOTH = f"s AS (SELECT '{DOWN[0]}' AS direction, {DOWN[1]} AS f, {DOWN[2]} AS t, * FROM e UNION ALL SELECT '{UP[0]}', {UP[1]}, {UP[2]}, * FROM e)"
_FILE = "lower(file)"
_SCORE = "CASE WHEN {h} THEN {p} ELSE 0 END"
_GATE = f"""{_OC}, f AS (SELECT *, CASE WHEN turn % 4 = 0 THEN 'src/C'||conv_id||'.tsx' ELSE 'src/c'||conv_id||'.ts' END AS file FROM o),
q AS (SELECT *, lower(trim(coalesce(task, '')||' '||file)) AS t FROM f),
g AS (SELECT *, {", ".join(f"regexp_matches(t, $p${p}$p$) AS s{i}" for i, p in enumerate(T.SIGNALS.values()))} FROM q),
k AS (SELECT *, CASE WHEN ends_with(file, '.tsx') AND NOT (s0 OR s1 OR s2 OR s3 OR s5) THEN 'optional_skip_allowed' WHEN s0 OR s1 OR s2 OR s3 OR s4 OR s5 THEN 'required' ELSE 'recommended' END AS decision FROM g)"""
_RULES = " UNION ALL ".join(f"SELECT '{c}' AS category FROM f WHERE {f'regexp_matches(lower(coalesce(task, $p$$p$)), $p${p}$p$) OR ' if p else ''}regexp_matches(lower(file), $p${q}$p$)" for c, _, p, q in X.RULES)
_SCOPES = """c AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS mode, l_partkey FROM lineitem), p AS (SELECT id, count(*) FILTER (WHERE mode > 6 OR id % 17 = 0) AS outside FROM c GROUP BY 1),
v AS (SELECT o_orderkey AS id, o_orderpriority, o_orderstatus, coalesce(outside, 0) AS outside, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS missing,
 CASE WHEN o_orderkey % 17 = 0 THEN 'pmm_context_unavailable' WHEN coalesce(outside, 0) > 0 THEN 'scope_review_needed' WHEN o_orderstatus = 'O' THEN 'possibly_incomplete' ELSE 'within_scope' END AS verdict FROM orders LEFT JOIN p ON p.id = o_orderkey)"""

QUERIES = {
    "selector_start": (selector_start, _START("BUILDING", "true")),
    "typed_start": (typed_start, _START("1-urgent", "type = 'request' AND contains(area, 'contract')")),
    "faceted_search": (faceted_search, f"WITH {RICH_SQL} SELECT id, name, file FROM rn WHERE type = 'table' AND {_FUZZY('red')} AND len(list_filter(tags, lambda t: {_HAS('t', 'brand#')})) > 0 AND NOT contains(lower(file), 'brand#1')"),
    "not_found_suggestions": (not_found_suggestions, f"WITH {RICH_SQL} SELECT type, CAST(row_number() OVER w AS INTEGER) AS place, id, name FROM rn WHERE type IN ('method', 'request', 'route', 'table', 'external-service') AND ({_FUZZY('11')} OR {_HAS('http_method', '11')}) WINDOW w AS (PARTITION BY type ORDER BY name, id) QUALIFY place <= 3"),
    "business_groups": (business_groups, f"""WITH {RICH_SQL}, g AS (SELECT id, name, CASE WHEN contains(lower(regexp_replace(file||' '||name, '/+', '/', 'g')), '/orders/') THEN 'orders-http' ELSE type END AS "group",
 CASE WHEN contains(lower(regexp_replace(file||' '||name, '/+', '/', 'g')), '/orders/') THEN 1 ELSE 10 + CASE type WHEN 'route' THEN 3 WHEN 'method' THEN 6 WHEN 'table' THEN 9 ELSE 99 END END AS priority FROM rn)
SELECT "group", priority, id, name, CAST(row_number() OVER (PARTITION BY "group" ORDER BY name, id) AS INTEGER) AS place FROM g QUALIFY place <= 5"""),
    "http_mainline": (http_mainline, _bfs_sql((START,), 3, (DOWN, UP)) + f", {NODES_SQL} SELECT depth, direction, src, dst, x.type FROM x JOIN n ON n.id = dst WHERE n.type IN ('request', 'endpoint', 'route', 'method')"),
    "typed_detail": (typed_detail, f"""WITH {EDGES_SQL}, r AS (SELECT DISTINCT id, role, other FROM (SELECT dst AS id, CASE type WHEN 'reads' THEN 'readers' WHEN 'writes' THEN 'writers' WHEN 'requests' THEN 'callers' END AS role, src AS other FROM e UNION ALL SELECT src, CASE type WHEN 'binds' THEN 'handlers' END, dst FROM e)
 WHERE role IS NOT NULL AND (id LIKE 'part:%' OR id LIKE 'nation:%' OR id LIKE 'supplier:%' OR id LIKE 'order:%'))
SELECT id, role, count(*) AS n, array_to_string(list_sort(list(other))[1:12], ',') AS first FROM r GROUP BY 1, 2"""),
    "node_summary": (node_summary, f"""WITH {RICH_SQL}, {EDGES_SQL}, g AS (SELECT id, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1),
b AS (SELECT src AS id, array_to_string(list_sort(list(DISTINCT dst))[1:8], ',') AS binds FROM e WHERE type = 'binds' GROUP BY 1)
SELECT rn.id, type, name, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(binds, '') AS binds, CASE type WHEN 'request' THEN http_method||' '||target WHEN 'route' THEN route WHEN 'external-service' THEN host WHEN 'table' THEN kind ELSE file END AS label
FROM rn LEFT JOIN g ON g.id = rn.id LEFT JOIN b ON b.id = rn.id"""),
    "compact_nodes": (compact_nodes, f"WITH {RICH_SQL} " + " UNION ALL ".join(f"SELECT id, '{k}' AS key, {c} AS value FROM rn WHERE {c} <> ''" for k, c in (("protocol", "protocol"), ("target", "target"), ("host", "host"), ("serviceKind", "service_kind"), ("route", "route")))),
    "edge_evidence": (edge_evidence, f"""WITH {NODES_SQL}, {EDGES_SQL} SELECT 'edge' AS kind, e.type, src, dst, coalesce(CASE WHEN a.type = 'method' THEN a.name END, CASE WHEN b.type = 'method' THEN b.name END, '') AS method,
 coalesce(CASE WHEN a.type IN ('endpoint', 'request') THEN a.name END, CASE WHEN b.type IN ('endpoint', 'request') THEN b.name END, '') AS endpoint, 'high' AS confidence, coalesce(a.name, src) AS src_name, coalesce(b.name, dst) AS dst_name FROM e LEFT JOIN n a ON a.id = src LEFT JOIN n b ON b.id = dst"""),
    "feature_card": (feature_card, f"""WITH {NODES_SQL}, {EDGES_SQL}, g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
u AS (SELECT 'types' AS section, type AS id, type AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'core-methods', n.id, name, g.n FROM n JOIN g ON g.id = n.id WHERE type = 'method'
 UNION ALL SELECT 'tables', dst, coalesce(min(name), dst), count(*) FROM e LEFT JOIN n ON n.id = dst WHERE e.type IN ('reads', 'writes') GROUP BY 2)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY n DESC, name, id) AS INTEGER) AS place, id, name, n FROM u QUALIFY place <= 16"""),
    "change_impact": (change_impact, f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {_BOTH}, c AS (SELECT DISTINCT lower(p_brand||'/'||p_type) AS file FROM part WHERE {CHANGED}),
m AS (SELECT id FROM n WHERE lower(file) IN (SELECT file FROM c)),
r(id, d) AS (SELECT id, 0 FROM m UNION SELECT t, d + 1 FROM r JOIN s ON f = id WHERE d < 2), k AS (SELECT DISTINCT id FROM r)
SELECT type, id IN (SELECT id FROM m) AS matched, count(*) AS n FROM n JOIN k USING (id) GROUP BY 1, 2"""),
    "impact_report": (impact_report, f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {_BOTH}, c AS (SELECT DISTINCT lower(p_brand||'/'||p_type) AS file FROM part WHERE {CHANGED}),
m AS (SELECT id FROM n WHERE lower(file) IN (SELECT file FROM c)), r(id, d) AS (SELECT id, 0 FROM m UNION SELECT t, d + 1 FROM r JOIN s ON f = id WHERE d < 1), k AS (SELECT DISTINCT id FROM r),
w AS (SELECT n.*, n.id IN (SELECT id FROM m) AS matched FROM n JOIN k USING (id)), fe AS (SELECT DISTINCT p_brand AS key, lower(p_brand||'/'||p_type) AS root FROM part),
h AS (SELECT key, count(DISTINCT CASE WHEN root IN (SELECT file FROM c) THEN root END) AS own, count(DISTINCT CASE WHEN root IN (SELECT lower(file) FROM w) THEN root END) AS near FROM fe GROUP BY 1),
t AS (SELECT lower(type||' '||name||' '||file) AS t FROM w UNION ALL SELECT lower(e.type||' '||e.operation) FROM e WHERE src IN (SELECT id FROM m) OR dst IN (SELECT id FROM m))
SELECT 'matched' AS section, type AS name, count(*) AS n FROM w WHERE matched GROUP BY 2 UNION ALL SELECT 'related', type, count(*) FROM w GROUP BY 2 UNION ALL SELECT 'features', key, CASE WHEN own > 0 THEN 100 + 10 * own ELSE least(10 * near, 20) END FROM h WHERE own + near > 0
UNION ALL SELECT 'risk', CASE WHEN bool_or(regexp_matches(t, '{T.HIGH_RISK}')) THEN 'high' WHEN bool_or(regexp_matches(t, '{T.MEDIUM_RISK}')) THEN 'medium' ELSE 'low' END, 1 FROM t"""),
    "relevant_rules": (relevant_rules, """WITH t AS (SELECT conv_id||'-'||turn AS id, 't'||(turn % 4) AS title, lower(concat_ws(' ', 't'||(turn % 4), text, role, 'tag', 'src/c'||conv_id||'.ts')) AS t FROM conversations),
s AS (SELECT id, title, CASE WHEN contains(t, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'user') THEN 3 ELSE 0 END + CASE WHEN contains(t, 'src/c1') THEN 6 ELSE 0 END + CASE WHEN contains(t, 'c7.ts') THEN 8 ELSE 0 END + CASE WHEN contains(t, 'src/c12.ts') THEN 8 ELSE 0 END AS score FROM t)
SELECT id, title, score FROM s WHERE score > 0 ORDER BY score DESC, title, id LIMIT 40"""),
    "memory_summary": (memory_summary, f"""WITH {_OC}, b AS (SELECT conv_id, turn, task, row_number() OVER (ORDER BY length(task) DESC, conv_id||'-'||turn) AS place FROM o WHERE length(coalesce(task, '')) > 0 QUALIFY place <= 50),
v AS (SELECT 'files' AS section, 'f'||(conv_id % 9) AS value, place FROM b UNION ALL SELECT 'validation', 'turn'||(turn % 3), place FROM b UNION ALL SELECT 'observations', split_part(task, ' ', 1), place FROM b),
g AS (SELECT section, value, count(*) AS n, min(place) AS first FROM v WHERE value <> '' GROUP BY 1, 2)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'observations' THEN first ELSE -n END, value) AS INTEGER) AS place, value, n FROM g QUALIFY place <= CASE section WHEN 'validation' THEN 12 ELSE 16 END"""),
    "task_context": (task_context, f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {_BOTH}, x AS (SELECT id, name, type, lower(type||' '||name||' '||file||' '||area) AS t FROM n),
z AS (SELECT id, name, {" + ".join(f"CASE WHEN lower(trim(name)) = '{w}' THEN 12 WHEN contains(t, '{w}') THEN 5 ELSE 0 END" for w in ("promo", "steel", "data"))} + CASE type WHEN 'request' THEN 3 WHEN 'method' THEN 2 WHEN 'table' THEN 1 WHEN 'external-service' THEN 1 ELSE 0 END AS score FROM x),
b AS (SELECT id, score FROM z WHERE score > 0 ORDER BY score DESC, name, id LIMIT 5),
r(id, d) AS (SELECT id, 0 FROM b UNION SELECT t, d + 1 FROM r JOIN s ON f = id WHERE d < 2), k AS (SELECT DISTINCT id FROM r)
SELECT type, CAST(row_number() OVER (PARTITION BY type ORDER BY score DESC NULLS LAST, name, n.id) AS INTEGER) AS place, n.id, name, coalesce(score, 0) AS score, score IS NOT NULL AS start FROM n JOIN k ON k.id = n.id LEFT JOIN b ON b.id = n.id QUALIFY place <= 12"""),
    "affected_features": (affected_features, """WITH p AS (SELECT p_brand AS key, lower(p_brand||'/'||replace(p_type, ' ', '/')) AS file, lower(p_brand||'/'||split_part(p_type, ' ', 1)) AS root, p_size FROM part),
r AS (SELECT DISTINCT key, root FROM p), h AS (SELECT r.key, count(DISTINCT CASE WHEN p_size = 50 THEN file END) AS own, count(DISTINCT file) AS near FROM r JOIN p ON p.root = r.root WHERE p_size >= 45 GROUP BY 1)
SELECT key, own > 0 AS direct, CAST(CASE WHEN own > 0 THEN 100 + 10 * own ELSE least(10 * near, 20) END AS INTEGER) AS score, CASE WHEN own > 0 THEN 'high' ELSE 'medium' END AS confidence FROM h"""),
    "mounted_endpoints": (mounted_endpoints, """WITH x AS (SELECT DISTINCT 'routes/'||o_orderstatus||'.ts' AS file, '/list/'||lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9_.-]+', '-', 'g')) AS p FROM orders), m AS (SELECT '/api/'||lower(n_name) AS base, CASE WHEN n_regionkey = 3 THEN 'routes/O.ts' ELSE 'routes/F.ts' END AS spot FROM nation)
SELECT file, 'GET' AS method, coalesce(base, '')||p AS path, p AS original, base FROM x LEFT JOIN m ON file = spot"""),
    "service_routes": (service_routes, """WITH a AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS l FROM lineitem), r AS (SELECT k, l, s_nationkey, CASE l WHEN 1 THEN '' WHEN 2 THEN 'app.rpc.' WHEN 3 THEN 'remote.' END AS pre FROM a JOIN supplier ON s_suppkey = k WHERE l <= 3)
SELECT k||'-'||l AS id, pre||'n'||s_nationkey||'.s'||k||'.GO' AS route, 'x/app/servers/n'||s_nationkey||'/remote/S'||k||'.ts' AS file, 'go' AS name FROM r"""),
    "call_links": (call_links, """WITH c AS (SELECT DISTINCT 'p'||l_partkey AS caller, 's'||l_suppkey AS callee, CASE l_returnflag WHEN 'R' THEN 'field' WHEN 'A' THEN 'imported' ELSE 'local' END AS kind FROM lineitem), g AS (SELECT caller, callee, string_agg(kind, ',' ORDER BY kind) AS how FROM c GROUP BY 1, 2),
p AS (SELECT DISTINCT 'p'||l_partkey AS caller, 's'||(l_suppkey + l_linenumber % 2) AS callee FROM lineitem) SELECT p.caller, p.callee, coalesce(how, 'none') AS how FROM p LEFT JOIN g ON g.caller = p.caller AND g.callee = p.callee"""),
    "unresolved_calls": (unresolved_calls, """WITH l AS (SELECT 'f'||l_linenumber AS file, l_suppkey AS s, l_partkey % 50 AS p, l_returnflag AS f FROM lineitem)
SELECT file, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM l k WHERE k.f = 'R' AND k.file = l.file AND k.s = l.s AND k.p = l.p) GROUP BY 1"""),
    "message_links": (message_links, """WITH a AS (SELECT DISTINCT event_type AS message, CASE event_type WHEN 'click' THEN 'sender' WHEN 'view' THEN 'handler' ELSE 'dispatcher' END AS role, user_id FROM events),
m AS (SELECT 'm'||(c_custkey % 10) AS name, max('customer:'||c_custkey) AS id FROM customer GROUP BY 1),
x AS (SELECT message, role, CASE WHEN role <> 'dispatcher' THEN (SELECT 'customer:'||c_custkey FROM customer WHERE c_custkey = user_id) ELSE m.id END AS method FROM a LEFT JOIN m ON m.name = 'm'||(user_id % 20))
SELECT message, role, method, CASE WHEN role = 'sender' THEN 'emits' ELSE 'binds' END AS type, CASE WHEN role = 'handler' THEN 'message:'||message ELSE method END AS src, CASE WHEN role = 'handler' THEN method ELSE 'message:'||message END AS dst FROM x WHERE method IS NOT NULL"""),
    "field_flow": (field_flow, """WITH x AS (SELECT DISTINCT 'u'||user_id AS file, event_type AS method, CASE WHEN event_type = 'purchase' THEN 'request' WHEN value > 50 THEN 'write' ELSE 'read' END AS kind, 'State.k'||json_extract_string(props, '$.k') AS field, CASE WHEN user_id % 2 = 0 THEN 'frontend' ELSE 'backend' END AS area FROM events)
SELECT CASE WHEN kind = 'request' THEN 'network' ELSE area END AS side, kind, count(*) AS n FROM x WHERE contains(lower(field), 'state.k1') GROUP BY 1, 2"""),
    "task_gate": (task_gate, f"WITH {_GATE} SELECT decision, {' + '.join(f'CAST(s{i} AS INTEGER)' for i in range(6))} AS signals, count(*) AS n FROM k GROUP BY 1, 2"),
    "execution_plan": (execution_plan, f"""WITH {_GATE}, p AS (SELECT list_filter([CASE WHEN decision <> 'optional_skip_allowed' THEN 'prepare-context' END, CASE WHEN s0 THEN 'check-endpoints' END, CASE WHEN s1 THEN 'check-tables' END, CASE WHEN s2 THEN 'check-credentials' END, CASE WHEN s3 THEN 'check-services' END, 'edit', 'validate-scope', CASE WHEN decision = 'required' THEN 'review-patch' END], lambda x: x IS NOT NULL) AS steps FROM k),
u AS (SELECT unnest(steps) AS step, unnest(range(len(steps))) AS place FROM p) SELECT CAST(place AS INTEGER) AS place, step, count(*) AS n FROM u GROUP BY 1, 2"""),
    "inferred_rules": (inferred_rules, f"WITH {_GATE}, r AS ({_RULES}) SELECT category, count(*) AS n FROM r GROUP BY 1"),
    "scope_verdicts": (scope_verdicts, f"WITH {_SCOPES} SELECT 'required' AS decision, verdict, count(*) AS n, CAST(sum(outside) AS BIGINT) AS outside, CAST(sum(missing) AS BIGINT) AS missing FROM v GROUP BY 2"),
    "patch_reviews": (patch_reviews, f"""WITH {_SCOPES}, x AS (SELECT CASE WHEN verdict = 'pmm_context_unavailable' OR o_orderpriority = '1-URGENT' THEN 'changes_requested' ELSE 'review_ready' END AS verdict, CASE WHEN verdict <> 'within_scope' THEN 1 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS findings FROM v)
SELECT verdict, findings, count(*) AS n FROM x GROUP BY 1, 2"""),
    "feature_candidates": (feature_candidates, """WITH s AS (SELECT lower(split_part(p_type, ' ', 1)) AS key, CASE WHEN p_size > 25 THEN 40 ELSE 35 END AS w FROM part UNION ALL SELECT lower(replace(p_brand, '#', '-')), CASE WHEN p_size > 25 THEN 25 ELSE 12 END FROM part)
SELECT key, CAST(sum(w) AS BIGINT) AS score, count(*) AS nodes, CASE WHEN sum(w) >= 40 THEN 'high' WHEN sum(w) >= 25 THEN 'medium' ELSE 'low' END AS confidence FROM s GROUP BY 1"""),
    "recalled_outcomes": (recalled_outcomes, f"""WITH {_OC}, x AS (SELECT conv_id||'-'||turn AS id, conv_id, lower(coalesce(task, '')) AS t, lower(coalesce(task, '')||' '||coalesce(outcome, '')||' src/app/c'||conv_id||'.ts') AS e FROM o),
s AS (SELECT id, conv_id, {" + ".join(f"CASE WHEN contains(t, '{w}') THEN 8 WHEN contains(e, '{w}') THEN 3 ELSE 0 END" for w in ("the", "of", "and"))} + CASE WHEN conv_id = 7 THEN 12 WHEN 'src/app/c'||conv_id||'.ts' LIKE '%app/c7.ts%' THEN 4 ELSE 0 END + CASE WHEN contains('src/app/c'||conv_id||'.ts', 'src/app/c2') THEN 4 ELSE 0 END + CASE WHEN conv_id > 20 THEN 1 ELSE 0 END AS score FROM x)
SELECT id, score, CASE WHEN score >= 20 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS confidence FROM s WHERE score > 0 ORDER BY score DESC, conv_id DESC, id LIMIT 25"""),
    "workspace_matches": (workspace_matches, """WITH m AS (SELECT c_custkey AS ask, k.n_name AS id, 60 + CASE WHEN c_custkey % 3 = 0 AND k.n_nationkey = c_nationkey THEN 80 ELSE 0 END AS score FROM customer JOIN nation k ON k.n_nationkey % 5 = c_nationkey % 5),
b AS (SELECT *, count(*) OVER (PARTITION BY ask) > 1 AS ambiguous FROM (SELECT * FROM m QUALIFY score = max(score) OVER (PARTITION BY ask))) SELECT score, ambiguous, count(*) AS n, count(DISTINCT ask) AS asked FROM b GROUP BY 1, 2"""),
    "text_scalars": (text_scalars, """SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) AS workspace, left(sha1('/w/'||lower(p_brand)), 12) AS hash, 'cb_'||regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') AS synthetic,
 array_to_string(list_transform(string_split(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: upper(w[1:1])||w[2:]), ' ') AS title, 'GET /'||p_brand AS request, CASE WHEN p_size <= 10 THEN 20 ELSE least(p_size - 10, 30) END AS "limit", 'packages/'||p_brand AS root, regexp_matches(p_name, '[\\s,;!?]') AS prose FROM part"""),
}
