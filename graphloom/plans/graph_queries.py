"""Graph and search queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search as S
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table

START = "customer:1"
SEEDS = ("part:1", "customer:1")


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def bfs(start: tuple, direction: str, depth: int):
    return lambda spark, d: G.traverse(edges(spark, d, repeated=True), _starts(spark, *start), depth, direction)


def _bfs_sql(starts: tuple, depth: int, sides: tuple, name: str = "r") -> str:
    steps = " UNION ALL ".join(f"SELECT '{d}' AS direction, {a} AS f, {b} AS t, * FROM e" for d, a, b in sides)
    first = " UNION ".join(f"SELECT '{s}', 0" for s in starts)
    return f"""WITH RECURSIVE {EDGES_SQL}, s AS ({steps}),
r(id, d) AS ({first} UNION SELECT t, d + 1 FROM r JOIN s ON f = id WHERE d < {depth - 1}),
m AS (SELECT id, min(d) AS d FROM r GROUP BY id),
x AS (SELECT CAST(d + 1 AS INTEGER) AS depth, direction, src, dst, type, operation FROM m JOIN s ON f = id)"""


DOWN, UP = ("downstream", "src", "dst"), ("upstream", "dst", "src")


def data_access_summary(spark, d):
    return G.data_access(G.traverse(edges(spark, d, repeated=True), _starts(spark, START), 4), nodes(spark, d))


def nodes_by_type(spark, d):
    return nodes(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def degree_topk(spark, d):
    return G.top_degree(edges(spark, d))


def incident_detail(spark, d):
    return G.incident(edges(spark, d), nodes(spark, d).where("type IN ('route', 'module')"))


def focus_shaping(spark, d):
    found = G.traverse(edges(spark, d, repeated=True), _starts(spark, START), 3)
    return G.helpers_apart(found, nodes(spark, d)).groupBy("type", "related_helper").agg(F.count(F.lit(1)).alias("n"))


def node_search(spark, d):
    return S.search(nodes(spark, d), name="red", kind="table", area="data", without="brand#1")


def has_handler(spark, d):
    return S.having_edge(nodes(spark, d), edges(spark, d), "binds", "nation:1").select("id", "name")


def resolve_selector(spark, d):
    return S.resolve(nodes(spark, d), "red")


def ambiguity_groups(spark, d):
    return S.recommend(S.search(nodes(spark, d), name="1"))


def term_scoring_topk(spark, d):
    return S.top(S.score_nodes(nodes(spark, d), ["order", "get", "backend", "brand#1", "data"]), 50, "name", "id")


def request_endpoint_match(spark, d):
    """Requests and endpoints by method and normalised path; the endpoint dimension is configuration (15 rows)."""
    n = nodes(spark, d).where("type = 'request'")
    pri = table(spark, d, "orders").select(T.slugify(F.col("o_orderpriority")).alias("p")).distinct()
    methods = F.explode(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT")]))
    endpoints = pri.select("p", methods.alias("m")).select(F.concat_ws(" ", "m", F.concat(F.lit("/api/orders/"), "p")).alias("endpoint"), "m", T.route(F.concat(F.lit("/api/orders/"), "p")).alias("r"))
    parts = F.split("name", " ", 2)
    r = n.select("id", parts[0].alias("m"), T.route(parts[1]).alias("r"))
    return r.join(endpoints, ["m", "r"]).select("id", "endpoint")


def area_longest_prefix(spark, d):
    roots = [("brand#1", "one"), ("brand#11", "eleven"), ("brand#11/promo", "promo"), ("brand#2", "two"), ("brand#23", "twenty-three")]
    return S.longest_prefix(nodes(spark, d).where("type = 'table'").select("id", F.col("file").alias("path")), roots).select("id", "area")


def suffix_match_impact(spark, d):
    pages = table(spark, d, "pages")
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), "/+$", "")
    files = pages.select("page_id", path.alias("file"))
    changed = pages.select(F.substring_index(path, "/", -2).alias("changed")).distinct()
    return S.suffix_matches(files, changed).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


def node_merge_lww(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("name"), F.get_json_object("props", "$.k").alias("state"))
    return G.merge_nodes(e, "id", "seq", ["name", "state"])


def edge_dedup(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").alias("seq"))
    return G.first_of(e, ["src", "dst"], "seq")


def slugify_paths(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.slugify(F.col("p_name")).alias("slug"), T.path(F.concat(F.lit("A\\\\B//"), "p_type")).alias("path"), T.join_path(F.col("p_brand"), F.lit("/x/")).alias("joined"), T.route(F.concat(F.lit("/API//"), "p_brand", F.lit("/"))).alias("route"))


def tokenize_tags(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array_join(T.search_tags(F.col("p_name"), F.col("p_type")), ",").alias("tags"))


def risk_level(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.risk(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))) > 0).alias("risk"))
    return x.groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def effective_requests(spark, d):
    """Suppliers of a nation call the next one by key; requests are the nation's parts with a small key."""
    s = table(spark, d, "supplier")
    calls = s.alias("a").join(s.alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("b.s_suppkey") == F.col("a.s_suppkey") + 25)).select(F.col("a.s_nationkey").alias("script"), F.col("a.s_suppkey").alias("method"), F.col("b.s_suppkey").alias("callee"))
    requests = s.where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("script"), F.col("s_suppkey").alias("method"), F.col("s_name").alias("request"))
    return G.effective(calls, requests)


_N, _E = f"WITH {NODES_SQL}", f"WITH {EDGES_SQL}"
_SLUG = lambda c: f"lower(regexp_replace(regexp_replace(regexp_replace(trim({c}), '[^\\w.-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'))"
_TOK = lambda c: f"list_filter(string_split_regex(lower(trim(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./:@-]', ' ', 'g'))), '\\s+'), lambda t: t <> '')"
_SYN = lambda c: "list_concat(" + ", ".join(f"CASE WHEN contains(lower(trim({c})), '{k}') THEN [" + ", ".join(f"'{t}'" for t in tags) + "] ELSE [] END" for k, tags in T.SYNONYMS.items()) + ")"

QUERIES = {
    "bfs_downstream": (bfs((START,), "downstream", 4), _bfs_sql((START,), 4, (DOWN,)) + " SELECT * FROM x"),
    "bfs_upstream": (bfs(("part:1",), "upstream", 2), _bfs_sql(("part:1",), 2, (UP,)) + " SELECT * FROM x"),
    "bfs_bidirectional": (bfs(SEEDS, "both", 2), _bfs_sql(SEEDS, 2, (DOWN, UP)) + " SELECT * FROM x"),
    "data_access_summary": (data_access_summary, _bfs_sql((START,), 4, (DOWN,)) + f""", {NODES_SQL},
a AS (SELECT DISTINCT src, dst, type, operation FROM x WHERE type IN ('reads', 'writes'))
SELECT a.dst AS "table", coalesce(n.name, a.dst) AS name, count(*) FILTER (WHERE a.type = 'reads') AS reads, count(*) FILTER (WHERE a.type = 'writes') AS writes, count(DISTINCT src) AS actors
FROM a LEFT JOIN n ON n.id = a.dst GROUP BY 1, 2"""),
    "nodes_by_type": (nodes_by_type, f"{_N} SELECT type, count(*) AS n FROM n GROUP BY type"),
    "degree_topk": (degree_topk, f"{_E} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY degree DESC, id LIMIT 16"),
    "incident_detail": (incident_detail, f"""{_E}, i AS (SELECT dst AS id, 'in' AS direction, src AS other, type FROM e UNION ALL SELECT src, 'out', dst, type FROM e)
SELECT id, type, direction, count(*) AS n, array_to_string(list_sort(list(DISTINCT other))[1:25], ',') AS neighbours FROM i WHERE id LIKE 'nation:%' OR id LIKE 'region:%' GROUP BY 1, 2, 3"""),
    "focus_shaping": (focus_shaping, _bfs_sql((START,), 3, (DOWN,)) + f""", {NODES_SQL}, mm AS (SELECT id, file FROM n WHERE type = 'method')
SELECT x.type, coalesce(a.file = b.file, false) AS related_helper, count(*) AS n FROM x LEFT JOIN mm a ON a.id = src LEFT JOIN mm b ON b.id = dst GROUP BY 1, 2"""),
    "node_search": (node_search, f"{_N} SELECT * FROM n WHERE type = 'table' AND contains(lower(name||' '||id), 'red') AND area = 'data' AND NOT contains(lower(file), 'brand#1')"),
    "has_handler": (has_handler, f"{_N}, {EDGES_SQL} SELECT id, name FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.src = n.id AND e.type = 'binds' AND contains(lower(e.dst), 'nation:1'))"),
    "resolve_selector": (resolve_selector, f"""{_N}, t AS (SELECT id, type, name, CASE WHEN id = 'red' THEN 1 WHEN lower(trim(name)) = 'red' THEN 2 WHEN contains(lower(name||' '||file), 'red') THEN 3 END AS tier FROM n)
SELECT id, type, name, tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""),
    "ambiguity_groups": (ambiguity_groups, f"""{_N} SELECT CASE type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in S.GROUP.items())} ELSE 99 END AS priority, type, CAST(row_number() OVER (PARTITION BY type ORDER BY name, id) AS INTEGER) AS place, id, name
FROM n WHERE contains(lower(name||' '||id), '1') QUALIFY row_number() OVER (PARTITION BY type ORDER BY name, id) <= 5"""),
    "term_scoring_topk": (term_scoring_topk, f"""{_N}, s AS (SELECT id, name, {' + '.join(f"CASE WHEN lower(trim(name)) = '{t}' THEN 12 WHEN contains(lower(type||' '||name||' '||file||' '||area), '{t}') THEN {8 if '/' in t else 5} ELSE 0 END" for t in ("order", "get", "backend", "brand#1", "data"))}
 + CASE type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in S.TYPE_BONUS.items())} ELSE 0 END AS score FROM n) SELECT id, name, score FROM s WHERE score > 0 ORDER BY score DESC, name, id LIMIT 50"""),
    "request_endpoint_match": (request_endpoint_match, f"""{_N} SELECT n.id, m||' /api/orders/'||p AS endpoint FROM n, (SELECT DISTINCT {_SLUG('o_orderpriority')} AS p FROM orders), (VALUES ('GET'), ('POST'), ('PUT')) v(m)
WHERE n.type = 'request' AND n.name = m||' /Orders//'||p||'/'"""),
    "area_longest_prefix": (area_longest_prefix, f"""{_N}, r(root, area) AS (VALUES ('brand#1', 'one'), ('brand#11', 'eleven'), ('brand#11/promo', 'promo'), ('brand#2', 'two'), ('brand#23', 'twenty-three'))
SELECT n.id, coalesce(arg_max(r.area, length(root)), 'unknown') AS area FROM n LEFT JOIN r ON lower(n.file) = root OR starts_with(lower(n.file), root||'/') WHERE n.type = 'table' GROUP BY n.id"""),
    "suffix_match_impact": (suffix_match_impact, r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/+$', '') AS file FROM pages),
c AS (SELECT DISTINCT array_to_string(list_slice(string_split(file, '/'), -2, -1), '/') AS changed FROM p)
SELECT changed, count(*) AS n FROM p JOIN c ON file = changed OR ends_with(file, '/'||changed) OR ends_with(changed, '/'||file) GROUP BY changed"""),
    "node_merge_lww": (node_merge_lww, """WITH e AS (SELECT 'user:'||user_id AS id, event_id AS seq, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS name, json_extract_string(props, '$.k') AS state FROM events)
SELECT id, arg_max(name, seq) FILTER (WHERE name <> '') AS name, arg_max(state, seq) FILTER (WHERE state <> '') AS state FROM e GROUP BY id"""),
    "edge_dedup": (edge_dedup, "SELECT 'user:'||user_id AS src, event_type AS dst, min(event_id) AS seq FROM events GROUP BY 1, 2"),
    "slugify_paths": (slugify_paths, f"""SELECT p_partkey, {_SLUG('p_name')} AS slug, regexp_replace(replace(lower('A\\\\B//'||p_type), '\\', '/'), '/+', '/', 'g') AS path,
regexp_replace('/'||p_brand||'//x/', '/+', '/', 'g') AS joined, lower('/'||p_brand) AS route FROM part"""),
    "tokenize_tags": (tokenize_tags, f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([lower(trim(p_name)), lower(trim(p_type))], list_concat({_TOK('p_name')}, {_TOK('p_type')}, {_SYN('p_name')}, {_SYN('p_type')})), lambda t: t <> ''))), ',') AS tags FROM part"""),
    "risk_level": (risk_level, f"""SELECT CASE WHEN regexp_matches(lower(coalesce(text, '')), '{T.HIGH_RISK}') THEN 'high' WHEN regexp_matches(lower(coalesce(text, '')), '{T.MEDIUM_RISK}') THEN 'medium' WHEN length(coalesce(text, '')) > 0 THEN 'low' ELSE 'unknown' END AS risk, count(*) AS n FROM documents GROUP BY 1"""),
    "effective_requests": (effective_requests, """WITH RECURSIVE c AS (SELECT a.s_nationkey AS script, a.s_suppkey AS method, b.s_suppkey AS callee FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey = a.s_suppkey + 25),
q AS (SELECT s_nationkey AS script, s_suppkey AS method, s_name AS request FROM supplier WHERE s_suppkey % 3 = 0),
r(script, method, via_method) AS (SELECT script, method, method FROM c UNION SELECT script, method, method FROM q UNION SELECT r.script, r.method, c.callee FROM r JOIN c ON c.script = r.script AND c.method = r.via_method)
SELECT DISTINCT r.script, r.method, r.via_method, q.request FROM r JOIN q ON q.script = r.script AND q.method = r.via_method"""),
}
