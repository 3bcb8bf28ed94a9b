"""Queries on method bodies, manifests and authoring requests that Spark derives from the tables, with SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import authoring as A
from ..operators import bodies as B
from ..operators import extract as X
from ..operators import lifecycle as LC
from ..operators import linking as L
from ..operators import manifests as M
from ..operators import prefab as P
from ..sources.storage import written
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from .prefab_queries import _O, derived_catalog, derived_prefabs

#: A class for each order: {k} its key, {c} its customer, {s} its status, {p} its priority's digit.
BODY = """import { Kind{p}, Other as Alias } from "./kinds/{p}";
/** Order {k} of the shop.
 * @param {number} id - the {s} key
 * @returns {Promise<Row>} the row
 * @see Customer{c}
 */
export class Order{k} {
  /* bus.on("no", () => gone()); */
  @property({ type: Kind{p} }) icon;
  private total: Alias[] = [];
  handlers = { ["{s}Opened"]: this.open{p}, 'closed': this.close, skipped: 3 };
  open(id) { if (!id) { return; } for (const x of this.rows) { store.push(x, [1, 2]); } const y = id ?? "a,b(";
    const z = this.rows.filter((r) => r.id); return y; }
  bind() { Object.entries(this.handlers).forEach(([e, h]) => { eventBus.on(e, h, this); });
    eventBus.once("{s}Ready", (m) => { load{p}(m); this.draw(m); }); this.open(e); this.total.add(1); Alias.go(1); }
}
export const api{k} = { get kind() { return Kind{p}; }, other: Alias, local: Plain };
"""


def derived_bodies(spark, d):
    """file, text: a class for each order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderstatus").alias("s"), F.left("o_orderpriority", F.lit(1)).alias("p"))
    # A table of one file is read by one task, however long its texts are looked at.
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    # What is fixed and what is filled in take turns.
    text = F.concat(*[F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{([kcsp])\}", BODY))])
    return o.select(F.concat(F.lit("o/"), "k", F.lit(".ts")).alias("file"), text.alias("text"))


def _names(spark, d):
    i = X.facts(derived_bodies(spark, d), kinds=("import",)).select("file", F.col("subject").alias("clause"), F.col("detail").alias("specifier"))
    return L.import_names(i)


def _bare(spark, d):
    return derived_bodies(spark, d).withColumn("text", B.without_comments("text"))


def body_operations(spark, d):
    """Operations of each order's class by type and target."""
    s = B.summaries(_bare(spark, d)).select("file", F.explode("operations").alias("o"))
    return s.groupBy("file", "o.type", "o.target", "o.detail", "o.flag").agg(F.count(F.lit(1)).alias("n"))


def _methods(spark, d):
    return B.methods(derived_bodies(spark, d))


def _stored_methods(spark, d):
    """Methods that are written, as their calls and their names are read apart."""
    return written(_methods(spark, d).select("file", "method", "body"), "methods")


def _calls(spark, d, found):
    names = _names(spark, d)
    return B.method_calls(found, names, B.field_types(_bare(spark, d), names))


def body_methods(spark, d):
    """Methods of the orders' classes and how long their bodies are."""
    return _methods(spark, d).select("file", "method", "params", "line", F.length("body").alias("length"))


def method_calls(spark, d):
    """Calls of the orders' methods by kind."""
    return _calls(spark, d, _stored_methods(spark, d)).groupBy("caller", "callee", "owner", "kind").agg(F.sum("n").alias("n"))


def method_graph(spark, d):
    """Nodes of the graph of the orders' methods and the edges that end there."""
    resolved = X.resolved_imports(X.facts(derived_bodies(spark, d), kinds=("import",)), table(spark, d, "orders").select(F.concat(F.lit("o/kinds/"), F.left("o_orderpriority", F.lit(1)), F.lit(".ts")).alias("file")).distinct())
    m = _stored_methods(spark, d)
    found, edges = B.method_graph(m, written(_calls(spark, d, m), "calls"), resolved)
    return found.join(edges.groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("calls")), "id", "left").select("id", "synthetic", F.coalesce("calls", F.lit(0)).alias("calls"))


def body_complexity(spark, d):
    """Counts, flows and complexity of each order's class."""
    return B.summaries(_bare(spark, d)).select("file", F.size("flows").alias("flows"), "branches", "loops", "calls", "complexity")


def body_documentation(spark, d):
    """The documentation of each order's class."""
    doc = B.documentation(derived_bodies(spark, d))
    return doc.select("name", F.col("doc.description").alias("description"), F.col("doc.params")["id"]["description"].alias("param"), F.col("doc.returns").alias("returns"), F.col("doc.returns_type").alias("returns_type"), F.col("doc.see")[0].alias("see"), F.col("doc.deprecated").alias("deprecated"))


def body_snippets(spark, d):
    """Snippets of the orders' comments, short ones and cut ones."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("return a; // "), "o_orderstatus", F.lit("\nthis.total = "), "o_orderkey", F.lit("; load"), F.left("o_orderpriority", F.lit(1)), F.lit("("), "o_custkey", F.lit(");"), F.when(F.col("o_orderstatus") == "F", " const finished = this.finish(rows, ids); this.finish(rows, ids);").otherwise("")).alias("text"))
    return o.select("o_orderkey", B.snippet(F.col("text")).alias("snippet"), B.snippet(F.col("text"), 20).alias("short"))


def inline_events(spark, d):
    """Inline subscriptions of the orders' classes; the one in a comment does not count."""
    return B.inline_events(_bare(spark, d)).select("file", "bus", "mode", "event", F.array_join("calls", ",").alias("calls"))


def mapped_events(spark, d):
    """Subscriptions of every entry of the orders' handler maps."""
    b, bare = derived_bodies(spark, d), B.without_comments("text")
    return B.mapped_events(b, B.handler_maps(b, text=bare), text=bare)


def source_namespaces(spark, d):
    """Members of the orders' exported objects."""
    return B.namespaces(_bare(spark, d), _names(spark, d))


def field_types(spark, d):
    """E20d, X28, X30: fields of the orders' classes by type."""
    f = B.field_types(_bare(spark, d), _names(spark, d))
    return f.groupBy("field", "raw", "base", "specifier", "via").agg(F.count(F.lit(1)).alias("n"))


def derived_manifests(spark, d):
    """path, text: a manifest for each supplier, of a kind by key modulo 4, below its nation's folder."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("n"), "s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, "-web/rest/s").otherwise("/s"), "s_suppkey").alias("dir"))
    k = F.col("k")
    deps = F.concat(F.lit('{"dependencies":{"'), F.when(k % 3 == 0, "Next").when(k % 3 == 1, "express").otherwise("ws"), F.lit('":"1"},"devDependencies":{"kafkajs":"2"}'), F.when(k % 5 == 0, ',"main":"x.js"').otherwise(""), F.lit("}"))
    name = F.when(k % 4 == 0, "package.json").when(k % 4 == 1, "go.mod").when(k % 4 == 2, "requirements.txt").otherwise("notes.txt")
    text = F.when(k % 4 == 0, deps).when(k % 4 == 1, F.concat(F.lit("require github.com/gofiber/fiber v"), "k")).when(k % 4 == 2, "Flask==1\nnatsort").otherwise("vue")
    return s.select(F.concat_ws("/", "dir", name).alias("path"), text.alias("text"))


def manifest_stacks(spark, d):
    """Stacks and areas of the suppliers' manifests."""
    return M.stacks(M.scan(derived_manifests(spark, d))).select("path", F.array_join("stacks", ",").alias("stacks"), "area")


def project_integrations(spark, d):
    """What shows each integration in the suppliers' projects."""
    files = derived_manifests(spark, d)
    return M.integrations(files, M.scan(files))


def _component(c):
    return F.coalesce(F.regexp_extract(c("script"), r"([^/]*)\.ts$", 1), c("type"))


def _authored(spark, d):
    found = P.objects(derived_prefabs(spark, d))
    parts = P.components(found, derived_catalog(spark, d))
    return found, parts, parts.select("file", "path", _component(F.col).alias("component")), P.tree(found).where("depth = 1").select("file", "path")


def _asked(spark, d):
    """For each order a wish about the script of its priority, at the order's node."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("p"))
    path = F.concat(F.lit("c"), "o_custkey", F.lit("/o"), "id")
    return o.select("id", F.concat(F.lit("ui/c"), "o_custkey", F.lit(".prefab")).alias("file"), path.alias("node"), F.concat(F.lit("P"), "p").alias("component"), F.concat(F.lit("tap"), "p").alias("handler"), F.when(F.col("o_orderstatus") == "O", path).alias("target"))


def _declared(spark, d):
    p = table(spark, d, "orders").select(F.left("o_orderpriority", F.lit(1)).alias("p")).distinct().where("p <> '5'")
    return p.select(F.concat(F.lit("P"), "p").alias("component"), F.when(F.col("p") <= "2", F.concat(F.lit("tap"), "p")).otherwise("idle").alias("method"))


def click_plans(spark, d):
    """C4: changes that a tap on each order's node needs."""
    _, _, parts, roots = _authored(spark, d)
    events = _asked(spark, d).where("id % 2 = 0").select("file", F.col("node").alias("source"), "component", "handler")
    return A.click_plans(_asked(spark, d), parts, _declared(spark, d), events, roots)


def field_plans(spark, d):
    """Changes that the icon and the size of each order's script need."""
    found, parts, named, roots = _authored(spark, d)
    refs = P.references(found, derived_catalog(spark, d)).join(parts.select("file", "place", "path", _component(F.col).alias("component")), ["file", "place"]).select("file", "path", "component", "field", F.col("target").alias("value"))
    names = _declared(spark, d).select("component")
    fields = names.withColumn("field", F.lit("icon")).withColumn("base", F.lit("SpriteFrame")).union(names.withColumn("field", F.lit("size")).withColumn("base", F.lit("Number")))
    asked = _asked(spark, d).select("id", "file", "component", F.when(F.col("id") % 2 == 0, "icon").otherwise("size").alias("field"), "node", F.when(F.col("id") % 4 == 0, F.lit("I/")).alias("target"))
    return A.field_plans(asked, named, fields, refs, roots)


def prefab_profiles(spark, d):
    """Profiles of the prefabs of every feature, which is a customer's segment."""
    found, parts, _, _ = _authored(spark, d)
    features = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("feature"), F.concat(F.lit("ui/c"), "c_custkey", F.lit(".prefab")).alias("file"))
    return A.find_prefabs(A.profiles(found, parts), features, "I", "C")


def derived_nesting(spark, d):
    """file, text: for each supplier a prefab that refers into its nation's prefab, and the nations' prefabs."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    outer = F.lit('[{"__type__":"cc.Prefab"},{"__type__":"cc.Node","_name":"s@k","_parent":null,"_prefab":{"__id__":2}},{"__type__":"cc.PrefabInfo","asset":{"__uuid__":"nation@n"}},'
                  '{"__type__":"cc.TargetInfo","localID":["id@m"]},{"__type__":"cc.TargetOverrideInfo","source":{"__id__":9},"propertyPath":["list","0"],"target":{"__id__":1},"targetInfo":{"__id__":3}}]')  # fmt: skip
    inner = F.lit('[{"__type__":"cc.Prefab"},{"__type__":"cc.Node","_name":"n@n","_parent":null},{"__type__":"cc.Label","node":{"__id__":1},"__prefab":{"__id__":3}},{"__type__":"cc.CompPrefabInfo","fileId":"id0"}]')
    m = (F.col("k").cast("long") % 2).cast("string")
    outers = s.select(F.concat(F.lit("s/"), "k", F.lit(".prefab")).alias("file"), F.replace(F.replace(F.replace(outer, F.lit("@k"), F.col("k")), F.lit("@n"), F.col("n")), F.lit("@m"), m).alias("text"))
    return outers.union(s.select("n").distinct().select(F.concat(F.lit("n/"), "n", F.lit(".prefab")), F.replace(inner, F.lit("@n"), F.col("n"))))


def nested_overrides(spark, d):
    """What the suppliers' prefabs refer to inside their nations' prefabs; odd ones name nothing there."""
    found = P.objects(derived_nesting(spark, d))
    metas = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.concat(F.lit("n/"), "n_nationkey", F.lit(".prefab.meta")).alias("path"), F.concat(F.lit('{"uuid":"nation'), "n_nationkey", F.lit('"}')).alias("text"))
    assets = P.catalog(metas)
    return A.nested_overrides(found, assets, P.components(found, assets)).select("file", "property", "prefab", "path", "type")


def build_report(spark, d):
    """K9: what a build of the graph holds."""
    return LC.report(nodes(spark, d), edges(spark, d))


def refreshed_index(spark, d):
    """One index of customers from three: from tables, registered and configured ones."""
    c = table(spark, d, "customer").withColumn("c_place", F.concat(F.lit("n"), "c_nationkey"))
    key = F.col("c_name").alias("key")
    out = lambda k, v: F.create_map(F.lit(k), F.col(v)).alias("outputs")
    row = lambda df, title, doc, o: df.select(key, title.alias("title"), doc.alias("docs"), o)
    first = row(c, F.lit("kb"), F.col("c_mktsegment"), out("scan", "c_place"))
    second = row(c.where("c_custkey % 2 = 0"), F.lit("registered"), F.lit(""), out("graph", "c_mktsegment"))
    third = row(c.where("c_custkey % 3 = 0"), F.col("c_place"), F.when(F.col("c_custkey") % 2 == 0, "own").otherwise(""), out("scan", "c_name"))
    r = LC.refreshed(first, second, third, kept=("docs",), merged=("outputs",))
    return r.select("key", "title", "docs", F.col("outputs")["scan"].alias("scan"), F.col("outputs")["graph"].alias("graph"))


def rebuild_targets(spark, d):
    """Suppliers registered in two spellings of a path and those that are present."""
    s = table(spark, d, "supplier")
    path = lambda sep: F.concat(F.lit("configs" + sep), "s_name", F.lit(".json"))
    registered = s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("key"), path("\\").alias("path")).union(s.where("s_suppkey % 4 = 0").select(F.concat(F.lit("z"), "s_name"), path("//")))
    return LC.rebuild_targets(registered, s.where("s_suppkey % 3 = 0").select(F.lower("s_name").alias("key"), path("/").alias("path")))


def path_issues(spark, d):
    """Issues of the suppliers' configurations against folders of customers' segments."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.lit("{no")).when(k % 5 == 1, F.concat(F.lit('{"assetRoots":"C:/n'), "s_nationkey", F.lit('"}'))).otherwise(F.concat(F.lit('{"methodRoots":["./N'), "s_nationkey", F.lit('/"],"prefabs":["N'), "s_nationkey", F.lit('/x"]}')))
    files = table(spark, d, "customer").select(F.concat(F.lit("N"), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("/y/")).otherwise(F.lit("/x/")), "c_name").alias("path"))
    needed = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey", F.lit("/state")).alias("path"))
    return LC.path_issues(s.select(F.concat(F.lit("s"), "s_suppkey").alias("config"), text.alias("text")), files, needed)


_B = "b AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, left(o_orderpriority, 1) AS p, 'o/'||o_orderkey||'.ts' AS file FROM orders)"
#: Type, target, detail (as SQL), flag of the operations in BODY.
_OPS = (
    ("condition", "''", "'!id'", True), ("loop", "'for_of'", "'this.rows'", False), ("method_call", "'store.push'", "'x, [1, 2]'", False), ("assignment", "'y'", "'id ?? \"a,b(\"'", True),
    ("assignment", "'z'", "'this.rows.filter((r) => r.id)'", False), ("filter", "'this.rows'", "'(r) => r.id'", False), ("return", "''", "''", False), ("return", "''", "'y'", False), ("return", "''", "'Kind'||p", False),
    ("method_call", "'Object.entries'", "'this.handlers'", False), ("foreach", "'()'", "'([e, h]) => { eventBus.on(e, h, this); }'", False), ("method_call", "'eventBus.on'", "'e, h, this'", False),
    ("method_call", "'eventBus.once'", "CASE WHEN TRUE THEN left('\"'||s||'Ready\", (m) => { load'||p||'(m); this.draw(m); }', 47)||CASE WHEN length('\"'||s||'Ready\", (m) => { load'||p||'(m); this.draw(m); }') > 50 THEN '...' ELSE substr('\"'||s||'Ready\", (m) => { load'||p||'(m); this.draw(m); }', 48) END END", False),
    ("method_call", "'global:load'||p", "'m'", False), ("method_call", "'this.draw'", "'m'", False), ("method_call", "'this.open'", "'e'", False), ("method_call", "'this.total.add'", "'1'", False), ("method_call", "'Alias.go'", "'1'", False), ("method_call", "'global:property'", "'{ type: Kind'||p||' }'", False),
    ("assignment", "'api'||k", "'{ get kind() { return Kind'||p", False),
)
_SQL_OPS = " UNION ALL ".join(f"SELECT file, '{t}' AS type, {target} AS target, {detail} AS detail, {str(flag).lower()} AS flag FROM b" for t, target, detail, flag in _OPS)
_A = f"{_O}, a AS (SELECT k, 'ui/c'||c||'.prefab' AS file, 'c'||c||'/o'||k AS node, 'c'||c AS root, p, f, (SELECT o_orderstatus = 'O' FROM orders WHERE o_orderkey = k) AS open FROM o)"

QUERIES = {
    "body_operations": (body_operations, f"WITH {_B}, x AS ({_SQL_OPS}) SELECT file, type, target, detail, flag, count(*) AS n FROM x GROUP BY ALL"),
    "body_complexity": (body_complexity, f"WITH {_B}, x AS ({_SQL_OPS}), g AS (SELECT file, CAST(count(*) FILTER (WHERE type IN ('assignment', 'filter')) AS INTEGER) AS flows, CAST(count(*) FILTER (WHERE type = 'condition') AS INTEGER) AS branches, CAST(count(*) FILTER (WHERE type = 'loop') AS INTEGER) AS loops, CAST(count(*) FILTER (WHERE type = 'method_call') AS INTEGER) AS calls FROM x GROUP BY 1) SELECT *, CASE WHEN branches + 2 * loops + 0.5 * calls <= 2 THEN 'low' WHEN branches + 2 * loops + 0.5 * calls <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM g"),
    "body_methods": (body_methods, f"""WITH {_B}, x AS (SELECT 'kind' AS method, '' AS params, 17 AS line, length(' return Kind'||p||'; ') AS length, file FROM b
UNION ALL SELECT 'open', 'id', 12, length(' if (!id) {{ return; }} for (const x of this.rows) {{ store.push(x, [1, 2]); }} const y = id ?? "a,b(";
    const z = this.rows.filter((r) => r.id); return y; '), file FROM b
UNION ALL SELECT 'bind', '', 14, length(' Object.entries(this.handlers).forEach(([e, h]) => {{ eventBus.on(e, h, this); }});
    eventBus.once("'||s||'Ready", (m) => {{ load'||p||'(m); this.draw(m); }}); this.open(e); this.total.add(1); Alias.go(1); '), file FROM b) SELECT file, method, params, line, CAST(length AS INTEGER) AS length FROM x"""),
    "method_calls": (method_calls, f"""WITH {_B}, x AS (SELECT 'open' AS caller, 'push' AS callee, 'store' AS owner, 'unresolved' AS kind FROM b UNION ALL SELECT 'bind', 'entries', 'Object', 'unresolved' FROM b UNION ALL SELECT 'bind', 'on', 'eventBus', 'unresolved' FROM b
UNION ALL SELECT 'bind', 'once', 'eventBus', 'unresolved' FROM b UNION ALL SELECT 'bind', 'load'||p, '', 'unresolved' FROM b UNION ALL SELECT 'bind', 'draw', 'this', 'unresolved' FROM b UNION ALL SELECT 'bind', 'open', 'this', 'local' FROM b
UNION ALL SELECT 'bind', 'add', 'this.total', 'field' FROM b UNION ALL SELECT 'bind', 'go', 'Alias', 'imported' FROM b) SELECT *, count(*) AS n FROM x GROUP BY ALL"""),
    "method_graph": (method_graph, f"""WITH {_B}, x AS (SELECT file||'#kind' AS id, false AS synthetic, 0 AS calls FROM b UNION ALL SELECT file||'#bind', false, 0 FROM b UNION ALL SELECT file||'#open', false, 1 FROM b
UNION ALL SELECT 'o/kinds/'||p||'.ts#add', true, 1 FROM b UNION ALL SELECT 'o/kinds/'||p||'.ts#go', true, 1 FROM b) SELECT id, synthetic, CAST(sum(calls) AS BIGINT) AS calls FROM x GROUP BY 1, 2"""),
    "body_documentation": (body_documentation, f"WITH {_B} SELECT 'Order'||k AS name, 'Order '||k||' of the shop.' AS description, 'the '||s||' key' AS param, 'the row' AS returns, 'Promise<Row>' AS returns_type, 'Customer'||c AS see, false AS deprecated FROM b"),
    "body_snippets": (body_snippets, f"""WITH {_B}, t AS (SELECT *, 'return a; this.total = '||k||'; load'||p||'('||c||');'||CASE s WHEN 'F' THEN ' const finished = this.finish(rows, ids); this.finish(rows, ids);' ELSE '' END AS flat,
 CASE s WHEN 'F' THEN 'const finished = this.finish(rows, ids); ' ELSE '' END||'this.total = '||k||'; return a; load'||p||'('||c||')'||CASE s WHEN 'F' THEN '; finish(rows, ids)' ELSE '' END AS shown FROM b)
SELECT k AS o_orderkey, CASE WHEN length(shown) < 50 THEN flat ELSE shown END AS snippet, CASE WHEN length(shown) < 50 THEN left(flat, 20) ELSE left(shown, 20)||'...' END AS short FROM t"""),
    "inline_events": (inline_events, f"WITH {_B} SELECT file, 'eventBus' AS bus, 'once' AS mode, s||'Ready' AS event, 'global:load'||p||',this.draw' AS calls FROM b"),
    "mapped_events": (mapped_events, f"WITH {_B} SELECT file, 'eventBus' AS bus, 'on' AS mode, s||'Opened' AS event, 'open'||p AS handler, 'handlers' AS map FROM b UNION ALL SELECT file, 'eventBus', 'on', 'closed', 'close', 'handlers' FROM b"),
    "source_namespaces": (source_namespaces, f"""WITH {_B} SELECT file, 'api'||k AS identifier, 'kind' AS member, 'Kind'||p AS target, 'getter' AS kind, './kinds/'||p AS specifier FROM b
UNION ALL SELECT file, 'api'||k, 'other', 'Alias', 'property', './kinds/'||p FROM b UNION ALL SELECT file, 'api'||k, 'local', 'Plain', 'property', NULL FROM b"""),
    "field_types": (field_types, f"""WITH {_B}, f AS (SELECT 'icon' AS field, 'Kind'||p AS raw, 'Kind'||p AS base, './kinds/'||p AS specifier, 'decorator' AS via FROM b UNION ALL SELECT 'total', 'Alias[]', 'Alias', './kinds/'||p, 'annotation' FROM b)
SELECT *, count(*) AS n FROM f GROUP BY ALL"""),
    "manifest_stacks": (manifest_stacks, """WITH s AS (SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS web, 'n'||s_nationkey||CASE WHEN s_nationkey % 2 = 0 THEN '-web/rest/s' ELSE '/s' END||s_suppkey AS dir FROM supplier)
SELECT dir||'/package.json' AS path, CASE k % 3 WHEN 0 THEN 'next,nodejs,react' WHEN 1 THEN 'express,'||CASE WHEN web THEN 'frontend-js,' ELSE '' END||'nodejs' ELSE CASE WHEN web THEN 'frontend-js,' ELSE '' END||'nodejs' END AS stacks,
 CASE WHEN k % 3 = 0 THEN 'frontend' WHEN k % 3 = 1 THEN 'backend' WHEN k % 5 = 0 THEN 'shared' ELSE 'unknown' END AS area FROM s WHERE k % 4 = 0
UNION ALL SELECT dir||'/go.mod', 'fiber,go', 'unknown' FROM s WHERE k % 4 = 1 UNION ALL SELECT dir||'/requirements.txt', 'flask,python', 'unknown' FROM s WHERE k % 4 = 2"""),
    "project_integrations": (project_integrations, """WITH s AS (SELECT s_suppkey AS k, s_nationkey % 2 = 0 AS web FROM supplier),
g AS (SELECT 'http' AS integration, 'secondary' AS rank, count(*) FILTER (WHERE web) AS folders, count(*) FILTER (WHERE k % 12 = 4) AS packages, count(*) FILTER (WHERE k % 4 IN (1, 2)) AS texts FROM s
UNION ALL SELECT 'websocket', 'primary', 0, count(*) FILTER (WHERE k % 12 = 8), 0 FROM s UNION ALL SELECT 'mq', 'secondary', 0, count(*) FILTER (WHERE k % 4 = 0), 0 FROM s) SELECT * FROM g WHERE folders + packages + texts > 0"""),
    "click_plans": (click_plans, f"""WITH {_A}, w AS (SELECT *, coalesce(CASE WHEN open THEN node END, (SELECT min(b.node) FROM a b WHERE b.file = a.file AND b.p = a.p AND NOT b.f), root) AS spot FROM a WHERE p <> '5'),
v AS (SELECT w.*, EXISTS (SELECT 1 FROM a b WHERE b.file = w.file AND b.node = w.spot AND b.p = w.p AND NOT b.f) AS attached FROM w),
x AS (SELECT k AS id, 0 AS o, 'attach-component' AS kind, attached AS ok, spot AS path FROM v UNION ALL SELECT k, 1, 'add-method', p <= '2', '' FROM v UNION ALL SELECT k, 2, 'attach-built-in-component', false, node FROM v WHERE NOT f UNION ALL SELECT k, 3, 'bind-event', k % 2 = 0, node FROM v)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS INTEGER) AS step, kind, CASE WHEN ok THEN 'already-satisfied' ELSE 'required' END AS status, path FROM x"""),
    "field_plans": (field_plans, f"""WITH {_A} SELECT k AS id, node AS path, CASE WHEN k % 2 = 0 THEN 'asset' ELSE 'primitive' END AS binding, CASE WHEN NOT f THEN 'already-satisfied' ELSE 'required' END AS attach, CASE WHEN NOT f AND k % 2 = 0 THEN 'already-satisfied' ELSE 'required' END AS bind FROM a WHERE p <> '5'"""),
    "prefab_profiles": (prefab_profiles, f"""WITH {_O}, g AS (SELECT c, count(*) AS components, count(*) FILTER (WHERE NOT f AND p <> '5') AS scripts, count(*) FILTER (WHERE f) AS built_in, count(*) FILTER (WHERE NOT f AND p = '5') AS unresolved FROM o GROUP BY 1)
SELECT lower(c_mktsegment) AS feature, 'ui/c'||c||'.prefab' AS file, components + 1 AS nodes, components, scripts, built_in, unresolved, 0 AS events FROM g JOIN customer ON c_custkey = c WHERE lower(c_mktsegment) LIKE '%i%'"""),
    "nested_overrides": (nested_overrides, """SELECT 's/'||s_suppkey||'.prefab' AS file, 'list.0' AS property, CASE WHEN s_nationkey % 5 <> 0 THEN 'n/'||s_nationkey||'.prefab' END AS prefab,
 CASE WHEN s_nationkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN 'n'||s_nationkey END AS path, CASE WHEN s_nationkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN 'cc.Label' END AS type FROM supplier"""),
    "build_report": (build_report, f"WITH {NODES_SQL}, {EDGES_SQL}, x AS (SELECT 'nodes' AS what, type FROM n UNION ALL SELECT 'edges', type FROM e) SELECT what, type, count(*) AS n FROM x GROUP BY ROLLUP (what, type) HAVING what IS NOT NULL"),
    "refreshed_index": (refreshed_index, """SELECT c_name AS key, CASE WHEN c_custkey % 3 = 0 THEN 'n'||c_nationkey WHEN c_custkey % 2 = 0 THEN 'registered' ELSE 'kb' END AS title, CASE WHEN c_custkey % 6 = 0 THEN 'own' ELSE c_mktsegment END AS docs,
 CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'n'||c_nationkey END AS scan, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS graph FROM customer"""),
    "rebuild_targets": (rebuild_targets, "SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE lower(s_name) END AS key, 'configs/'||s_name||'.json' AS path, s_suppkey % 2 = 0 AS registered, s_suppkey % 3 = 0 AS present FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0"),
    "path_issues": (path_issues, """WITH f AS (SELECT DISTINCT c_nationkey AS n, c_custkey % 2 <> 0 AS x FROM customer)
SELECT 's'||s_suppkey AS config, 'error' AS severity, 'unparsable' AS issue, '' AS path FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 's'||s_suppkey, 'error', 'windows-path', 'C:/n'||s_nationkey FROM supplier WHERE s_suppkey % 5 = 1
UNION ALL SELECT 's'||s_suppkey, 'warning', 'missing', 'C:/n'||s_nationkey FROM supplier WHERE s_suppkey % 5 = 1
UNION ALL SELECT 's'||s_suppkey, 'warning', 'missing', './N'||s_nationkey||'/' FROM supplier WHERE s_suppkey % 5 > 1 AND s_nationkey NOT IN (SELECT n FROM f)
UNION ALL SELECT 's'||s_suppkey, 'warning', 'missing', 'N'||s_nationkey||'/x' FROM supplier WHERE s_suppkey % 5 > 1 AND s_nationkey NOT IN (SELECT n FROM f WHERE x) UNION ALL SELECT '', 'warning', 'missing', 'N'||n_nationkey||'/state' FROM nation"""),
}
