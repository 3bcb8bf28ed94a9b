"""Queries on programs that Spark derives from the tables, row by row: which methods a class has, in what form, with what
brackets, comments and strings in them, follows from each order's lines, and the SQL states it over these columns."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import freshness as V
from ..operators import graph as G
from ..operators import learn as LN
from ..operators import lexing as X
from ..operators import lifecycle as LC
from ..operators import linking as L
from ..operators import members as M
from ..operators import protocols as P
from ..operators import rebuild as R
from ..operators import selectors as S
from ..sources.storage import shared_dir
from ..sources.tables import EDGES_SQL, NODES_SQL, edges, message_facts, nodes, table

#: What a line of an order writes into the order's class, by its return flag and status; {i} its number, {c} its supplier
#: modulo 3, {g} its part modulo 5, {h} its part modulo 2.
FORMS = {
    "R": """  async m{i}<T extends {a: number}>(x: T, y = {b: 1}): Promise<{a: number}> {
    this.count{c} += 1; // if (x) {{ this.no(1)
    return this.api?.get{g}(x);
  }
""",
    "A": """  m{i} = x => { const r = /[{(]/; if (this.rows{h}.length) { return; } helper{g}(r, "}}", `${x}(`); };
""",
    "NO": """  m{i} = async (x) => g{c}(x)
""",
    "NF": """  /* m{i}() { old(); } */
  m{i}(x) { do { this.list{c}.push(x); } while (x > 1); for (const y of this.rows) { new Foo(y); this.m1(y); } window.bus.go(x); client{c}.send(x); }
""",
}
HEAD = 'import { helper0, Base as B } from "./base";\nexport class C extends B {\n'
#: How an order's class begins by its status: with a field of a type of its own, of an imported type, or none.
FIELDS = {"O": "  api: Api;\n", "F": "  api: B;\n", "P": ""}


def _filled(form: str, **columns):
    # What is fixed and what is filled in take turns.
    return F.concat(*[columns[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(" + "|".join(columns) + r")\}", form))])


def _lines(spark, d):
    """The lines of orders with ``i``, their number within the order, as line numbers repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, d, "lineitem").withColumn("i", F.row_number().over(order))


def derived_classes(spark, d):
    """file, text: a class for each order, a member for each of its lines; one in progress is never closed."""
    line = _lines(spark, d)
    flag = F.when(F.col("l_returnflag") == "N", F.concat("l_returnflag", "l_linestatus")).otherwise(F.col("l_returnflag"))
    at = {"i": F.col("i"), "c": F.col("l_suppkey") % 3, "g": F.col("l_partkey") % 5, "h": F.col("l_partkey") % 2}
    text = F.coalesce(*[F.when(flag == f, _filled(form, **at)) for f, form in FORMS.items()])
    members = line.select("l_orderkey", F.struct("i", text.alias("text")).alias("m")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("m"))["text"], "").alias("body"))
    o = table(spark, d, "orders").join(members, F.col("o_orderkey") == F.col("l_orderkey"))
    begin = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.lit(HEAD + f)) for s, f in FIELDS.items()])
    return o.select(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".ts")).alias("file"), F.concat(begin, "body", F.when(F.col("o_orderstatus") == "P", "").otherwise("}\n")).alias("text"))


def _methods(spark, d):
    return X.methods(derived_classes(spark, d))


def code_methods(spark, d):
    """Methods of the orders' classes, whatever their form, with type parameters, return types with
    braces, brackets in regular expressions, strings, comments and templates, and missing ends."""
    return _methods(spark, d).select("file", "method", "form", "params", "line", F.length("body").alias("length"))


def _keyed(spark, d):
    m = _methods(spark, d)
    return m.select(F.concat_ws("#", "file", "method").alias("file"), F.col("body").alias("text"))


def code_operations(spark, d):
    """What the orders' methods do."""
    return X.operations(_keyed(spark, d)).groupBy("file", "type", "target", "method", "detail", "flag").agg(F.sum("times").alias("n"))


def code_complexity(spark, d):
    """Counts, flows and complexity of the orders' methods."""
    return X.summaries(_keyed(spark, d)).select("file", "branches", "loops", "calls", "flows", "complexity")


def semantic_code(spark, d):
    """F9 fed from E22: the methods that call others, at least of medium complexity, with their first calls."""
    m = X.summaries(_keyed(spark, d)).select(F.col("file").alias("id"), "complexity", "operations", F.col("steps").alias("flows"))
    return S.semantic(m, "method_call", flow_to="", least="medium").select("id", "complexity", F.size("matched").alias("matched"), "total")


def _names(spark, d):
    return derived_classes(spark, d).select("file", F.explode(F.array(*[F.struct(F.lit(i).alias("identifier"), F.lit("./base").alias("specifier")) for i in ("helper0", "B")])).alias("n")).select("file", "n.*")


def _fields(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    return o.select(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".ts")).alias("file"), F.lit("api").alias("field"), F.when(F.col("o_orderstatus") == "F", "./base").alias("specifier"))


def code_calls(spark, d):
    """Calls of the orders' methods and which lookup decided; of the clients one is a known signature."""
    known = derived_classes(spark, d).select("file", F.lit("client1").alias("identifier"), F.lit("send").alias("member"))
    return M.calls(_methods(spark, d), _names(spark, d), _fields(spark, d), known)


def code_states(spark, d):
    """States that the orders' methods read and write; members of imported types are none."""
    return M.state_accesses(_methods(spark, d), _fields(spark, d))


def code_handler_states(spark, d):
    """J19, U6 from texts: the states that the handlers of each return flag's message touch."""
    touched = M.touched(M.state_accesses(_methods(spark, d), _fields(spark, d)))
    h = _lines(spark, d).select(F.col("l_returnflag").alias("message"), F.concat(F.lit("src/o"), "l_orderkey", F.lit(".ts")).alias("file"), F.concat(F.lit("m"), "i").alias("method"))
    return L.handler_states(h, touched).select("message", F.array_join("states", ",").alias("states"))


def code_field_flow(spark, d):
    """G12 from texts: reads and writes of counters, by the side that an order's priority puts its file on."""
    s = M.state_accesses(_methods(spark, d), _fields(spark, d))
    o = table(spark, d, "orders").select(F.concat(F.lit("src/o"), "o_orderkey", F.lit(".ts")).alias("file"), F.when(F.col("o_orderpriority") < "2", "frontend").when(F.col("o_orderpriority") < "4", "backend").otherwise("shared").alias("area"))
    facts = s.join(o, "file").select("file", "method", F.col("access").alias("kind"), F.col("state").alias("field"), "area")
    return L.field_flow(facts, "COUNT").groupBy("side", "kind").agg(F.count(F.lit(1)).alias("n"))


#: What an order asks for in its script, by its priority's digit; {c} its customer modulo 9.
ASKED = {
    "1": "fetch(`${API_BASE}/orders/{c}?x=1`, { method: 'post', body: f(1) });\n",
    "2": "Net.inst.tableMsg({ cmd: 'buy{c}', n: 1 }, (r) => { this.app.rpc.shop.cart.add{c}(r); });\n",
    "3": "class K extends Http {\n  constructor() { super('/base{c}'); }\n  load() { return this.get('items//{c}'); }\n}\n",
    "4": "axios.put(\"//host/{c}\", a, b); axios({ url: '/q{c}', method: 'Patch' });\n",
    "5": "this.get('/nothing'); // fetch('/no{c}')\nconst s = \"fetch('/quoted')\"; global.App.rpc.a.b.c{c}();\n",
}


def code_requests(spark, d):
    """What the orders' scripts ask of servers: by fetch, tables, remote calls, clients of their own and axios."""
    o = table(spark, d, "orders").select("o_orderkey", F.left("o_orderpriority", F.lit(1)).alias("p"), (F.col("o_custkey") % 9).alias("c"))
    text = F.coalesce(*[F.when(F.col("p") == k, _filled(t, c=F.col("c"))) for k, t in ASKED.items()], F.lit(""))
    return M.requests(o.select(F.col("o_orderkey").alias("file"), text.alias("text")))


#: What an event writes into its user's script: {v} its value's whole part modulo 7.
SUBSCRIPTIONS = {
    "click": 'eventBus.on("c{v}", this.take);\n',
    "view": 'oops.message\n  .once("v{v}", (m) => { eventBus.on("inner{v}", other); });\n',
    "purchase": '// eventBus.once("gone{v}", lost);\n',
    "signup": "this.game.director.on('s{v}', function () { });\n",
    "error": 'const s = "eventBus.on(\'quoted{v}\', no)"; bus.on("x{v}", y);\n',
}


def event_subscriptions(spark, d):
    """Subscriptions in scripts that the users' events write, by tokens and by pattern: what both find counts
    once, what one finds stays."""
    e = table(spark, d, "events")
    text = F.coalesce(*[F.when(F.col("event_type") == k, _filled(t, v=F.floor("value").cast("long") % 7)) for k, t in SUBSCRIPTIONS.items()], F.lit(""))
    scripts = e.groupBy(F.col("user_id").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("text")))), lambda x: x["text"]), "").alias("text"))
    return M.subscriptions(scripts.withColumn("file", F.col("file").cast("long")))


def message_routes(spark, d):
    """Routes of the suppliers' servers: their layer, service and methods, and what they register for messages."""
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey"))
    file = F.concat(F.lit("x/app/servers/n"), "s_nationkey", F.when(F.col("k") % 3 == 0, "/handler/").when(F.col("k") % 3 == 1, "/remote/").otherwise("/other/"), "k", F.lit(".ts"))
    text = F.concat(F.lit("class A {\n  init() { "), F.when(F.col("k") % 2 == 0, F.concat(F.lit("this.regHandler('t"), "s_nationkey", F.lit("', this.go); this.regHandler( \"u\" , this.gone );"))).otherwise(""), F.lit(" }\n  go() { }\n"), F.when(F.col("k") % 4 == 0, "  handleMsg(m) { }\n").otherwise(""), F.lit("}\n"))
    t = s.select(file.alias("file"), text.alias("text"))
    return P.message_routes(t, X.methods(t))


def _learned(spark, d):
    f = message_facts(spark, d)
    patterns = LN.message_patterns(f).select("message", F.lit("ws").alias("protocol"), "confidence", F.concat(F.lit("src/"), "message", F.lit(".ts")).alias("file"))
    by_id = F.col("role") == "handler"
    actors = f.select("message", "role", F.when(by_id, F.concat(F.lit("customer:"), "actor")).otherwise("").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("actor").cast("string"), 9, "0")).alias("name"), F.lit("").alias("callee")).distinct()
    return patterns, actors


def protocol_graph(spark, d):
    """The graph with the learned messages, published as a second version: edges of messages by type and role,
    messages, and what the first version still has."""
    root = shared_dir(spark, "graph")
    LC.publish({"nodes": nodes(spark, d), "edges": edges(spark, d).withColumn("meta_key", F.col("operation"))}, root, 1)
    P.write_back(spark, root, 2, *_learned(spark, d))
    n, e = LC.current(spark, root, "nodes"), LC.current(spark, root, "edges")
    count = lambda df, what, of: df.groupBy(F.lit(what).alias("what"), of.alias("of")).agg(F.count(F.lit(1)).alias("n"))
    linked = e.where("src LIKE 'message:%' OR dst LIKE 'message:%'")
    first = spark.read.parquet(f"{root}/version=1/nodes")
    return count(n, "nodes", F.col("type")).union(count(linked, "edges", F.concat_ws(" ", "type", F.split("meta_key", r"\|")[1], F.split("meta_key", r"\|")[2]))).union(count(n.where("type = 'message'"), "areas", F.concat_ws(" ", "id", "area"))).union(count(first, "before", F.col("type")))


def gated_timings(spark, d):
    """What users do once an event has come that they subscribe to in place, and the messages they handle."""
    f = message_facts(spark, d)
    methods = F.concat(F.lit("U.u"), "actor")
    context = P.message_context(f.select("message", "role", methods.alias("method")))
    inline = f.where("role = 'dispatcher'").groupBy(methods.alias("method"), F.col("message").alias("event")).agg(F.array_sort(F.collect_set(F.when(F.col("value") >= 50, F.concat(F.lit("this.s"), F.floor(F.col("value") / 10).cast("long"))))).alias("calls"), F.array_sort(F.collect_set(F.when(F.col("value") < 10, F.col("state")))).alias("writes"))
    found = P.event_gated(inline.withColumn("bus", F.lit("eventBus")).withColumn("file", F.lit("u.ts")), context)
    return found.select("method", "event", F.array_join("next", ",").alias("next"), F.array_join("writes", ",").alias("writes"), F.array_join("handled", ",").alias("handled"), "confidence")


def _needs(spark, d):
    """Which file needs which: a part's file the next part's of its brand, in steps, and all the file of their maker."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.substring("p_brand", 1, 7).alias("maker"), "p_brand")
    file = lambda c: F.concat(F.lit("p"), c, F.lit(".ts"))
    after = p.select(F.col("k").alias("target_k"), F.col("p_brand").alias("b"))
    chain = p.join(after, (F.col("target_k") == F.col("k") + 1) & (F.col("b") == F.col("p_brand"))).select(file(F.col("k")).alias("file"), file(F.col("target_k")).alias("target"))
    return R.dependencies(chain, p.select(file(F.col("k")).alias("file"), F.when(F.col("k") % 5 == 0, F.col("maker")).alias("target")))


def affected_files(spark, d):
    """The files that a change of one maker's file, and of the parts of size 50, reaches, and how far."""
    changed = table(spark, d, "part").where("p_size = 50").select(F.concat(F.lit("p"), "p_partkey", F.lit(".ts")).alias("file"))
    changed = changed.union(table(spark, d, "part").where("p_brand LIKE 'Brand#1%'").select(F.substring("p_brand", 1, 7)).distinct())
    return R.affected(_needs(spark, d), changed)


def rebuilt_facts(spark, d):
    """Facts of the suppliers' files after a rebuild of those of three nations, of which one nation's are gone."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".ts")).alias("file"), F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))
    extract = lambda df: df.select("file", F.regexp_extract("text", r"call(\d+)", 1).cast("long").alias("called"))
    text = lambda c: F.concat(F.lit("call"), c).alias("text")
    root = shared_dir(spark, "facts")
    R.build(extract(s.select("file", text(F.col("k")))), root)
    after = s.where("n <> 7").select("file", text(F.when(F.col("n") < 5, F.col("k") + 1000).otherwise(F.col("k"))))
    R.rebuild(spark, root, s.where("n IN (3, 4, 7)").select("file"), after, extract)
    return R.read(spark, root)


def kb_states(spark, d):
    """V3: the states of the customers' tables: never built, without configuration or snapshot, of an old version, changed
    or fresh."""
    k = F.col("c_custkey")
    tables = table(spark, d, "customer").select(k.alias("key"), (k % 11 != 0).alias("built"), (k % 7 != 0).alias("configured"), F.when(k % 5 == 0, F.lit(None).cast("int")).when(k % 13 == 0, 1).otherwise(2).alias("snapshot"), F.when(k % 17 == 0, "0.9").otherwise("1.0").alias("tool"))
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 40 == 1, "added").when(F.col("o_orderkey") % 40 == 2, "deleted").when(F.col("o_orderkey") % 40 == 3, "changed").otherwise("same").alias("change"))
    return V.states(tables, changes, "1.0").select("key", "status", "stale", F.array_join("reasons", ",").alias("reasons"), "action")


def reach_closure(spark, d):
    """G1 without bound: everything downstream of two regions and the least number of steps to it."""
    starts = spark.createDataFrame([("region:1",), ("region:3",)], "id string")
    flow = edges(spark, d).where("type IN ('contains', 'binds')").select(F.when(F.col("type") == "contains", F.col("src")).otherwise(F.col("dst")).alias("from_id"), F.when(F.col("type") == "contains", F.col("dst")).otherwise(F.col("src")).alias("to_id"))
    return G.walk(flow, starts, None)


_L = """l AS (SELECT 'src/o'||l_orderkey||'.ts' AS file, l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS i, l_suppkey % 3 AS c, l_partkey % 5 AS g, l_partkey % 2 AS h, CASE l_returnflag WHEN 'N' THEN 'N'||l_linestatus ELSE l_returnflag END AS f, l_returnflag, o_orderstatus AS s, o_orderpriority AS pr FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_B = """b AS (SELECT *, file||'#m'||i AS id, CASE f WHEN 'R' THEN '\n    this.count'||c||' += 1; // if (x) {{ this.no(1)\n    return this.api?.get'||g||'(x);\n  '
 WHEN 'A' THEN ' const r = /[{(]/; if (this.rows'||h||'.length) { return; } helper'||g||'(r, "}}", `${x}(`); ' WHEN 'NO' THEN 'g'||c||'(x)'
 ELSE ' do { this.list'||c||'.push(x); } while (x > 1); for (const y of this.rows) { new Foo(y); this.m1(y); } window.bus.go(x); client'||c||'.send(x); ' END AS body FROM l)"""
_OPS = """ops AS (SELECT id AS file, 'return' AS type, '' AS target, '' AS method, 'this.api?.get'||g||'(x)' AS detail, false AS flag, 1 AS n FROM b WHERE f = 'R' UNION ALL SELECT id, 'method_call', 'this.api', 'get'||g, 'x', false, 1 FROM b WHERE f = 'R'
 UNION ALL SELECT id, 'assignment', 'r', '', '/[{(]/', false, 1 FROM b WHERE f = 'A' UNION ALL SELECT id, 'condition', '', '', 'this.rows'||h||'.length', true, 1 FROM b WHERE f = 'A' UNION ALL SELECT id, 'return', '', '', '', false, 1 FROM b WHERE f = 'A'
 UNION ALL SELECT id, 'method_call', 'global', 'helper'||g, 'r, "}}", `${x}(`', false, 2 FROM b WHERE f = 'A' UNION ALL SELECT id, 'method_call', 'global', 'g'||c, 'x', false, 2 FROM b WHERE f = 'NO'
 UNION ALL SELECT id, 'method_call', 'this.list'||c, 'push', 'x', false, 2 FROM b WHERE f = 'NF' UNION ALL SELECT id, 'loop', 'this.rows', 'for_of', '', false, 1 FROM b WHERE f = 'NF' UNION ALL SELECT id, 'method_call', 'this', 'm1', 'y', false, 2 FROM b WHERE f = 'NF'
 UNION ALL SELECT id, 'method_call', 'window.bus', 'go', 'x', false, 2 FROM b WHERE f = 'NF' UNION ALL SELECT id, 'method_call', 'client'||c, 'send', 'x', false, 2 FROM b WHERE f = 'NF')"""
_SUMS = """g AS (SELECT file, CAST(sum(CASE type WHEN 'condition' THEN n ELSE 0 END) AS BIGINT) AS branches, CAST(sum(CASE type WHEN 'loop' THEN n ELSE 0 END) AS BIGINT) AS loops, CAST(sum(CASE type WHEN 'method_call' THEN n ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE type WHEN 'assignment' THEN n ELSE 0 END) AS BIGINT) AS flows, count(*) FILTER (WHERE type = 'method_call') AS matched FROM ops GROUP BY 1),
q AS (SELECT *, CASE WHEN branches + 2 * loops + 0.5 * calls <= 2 THEN 'low' WHEN branches + 2 * loops + 0.5 * calls <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM g)"""
_STATES = """st AS (SELECT DISTINCT file, 'm'||i AS method, state, access, l_returnflag, pr FROM (SELECT *, 'count'||c AS state, unnest(['read', 'write']) AS access FROM l WHERE f = 'R' UNION ALL SELECT *, 'api', 'read' FROM l WHERE f = 'R' AND s <> 'F' UNION ALL SELECT *, 'rows'||h||'.length', 'read' FROM l WHERE f = 'A'
 UNION ALL SELECT *, 'list'||c, unnest(['read', 'write']) FROM l WHERE f = 'NF' UNION ALL SELECT *, 'rows', 'read' FROM l WHERE f = 'NF'))"""

QUERIES = {
    "code_methods": (code_methods, f"""WITH {_L}, {_B}, z AS (SELECT *, CASE f WHEN 'R' THEN 4 WHEN 'NF' THEN 2 ELSE 1 END AS lines FROM b)
SELECT file, 'm'||i AS method, CASE WHEN f IN ('R', 'NF') THEN 'declared' ELSE 'arrow' END AS form, CASE f WHEN 'R' THEN 'x: T, y = {{b: 1}}' ELSE 'x' END AS params,
 CAST(2 + CASE s WHEN 'P' THEN 0 ELSE 1 END + sum(lines) OVER (PARTITION BY k ORDER BY i) - CASE f WHEN 'R' THEN 3 ELSE 0 END AS INTEGER) AS line, CAST(length(body) AS INTEGER) AS length FROM z"""),
    "code_operations": (code_operations, f"WITH {_L}, {_B}, {_OPS} SELECT file, type, target, method, detail, flag, CAST(sum(n) AS BIGINT) AS n FROM ops GROUP BY ALL"),
    "code_complexity": (code_complexity, f"WITH {_L}, {_B}, {_OPS}, {_SUMS} SELECT file, branches, loops, calls, flows, complexity FROM q"),
    "semantic_code": (semantic_code, f"WITH {_L}, {_B}, {_OPS}, {_SUMS} SELECT file AS id, complexity, CAST(least(matched, 5) AS INTEGER) AS matched, count(*) OVER () AS total FROM q WHERE complexity <> 'low' AND matched > 0"),
    "code_calls": (code_calls, f"""WITH {_L}, c AS (SELECT file, 'm'||i AS caller, 'get'||g AS callee, 'this.api' AS owner, CASE WHEN s = 'P' THEN 'ignored' ELSE 'field' END AS kind, CASE WHEN s = 'P' THEN 'built-in' ELSE 'field' END AS decided, '' AS reason, CASE WHEN s = 'F' THEN './base' END AS specifier FROM l WHERE f = 'R'
 UNION ALL SELECT file, 'm'||i, 'helper'||g, '', CASE WHEN g = 0 THEN 'imported' ELSE 'ignored' END, CASE WHEN g = 0 THEN 'imported' ELSE 'built-in' END, '', CASE WHEN g = 0 THEN './base' END FROM l WHERE f = 'A'
 UNION ALL SELECT file, 'm'||i, 'g'||c, '', 'ignored', 'built-in', '', NULL FROM l WHERE f = 'NO' UNION ALL SELECT file, 'm'||i, 'push', 'this.list'||c, 'ignored', 'built-in', '', NULL FROM l WHERE f = 'NF'
 UNION ALL SELECT file, 'm'||i, 'm1', 'this', 'local', 'local', '', NULL FROM l WHERE f = 'NF'
 UNION ALL SELECT file, 'm'||i, 'go', 'window.bus', 'unresolved', 'none', 'dynamic_global_service', NULL FROM l WHERE f = 'NF'
 UNION ALL SELECT file, 'm'||i, 'send', 'client'||c, CASE WHEN c = 1 THEN 'suppressed' ELSE 'unresolved' END, CASE WHEN c = 1 THEN 'signature' ELSE 'none' END, CASE WHEN c = 1 THEN '' ELSE 'owner_not_resolved_or_external_client' END, NULL FROM l WHERE f = 'NF')
SELECT *, 1 AS n FROM c"""),
    "code_states": (code_states, f"WITH {_L}, {_STATES} SELECT file, method, state, access FROM st"),
    "code_handler_states": (code_handler_states, f"WITH {_L}, {_STATES} SELECT l_returnflag AS message, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM st GROUP BY 1"),
    "code_field_flow": (code_field_flow, f"""WITH {_L}, {_STATES} SELECT CASE WHEN pr < '2' THEN 'frontend' WHEN pr < '4' THEN 'backend' ELSE 'other' END AS side, access AS kind, count(*) AS n FROM st WHERE contains(state, 'count') GROUP BY 1, 2"""),
    "code_requests": (code_requests, """WITH o AS (SELECT o_orderkey AS file, left(o_orderpriority, 1) AS p, o_custkey % 9 AS c FROM orders)
SELECT file, 'fetch' AS callee, '/api/orders/'||c AS target, 'http' AS protocol, 'POST' AS http_method, 'fetch' AS transport, 1 AS line FROM o WHERE p = '1' UNION ALL SELECT file, 'Net.inst.tableMsg', 'cmd:buy'||c, '', '', 'net', 1 FROM o WHERE p = '2'
UNION ALL SELECT file, 'pinus.rpc', 'shop.cart.add'||c, 'pinus-rpc', '', 'pinus-rpc', 1 FROM o WHERE p = '2' UNION ALL SELECT file, 'this.get', '/base'||c||'/items/'||c, 'http', 'GET', 'http-client', 3 FROM o WHERE p = '3'
UNION ALL SELECT file, 'axios.put', '/host/'||c, 'http', 'PUT', 'axios', 1 FROM o WHERE p = '4' UNION ALL SELECT file, 'axios', '/q'||c, 'http', 'PATCH', 'axios', 1 FROM o WHERE p = '4' UNION ALL SELECT file, 'pinus.rpc', 'a.b.c'||c, 'pinus-rpc', '', 'pinus-rpc', 2 FROM o WHERE p = '5'"""),
    "event_subscriptions": (event_subscriptions, """WITH e AS (SELECT user_id AS file, event_type AS t, CAST(floor(value) AS BIGINT) % 7 AS v FROM events),
u AS (SELECT file, 'eventBus' AS bus, 'on' AS mode, 'c'||v AS event, 'take' AS handler, 'tokens' AS via FROM e WHERE t = 'click' UNION ALL SELECT file, 'oops.message', 'once', 'v'||v, '', 'tokens' FROM e WHERE t = 'view' UNION ALL SELECT file, 'eventBus', 'on', 'inner'||v, 'other', 'tokens' FROM e WHERE t = 'view'
 UNION ALL SELECT file, 'eventBus', 'once', 'gone'||v, 'lost', 'pattern' FROM e WHERE t = 'purchase' UNION ALL SELECT file, 'director', 'on', 's'||v, '', 'tokens' FROM e WHERE t = 'signup' UNION ALL SELECT file, 'eventBus', 'on', 'quoted'||v, 'no', 'pattern' FROM e WHERE t = 'error')
SELECT file, bus, mode, event, handler, max(via) AS via, count(*) AS n FROM u GROUP BY 1, 2, 3, 4, 5"""),
    "message_routes": (message_routes, """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'x/app/servers/n'||s_nationkey||CASE s_suppkey % 3 WHEN 0 THEN '/handler/' WHEN 1 THEN '/remote/' ELSE '/other/' END||s_suppkey||'.ts' AS file FROM supplier),
m AS (SELECT *, unnest(CASE WHEN k % 4 = 0 THEN ['init', 'go', 'handleMsg'] ELSE ['init', 'go'] END) AS method FROM s), r AS (SELECT *, 'n'||n||'.'||k||'.'||method AS base, CASE k % 3 WHEN 0 THEN 'handler' ELSE 'remote' END AS layer FROM m WHERE k % 3 < 2)
SELECT file, method, 'pinus-'||layer AS kind, CASE layer WHEN 'handler' THEN 'pinus' ELSE 'pinus-rpc' END AS protocol, unnest([base, 'app.rpc.'||base, layer||'.'||base]) AS route, method AS handler, 'handler' AS role FROM r
UNION ALL SELECT file, 'go', 'table-msg', 'table-msg', 't'||n, 'go', 'handler' FROM s WHERE k % 2 = 0 UNION ALL SELECT file, 'handleMsg', 'table-msg', 'table-msg', 't'||n, 'go', 'dispatcher' FROM s WHERE k % 4 = 0 UNION ALL SELECT file, 'handleMsg', 'table-msg', 'table-msg', 'u', 'gone', 'dispatcher' FROM s WHERE k % 4 = 0"""),
    "protocol_graph": (protocol_graph, f"""WITH {NODES_SQL}, f AS (SELECT DISTINCT event_type AS m, CASE WHEN event_type IN ('view', 'click') THEN 'handler' WHEN event_type IN ('purchase', 'signup') THEN 'sender' ELSE 'dispatcher' END AS role, user_id AS u FROM events),
a AS (SELECT m, role, id FROM f JOIN n ON n.type = 'method' AND CASE role WHEN 'handler' THEN n.id = 'customer:'||u ELSE n.name = 'Customer#'||lpad(u::VARCHAR, 9, '0') END), t AS (SELECT type AS of, count(*) AS n FROM n GROUP BY 1)
SELECT 'nodes' AS what, of, n FROM t UNION ALL SELECT 'before', of, n FROM t UNION ALL SELECT 'nodes', 'message', count(DISTINCT m) FROM f UNION ALL SELECT 'edges', CASE role WHEN 'sender' THEN 'emits' ELSE 'binds' END||' '||m||' '||role, count(*) FROM a GROUP BY m, role
UNION ALL SELECT 'areas', 'message:ws:'||m||' '||CASE WHEN m IN (SELECT m FROM a) THEN 'frontend' ELSE 'unknown' END, 1 FROM (SELECT DISTINCT m FROM f)"""),
    "gated_timings": (gated_timings, """WITH f AS (SELECT 'U.u'||user_id AS method, event_type AS m, CASE WHEN event_type IN ('view', 'click') THEN 'handler' WHEN event_type IN ('purchase', 'signup') THEN 'sender' ELSE 'dispatcher' END AS role, value, json_extract_string(props, '$.k') AS state FROM events),
c AS (SELECT method, string_agg(DISTINCT m, ',' ORDER BY m) AS handled FROM f WHERE role <> 'sender' GROUP BY 1),
i AS (SELECT method, m AS event, coalesce(string_agg(DISTINCT CASE WHEN value >= 50 THEN 'U.s'||CAST(floor(value / 10) AS BIGINT) END, ','), '') AS next, coalesce(string_agg(DISTINCT CASE WHEN value < 10 THEN state END, ',' ORDER BY CASE WHEN value < 10 THEN state END), '') AS writes FROM f WHERE role = 'dispatcher' GROUP BY 1, 2)
SELECT i.method, event, array_to_string(list_sort(string_split(next, ',')), ',') AS next, writes, handled, round(least(0.9, 0.45 + CASE WHEN next <> '' THEN 0.2 ELSE 0 END + CASE WHEN writes <> '' THEN 0.15 ELSE 0 END + CASE WHEN handled <> '' THEN 0.1 ELSE 0 END), 2)::DOUBLE AS confidence FROM i JOIN c USING (method)"""),
    "affected_files": (affected_files, """WITH RECURSIVE d AS (SELECT 'p'||a.p_partkey||'.ts' AS file, 'p'||b.p_partkey||'.ts' AS needs FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND b.p_brand = a.p_brand UNION SELECT 'p'||p_partkey||'.ts', left(p_brand, 7) FROM part WHERE p_partkey % 5 = 0),
c AS (SELECT 'p'||p_partkey||'.ts' AS file FROM part WHERE p_size = 50 UNION SELECT left(p_brand, 7) FROM part WHERE p_brand LIKE 'Brand#1%'),
r(file, depth) AS (SELECT file, 0 FROM c UNION SELECT d.file, r.depth + 1 FROM r JOIN d ON d.needs = r.file) SELECT file, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1"""),
    "rebuilt_facts": (rebuilt_facts, "SELECT 's'||s_suppkey||'.ts' AS file, CASE WHEN s_nationkey IN (3, 4) THEN s_suppkey + 1000 ELSE s_suppkey END AS called FROM supplier WHERE s_nationkey <> 7"),
    "kb_states": (kb_states, """WITH g AS (SELECT o_custkey AS k, count(*) FILTER (WHERE o_orderkey % 40 = 1) AS a, count(*) FILTER (WHERE o_orderkey % 40 = 2) AS d, count(*) FILTER (WHERE o_orderkey % 40 = 3) AS c FROM orders GROUP BY 1),
t AS (SELECT c_custkey AS key, c_custkey % 11 <> 0 AS b, c_custkey % 7 <> 0 AS f, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 1 ELSE 2 END AS s, c_custkey % 17 = 0 AND c_custkey % 11 <> 0 AS other, coalesce(a, 0) AS a, coalesce(d, 0) AS d, coalesce(c, 0) AS c FROM customer LEFT JOIN g ON k = c_custkey),
x AS (SELECT *, b AND f AND s IS NOT DISTINCT FROM 2 AS known FROM t),
y AS (SELECT *, CASE WHEN other THEN 'stale' WHEN NOT b THEN 'missing' WHEN NOT known THEN 'unknown' WHEN a + d + c > 0 THEN 'stale' ELSE 'fresh' END AS status FROM x)
SELECT key, status, status <> 'fresh' AS stale, array_to_string(list_filter([CASE WHEN NOT b THEN 'missing-kb' END, CASE WHEN b AND NOT f THEN 'missing-kb-config' END, CASE WHEN b AND f AND s IS NULL THEN 'missing-source-snapshot' END, CASE WHEN b AND f AND s = 1 THEN 'source-snapshot-version-unsupported' END,
 CASE WHEN known AND a > 0 THEN 'source-files-added' END, CASE WHEN known AND d > 0 THEN 'source-files-deleted' END, CASE WHEN known AND c > 0 THEN 'source-files-changed' END, CASE WHEN other THEN 'tool-version-changed' END], lambda r: r IS NOT NULL), ',') AS reasons, CASE WHEN status = 'fresh' THEN '' ELSE 'rebuild' END AS action FROM y"""),
    "reach_closure": (reach_closure, """SELECT 'region:'||r_regionkey AS id, 0 AS depth FROM region WHERE r_regionkey IN (1, 3) UNION ALL SELECT 'nation:'||n_nationkey, 1 FROM nation WHERE n_regionkey IN (1, 3)
UNION ALL SELECT 'supplier:'||s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (1, 3)"""),
}
