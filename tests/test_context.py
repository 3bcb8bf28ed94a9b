"""Selectors, context, linking, execution and discovery on small hand-made tables."""

from datetime import datetime

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, discovery, execution, freshness, graph, linking, selectors

NODE = "id string, type string, name string, file string, area string, tags array<string>, meta map<string,string>"


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="session")
def nodes(spark):
    return spark.createDataFrame([
        ("method:a", "method", "Shop.open", "src/app/http/shop.ts", "unknown", ["shop"], {"methodName": "open"}),
        ("method:b", "method", "Mall.open", "src/web/mall.ts", "frontend", [], {"methodName": "open"}),
        ("endpoint:e", "endpoint", "GET /api/shop/items/list", "src/app/http/routes/shop.ts", "backend", [], {"path": "/api/shop/items/list", "httpMethod": "GET"}),
        ("request:r", "request", "GET /shop/items", "src/web/mall.ts", "frontend", [], {"httpMethod": "GET", "target": "/shop/items", "empty": ""}),
        ("message:m", "message", "shop.buy", "app/servers/shop/handler/buy.ts", "backend", ["buy"], {}),
        ("table:t", "table", "Items", "prisma/schema.prisma", "data", None, {"kind": "model"}),
        ("unresolved-call:u", "unresolved-call", "x.y", "", "unknown", [], None),
        ("script:g", "script", "Room.ts", "assets/game/common/RoomCard/Room.ts", "frontend", [], {}),
    ], NODE)


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([("method:b", "request:r", "requests", ""), ("request:r", "endpoint:e", "matches_endpoint", ""), ("endpoint:e", "method:a", "binds", ""), ("method:a", "table:t", "reads", "find"), ("method:a", "unresolved-call:u", "unresolved_calls", ""), ("message:m", "method:a", "binds", "")], "src string, dst string, type string, operation string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def value(spark, c, *rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(c).collect()]


def test_selectors(nodes, edges):
    assert ids(selectors.start(nodes, "method:a")) == ["method:a"]
    found = selectors.start(nodes, "open").collect()
    assert {r.id for r in found} == {"method:a", "method:b"} and all(r.ambiguous and r.tier == 3 for r in found)
    assert ids(selectors.start(nodes, "open", area="front")) == ["method:b"]
    assert ids(selectors.start(nodes, "shop.buy", "message")) == ["message:m"] and selectors.start(nodes, "shop", "message").isEmpty()
    assert ids(selectors.start(nodes, "items", "endpoint")) == ["endpoint:e"] and selectors.start(nodes, "nowhere").isEmpty()
    assert ids(selectors.facets(nodes, area="backend")) == ["endpoint:e", "message:m", "method:a"]
    assert ids(selectors.facets(nodes, protocol="HTTP")) == ["endpoint:e", "request:r"] and ids(selectors.facets(nodes, path="shop/items")) == ["endpoint:e", "request:r"]
    assert ids(selectors.search(nodes, edges, name="BUY")) == ["message:m"] and ids(selectors.search(nodes, edges, handler="method:a")) == ["endpoint:e", "message:m"]
    assert ids(selectors.search(nodes, kind="method", module="web")) == ["method:b"] and ids(selectors.search(nodes, tag="sho")) == ["method:a"] and selectors.search(nodes, limit=2).count() == 2
    assert {(r.type, r.place, r.id) for r in selectors.suggestions(nodes, "shop").collect()} == {("method", 1, "method:a"), ("endpoint", 1, "endpoint:e"), ("request", 1, "request:r"), ("message", 1, "message:m")}
    groups = {r.id: (r.group, r.priority) for r in selectors.business_group(nodes, (("web", True), ("http", True))).collect()}
    assert groups["request:r"] == ("web-http", 1) and groups["method:b"] == ("web", 1) and groups["endpoint:e"] == ("http-http", 2) and groups["table:t"] == ("table", 19)
    assert selectors.spec(upstream=True, method="x") == {"kind": "method", "query": "x", "direction": "upstream"}
    with pytest.raises(ValueError):
        selectors.spec(method="x", event="y")
    assert ids(selectors.resolved_only(edges, nodes), "dst") == ["endpoint:e", "method:a", "method:a", "request:r", "table:t"]
    assert ids(selectors.http_mainline(edges, nodes, "src/app/http/shop.ts"), "dst") == ["endpoint:e", "request:r"]


def test_semantic_and_protocol_search(spark):
    m = spark.createDataFrame([("a", [("loop", "for"), ("call", "x")], [("in", "out")], "high"), ("b", [("call", "y")], [], "low"), ("c", [("call", "z")], [("in", "db")], "medium")], "id string, operations array<struct<type:string,detail:string>>, flows array<struct<`from`:string,`to`:string>>, complexity string")
    assert [(r.id, r.total) for r in selectors.semantic(m, "call").collect()] == [("a", 3), ("c", 3), ("b", 3)]
    assert ids(selectors.semantic(m, least="medium", flow_to="db")) == ["c"]
    p = spark.createDataFrame([("x", ["Alpha"], {"k": "beta"}, 1), ("y", None, None, 2)], "id string, names array<string>, more map<string,string>, n int")
    assert ids(selectors.protocol_search(p, "ALPHA")) == ids(selectors.protocol_search(p, "bet")) == ["x"] and ids(selectors.protocol_search(p, "2")) == ["y"]


def test_context(spark, nodes, edges):
    assert {"buy", "auth", "login", "/api/auth"} <= set(context.terms("Buy at LOGIN a")) and "a" not in context.terms("a")
    assert context.terms("the chat", context.RECALL_CONCEPTS, ("the",)) == ["/api/chat", "anthropic", "chat", "claude", "stream"]
    kept = {r.id: r.meta for r in context.compact(nodes).collect()}
    assert kept["request:r"] == {"target": "/shop/items"} and kept["unresolved-call:u"] is None
    assert {(r.src_name, r.dst_name) for r in context.named_edges(edges, nodes).collect()} >= {("Shop.open", "Items")}
    assert {r.id: (r.method, r.endpoint) for r in context.node_evidence(nodes, "x").collect()}["endpoint:e"] == ("", "GET /api/shop/items/list")
    assert {(r.src, r.method, r.endpoint) for r in context.edge_evidence(edges, nodes, "x").collect()} >= {("method:b", "Mall.open", "GET /shop/items"), ("method:a", "Shop.open", "")}
    features = spark.createDataFrame([("shop", "Shop", "sells", ["web"], ["src/web", "src"], [("x", "prisma/schema.prisma")]), ("mall", "Mall", "", [], ["src/app/http"], [])], "key string, name string, summary string, areas array<string>, roots array<string>, evidence array<struct<name:string,file:string>>")
    assert {r.key: r.score for r in context.score_features(features, ["shop", "sells", "src/app"], ["SRC/web/mall.ts", "schema.prisma"]).collect()} == {"shop": 20 + 6 + 10 + 12, "mall": 8}
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "file string")
    got = {r.key: (r.direct, r.score, r.confidence) for r in context.changed_features(features, files("src/web/mall.ts", "a/prisma/schema.prisma"), files("src/app/http/shop.ts", "src/app/http/routes/shop.ts", "src/app/http/x.ts")).collect()}
    assert got == {"shop": (True, 122, "high"), "mall": (False, 20, "medium")}
    related, found = context.impact(nodes, edges, files("web/mall.ts"), 3)
    assert {r.id: r.matched for r in related.collect()} == {"method:b": True, "request:r": True, "endpoint:e": False, "method:a": False, "table:t": False, "unresolved-call:u": False, "message:m": False}
    assert context.risk(related, found).first().level == "medium"
    assert {(r.type, r.place, r.id, r.start) for r in context.task_context(nodes, edges, ["mall"], 1, 2).collect()} == {("request", 1, "request:r", True), ("method", 1, "method:b", False), ("method", 2, "method:a", False), ("endpoint", 1, "endpoint:e", False)}
    card = {(r.section, r.id): r.n for r in context.feature_card(nodes, edges).collect()}
    assert card["types", "method"] == 2 and card["core-methods", "method:a"] == 4 and card["tables", "table:t"] == 1
    assert {(r.id, r.role, r.first) for r in context.detail(edges, nodes.select("id")).collect()} >= {("table:t", "readers", "method:a"), ("endpoint:e", "handlers", "method:a"), ("message:m", "handlers", "method:a"), ("endpoint:e", "requests", "request:r")}
    summary = {r.id: r for r in context.node_summary(nodes, edges).collect()}
    assert (summary["endpoint:e"].binds, summary["endpoint:e"].incoming, summary["request:r"].label) == ("method:a", 1, "GET /shop/items")
    records = spark.createDataFrame([(1, "buy shop", "", ["src/web/mall.ts"], datetime(2024, 1, 1)), (2, "shop", "", None, datetime(2024, 3, 1)), (3, "x", "at /api/shop", [], None), (4, "", "", [], None)], "id int, task string, text string, files array<string>, recorded timestamp")
    got = [(r.id, r.score) for r in context.recall(records, ["shop", "/api"], ["web/mall.ts", "src/web/other.ts"], F.lit(datetime(2024, 3, 2))).collect()]
    assert got == [(1, 8 + 12), (2, 8 + 1), (3, 3 + 6)]


def test_linking(spark, nodes):
    imports = spark.createDataFrame([("f", "a, { b as c, type D }", "./x"), ("f", "* as n", "./y"), ("f", "", "./z"), ("f", "type { E }", "./db/schema")], "file string, clause string, specifier string")
    names = linking.import_names(imports)
    assert {(r.identifier, r.imported, r.kind) for r in names.collect()} == {("a", "default", "default"), ("c", "b", "named"), ("D", "D", "named"), ("n", "*", "namespace"), ("E", "E", "named")}
    endpoints = spark.createDataFrame([("r/a.ts", "GET", "/list"), ("r/a.ts", "GET", "/api/a/one"), ("r/b.ts", "GET", "/list")], "file string, method string, path string")
    mounts = spark.createDataFrame([("r/a.ts", "/api/a"), ("r/a.ts", "/v2")], "file string, base string")
    assert sorted((r.file, r.path) for r in linking.mounted(endpoints, mounts).collect()) == [("r/a.ts", "/api/a/list"), ("r/a.ts", "/api/a/one"), ("r/a.ts", "/v2/api/a/one"), ("r/a.ts", "/v2/list"), ("r/b.ts", "/list")]
    calls = spark.createDataFrame([("c", "f1", "Api", "user.deep", "get", "ns.ts", "function"), ("c", "f2", "x", "", "get", "u.ts", "function"), ("c", "f3", "y", "", "get", "my-api.ts", ""), ("c", "f4", "U", "", "get", "u.ts", "static-method"), ("c", "f5", "q", "", "get", "u.ts", "static-method"), ("c", "f6", "Api", "gone", "get", "u.ts", "function"), ("c", "f7", "x", "", "no", "u.ts", "function")], "caller_file string, caller string, identifier string, member string, method string, source string, kind string")
    methods = spark.createDataFrame([("u.ts", "get", "Other"), ("my-api.ts", "get", "")], "file string, name string, owner string")
    ns = spark.createDataFrame([("ns.ts", "Api", "user", "old.ts", 1), ("ns.ts", "Api", "user", "u.ts", 2)], "file string, identifier string, member string, source string, seq int")
    assert {(r.caller, r.file, r.via) for r in linking.imported_calls(calls, methods, ns).collect()} == {("f1", "u.ts", "namespace"), ("f2", "u.ts", "function"), ("f3", "my-api.ts", "api"), ("f4", "u.ts", "static")}
    routes = spark.createDataFrame([("1", "app.rpc.shop.BuyRemote.go"), ("2", "Shop.buyremote.GO"), ("3", "other")], "id string, route string")
    served = spark.createDataFrame([("x/app/servers/shop/remote/BuyRemote.ts", "go")], "file string, name string")
    assert ids(linking.route_methods(routes, served)) == ["1", "2"]
    access = spark.createDataFrame([("f", "E", "select"), ("f", "c", "select")], "file string, identifier string, operation string")
    assert [(r.table, r.operation) for r in linking.schema_tables(access, names).collect()] == [("E", "select")]
    actors = spark.createDataFrame([("m", "sender", "", "open"), ("m", "handler", "method:a", "?"), ("m", "dispatcher", "gone", "open"), ("m", "sender", None, "none")], "message string, role string, id string, name string")
    m = spark.createDataFrame([("method:a", "open"), ("method:b", "open")], "id string, name string")
    assert {(r.role, r.src, r.dst, r.type) for r in linking.message_methods(actors, m).collect()} == {("sender", "method:b", "message:m", "emits"), ("handler", "message:m", "method:a", "binds")}
    open_calls = spark.createDataFrame([("f", "a.b", "go"), ("f", "z", "go")], "file string, owner string, member string")
    known = spark.createDataFrame([("f", "a", "go")], "file string, identifier string, member string")
    assert [r.owner for r in linking.unresolved(open_calls, known).collect()] == ["z"]
    between = spark.createDataFrame([("x", "y", "local"), ("x", "y", "field")], "caller string, callee string, kind string")
    assert {(r.callee, r.how) for r in linking.calls_between(between, spark.createDataFrame([("x", "y"), ("x", "z")], "caller string, callee string")).collect()} == {("y", "field,local"), ("z", "none")}
    facts = spark.createDataFrame([("f", "m", "read", "state.userName", "frontend"), ("f", "m", "request", "userName", ""), ("f", "m", "write", "other", "backend")], "file string, method string, kind string, field string, area string")
    assert {(r.side, r.kind) for r in linking.field_flow(facts, "username").collect()} == {("frontend", "read"), ("network", "request")}
    handlers, raw = spark.createDataFrame([("m", "f", "a"), ("m", "f", "b")], "message string, file string, method string"), spark.createDataFrame([("f", "a", ["s"], None), ("f", "b", ["t"], ["s", "u"])], "file string, method string, reads array<string>, writes array<string>")
    assert [r.states for r in linking.handler_states(handlers, raw).collect()] == [["s", "t", "u"]]
    tools = lambda *x: spark.createDataFrame([(t,) for t in x], "tool string")
    assert ids(linking.missing(tools("a", "b"), tools("b"), ["tool"]), "tool") == ["a"]
    c = spark.createDataFrame([("method:Shop.open",), ("method:mall.OPEN",), ("table:gone",)], "candidate string")
    assert {(r.id, r.exact) for r in linking.split_candidate(c, nodes).collect()} == {("method:a", True), ("method:b", False)}


def test_execution(spark):
    tasks = spark.createDataFrame([(1, "", None), (2, "polish", ["src/Button.tsx"]), (3, "polish", ["src/a.ts"]), (4, "fix the login", ["src/a.tsx"]), (5, "x", ["src/a.ts", "lib/b.ts"]), (6, "x", ["web/app/api/x/route.ts"]), (7, None, []), (8, "x", None), (9, "the shop", ["src/a.tsx"])], "id int, task string, files array<string>")
    gates = execution.gated(tasks)
    assert {r.id: r.decision for r in gates.collect()} == {1: "required", 2: "optional_skip_allowed", 3: "recommended", 4: "required", 5: "required", 6: "required", 7: "required", 8: "required", 9: "optional_skip_allowed"}
    changes = spark.createDataFrame([(2, "src/Button.tsx"), (3, "other/x.ts"), (4, "src/a.tsx"), (5, "lib/b.ts"), (6, "web/app/api/x/route.ts"), (9, "src/shop/a.tsx"), (5, "lib/b.ts")], "id int, file string")
    boundary = spark.createDataFrame([(i, ["Button.tsx", "src/a.tsx"], ["lib/", "src/shop"]) for i in (2, 3, 4, 5, 6, 9)], "id int, primary array<string>, roots array<string>")
    critical = spark.createDataFrame([(4, "lib/Settings.ts"), (4, "lib/plain.ts"), (5, "LIB/B.ts"), (5, "lib/chat.ts"), (2, "lib/chat.ts")], "id int, file string")
    scopes = execution.validate(tasks, changes, boundary, critical)
    got = {r.id: (r.outside, r.risky, r.missing, r.verdict) for r in scopes.collect()}
    assert got == {1: (0, 0, 0, "pmm_context_unavailable"), 2: (0, 0, 1, "within_scope"), 3: (1, 0, 0, "scope_review_needed"), 4: (0, 0, 1, "possibly_incomplete"), 5: (0, 0, 1, "possibly_incomplete"), 6: (1, 1, 0, "scope_review_needed"), 7: (0, 0, 0, "pmm_context_unavailable"), 8: (0, 0, 0, "pmm_context_unavailable"), 9: (0, 0, 0, "within_scope")}
    reviews = execution.reviewed(scopes.select("id", "verdict", F.when(F.col("id") == 2, "high").otherwise("low").alias("risk"), (F.col("id") == 9).alias("rebuild")))
    assert {r.id: (len(r.findings), r.verdict) for r in reviews.collect()} == {1: (1, "changes_requested"), 2: (1, "changes_requested"), 3: (1, "review_ready"), 4: (1, "review_ready"), 5: (1, "review_ready"), 6: (1, "review_ready"), 7: (1, "changes_requested"), 8: (1, "changes_requested"), 9: (1, "review_ready")}
    steps = execution.plan(gates)
    assert [r.step for r in steps.where("id = 4").orderBy("place").collect()] == ["prepare-context", "check-credentials", "edit", "validate-scope", "review-patch"]
    brief = execution.brief(gates, steps, scopes, spark.createDataFrame([(4, 0, "seen")], "id int, place int, text string"))
    assert {r.section for r in brief.where("id = 4").collect()} == {"gate", "plan", "scope", "memory"}
    rules = execution.inferred_rules(spark.createDataFrame([(1, "OAuth fails", None), (2, "x", ["app/api/y.ts"]), (3, None, None)], "id int, text string, files array<string>"))
    assert sorted((r.id, r.category) for r in rules.collect()) == [(1, "oauth"), (1, "security"), (2, "api")]
    checks = spark.createDataFrame([("a", "x", "ok"), ("b", "x", "fail"), ("b", "y", "warn"), ("c", "x", "warn")], "id string, check string, result string")
    assert {r.id: (r.score, r.status) for r in execution.health(checks).collect()} == {"a": (100, "ready"), "b": (60, "blocked"), "c": (90, "needs_action")}
    need = spark.createDataFrame([("a", "reinstall_skill"), ("a", "init_workspace"), ("b", "?")], "id string, action string")
    assert {r.id: r.action for r in execution.next_actions(need).collect()} == {"a": "init_workspace", "b": "proceed"}
    known = spark.createDataFrame([("w1", "h1", "/a", "r1", "Big Shop"), ("w2", "h2", "/b", "r1", "Big Mall")], "id string, hash string, root string, remote string, name string")
    asked = spark.createDataFrame([(1, "h1", "/a", "r1", "", ""), (2, "", "", "r1", "big", ""), (3, "", "", "", "Big Shop", "w1"), (4, "", "", "", "none", "")], "ask int, hash string, root string, remote string, name string, want string")
    assert sorted((r.ask, r.id, r.score, r.ambiguous) for r in execution.resolve_workspace(known, asked).collect()) == [(1, "w1", 160, False), (2, "w1", 85, True), (2, "w2", 85, True), (3, "w1", 130, False)]
    assert freshness.gate("stale", "auto_rebuild") == {"status": "stale", "stale": True, "run": True, "rebuild": True} and not freshness.gate("unknown")["run"]


def test_discovery(spark, nodes, edges):
    found = discovery.seeds(nodes)
    assert {(r.key, r.weight, r.id) for r in found.collect()} == {("shop-items", 45, "endpoint:e"), ("shop", 40, "message:m"), ("room-card", 25, "script:g")}
    app = spark.createDataFrame([(f"n{i}", "route", f"n{i}", f"web/app/api/orders/{i}/route.ts", "backend") for i in range(9)] + [("p", "method", "p", "web/app/(main)/orders/page.tsx", "frontend"), ("l", "method", "l", "lib/orders/db.ts", "data")], "id string, type string, name string, file string, area string")
    per, evidence = discovery.candidates(discovery.app_seeds(app).unionByName(found), 5)
    got = {r.key: (r.score, r.nodes, r.confidence) for r in per.collect()}
    assert got["orders"] == (90, 10, "high") and got["shop-items"] == (45, 1, "high") and got["room-card"] == (25, 1, "medium")
    assert evidence.where("key = 'orders'").count() == 5 and [r.key for r in discovery.ordered(per).collect()] == ["orders", "shop-items", "shop", "room-card"]
    e = spark.createDataFrame([("p", "l"), ("n1", "p")], "src string, dst string")
    assert [tuple(r) for r in discovery.related_roots(discovery.app_seeds(app), e, app).collect()] == [("orders", "lib/orders")]
    assert [tuple(r) for r in discovery.fullstack(app, "web", "lib").collect()] == [(11, 91)] and discovery.fullstack(app, "web", "none").isEmpty()


def test_text_functions(spark):
    f = lambda c, *rows: value(spark, c, *[(r,) for r in rows], schema="x string")
    x = F.col("x")
    assert f(T.any_glob(x, ["src/**/*.ts", "a?.md"]), "src/a.ts", "src/b/c.ts", "lib/a.ts", "ab.md", "abc.md") == [True, True, False, True, False]
    assert f(T.dynamic_target(x), "url", "`/a/${id}`", "/api/x") == [True, True, False]
    assert f(T.ignored_import(x), "cc", "cc/env", "db://x", "node:fs", "a/node_modules/b", "./cc", "ccx/y") == [True, True, True, True, True, False, False]
    assert f(T.external(x), "react", "./a", "@/b", "@scope/p", "node:fs") == [True, False, False, True, False]
    assert f(T.reads_like_a_question(x), "open shop", "shop.open", "一二三四五六七八九十") == [True, False, True]
    assert f(T.specific_root(x), "src/a", "src", "SRC/web/", "") == [True, False, True, False]
    assert f(T.route_endpoint(x), "web/app/api/a/[id]/route.ts", "app/api/[...all]/route.js", "app/api/route.ts", "app/page.tsx") == ["/api/a/:id", "/api/:all*", "/api", None]
    assert f(T.segment(x), "[id]", "[[...rest]]", "plain") == [":id", ":rest*", "plain"]
    assert f(T.routes_base(x), "s/app/http/routes/x/y.ts", "s/app/http/routes/index.ts", "other.ts") == ["/x/y", "", ""]
    assert f(T.synthetic_name("cb", x), " on-click! ") == ["cb_on_click"]
    assert f(T.message_name(x), "cmd:Buy", "Buy") == ["Buy", ""] and f(T.workspace_id(x), " My App! ") == ["my-app"] and len(f(T.workspace_hash(x), "/A/b/")[0]) == 12
    assert f(T.workspace_hash(x), "/A/b/") == f(T.workspace_hash(x), "/a//b") and f(T.without_credentials(x), "https://u:p@h/x.git", "git@h:x") == ["https://h/x.git", "git@h:x"]
    assert f(T.title(x), "shop-items_list") == ["Shop Items List"] and f(T.words(x), "loadMore分页 x") == [["load", "More分页", "x"]]
    assert f(T.area_root(x), "packages/a/b.ts", "src/x", "") == ["packages/a", "src", ""] and f(T.signals(x), "POST /api/login") == [["api", "auth"]]
    assert value(spark, T.clamp(F.col("n"), 20, 100), (None,), (0,), (7,), (500,), schema="n int") == [20, 20, 7, 100]
    assert value(spark, T.request_name(F.col("p"), F.col("m"), F.col("t"), F.col("c")), ("http", "get", "/x", "fetch"), ("http", "get", "url", "url"), ("ws", "", "", "send"), schema="p string, m string, t string, c string") == ["GET /x", "url", "send"]
    assert value(spark, T.component_class(F.col("n"), F.col("r"), F.col("f"), F.lit("p.prefab")), ("A@1", "x", "a.ts"), ("cc.Button@2", "x", ""), ("n", "sp.Skeleton", ""), ("n", "x", "p.prefab"), schema="n string, r string, f string") == ["custom-script", "builtin", "builtin", "unresolved"]
    assert value(spark, T.same_path(F.col("a"), F.col("b")), ("A\\b//c", "a/b/c"), ("", ""), schema="a string, b string") == [True, False]
    assert value(spark, T.package_version(F.col("x")) < T.package_version(F.lit("1.10.0")), ("v1.9.3",), ("1.10",), ("2",), schema="x string") == [True, False, False]


def test_prefabs(spark):
    import json

    from graphloom.operators import prefab

    text = json.dumps([{"__type__": "cc.Prefab"}, {"__type__": "cc.Node", "_name": "root", "_parent": None}, {"__type__": "cc.Node", "_name": "ok", "_parent": {"__id__": 1}}, {"__type__": "cc.Button", "node": {"__id__": 2}, "clickEvents": [{"__id__": 4}], "n": 3}, {"__type__": "cc.ClickEvent", "target": {"__id__": 1}, "component": "Shop", "handler": "onOk"}, {"__type__": "CCPropertyOverrideInfo", "propertyPath": ["_lpos", "x"], "value": {"x": 1}}])
    found = prefab.objects(spark.createDataFrame([("a.prefab", text), ("bad", "no json"), ("none", None)], "file string, text string"))
    assert {(r.place, r.path, r.depth) for r in prefab.tree(found).collect()} == {(1, "root", 1), (2, "root/ok", 2)}
    assert [tuple(r)[2:] for r in prefab.events(found).collect()] == [(1, "Shop", "onOk")]
    assert [(r.property, r.value) for r in prefab.overrides(found).collect()] == [("_lpos.x", '{"x":1}')]
    meta = spark.createDataFrame([("s/Shop.ts.meta", '{"uuid":"fc991dd7-0033-4b80-9d41-c8a86a702e59"}'), ("x.d.ts.meta", '{"uuid":"u"}'), ("p.prefab.meta", '{"uuid":"v"}'), ("p.png.meta", "{}"), ("p.ts", "")], "path string, text string")
    assert {(r.path, r.kind, r.short) for r in prefab.catalog(meta).collect()} == {("s/Shop.ts", "script", "fc9913XADNLgJ1ByKhqcC5Z"), ("x.d.ts", "asset", "u"), ("p.prefab", "prefab", "v")}


def test_steps_are_sieved_before_they_move(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(300)] + [("n3", "n9"), ("n3", "n9"), (None, "n1"), ("n5", None)], "src string, dst string")
    starts = spark.createDataFrame([("n3",), ("n200",), (None,)], "id string")
    step = graph.steps(edges, "both")
    told = lambda stored: {tuple(r) for r in graph.walk(step, starts, 3, stored=stored).collect()}
    assert told(False) == told(True) and ("n8", 2) in told(False)
    kept = graph.sieve(step, "from_id", starts)
    assert {r.from_id for r in kept.collect()} == {"n3", "n200", None}
    assert {r.from_id for r in graph.sieve(step, "from_id", starts, bits=6).collect()} >= {"n3", "n200"}


def test_evidence_has_names_from_the_same_joins(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "x", "calls"), (None, "b", "calls")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a", "method", "A.run"), ("b", "request", "GET /b")], "id string, type string, name string")
    found = context.edge_evidence(edges, nodes, "r", named=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, context.named_edges(context.edge_evidence(edges, nodes, "r"), nodes).collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_risk_looks_at_equal_words_once(spark):
    related = spark.createDataFrame([("method", "a", "f")] * 3, "type string, name string, file string")
    found = spark.createDataFrame([("writes", "token"), ("writes", "token"), ("reads", None)], "type string, operation string")
    level = context.risk(related, found)
    assert level.first().level == "high" and context.risk(related, found.limit(0)).first().level == "low"
    assert level._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [type") == 2


def test_signals_by_words_and_patterns(spark):
    texts = ["src/API/x.ts", "api", "a/apis", "route.ts", "routexts", "schema.prisma x", "DB", " Token ", "订单", "跨端 graph", "", None, "mall|shop", "order"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.array_compact(F.array(*[F.when(T.normal(F.col("t")).rlike(p), F.lit(k)) for k, p in T.SIGNALS.items()]))
    for r in rows.select("t", T.signals(F.col("t")).alias("a"), slow.alias("b")).collect():
        assert r.a == r.b, r.t
    got = rows.select("t", *[T.has_any(F.col("t"), p).alias(k) for k, p in (("x", r"a\|b|mall\|"), ("y", r"(?:^|x)api|[|]|\.ts$"))]).collect()
    assert {r.t for r in got if r.x} == {"mall|shop"} and {r.t for r in got if r.y} == {"api", "a/apis", "route.ts", "mall|shop", "src/API/x.ts"} - {"a/apis"}


def test_changes_move_once(spark):
    tasks = spark.createDataFrame([(1, None, None), (2, "x", None)], "id long, task string, files array<string>")
    changes = spark.createDataFrame([(1, "A/x.ts"), (1, "A/x.ts"), (1, "lib/API/b.ts"), (2, None)], "id long, file string")
    boundary = spark.createDataFrame([(1, None, [" a// ", "", None]), (2, ["q.ts"], [])], "id long, primary array<string>, roots array<string>")
    critical = spark.createDataFrame([(1, "LIB/api/B.ts"), (1, "chat.ts"), (2, "other.ts")], "id long, file string")
    found = execution.validate(tasks, changes, boundary, critical)
    assert {(r.id, r.outside, r.risky, r.missing) for r in found.collect()} == {(1, 0, 1, 1), (2, 0, 0, 0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [id") == 1
