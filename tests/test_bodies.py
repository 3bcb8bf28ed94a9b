"""Bodies, manifests, authoring plans and builds on small hand-made tables."""

import pyarrow as pa
import pytest
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import authoring, bodies, lifecycle, manifests, prefab
from graphloom.sources.storage import shared_dir


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_comments_and_brackets(spark):
    for text, want in (
        ('a // x\nb', "a \nb"), ('"http://x" /* y */ z', '"http://x"  z'), (r"'it\'s // in' // out", r"'it\'s // in' " + "\n"), ("/* never closed", ""), ("`${a} // t`", "`${a} // t`"), ("", ""), (None, None),
        ("x" * 300_000 + "//y\n" * 1000, "x" * 300_000 + "\n" * 1000),
    ):
        assert one(spark, text, bodies.without_comments("text")) == want
    got = one(spark, "f(a, [b, c], g(d, e), ')', x); f(; f()", bodies.bracketed("text", r"\b(f)\("))
    assert [(r.name, r.parts) for r in got] == [("f", ["a", "[b, c]", "g(d, e)", "')'", "x"]), ("f", [])]
    assert one(spark, None, bodies.bracketed("text", r"(f)\(")) == [] and one(spark, "f(" * 5000, bodies.bracketed("text", r"(f)\(")) == []


def test_brackets_in_regular_expressions(spark):
    text = "a() { const r = /[{(]/, n = x / y / z; }\nb() { return /\\/\\/(/.test(s) && [/}/]; } // c() {"
    rows = spark.createDataFrame([("f", text)], "file string, text string")
    assert [(r.method, r.body) for r in bodies.methods(rows).orderBy("line").collect()] == [("a", " const r = /[{(]/, n = x / y / z; "), ("b", " return /\\/\\/(/.test(s) && [/}/]; ")]
    assert one(spark, "x = /a\\/\\/b/; // gone", bodies.without_comments("text")) == "x = /a\\/\\/b/; \n"


def test_requests_through_wrappers(spark):
    from graphloom.operators import members

    text = "class K extends Http { constructor() { super('/base'); }\n load() { this.get('x'); this.other('y'); } }\nfetch(`/a/${id}?q=1`, { method: 'put' });\nglobal.App.rpc.s.t.u(1); this.app?.rpc.s.t.v();\nNet.inst.tableMsg({ cmd: 'buy' });\nNet.inst.request('go', (r) => { fetch('/in') });\naxios.get('/b', c); axios({ method: 'post' }); // fetch('/no')\nconst s = \"fetch('/quoted')\";"
    rows = spark.createDataFrame([("f", text)], "file string, text string")
    got = {(r.callee, r.target, r.protocol, r.http_method, r.line) for r in members.requests(rows).collect()}
    assert got == {
        ("this.get", "/base/x", "http", "GET", 2), ("fetch", "/a/", "http", "PUT", 3), ("pinus.rpc", "s.t.u", "pinus-rpc", "", 4), ("pinus.rpc", "s.t.v", "pinus-rpc", "", 4), ("Net.inst.tableMsg", "cmd:buy", "", "", 5),
        ("Net.inst.request", "go", "", "", 6), ("fetch", "/in", "http", "GET", 6), ("axios.get", "/b", "http", "GET", 7), ("axios", "axios", "http", "POST", 7),
    }


def test_fingerprints_are_a_tree(spark):
    from graphloom.operators import freshness

    files = spark.range(3000).selectExpr("concat('p', id) AS path", "id AS size", "'h' AS hash")
    flat, deep = freshness.whole_fingerprint(files).first(), freshness.whole_fingerprint(files, held=0.1).first()
    assert flat.files == deep.files == 3000 and flat.fingerprint != deep.fingerprint
    assert freshness.whole_fingerprint(files.repartition(7), held=0.1).first().fingerprint == deep.fingerprint
    other = files.where("path <> 'p17'")
    assert freshness.whole_fingerprint(other, held=0.1).first().fingerprint != deep.fingerprint
    assert freshness.whole_fingerprint(files.limit(0)).first().files == 0


def test_operations(spark):
    text = "if (a) return;\nif (b) { x = 1; return; }\nfor (let i = 0; i < 3; i++) go();\nfor (const k in o) {}\nwhile (w) {}\nlist.map(f).forEach((x) => x);\nfunction no(a) {}\nopen(): void {}\nthis.v = q ?? r;"
    got = [tuple(r) for r in one(spark, text, bodies.operations("text"))]
    assert got == [
        ("condition", "", "a", 1, True), ("return", "", "", 1, False), ("condition", "", "b", 2, False), ("return", "", "", 2, False), ("loop", "for", "", 3, False), ("assignment", "i", "0", 3, False),
        ("method_call", "global:go", "", 3, False), ("loop", "for_in", "o", 4, False), ("loop", "while", "", 5, False), ("map", "list", "f", 6, False), ("foreach", "()", "(x) => x", 6, False), ("assignment", "this.v", "q ?? r", 9, True),
    ]
    assert one(spark, None, bodies.operations("text")) == [] and one(spark, "", bodies.operations("text")) == []
    rows = spark.createDataFrame([("a", None), ("b", "f(1)")], "file string, text string")
    assert {r.file: (r.calls, r.complexity) for r in bodies.summaries(rows).collect()} == {"a": (0, "low"), "b": (1, "low")}


def test_methods_and_calls(spark):
    text = "/* no() {} */\nfunction top(a,\n b) { return inner(a); }\nclass A {\n  item: Item;\n  run() { // stop() {}\n    top(1); this.run(); this.item.show(); lib(); lib.x.y(2); lib(); gone.z(); }\n}\nconst inner = async (x) => { top(x, 1); };\nconst no = (x) => x;\nfunction open() {"
    files = spark.createDataFrame([("src/a.ts", text), ("b.ts", None), ("src/lib.ts", "")], "file string, text string")
    found = bodies.methods(files)
    assert {(r.method, r.params, r.line) for r in found.collect()} == {("top", "a, b", 2), ("run", "", 6), ("inner", "x", 9)}
    names = spark.createDataFrame([("src/a.ts", "./lib", "lib", "default", "default"), ("src/a.ts", "./item", "Item", "Item", "named")], "file string, specifier string, identifier string, imported string, kind string")
    calls = bodies.method_calls(found, names, bodies.field_types(files, names))
    assert {(r.caller, r.owner, r.callee, r.kind, r.specifier, r.n) for r in calls.collect()} == {
        ("top", "", "inner", "local", None, 1), ("inner", "", "top", "local", None, 1), ("run", "", "top", "local", None, 1), ("run", "this", "run", "local", None, 1), ("run", "this.item", "show", "field", "./item", 1),
        ("run", "", "lib", "imported", "./lib", 2), ("run", "lib.x", "y", "imported", "./lib", 1), ("run", "gone", "z", "unresolved", None, 1),
    }
    resolved = spark.createDataFrame([("src/a.ts", "./lib", "src/lib.ts"), ("src/a.ts", "./item", None)], "file string, specifier string, target string")
    nodes, edges = bodies.method_graph(found, calls, resolved)
    assert {tuple(r) for r in nodes.collect()} == {("src/a.ts#top", False), ("src/a.ts#run", False), ("src/a.ts#inner", False), ("src/lib.ts#lib", True), ("src/lib.ts#y", True)}
    assert ("src/a.ts#run", "src/lib.ts#lib", "imported", 2) in {tuple(r) for r in edges.collect()}


def test_documentation(spark):
    text = "/** Does\n * it.\n * @deprecated\n * @param {a|b} x - the x\n * @param y\n * @example\n * f(1)\n * @since 2 */\nexport async function run() {}\n/***/\n"
    first, second = bodies.documentation(spark.createDataFrame([("f", text), ("g", None)], "file string, text string")).collect()
    d = first.doc
    assert (first.name, d.description, d.deprecated, d.examples, d.since, d.returns) == ("run", "Does it.", True, ["f(1)"], "2", "")
    assert {k: tuple(v) for k, v in d.params.items()} == {"x": ("a|b", "the x"), "y": ("", "")}
    assert (second.name, second.doc.description, second.doc.params) == ("", "", {})


def test_types_and_literals(spark):
    for text, want in (("cc.Node | null", "Node"), ("Array<Item[]>", "Array"), ("readonly a.b.C[]", "C"), ("", ""), (None, "")):
        assert one(spark, text, T.type_name(F.col("text"))) == want
    assert one(spark, "{ a: 1, 'key': \"v, w\", keyed: 2 }", bodies.property_of(F.col("text"), "key")) == '"v, w"'
    fields = spark.createDataFrame([("f", "class A {\n  @type(cc.Label)\n  label;\n  node: cc.Node = null;\n  _own: Item;\n  @property({ tooltip: 't', type: Item }) item;\n}\n")], "file string, text string")
    names = spark.createDataFrame([("f", "./item", "Item", "Item", "named")], "file string, specifier string, identifier string, imported string, kind string")
    assert {tuple(r)[1:] for r in bodies.field_types(fields, names).collect()} == {("label", "cc.Label", "Label", "cc", "decorator"), ("node", "cc.Node", "Node", "cc", "annotation"), ("item", "Item", "Item", "./item", "decorator")}


def test_snippet(spark):
    assert one(spark, "  ", bodies.snippet(F.col("text"))) == "" and one(spark, "a; /* b */ c", bodies.snippet(F.col("text"))) == "a; c"
    many = "; ".join(f"call{i}(1)" for i in range(9)) + "; return done(2)"
    assert one(spark, many, bodies.snippet(F.col("text"), 60)) == "return done(2); call0(1); call1(1); call2(1); call3(1); call4(1)"[:60] + "..."


def test_manifests(spark):
    files = spark.createDataFrame(
        [("game/package.json", '{"creator": {"version": "3"}, "peerDependencies": {"GRPC": "1"}}'), ("web/package.json", "not json"), ("api/pom.xml", "SPRING-BOOT-starter-web"), ("api/PyProject.toml", None), ("a/proto/x.proto", ""), ("a/ws/x.ts", "vue"), ("lib/package.json", '{"type": "module", "dependencies": null}')],
        "path string, text string",
    )
    found = manifests.scan(files)
    assert {r.path: (r.stacks, r.area) for r in manifests.stacks(found).collect()} == {
        "game/package.json": (["cocos", "nodejs", "typescript"], "unknown"), "web/package.json": (["frontend-js", "nodejs"], "unknown"), "api/pom.xml": (["java", "spring"], "unknown"), "api/PyProject.toml": (["python"], "unknown"), "lib/package.json": (["nodejs"], "shared"),
    }
    assert {tuple(r) for r in manifests.integrations(files, found).collect()} == {("websocket", "primary", 1, 0, 0), ("http", "secondary", 0, 0, 1), ("grpc", "secondary", 1, 1, 0)}
    empty = files.where("false")
    assert manifests.integrations(empty, manifests.scan(empty)).count() == 0


def test_plans(spark):
    parts = spark.createDataFrame([("p", "r/a", "Shop"), ("p", "r/a", "cc.Button"), ("p", "r/b", "Shop")], "file string, path string, component string")
    methods = spark.createDataFrame([("Shop", "open"), ("Bag", "close")], "component string, method string")
    events = spark.createDataFrame([("p", "r/a", "Shop", "open")], "file string, source string, component string, handler string")
    roots = spark.createDataFrame([("p", "r")], "file string, path string")
    asked = spark.createDataFrame([(1, "p", "r/a", "Shop", "open", None), (2, "p", "r/c", "Bag", "open", None), (3, "p", "r/c", "Gone", "open", None)], "id int, file string, node string, component string, handler string, target string")
    got = {}
    for r in authoring.click_plans(asked, parts, methods, events, roots).orderBy("id", "step").collect():
        got.setdefault(r.id, []).append((r.kind, r.status, r.path))
    yes, no = "already-satisfied", "required"
    assert got == {1: [("attach-component", yes, "r/a"), ("add-method", yes, ""), ("bind-event", yes, "r/a")], 2: [("attach-component", no, "r"), ("add-method", no, ""), ("attach-built-in-component", no, "r/c"), ("bind-event", no, "r/c")]}
    fields = spark.createDataFrame([("Shop", "icon", "SpriteFrame"), ("Shop", "to", "Bag")], "component string, field string, base string")
    bound = spark.createDataFrame([("p", "r/a", "Shop", "icon", "ui/Icon.png")], "file string, path string, component string, field string, value string")
    wish = spark.createDataFrame([(1, "p", "Shop", "icon", None, None), (2, "p", "Shop", "icon", None, "icon"), (3, "p", "Shop", "icon", None, "other"), (4, "p", "Shop", "to", "r", None), (5, "p", "Shop", "none", None, None)], "id int, file string, component string, field string, node string, target string")
    assert {tuple(r) for r in authoring.field_plans(wish, parts, fields, bound, roots).collect()} == {(1, "r/a", "asset", yes, yes), (2, "r/a", "asset", yes, yes), (3, "r/a", "asset", yes, no), (4, "r", "script", no, no)}
    nodes = prefab.objects(spark.createDataFrame([("p", '[{"__type__":"cc.Node","_name":"Root"},{"__type__":"cc.Node","_name":"Shop","_parent":{"__id__":0}}]')], "file string, text string"))
    features = spark.createDataFrame([Row(feature="f", file="p")])
    assert [tuple(r) for r in authoring.find_nodes(nodes, features, "Shop").collect()] == [("f", "p", "Root/Shop")] and authoring.find_nodes(nodes, features, "shop").count() == 0


def test_builds(spark):
    root = shared_dir(spark, "test-build")
    first, second = spark.range(3), spark.range(5)
    lifecycle.publish({"nodes": first}, root, 1)
    second.write.parquet(f"{root}/version=2/nodes")  # a build that ended before its pointer
    assert lifecycle.current(spark, root, "nodes").count() == 3
    lifecycle.publish({"nodes": second, "edges": first}, root, 2)
    assert lifecycle.current(spark, root, "nodes").count() == 5 and lifecycle.current(spark, root, "edges").count() == 3
    with pytest.raises(ValueError, match="no version"):
        lifecycle.current(spark, root, "other")
    empty = spark.createDataFrame([], "config string, text string")
    assert lifecycle.path_issues(empty, spark.createDataFrame([], "path string"), spark.createDataFrame([("kb",)], "path string")).count() == 1
    w = spark.createDataFrame([("a", None), ("b", 2), ("c", 3), ("d", 3)], "id string, updated_at int")
    assert [r.id for r in lifecycle.latest_first(w).collect()] == ["c", "d", "b", "a"]


def test_whole_fingerprint_of_a_fixed_depth(spark):
    from graphloom.operators import freshness

    files = spark.range(3000).selectExpr("concat('p', id) AS path", "id AS size", "'h' AS hash")
    assert freshness.whole_fingerprint(files, held=0.1, digits=3).first() == freshness.whole_fingerprint(files).first()


def test_one_file_of_texts_is_dealt_over_tasks(spark):
    import test_queries
    from graphloom.plans import body_queries

    assert body_queries.derived_bodies(spark, test_queries.SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_brackets_are_told_in_one_place_as_in_the_whole(spark):
    for text in ('f("(", /[)]/g, [1, 2]) // g(\n{a, b}', "a = b / (c, d) / 2; (/x(/)", "return /(/ (1, (2, 3))", "/* ( */ ('\\'(', `)`)]", "x_return /(/, (1)", "(", "/a/return /b(/ (1)"):
        places = [i for i, c in enumerate(text) if c in "([{"]
        assert bodies._pairs_at(text, places) == bodies._pairs(text), text
    assert bodies._pairs("f(/[)]/, 'a)')") == {1: (13, [7])} and bodies._pairs("a / (b) / c") == {4: (6, [])}


def test_texts_are_looked_at_in_one_batch(spark):
    files = spark.createDataFrame([("a.ts", "class A {\n  on = { 'x': this.x, [y]: this.y, z: 1 }; // {\n  all() { Object.entries(this.on).forEach(([e, h]) => { eventBus.on(e, h, this); }); }\n}\n")], "file string, text string")
    bare = bodies.without_comments("text")
    maps = bodies.handler_maps(files, text=bare)
    assert {tuple(r) for r in bodies.mapped_events(files, maps, text=bare).collect()} == {("a.ts", "eventBus", "on", e, h, "on") for e, h in (("x", "x"), ("y", "y"))}
    assert maps._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_members_are_cut_once(spark):
    fields = spark.createDataFrame([("f", "class A {\n  @property({ type: [Item] })\n  private list: Map<a, (b) => c> = new Map();\n  @type(Item)\n  item;\n}\n")], "file string, text string")
    names = spark.createDataFrame([("f", "./item", "Item", "Item", "named")], "file string, specifier string, identifier string, imported string, kind string")
    found = bodies.field_types(fields, names)
    assert {(r.field, r.via, r.specifier) for r in found.collect()} == {("list", "annotation", None), ("item", "decorator", "./item")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(m") == 0


def test_pieces_give_what_the_whole_text_gives():
    """Lines near the margin are looked at apart, unless a quote, a bracket or an open statement goes on from one to the next."""
    apart = ["import { a } from './b';\nclass A {\n  a(x) { if (x) { return; } b(x); }\n  // c( {\n  get d() { return /[{(]/; }\n}\nconst e = (f) => { g(f); };\n"]
    together = ["class A {\n  t = `a\n  b(x) { c(x); }\n`;\n}\n", "a(x)\n  b { c(); }\n", "if (a) {\n  return;\n}\n", "a.\n  b(c);\n", "f(\n  g(x));\n", "/* a\n  b(x) { }\n*/\n  c(x) { }\n"]
    for text in apart + together:
        for of, run, kind in ((bodies._operations_of, bodies._operations_by_pieces, bodies.OPERATION), (bodies._methods_of, bodies._methods_by_pieces, bodies.METHOD)):
            assert bodies._found(pa.array([None, text, ""]), run, kind).to_pylist() == [[], of(text, None), []], text
    closed = lambda p: bodies._closed(p, list(bodies._passed(p, pattern=bodies._TOKEN)))
    assert all(closed(p) for p in bodies._PIECE.findall(apart[0])) and not any(all(closed(p) for p in bodies._PIECE.findall(t)[:-2]) for t in together)


def test_equal_pieces_are_remembered(monkeypatch):
    seen = []
    run = bodies._by_pieces(lambda text, tokens: seen.append(text) or [], bodies.OPERATION)
    for text in ("a(1);\nb(2);\n", "b(2);\na(1);\n", "b(2);\na(1);\nc(3);"):
        run(text)
    assert seen == ["a(1);\n", "b(2);\n", "c(3);"]
