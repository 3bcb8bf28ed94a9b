"""Lookups, flows, configurations of imports, written-back messages and partial rebuilds on small hand-made tables."""

import re

import pytest
from test_queries import spark  # noqa: F401

from graphloom.operators import context, freshness, graph, imports, lifecycle, lookup, protocols, rebuild, search, selectors
from graphloom.plans import lookup_queries
from graphloom.sources.storage import shared_dir

NODE = "id string, type string, name string, file string, area string, tags array<string>, meta map<string,string>"
EDGE = "src string, dst string, type string"


@pytest.fixture
def small(spark):  # noqa: F811
    nodes = spark.createDataFrame(
        [
            ("method:a", "method", "Shop.open", "src/shop.ts", "frontend", ["open", "Ladensuche"], {"methodName": "open"}),
            ("request:b", "request", "GET /Shop", "", "contract", None, {"httpMethod": "GET", "target": "/shop"}),
            ("table:c", "table", "orders", "db/SHOP.ts", "data", [], None),
            ("state:d", "state", "ab", None, None, ["x"], {}),
            (None, "state", "nothing", None, None, [], {}),
        ],
        NODE,
    )
    edges = spark.createDataFrame([("method:a", "request:b", "requests"), ("request:b", "table:c", "reads"), (None, "table:c", "reads")], EDGE)
    return nodes, edges, lookup.build(nodes, edges, shared_dir(spark, "test-lookup"))


@pytest.mark.parametrize("needle", ["shop", "SHOP", "op", "o", "/sho", "laden", "zzz", "ab", "x", " get ", "orders", "method:a", ""])
def test_lookup_gives_what_a_scan_gives(small, needle):
    nodes, _, found = small
    nodes = nodes.where("id IS NOT NULL")
    ids = lambda df, *c: sorted(tuple(r) for r in df.select("id", *c).collect())
    assert ids(found.search(name=needle)) == ids(selectors.search(nodes, name=needle))
    if needle:
        assert ids(found.ranked(needle), "tier") == ids(selectors.ranked(nodes, needle), "tier")
        assert ids(found.suggestions(needle), "place") == ids(selectors.suggestions(nodes, needle), "place")


def test_lookup_reads_the_folders_asked_for(small):
    """A search for a part reads one folder of runs; what a value names reads one folder of values."""
    _, _, found = small
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    of_run = re.findall(r"PartitionFilters: \[[^\]]*\]", plan(found.values_with("shop")))
    assert of_run and all(re.search(r"bucket#\d+ = \d+", p) for p in of_run)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan(found.table("values", ["orders"])))
    assert [r.id for r in found.saying("ORDERS", "name").collect()] == ["table:c"]
    assert {(r.id, r.direction, r.other) for r in found.near(found.saying("get /shop")).collect()} == {("request:b", "in", "method:a"), ("request:b", "out", "table:c")}
    assert {(r.id, r.depth) for r in graph.walk(found.steps("downstream"), found.saying("open", "meta:methodName"), None).collect()} == {("method:a", 0), ("request:b", 1), ("table:c", 2)}


def test_runs_of_values_alike_are_told_once(spark):  # noqa: F811
    """A run of what values have in common is one row for all of them; every run still names just the values that hold it."""
    values = [f"order:12{i:02d}" for i in range(100)] + ["a", "ab", "aab", "b", "日本語"]
    rows = lookup.grams(spark.createDataFrame([(v,) for v in [*values, "ab"]], "value string")).collect()
    got = [(r.run, r.stem + r.tails[i : i + r.width]) for r in rows for i in range(0, len(r.tails), r.width)]
    assert sorted(got) == sorted({(v[i : i + n], v) for v in values for n in (1, 2, 3) for i in range(len(v) - n + 1)})
    assert sum(r.run == "ord" for r in rows) == 1 and 4 * len(rows) < len(got)


def test_lookup_writes_the_tables_asked_for(spark, small):  # noqa: F811
    nodes, edges, whole = small
    few = lookup.build(nodes, edges, shared_dir(spark, "test-lookup"), ("values",))
    assert {tuple(r) for r in few.table("values").collect()} == {tuple(r) for r in whole.table("values").collect()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        few.table("edges")
    assert {(r.src, r.dst) for r in whole.steps("upstream").collect()} == {("method:a", "request:b"), ("request:b", "table:c")}


def test_walks_of_many_sets(spark):  # noqa: F811
    step = spark.createDataFrame([("k1", "a", "b"), ("k1", "b", "c"), ("k1", "c", "a"), ("k2", "b", "d"), ("k2", "a", "d")], "key string, from_id string, to_id string")
    starts = spark.createDataFrame([("k1", 1, "a"), ("k1", 2, "b"), ("k2", 1, "a")], "key string, set int, id string")
    got = {tuple(r) for r in graph.walk(step, starts, None, ("key", "set"), ("key",)).collect()}
    assert got == {("k1", 1, "a", 0), ("k1", 1, "b", 1), ("k1", 1, "c", 2), ("k1", 2, "b", 0), ("k1", 2, "c", 1), ("k1", 2, "a", 2), ("k2", 1, "a", 0), ("k2", 1, "d", 1)}
    assert {tuple(r) for r in graph.walk(step, starts, 1, ("key", "set"), ("key",)).where("key = 'k1' AND set = 1").collect()} == {("k1", 1, "a", 0), ("k1", 1, "b", 1)}


def test_flows_begin_at_requests_or_methods(spark):  # noqa: F811
    members = spark.createDataFrame([("f", f"r{i}", "request", i) for i in range(6)] + [("f", "m0", "method", 0)] + [("g", f"m{i}", "method", 9 - i) for i in range(5)], "feature string, id string, type string, place int")
    edges = spark.createDataFrame([("f", f"r{i}", f"t{j}", "reads") for i in range(6) for j in range(20)] + [("g", "m4", "m3", "calls"), ("g", "m3", "m0", "calls"), ("f", "m4", "x", "calls")], "feature string, src string, dst string, type string")
    got = context.flows(members, edges).collect()
    assert {r.start for r in got if r.feature == "f"} == {"r0", "r1", "r2", "r3"} and all(r.place <= 12 for r in got)
    assert {(r.start, r.depth, r.src, r.dst) for r in got if r.feature == "g"} == {("m4", 1, "m4", "m3"), ("m4", 2, "m3", "m0"), ("m3", 1, "m3", "m0")}


def test_features_of_one_graph_need_no_edges_of_their_own(spark):  # noqa: F811
    """Flows and cards from the whole graph's edges are those from each feature's own."""
    ids = {"f": ["m:1", "r:1", "t:1", "t:2"], "g": ["m:2", "r:2", "t:1"], "h": ["m:3"]}
    kinds = {"m": "method", "r": "request", "t": "table"}
    members = spark.createDataFrame([(f, i, kinds[i[0]], i.upper(), "auth.ts", int(i[2])) for f, each in ids.items() for i in each], "feature string, id string, type string, name string, file string, place int")
    whole = [("m:1", "r:1", "requests"), ("m:2", "r:2", "requests"), ("m:3", "m:3", "calls"), ("r:1", "t:1", "reads"), ("r:1", "t:1", "writes"), ("r:1", "t:2", "reads"), ("r:2", "t:1", "reads"), ("t:1", "m:1", "calls"), ("t:9", "t:1", "reads")]
    edges = spark.createDataFrame(whole, "src string, dst string, type string")
    own = members.select("feature", "id").join(edges, members["id"] == edges["src"]).select("feature", "src", "dst", "type")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    # In g a table calls what is no member: a card counts it, a flow goes on to where it leads.
    assert rows(context.feature_cards(members, edges)) == rows(context.feature_cards(members, own))
    f = members.where("feature <> 'g'")
    assert rows(context.flows(f, edges.union(edges))) == rows(context.flows(f, own))


def test_card_sorts_no_whole_section(spark):  # noqa: F811
    nodes = spark.createDataFrame([(f"m{i}", "method", f"n{i}") for i in range(40)] + [("t", "table", "t")], "id string, type string, name string")
    edges = spark.createDataFrame([(f"m{i}", "t", "reads", "") for i in range(40)] + [("m7", "m30", "calls", "")], "src string, dst string, type string, operation string")
    card = context.feature_card(nodes, edges, 3)
    assert card._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject") == 3
    want = [("core-methods", 1, "m30", 2), ("core-methods", 2, "m7", 2), ("core-methods", 3, "m0", 1), ("tables", 1, "t", 40), ("types", 1, "method", 40), ("types", 2, "table", 1)]
    assert sorted((r.section, r.place, r.id, r.n) for r in card.collect()) == want


def configured(spark, files):  # noqa: F811
    return imports.configurations(spark.createDataFrame(files, "file string, text string"))


def test_configurations_inherit(spark):  # noqa: F811
    files = [
        ("base.json", '// all\n{"compilerOptions": {"baseUrl": "lib", "paths": {"@a/*": ["a/*"]}}}'),
        ("tsconfig.json", '{"extends": "./base.json"}'),
        ("app/tsconfig.json", '{"extends": "../tsconfig", /* own */ "compilerOptions": {"paths": {"@b/*": ["b/*", "c/*"], "@none": []}}}'),
        ("app/jsconfig.json", '{"compilerOptions": {"baseUrl": "no"}}'),
        ("js/jsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"~x": ["x/y"]}}}'),
        ("loop/tsconfig.json", '{"extends": "../loop2/tsconfig"}'),
        ("loop2/tsconfig.json", '{"extends": "../loop/tsconfig", "compilerOptions": {"paths": {"q": ["r"]}}}'),
        ("bad/tsconfig.json", "{no"),
    ]
    got = {r.folder: (r.config, r.base, [(p.alias, p.targets) for p in r.patterns]) for r in configured(spark, files).collect()}
    assert got == {
        "": ("tsconfig.json", "lib", [("@a/*", ["a/*"])]), "app": ("app/tsconfig.json", "lib", [("@b/*", ["b/*", "c/*"])]), "js": ("js/jsconfig.json", "js", [("~x", ["x/y"])]),
        "loop": ("loop/tsconfig.json", "loop2", [("q", ["r"])]), "loop2": ("loop2/tsconfig.json", "loop2", [("q", ["r"])]), "bad": ("bad/tsconfig.json", "bad", []),
    }


@pytest.mark.parametrize("longest", [False, True])
def test_imports_of_nested_projects(spark, longest):  # noqa: F811
    configs = configured(spark, [("tsconfig.json", '{"compilerOptions": {"paths": {"@*": ["any/*"], "@app/*/view": ["app/*/v.ts"], "@app/*": ["app/*"], "one": ["lib/one"], "two*": ["lib/two"]}}}'), ("sub/tsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@app/*": ["*"]}}}')])
    there = ["any/app/x.ts", "app/x/index.tsx", "app/y/v.ts", "lib/one.js", "lib/two/z.vue", "sub/src/x.ts", "src/k.ts", "src/common/w.ts", "a/b.ts", "a/c/index.jsx"]
    asked = {("a/f.ts", "@app/x"): "app/x/index.tsx" if longest else "any/app/x.ts", ("a/f.ts", "@app/y/view"): "app/y/v.ts", ("a/f.ts", "one"): "lib/one.js", ("a/f.ts", "one/more"): None, ("a/f.ts", "twoz"): "lib/two/z.vue", ("sub/deep/f.ts", "@app/x"): "sub/src/x.ts",
             ("sub/f.ts", "one"): None, ("a/f.ts", "@/k"): "src/k.ts", ("a/f.ts", "src/common/w"): "src/common/w.ts", ("a/f.ts", "./b"): "a/b.ts", ("a/d/f.ts", "../c"): "a/c/index.jsx", ("a/f.ts", "react"): None}
    found = imports.resolved(spark.createDataFrame(list(asked), "file string, specifier string"), configs, spark.createDataFrame([(f,) for f in there], "file string"), longest=longest)
    assert {(r.file, r.specifier): r.target for r in found.collect()} == asked


def test_targets_and_globs(spark):  # noqa: F811
    files = spark.createDataFrame([(f,) for f in ("a/assets/x.prefab", "a/assets/n/y.prefab", "a/src/one.ts", "a/src/deep/two.ts", "a/dist/three.ts", "b/(s)/f.ts", "b/s/g.tsx")], "file string")
    configs = spark.createDataFrame([("c1", '{"assetRoots": "a/assets", "methodRoots": ["a/src/**/*.ts", "a/nowhere"]}'), ("c2", '{"prefabs": ["a/**/y*.prefab"], "assetRoots": ["a/assets"], "scanTargets": {"Component": "b/(s)", "x": ["b/?/*.tsx"]}}'), ("c3", "{no")], "config string, text string")
    got = {(r.config, r.kind, r.path) for r in imports.expanded(imports.targets(configs), files).collect()}
    assert got == {
        ("c1", "asset", "a/assets"), ("c1", "method", "a/src/one.ts"), ("c1", "method", "a/src/deep/two.ts"), ("c1", "prefab", "a/assets/x.prefab"), ("c1", "prefab", "a/assets/n/y.prefab"),
        ("c2", "asset", "a/assets"), ("c2", "prefab", "a/assets/n/y.prefab"), ("c2", "component", "b/(s)"), ("c2", "method", "b/s/g.tsx"),
    }


def test_suffix_matches_have_no_hot_key(spark):  # noqa: F811
    paths = [f"app/p{i}/page.tsx" for i in range(300)] + ["page.tsx", "p7/page.tsx", "other/app/p9/page.tsx"]
    nodes = spark.createDataFrame([(p,) for p in paths], "file string")
    changed = spark.createDataFrame([(p,) for p in ("p1/page.tsx", "x/app/p2/page.tsx", "page.tsx", "app/p9/page.tsx")], "changed string")
    end = lambda a, b: a == b or a.endswith("/" + b) or b.endswith("/" + a)
    want = {(p, c) for p in paths for c in ("p1/page.tsx", "x/app/p2/page.tsx", "page.tsx", "app/p9/page.tsx") if end(p, c)}
    got = [(r.file, r.changed) for r in search.suffix_matches(nodes, changed).collect()]
    assert set(got) == want and len(got) == len(want)
    few = search.suffix_matches(nodes, spark.createDataFrame([("app/p1/page.tsx",)], "changed string"))
    assert {r.file for r in few.collect()} == {"app/p1/page.tsx", "page.tsx"}


def test_learned_messages_are_written_back(spark):  # noqa: F811
    root = shared_dir(spark, "test-graph")
    nodes = spark.createDataFrame([("m1", "method", "A.go", "a.ts", "frontend"), ("m2", "method", "B.go", "b.ts", "backend"), ("m3", "method", "B.go", "c.ts", "data"), ("message:ws:old", "message", "old", "", "x")], "id string, type string, name string, file string, area string")
    edges = spark.createDataFrame([("m1", "m2", "calls", "")], "src string, dst string, type string, meta_key string")
    lifecycle.publish({"nodes": nodes, "edges": edges}, root, 1)
    patterns = spark.createDataFrame([("New One", "ws", 0.8, "n.ts"), ("old", "ws", 0.9, ""), ("", "ws", 0.9, "")], "message string, protocol string, confidence double, file string")
    actors = spark.createDataFrame([("New One", "sender", "", "B.go", "emit"), ("New One", "handler", "m1", "?", None), ("New One", "dispatcher", "gone", "A.go", None), ("old", "handler", "", "A.go", "")], "message string, role string, id string, name string, callee string")
    protocols.write_back(spark, root, 2, patterns, actors)
    n = {r.id: (r.type, r.area) for r in lifecycle.current(spark, root, "nodes").collect()}
    e = {(r.src, r.dst, r.type, r.meta_key) for r in lifecycle.current(spark, root, "edges").collect()}
    assert n == {"m1": ("method", "frontend"), "m2": ("method", "backend"), "m3": ("method", "data"), "message:ws:old": ("message", "x"), "message:ws:new-one": ("message", "frontend")}
    assert e == {("m1", "m2", "calls", ""), ("m3", "message:ws:new-one", "emits", "ws|New One|sender|emit"), ("message:ws:new-one", "m1", "binds", "ws|New One|handler|"), ("message:ws:old", "m1", "binds", "ws|old|handler|")}
    assert spark.read.parquet(f"{root}/version=1/nodes").count() == 4
    more = protocols.augmented(nodes, edges, nodes.limit(0), spark.createDataFrame([("m1", "lost", "binds", "k")], edges.schema))
    assert {(r.id, r.type) for r in more[0].where("id = 'lost'").collect()} == {("lost", "unknown")}


def test_rebuild_writes_only_what_a_change_touches(spark):  # noqa: F811
    root = shared_dir(spark, "test-facts")
    extract = lambda df: df.selectExpr("file", "length(text) AS n")
    text = lambda names, more="": spark.createDataFrame([(n, n + more) for n in names], "file string, text string")
    names = [f"file{i}" for i in range(500)]
    rebuild.build(extract(text(names)), root)
    before = rebuild.places(spark, root)[1]
    assert len(before) == rebuild.PARTS
    one = spark.createDataFrame([("file7",)], "file string")
    assert rebuild.rebuild(spark, root, one, text(names, "!!"), extract) == 1
    version, after = rebuild.places(spark, root)
    assert version == 2 and sum(before[p] != after[p] for p in after) == 1 and sorted(set(after.values())) == [1, 2]
    got = {r.file: r.n for r in rebuild.read(spark, root).collect()}
    assert got == {n: len(n) + (2 if n == "file7" else 0) for n in names}
    # A file that is gone, one that is new, and nothing at all.
    assert rebuild.rebuild(spark, root, spark.createDataFrame([("file8",), ("brand-new",)], "file string"), text(["brand-new"]), extract) <= 2
    assert {r.file for r in rebuild.read(spark, root).collect()} == set(names) - {"file8"} | {"brand-new"}
    assert rebuild.rebuild(spark, root, one.limit(0), text(names), extract) == 0
    assert {r.file: r.n for r in rebuild.read(spark, root, 1).collect()} == {n: len(n) for n in names}


def test_affected_files(spark):  # noqa: F811
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", None), ("f", "f")], "file string, target string")
    found = rebuild.dependencies(links)
    assert {(r.file, r.depth) for r in rebuild.affected(found, spark.createDataFrame([("b",)], "file string")).collect()} == {("b", 0), ("a", 1), ("d", 1), ("c", 2)}
    assert {r.file for r in rebuild.tracked(found, spark.createDataFrame([("z",), ("a",)], "file string")).collect()} == {"a", "b", "c", "z"}


def test_states_of_tables(spark):  # noqa: F811
    tables = spark.createDataFrame([("m", False, True, 2, "1"), ("c", True, False, 2, "1"), ("s", True, True, None, "1"), ("v", True, True, 1, "1"), ("f", True, True, 2, ""), ("x", True, True, 2, "1"), ("o", True, True, 2, "0")], "key string, built boolean, configured boolean, snapshot int, tool string")
    changes = spark.createDataFrame([("x", "p", "changed"), ("x", "q", "added"), ("f", "p", "same"), ("v", "p", "changed")], "key string, path string, change string")
    got = {r.key: (r.status, r.reasons) for r in freshness.states(tables, changes, "1").collect()}
    assert got == {"m": ("missing", ["missing-kb"]), "c": ("unknown", ["missing-kb-config"]), "s": ("unknown", ["missing-source-snapshot"]), "v": ("unknown", ["source-snapshot-version-unsupported"]), "f": ("fresh", []), "x": ("stale", ["source-files-added", "source-files-changed"]), "o": ("stale", ["tool-version-changed"])}


def test_readers_and_small_rules(spark, tmp_path):  # noqa: F811
    from pyspark.sql import functions as F

    from graphloom.functions import text as T
    from graphloom.operators import features, learn
    from graphloom.sources import files

    log = str(tmp_path / "log")
    files.append_lines(spark.createDataFrame([(1, "a")], "n int, s string"), log)
    files.append_lines(spark.createDataFrame([(2, "b")], "n int, s string"), log)
    (tmp_path / "log" / "bad.json").write_text('{"n": no\n{"n": 3}\n')
    read = files.json_lines(spark, log, "n int, s string").collect()
    assert sorted((r.n or 0, r._corrupt_record is None) for r in read) == [(0, False), (1, True), (2, True), (3, True)]
    assert [graph.depth_policy(*a) for a in ((None,), (0,), (3,), (None, "fullstack"), (6, "fullstack"))] == [2, 2, 3, 4, 6]
    paths = spark.createDataFrame([(r"C:\Work\App\x.ts",), ("c:/work/app/y/z.ts",), ("other/x",), (None,)], "p string")
    assert [r.x for r in paths.select(T.workspace_relative(F.col("p"), r"c:\work\app").alias("x")).collect()] == ["x.ts", "y/z.ts", "other/x", ""]
    seen = spark.createDataFrame([("a", None, f"f{i:02}") for i in range(15)] + [("a", "t", "z"), ("b", "t", None)], "kind string, target string, file string")
    got = {(r.kind, r.target): (r.n, r.confidence, r.evidence) for r in learn.learned_shares(seen, ["kind"], ["target"], "file").collect()}
    assert got == {("a", None): (15, 0.9375, [f"f{i:02}" for i in range(10)]), ("a", "t"): (1, 0.0625, ["z"]), ("b", "t"): (1, 1.0, None)}
    empty = features.data_root(seen.selectExpr("kind AS id").limit(0), seen.selectExpr("kind AS id"), spark.createDataFrame([], "code string, severity string")).first()
    assert (empty.workspaces, empty.registered, empty.manifest_only, empty.ok, empty.actions) == (2, 0, 2, True, ["register_workspace"])


def test_a_version_adds_to_the_one_before(spark, tmp_path):  # noqa: F811
    root = str(tmp_path)
    nodes = spark.createDataFrame([("m:a", "method", "A", "a.ts", "frontend")], "id string, type string, name string, file string, area string")
    edges = spark.createDataFrame([("m:a", "m:z", "calls", "", "k")], "src string, dst string, type string, operation string, meta_key string")
    lifecycle.publish({"nodes": nodes, "edges": edges}, root, 1)
    patterns = spark.createDataFrame([("x", "ws", 0.5, "x.ts")], "message string, protocol string, confidence double, file string")
    actors = spark.createDataFrame([("x", "handler", "m:a", "", ""), ("x", "handler", "m:a", "", ""), ("x", "handler", "m:none", "", "")], "message string, role string, id string, name string, callee string")
    for version in (2, 3):  # what is there is not added again
        protocols.write_back(spark, root, version, patterns, actors)
        assert {r.id for r in lifecycle.current(spark, root, "nodes").collect()} == {"m:a", "message:ws:x"}
        assert sorted(r.dst for r in lifecycle.current(spark, root, "edges").collect()) == ["m:a", "m:z"]
        assert lifecycle.current(spark, root, "nodes").count() == 2
    assert [spark.read.parquet(f"{root}/version={v}/edges").count() for v in (1, 2, 3)] == [1, 1, 0]


def test_neighbours_of_every_route_and_module(spark):  # noqa: F811
    found = lookup_queries.lookup_neighbours(spark, "/root/testdata/sf0.001").select("id").distinct().collect()
    assert {r.id for r in found} == {f"nation:{i}" for i in range(25)} | {f"region:{i}" for i in range(5)}


def test_cards_of_all_features_read_the_tables_once(spark):  # noqa: F811
    """Every step is kept, so that the last plan holds none of those before it."""
    plan = lookup_queries.feature_cards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "feature" in plan and "l_partkey" not in plan and "o_custkey" not in plan
