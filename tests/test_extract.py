"""Facts from small sources, import resolution, graph building and the merging stream."""

import pytest
from pyspark.sql import SparkSession

from graphloom.operators import extract, graph
from graphloom.sources.storage import shared_dir
from graphloom.streaming import events

SOURCE = """import { a, b } from "./util";
import x from '@/lib/net';
export class Shop {
  open() { this.state.count = 1; if (this.state.count == 1) { bus.emit("opened", 1); } }
  async load() { const r = await fetch(`/api/items`); setTimeout(this.tick, 10); return prisma.item.findMany(); }
}
app.get("/items", handler); bus.on('opened', open);
"""


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_facts_and_imports(spark):
    files = spark.createDataFrame([("src/shop/shop.ts", SOURCE), ("src/shop/util.ts", ""), ("src/lib/net/index.ts", None)], "file string, text string")
    found = extract.facts(files)
    got = {(r.kind, r.subject, r.detail) for r in found.collect()}
    assert {("import", "{ a, b }", "./util"), ("dispatch", "emit", "opened"), ("subscribe", "on", "opened"), ("request", "fetch", "/api/items"), ("timing", "setTimeout", "this.tick"),
            ("model-access", "item", "findMany"), ("endpoint", "get", "/items"), ("state-write", "state.count", "="), ("export", "", "Shop")} <= got
    assert not any(k == "call" and s == "if" for k, s, _ in got)
    assert {(r.specifier, r.target) for r in extract.resolved_imports(found, files).collect()} == {("./util", "src/shop/util.ts"), ("@/lib/net", "src/lib/net/index.ts")}
    nodes, edges = extract.graph(found)
    assert ("src/shop/shop.ts", "script") in {tuple(r) for r in nodes.collect()}
    assert ("src/shop/shop.ts", "dispatch:opened", "emits") in {tuple(r)[:3] for r in edges.collect()}
    assert {r.file: r.level for r in extract.complexity(found, files.where("text IS NOT NULL")).collect()}["src/shop/util.ts"] == "low"


def test_merge_log(spark):
    """Every line of a key counts, and the last one holds, within a batch and between batches."""
    source, out = shared_dir(spark, "test-log"), shared_dir(spark, "test-merged")
    schema = "id string, title string, hits int, seq long, created string"
    for batch in ([("k", "two", 1, 2, "b"), ("k", "one", 1, 1, "a"), ("k", "three", 1, 3, "c"), ("j", "x", 1, 1, "d")], [("k", "five", 1, 5, "e"), ("k", "four", 1, 4, "f")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        events.merge_log(events.event_stream(spark, source, schema), out, "id", "seq", kept=("created",), counted="hits").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{out}/version=000000001").collect()} == {("k", "five", 5, 5, "a"), ("j", "x", 1, 1, "d")}


def test_drained_windows_keep_the_last_state(spark):
    from datetime import datetime

    source = shared_dir(spark, "test-events")
    for hour in (1, 1, 2):
        spark.createDataFrame([(datetime(2024, 1, 1, hour), "view", 1.0 * hour)], "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(source)
    counts = events.window_counts(events.event_stream(spark, source, "ts timestamp, event_type string, value double", files_per_batch=1))
    assert sorted((r.start.hour, r.n, r.highest) for r in events.drained(counts, "test-windows").collect()) == [(1, 2, 1.0), (2, 1, 2.0)]


def test_scan_ignores_folders_within_its_root_only(spark, tmp_path):
    from graphloom.sources import files

    root = tmp_path / "build" / "project"
    for p in ("src/a.ts", "src/deep/b.ts", "dist/c.ts", "src/node_modules/d.ts", "src/e.md", "Out/f.ts", "src/legacy/g.ts"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    got = {r.path: bytes(r.content).decode() for r in files.scan(spark, str(root), ("**/*.ts",), more=("src/legacy",)).collect()}
    assert got == {"src/a.ts": "src/a.ts", "src/deep/b.ts": "src/deep/b.ts"}
    assert files.signatures(files.scan(spark, f"file://{root}")).count() == 4


def test_external_services(spark):
    files = spark.createDataFrame([("a.ts", "prisma.user.findMany(); new Anthropic()"), ("b.ts", "fetch(FACEBOOK_GRAPH_API_BASE)"), ("c.ts", None), ("d.ts", "")], "file string, text string")
    requests = spark.createDataFrame([("b.ts", "https://Graph.facebook.com/v1?x=1", "fetch"), ("c.ts", "https://u@API.example.com:443/v2", "axios"), ("c.ts", "/local", "fetch"), ("c.ts", None, "fetch")], "file string, target string, source string")
    imports = spark.createDataFrame([("a.ts", "@anthropic-ai/sdk"), ("a.ts", "./own"), ("d.ts", "next/server"), ("d.ts", "next-auth/react"), ("d.ts", "node:fs"), ("d.ts", "@prisma/client"), ("d.ts", "@prisma/client"), ("d.ts", None)], "file string, specifier string")
    got = {(r.file, r.name, r.service_kind, r.target, r.host, r.package, r.source) for r in extract.external_services(files, requests, imports).collect()}
    assert got == {
        ("a.ts", "Prisma ORM", "orm", "", "", "", "prisma-call"), ("a.ts", "Anthropic Claude", "ai-sdk", "", "", "@anthropic-ai/sdk", "import"),
        ("b.ts", "Facebook Graph API", "http-api", "https://graph.facebook.com", "graph.facebook.com", "", "literal"), ("b.ts", "Facebook Graph API", "http-api", "https://Graph.facebook.com/v1", "graph.facebook.com", "", "fetch"),
        ("c.ts", "api.example.com", "http-api", "https://u@API.example.com:443/v2", "api.example.com", "", "axios"),
        ("d.ts", "Next.js Runtime", "framework", "", "", "next", "import"), ("d.ts", "NextAuth", "auth", "", "", "next-auth", "import"), ("d.ts", "Prisma ORM", "orm", "", "", "@prisma/client", "import"),
    }


def test_node_paths(spark):
    deep = [(str(i), str(i - 1) if i else None, f"n{i}") for i in range(20)] + [("x", "gone", None)]
    got = {r.id: (r.path, r.depth) for r in graph.node_paths(spark.createDataFrame(deep, "id string, parent string, name string")).collect()}
    assert got["19"] == ("/".join(f"n{i}" for i in range(20)), 20) and got["0"] == ("n0", 1) and got["x"] == ("", 1) and len(got) == 21
    with pytest.raises(ValueError):
        graph.node_paths(spark.createDataFrame([("a", "b", "a"), ("b", "a", "b")], "id string, parent string, name string"))
