"""Each bound query against its SQL, on the smallest tables; operators on small hand-made frames."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from graphloom import plans
from graphloom.operators import graph, search
from graphloom.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def told(df):
    text = lambda v: "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(name, spark, db):
    assert told(plans.queries()[name](spark, SF).toPandas()) == told(db.sql(plans.oracle_sql()[name]).df())


def test_traversal_with_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    found = {(r.depth, r.src, r.dst) for r in graph.traverse(e, start, 2).collect()}
    assert found == {(1, "a", "b"), (2, "b", "a"), (2, "b", "b"), (2, "b", "c")}
    assert graph.traverse(e, start, 1, "upstream").count() == 1


def test_upsert(spark):
    old = spark.createDataFrame([("a", "x", 1, "old")], "id string, title string, hits int, created string")
    new = spark.createDataFrame([("a", "y", 1, "new"), ("b", "z", 1, "new")], old.schema)
    got = {tuple(r) for r in files.upsert(old, new, "id", kept=("created",), counted="hits").collect()}
    assert got == {("a", "y", 2, "old"), ("b", "z", 1, "new")}


def test_longest_prefix(spark):
    df = spark.createDataFrame([("src/app/x.ts",), ("src/application/y.ts",), ("lib",)], "path string")
    got = {r.path: r.area for r in search.longest_prefix(df, [("src", "one"), ("src/app", "two"), ("lib", "three")]).collect()}
    assert got == {"src/app/x.ts": "two", "src/application/y.ts": "one", "lib": "three"}


def test_suffix_matches_of_all_pages(spark, tmp_path):
    paths = ["a.org/x/1", "a.org/y/1", "b.org/x/1", "x/1", "1", "b.org/z/2", "z/2", "c.org"]
    spark.createDataFrame([(i, "https://" + p + "/" * (i % 2)) for i, p in enumerate(paths)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for c in {"/".join(p.split("/")[-2:]) for p in paths}:
        want[c] = sum(p == c or p.endswith("/" + c) or c.endswith("/" + p) for p in paths)
    assert {r.changed: r.n for r in plans.queries()["suffix_match_impact"](spark, str(tmp_path)).collect()} == want


def test_edge_summary_has_all_types(spark, db):
    orders = {}
    for c, o in db.sql("SELECT o_custkey, o_orderkey FROM orders").fetchall():
        orders.setdefault(f"customer:{c}", set()).add(f"order:{o}")
    found = {}
    for r in plans.queries()["edge_summary"](spark, SF).where("type = 'requests'").collect():
        found.setdefault(r.src, {})[r.place] = r.dst
    assert {c: [x[k] for k in sorted(x)] for c, x in found.items()} == {c: sorted(x)[:8] for c, x in orders.items()}


def test_effective_follows_long_chains(spark):
    calls = spark.createDataFrame([(1, i, i + 1) for i in range(11)] + [(1, 11, 0)], "script long, method long, callee long")
    requests = spark.createDataFrame([(1, 11, "r")], "script long, method long, request string")
    assert {r.method for r in graph.effective(calls, requests).collect()} == set(range(12))
    with pytest.raises(ValueError, match="further than 2"):
        graph.effective(calls, requests, depth=2)
