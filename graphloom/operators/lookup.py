"""A persisted lookup of a graph: which nodes say a word, and what lies next to a node (A1).

Below ``path`` lie five tables, each in folders by a checksum of its key, so that a question reads the folders of its
keys only: ``nodes`` by id, ``edges`` by the node they leave in either direction, ``values`` (normalised value to field
and node) by value, ``grams`` (runs of one to three characters to the values that hold them) by run, and ``counts`` of
values for each run. A search for a part of a value reads the one run of it that the fewest values hold, and compares
the values found; what it gives is all that a scan of the nodes gives.

A row of ``grams`` holds values that differ in their last characters only, as their common ``stem`` and a text of their
``tails``, each of ``width`` characters: a run of the stem is told once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import written
from . import selectors
from .graph import steps

#: Folders of each table, and the ways a folder's rows are dealt when they are written.
BUCKETS, FILES = 64, 16
#: Characters of the longest run that is kept, and of a value's tail.
RUN, TAIL = 3, 2
#: The tables, and those that each kind of question reads.
TABLES = ("nodes", "edges", "values", "grams", "counts")
SAYING, SEARCH = ("nodes", "values"), ("nodes", "values", "grams", "counts")


def bucket(c: Column) -> Column:
    """The folder of a key."""
    return F.pmod(F.crc32(c.cast("binary")), F.lit(BUCKETS)).cast("int")


def _bucket(text: str) -> int:
    return crc32(text.encode()) % BUCKETS


def said(nodes: DataFrame) -> DataFrame:
    """id, field, value: everything that a node says, trimmed and in lower case; empty values are left out, what is
    said twice is there twice."""
    one = lambda field, c: F.array(F.struct(F.lit(field).alias("field"), c.alias("value")))
    every = [one(c, F.col(c)) for c in ("id", "name", "file")]
    if "meta" in nodes.columns:
        every.append(F.coalesce(F.transform(F.map_entries("meta"), lambda e: F.struct(F.concat(F.lit("meta:"), e["key"]).alias("field"), e["value"].alias("value"))), F.array().cast("array<struct<field:string,value:string>>")))
    if "tags" in nodes.columns:
        every.append(F.coalesce(F.transform("tags", lambda t: F.struct(F.lit("tag").alias("field"), t.alias("value"))), F.array().cast("array<struct<field:string,value:string>>")))
    found = nodes.select("id", F.explode(F.concat(*every)).alias("x")).select("id", "x.field", T.normal(F.col("x.value")).alias("value"))
    return found.where("value <> ''")


def _runs(value: Column, after: Column) -> Column:
    """The distinct runs of one to ``RUN`` characters of a value that end behind its first ``after`` characters."""
    first = lambda n: F.greatest(after - n + 2, F.lit(1))
    last = lambda n: F.length(value) - n + 1
    of = lambda n: F.when(last(n) >= first(n), F.transform(F.sequence(first(n), last(n)), lambda i: F.substring(value, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, RUN + 1)]))


def runs(value: Column) -> Column:
    """The distinct runs of one to ``RUN`` characters of a value."""
    return _runs(value, F.lit(0))


def grams(values: DataFrame) -> DataFrame:
    """run, stem, width, tails: of the texts ``value``, which may repeat, those that hold each run; none is told twice for a
    run."""
    width = F.least(F.length("value"), F.lit(TAIL))
    cut = values.select(F.expr(f"left(value, length(value) - least(length(value), {TAIL}))").alias("stem"), width.alias("width"), F.right("value", width).alias("tail"))
    # Both aggregations keep to this one exchange.
    once = cut.repartition("stem", "width").distinct()
    stems = once.groupBy("stem", "width").agg(F.array_sort(F.collect_list("tail")).alias("tails"))
    of_stem = runs(F.col("stem"))
    whole = F.transform(of_stem, lambda r: F.struct(r.alias("run"), F.array_join("tails", "").alias("tails")))
    ending = lambda t: F.array_except(_runs(F.concat("stem", t), F.length("stem")), of_stem)
    own = F.flatten(F.transform("tails", lambda t: F.transform(ending(t), lambda r: F.struct(r.alias("run"), t.alias("tails")))))
    return stems.select("stem", "width", F.explode(F.concat(whole, own)).alias("x")).select("x.run", "stem", "width", "x.tails")


def _write(df: DataFrame, path: str, key: str, rest: str, once: bool = False) -> None:
    """A table in folders by its key, each file in the key's order; repeated rows count as one if ``once``."""
    dealt = df.withColumn("bucket", bucket(F.col(key))).withColumn("_file", F.pmod(F.xxhash64(rest), F.lit(FILES))).repartition("bucket", "_file")
    if once:
        dealt = dealt.distinct()
    dealt.drop("_file").sortWithinPartitions("bucket", key, *([] if rest == key else [rest])).write.partitionBy("bucket").parquet(path)


def build(nodes: DataFrame, edges: DataFrame, path: str, tables: Iterable[str] = TABLES) -> Lookup:
    """Writes the lookup of a graph below ``path``, which must not exist. Nodes have id, type, name, file, and may have
    area, tags and meta; edges have src, dst and type. A node without id and an edge without an end are left out.

    ``tables`` names those to write, if not every kind of question will be asked: ``SAYING`` for values as a whole,
    ``SEARCH`` for parts of values, "edges" for neighbours; ``grams`` are made from ``values`` and ``counts`` from them.
    """
    nodes, edges = nodes.where("id IS NOT NULL"), edges.where("src IS NOT NULL AND dst IS NOT NULL")
    read = lambda name: nodes.sparkSession.read.parquet(f"{path}/{name}")
    if "nodes" in tables:
        _write(nodes, f"{path}/nodes", "id", "id")
    if "edges" in tables:
        _write(steps(edges, "both").drop("src", "dst"), f"{path}/edges", "from_id", "to_id")
    if "values" in tables:
        _write(said(nodes), f"{path}/values", "value", "id", once=True)
    if "grams" in tables:
        _write(grams(read("values").select("value")), f"{path}/grams", "run", "stem")
    if "counts" in tables:
        _write(read("grams").groupBy("run").agg(F.sum(F.length("tails") / F.col("width")).cast("long").alias("n")), f"{path}/counts", "run", "run")
    return Lookup(nodes.sparkSession, path)


class Lookup:
    """The tables of a lookup that ``build`` has written, and what is asked of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str, keys: Iterable[str] | None = None) -> DataFrame:
        """A table, or the folders of the given keys."""
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df if keys is None else df.where(F.col("bucket").isin(sorted({_bucket(k) for k in keys})))

    def values_with(self, needle: str) -> DataFrame:
        """value: the distinct values that contain ``needle``, whatever its case."""
        n = needle.strip().lower()
        size = min(RUN, len(n))
        asked = sorted({n[i : i + size] for i in range(len(n) - size + 1)})
        # One row for each run of the needle at most.
        counts = {r["run"]: r["n"] for r in self.table("counts", asked).where(F.col("run").isin(asked)).collect()}
        rarest = min(asked, key=lambda r: (counts.get(r, 0), r))
        tails = F.transform(F.sequence(F.lit(0), (F.length("tails") / F.col("width")).cast("int") - 1), lambda i: F.substring(F.col("tails"), i * F.col("width") + 1, F.col("width")))
        held = self.table("grams", [rarest]).where(F.col("run") == rarest).select("stem", F.explode(tails).alias("tail"))
        return held.select(F.concat("stem", "tail").alias("value")).where(F.contains("value", F.lit(n)))

    def _nodes(self, ids: DataFrame) -> DataFrame:
        # Written, so that the join with a whole table is planned by their real size.
        ids = written(ids.select("id").distinct().withColumn("bucket", bucket(F.col("id"))), "lookup-ids")
        return self.table("nodes").join(ids, ["bucket", "id"], "left_semi").drop("bucket")

    def narrowed(self, needle: str) -> DataFrame:
        """The nodes that say ``needle`` in any field or tag; all nodes if it is empty."""
        if not needle.strip():
            return self.table("nodes").drop("bucket")
        found = written(self.values_with(needle).withColumn("bucket", bucket(F.col("value"))), "lookup-values")
        return self._nodes(self.table("values").join(found, ["bucket", "value"], "left_semi"))

    def saying(self, value: str, *fields: str) -> DataFrame:
        """The nodes one of whose fields (default: any) is ``value``, whatever its case: one folder of values is read."""
        n = value.strip().lower()
        found = self.table("values", [n]).where(F.col("value") == n)
        return self._nodes(found.where(F.col("field").isin(*fields)) if fields else found)

    def near(self, ids: DataFrame) -> DataFrame:
        """id, direction, other, type: a row for each edge of the given nodes."""
        ids = written(ids.select(F.col("id").alias("from_id")).distinct().withColumn("bucket", bucket(F.col("from_id"))), "lookup-ids")
        found = self.table("edges").join(ids, ["bucket", "from_id"], "left_semi")
        side = F.when(F.col("direction") == "upstream", "in").otherwise("out").alias("direction")
        return found.select(F.col("from_id").alias("id"), side, F.col("to_id").alias("other"), "type")

    def steps(self, direction: str = "both") -> DataFrame:
        """The edges as ``graph.walk`` takes them."""
        down = F.col("direction") == "downstream"
        ends = {"src": F.when(down, F.col("from_id")).otherwise(F.col("to_id")), "dst": F.when(down, F.col("to_id")).otherwise(F.col("from_id"))}
        found = self.table("edges").drop("bucket").withColumns(ends)
        return found if direction == "both" else found.where(F.col("direction") == direction)

    def search(self, name: str = "", tag: str = "", **asked) -> DataFrame:
        """``selectors.search`` (F6) on the nodes that say the name, or else the tag."""
        return selectors.search(self.narrowed(name or tag), name=name, tag=tag, **asked)

    def ranked(self, query: str) -> DataFrame:
        """``selectors.ranked``."""
        return selectors.ranked(self.narrowed(query), query)

    def start(self, query: str, kind: str | None = None, **facet: str) -> DataFrame:
        """``selectors.start``."""
        return selectors.start(self.narrowed(query), query, kind, **facet)

    def suggestions(self, query: str, *kinds: str, most: int = 3) -> DataFrame:
        """``selectors.suggestions``."""
        return selectors.suggestions(self.narrowed(query), query, kinds or selectors.SUGGESTED, most)
