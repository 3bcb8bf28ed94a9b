"""Graph operators: bounded traversal, degrees, merging, summaries."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

DEPTH, DEPTH_FULL = 2, 4


def depth_policy(depth: int | None, focus: str | None = None) -> int:
    """Default 2; a full-stack focus looks at least 4 deep."""
    d = depth if depth and depth > 0 else DEPTH
    return max(d, DEPTH_FULL) if focus == "fullstack" else d


_SIDES = {"downstream": ("src", "dst"), "upstream": ("dst", "src")}


def steps(edges: DataFrame, direction: str = "downstream") -> DataFrame:
    """The edges with ``direction``, ``from_id`` and ``to_id``; both ways, each edge is there twice."""
    chosen = list(_SIDES) if direction == "both" else [direction]
    each = [edges.withColumn("direction", F.lit(d)).withColumn("from_id", F.col(_SIDES[d][0])).withColumn("to_id", F.col(_SIDES[d][1])) for d in chosen]
    return each[0] if len(each) == 1 else each[0].unionByName(each[1])


def sieve(rows: DataFrame, column: str, ids: DataFrame, bits: int = 26) -> DataFrame:
    """The rows whose ``column`` may be one of ``ids`` (id), by a bit of its hash: all that are, and as many others as
    bits are taken by chance. What joins them afterwards moves fewer rows; the bits are 24 MB at most, whatever the input."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = (lambda c: F.shiftright(place(c), 6)), (lambda c: place(c).bitwiseAND(F.lit(63)).cast("int"))
    taken = ids.groupBy(word("id").alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit("id"))).alias("_bits"))
    return rows.join(F.broadcast(taken), (word(column) == F.col("_word")) & (F.getbit("_bits", bit(column)) == 1), "left_semi")


def walk(step: DataFrame, starts: DataFrame, depth: int | None, keys: tuple = (), within: tuple = (), stored: bool = True) -> DataFrame:
    """``keys``, id, depth: the nodes at most ``depth`` steps (from_id, to_id; None: any number) from the starts of the same
    keys, each at its least depth (G1, G2).

    The frontier is made of (keys, node), so any number of sets of starts goes forward in one join a level. Steps that
    have the columns ``within``, which are some of the keys, are taken by sets of the same values only. What is carried
    are nodes, not edges; the steps' ends are written once and read at each level, and each level is written, so
    lineage stays short and AQE picks the join by the frontier's real size. Steps that are but columns of tables need not
    be ``stored``: they are read again at each level, and sieved by the frontier before they move.
    """
    on = [*keys, "id"]
    seen = frontier = written(starts.select(*on).distinct().withColumn("depth", F.lit(0)), "walk-0")
    ends = step.select(*within, "from_id", "to_id")
    if stored and (depth is None or depth > 1):
        ends = written(ends, "steps")
    for d in count(1) if depth is None else range(1, depth + 1):
        near = ends if stored else sieve(ends, "from_id", frontier)
        reached = near.join(frontier.select(*keys, F.col("id").alias("from_id")), [*within, "from_id"]).select(*keys, F.col("to_id").alias("id")).distinct()
        frontier = written(reached.join(seen.select(*on), on, "left_anti").withColumn("depth", F.lit(d)), f"walk-{d}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def edges_from(step: DataFrame, near: DataFrame, depth: int, keys: tuple = (), within: tuple = ()) -> DataFrame:
    """The steps out of walked nodes that are nearer than ``depth``, each once, with the keys and their own depth from 1."""
    nodes = near.where(F.col("depth") < depth).select(*keys, F.col("id").alias("from_id"), (F.col("depth") + 1).alias("depth"))
    return step.join(nodes, [*within, "from_id"]).distinct()


def traverse(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "downstream") -> DataFrame:
    """depth, direction and the edge's columns: breadth-first from ``starts`` (id).

    Every node nearer than ``depth`` gives out each of its edges once, also those back to nodes seen before; ``edges``
    may repeat rows, which are dropped after the join, where few are left.
    """
    step = steps(edges, direction)
    return edges_from(step, walk(step, starts, depth - 1), depth).select("depth", "direction", *edges.columns)


def data_access(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """table, name, reads, writes, actors of the read and write edges found, each edge once."""
    access = found.where(F.col("type").isin("reads", "writes")).dropDuplicates(["src", "dst", "type", "operation"])
    per = access.groupBy("dst").agg(F.count_if(F.col("type") == "reads").alias("reads"), F.count_if(F.col("type") == "writes").alias("writes"), F.count_distinct("src").alias("actors"))
    names = nodes.where("type = 'table'").select(F.col("id").alias("dst"), "name")
    return per.join(names, "dst", "left").select(F.col("dst").alias("table"), F.coalesce("name", "dst").alias("name"), "reads", "writes", "actors")


def degrees(edges: DataFrame) -> DataFrame:
    """id, incoming, outgoing: both ends in one aggregation."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def top_degree(edges: DataFrame, k: int = 16) -> DataFrame:
    d = degrees(edges).select("id", (F.col("incoming") + F.col("outgoing")).alias("degree"))
    return d.orderBy(F.desc("degree"), "id").limit(k)


def merge_nodes(stream: DataFrame, key: str, seq: str, columns: list[str], empty: str = "") -> DataFrame:
    """Last non-empty value of each column by ``seq``; a partial aggregation per key, no sort."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != empty), F.col(seq))).alias(c) for c in columns]
    return stream.groupBy(key).agg(*last)


def first_of(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row by ``seq`` of each key (W6, A21, A22): a partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_first")).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def helpers_apart(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``related_helper``: edges between methods of one file, which a full-stack focus sets apart."""
    m = nodes.where("type = 'method'").select("id", "file")
    a, b = m.toDF("src", "file_a"), m.toDF("dst", "file_b")
    return found.join(a, "src", "left").join(b, "dst", "left").withColumn("related_helper", F.coalesce(F.col("file_a") == F.col("file_b"), F.lit(False))).drop("file_a", "file_b")


def incident(edges: DataFrame, ids: DataFrame, most: int = 25) -> DataFrame:
    """id, type, direction, n, neighbours (the first ``most`` by id, joined) of the given nodes.

    All neighbours are counted; ``neighbours_of`` lists them, a row each.
    """
    near = neighbours_of(edges, ids)
    place = F.row_number().over(Window.partitionBy("id", "type", "direction").orderBy("other"))
    first = near.select("id", "type", "direction", "other").distinct().withColumn("place", place).where(F.col("place") <= most)
    first = first.groupBy("id", "type", "direction").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("neighbours"))
    return near.groupBy("id", "type", "direction").agg(F.count(F.lit(1)).alias("n")).join(first, ["id", "type", "direction"])


def neighbours_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, direction, other, type: a row for each edge of the given nodes."""
    e = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other"), "type"), F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "type"))).alias("x")).select("x.*")
    return e.join(ids.select("id"), "id", "left_semi")


def effective(calls: DataFrame, requests: DataFrame, depth: int | None = None) -> DataFrame:
    """script, method, via_method, request: requests a method reaches through calls within its script.

    Each round joins the new pairs (method, reached) with all known ones, so the way known doubles, until none is new;
    cycles end so too. New pairs after ``depth`` rounds, if it is given, fail the query instead of being cut.
    """
    reach = calls.select("script", "method", F.col("callee").alias("via_method")).distinct()
    new = reach = written(reach, "effective")
    for i in count():
        after = lambda df: df.select("script", F.col("method").alias("via_method"), F.col("via_method").alias("next"))
        on = ["script", "via_method"]
        step = new.join(after(reach), on).union(reach.join(after(new), on)).select("script", "method", F.col("next").alias("via_method")).distinct()
        new = written(step.join(reach, ["script", "method", "via_method"], "left_anti"), f"effective-{i}")
        if new.isEmpty():
            break
        if depth is not None and i >= depth:
            raise ValueError(f"calls reach further than {depth} rounds")
        reach = reach.union(new)
    own = requests.select("script", "method", F.col("method").alias("via_method")).distinct()
    reach = reach.union(own).distinct()
    return reach.join(requests.select("script", F.col("method").alias("via_method"), "request"), ["script", "via_method"]).select("script", "method", "via_method", "request").distinct()


def node_paths(tree: DataFrame, keys: tuple = ()) -> DataFrame:
    """``keys``, id, path, depth: the names from the root to each node of (keys, id, parent, name), joined by '/' (E27).

    Each round doubles the part of the way that is known, so a tree of depth d takes log2(d) joins by id. An unknown
    parent is as none. After as many rounds as any chain of these nodes could take, what is left is a circle, which fails
    the query.
    """
    on = [*keys, "id"]
    known = written(tree.select(*on, F.col("parent").alias("up"), F.coalesce("name", F.lit("")).alias("path"), F.lit(1).alias("depth")), "node-paths")
    for _ in range(known.count().bit_length() + 1):
        if known.where("up IS NOT NULL").isEmpty():
            return known.select(*on, "path", "depth")
        above = known.select(*keys, F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("start"), F.col("depth").alias("more"))
        joined = known.join(above, [*keys, "up"], "left")
        known = written(joined.select(*on, F.col("next").alias("up"), F.concat_ws("/", "start", "path").alias("path"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "node-paths")
    raise ValueError("a node is above itself")
