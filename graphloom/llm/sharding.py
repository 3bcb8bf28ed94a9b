"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Each group of equal texts is a vector of shares; vectors go, largest first, to the shard whose residual capacity has
the highest dot product with them. A group stays whole unless it is above a quarter of a shard's share of bytes, tokens
or rows; such a group is packed in pieces of about a 64th. Groups above 1/HEAVY of a total (at most three
times HEAVY of them) are packed first, in one place; all smaller ones, each by its own vector, are packed in tasks of
about PACKED groups, and each task fills its share of the room that the large ones leave in every shard.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, require, table, written

SHARDS, HEAVY = 8, 2048
#: Cells in which slots are counted, and groups that one task packs.
CELLS, PACKED = 8192, 1 << 17
#: A group above 1/WHOLE of a shard's share is cut into pieces of about 1/PIECE of it.
WHOLE, PIECE = 4, 64
#: Weight of bytes, tokens and rows in the dot product: the law is near-equal bytes.
DIMENSIONS = ("bytes", "tokens", "rows")
IMPORTANCE = (16.0, 1.0, 1.0)


def pack(vectors: np.ndarray, shards: int, importance: tuple = IMPORTANCE, total: np.ndarray | None = None, residual: np.ndarray | None = None) -> np.ndarray:
    """The shard of each row of ``vectors`` (items x dimensions), largest first by the weighted share.

    Residuals are counted against an equal split of ``total`` (default: of these items), so the highest dot product is
    the shard that lacks most of what the item brings; ``residual`` (default: all free) is what is left of each shard,
    in these units, and is updated. Ties go to the lower shard.
    """
    total = np.asarray(vectors.sum(axis=0) if total is None else total, dtype=float)
    share = vectors / np.where(total > 0, total, 1) * shards
    weights = np.asarray(importance)
    residual = np.ones((shards, vectors.shape[1])) if residual is None else residual
    out = np.zeros(len(vectors), dtype=int)
    for i in np.argsort(-(share * weights).sum(axis=1), kind="stable"):
        out[i] = s = int(np.argmax(residual @ (share[i] * weights)))
        residual[s] -= share[i]
    return out


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, size, tokens, text_crc32, group, mix: a row per document. Null texts are as empty ones.

    ``mix`` deals the rows of one group: a number of the row, so that rows that repeat everything are dealt as well.
    ``whole`` adds the document itself as ``row``.
    """
    require(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("mix"),
        *[F.struct(*docs.columns).alias("row")] * whole,
    )


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (written) with group's cell, part and shard: parts of heavy groups, or -1."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    count, *total = groups.agg(F.count(F.lit(1)), *[F.sum(c) for c in DIMENSIONS]).first()
    total = [x or 0 for x in total]
    share = F.greatest(*[F.col(c) / F.lit(float(max(t, 1))) for c, t in zip(DIMENSIONS, total, strict=True)])
    pieces = F.when(F.col("share") * shards * WHOLE > 1, F.ceil(F.col("share") * shards * PIECE)).otherwise(1).cast("int")
    # At most 3 * HEAVY rows of 16 bytes.
    heavy = groups.select("group", share.alias("share")).where(F.col("share") > 1 / HEAVY)
    heavy = heavy.select("group", pieces.alias("pieces"), (pieces * F.ceil(F.col("share") * CELLS / pieces)).cast("int").alias("parts"))
    marked = rows.join(F.broadcast(heavy), "group", "left").withColumn("part", F.coalesce(F.pmod("mix", F.col("parts").cast("long")).cast("int"), F.lit(-1)))
    loads = marked.where("part >= 0").groupBy("group", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.min("pieces").alias("pieces"), F.min("parts").alias("parts"))
    # At most 3 * (CELLS + SHARDS * PIECE + 3 * HEAVY) rows reach the driver, whatever the input.
    found = sorted(loads.collect(), key=lambda r: (r["group"], r["part"]))
    items = [(r["group"], r["part"] * r["pieces"] // r["parts"]) for r in found]
    vectors: dict = defaultdict(lambda: np.zeros(len(DIMENSIONS), dtype=np.int64))
    for i, r in zip(items, found, strict=True):
        vectors[i] += [r[c] for c in DIMENSIONS]
    residual = np.ones((shards, len(DIMENSIONS)))
    shard_of = dict(zip(vectors, pack(np.array(list(vectors.values())).reshape(-1, len(DIMENSIONS)), shards, total=total, residual=residual).tolist(), strict=True))
    large = spark.createDataFrame([(r["group"], r["part"], shard_of[i]) for i, r in zip(items, found, strict=True)], "group long, part int, shard int")
    packers = max(1, -(-count // PACKED))

    def run(own: pa.Table) -> pa.Table:
        names = own.column("group").to_numpy()
        order = np.argsort(names, kind="stable")
        v = np.stack([own.column(c).to_numpy() for c in DIMENSIONS], axis=1)[order]
        mine = v.sum(axis=0) / np.where(np.asarray(total) > 0, total, 1) * shards
        room = residual.sum(axis=0)
        left = residual * np.where(room > 0, mine / np.where(room > 0, room, 1), 0)
        return pa.table({"group": names[order], "shard": pa.array(pack(v, shards, total=total, residual=left), pa.int32())})

    small = groups.join(F.broadcast(heavy.select("group")), "group", "left_anti").withColumn("packer", F.pmod(F.xxhash64("group"), F.lit(packers)))
    small = small.groupBy("packer").applyInArrow(run, "group long, shard int")
    few, many = marked.where("part >= 0"), marked.where("part < 0")
    few = few.join(F.broadcast(large), ["group", "part"]).withColumn("cell", F.col("group"))
    many = many.join(small, "group").withColumn("cell", F.pmod(F.col("group"), F.lit(CELLS)))
    return few.unionByName(many)


def _slotted(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard and slot, counted in cells of about 1/CELLS of a total, so no task holds a large group."""
    placed = written(_placed(rows, shards), "shard-placed")
    # At most CELLS for each shard and the parts of heavy groups.
    cells = sorted(placed.groupBy("cell", "part", "shard").count().collect(), key=lambda r: (r["shard"], r["part"], r["cell"]))
    plan, before = [], [0] * shards
    for r in cells:
        plan.append((r["cell"], r["part"], r["shard"], before[r["shard"]]))
        before[r["shard"]] += r["count"]
    plan = rows.sparkSession.createDataFrame(plan, "cell long, part int, shard int, first long")
    inside = Window.partitionBy("cell", "part", "shard").orderBy("doc_id", "text_crc32", "mix")
    return placed.join(F.broadcast(plan), ["cell", "part", "shard"]).withColumn("slot", F.col("first") + F.row_number().over(inside) - 1)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, group, shard, slot: one row per row of ``docs``; slots are gapless from 0 in a shard.

    Equal texts stay together unless they are above 1/WHOLE of a shard's share of all bytes, tokens or rows; the pieces
    of such a group are packed like groups, and its rows are dealt by a number of their own, so rows that repeat doc_id
    and text are spread too. Rows without text have size 1 and are packed like others; repeated rows count each; an
    empty table gives an empty result.
    """
    return _slotted(written(measured(docs), "shard-rows"), shards).select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes the documents with their shard as Parquet folders ``shard=0`` to ``shard=N``; returns the assignment.

    If documents have a column ``shard``, the folders are called ``shard_`` (and so on).
    """
    found = written(_slotted(written(measured(docs, whole=True), "shard-rows"), shards), "shards")
    name = "shard"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    found.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return found.select("doc_id", "size", "text_crc32", "group", "shard", "slot")


def op6_sharding(spark, sf_dir):
    found = assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
