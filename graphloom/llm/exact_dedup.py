"""Exact dedup with an extendible-hash index on shared files (native: DataFrame operations only).

Keys are 64-bit hashes of the normalised text. A directory addresses buckets by the leading bits of the key. Buckets
are stored on shared files; while one holds too many keys, its keys are written anew, split by one more bit, and the
directory doubles where that needs more bits than it has. Texts go to buckets through the directory and are combined
there by all their bytes; texts whose keys collide form a chain. The index is written dealt by bucket, so that each
owner task holds whole key ranges, and rows are looked up through slot and bucket. The directory begins at the depth
that the number of keys makes likely, so splits and doublings run where a bucket is over its capacity all the same.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, require, table, written

#: Keys that a bucket takes before it is split; more where the directory would else outgrow MAX_DEPTH.
CAPACITY = 4096
#: Leading key bits the directory may use: at most 2**18 slots whatever the input.
MAX_DEPTH = 18


def _prefix(key: Column, depth: int) -> Column:
    return F.call_function("shiftrightunsigned", key, F.lit(64 - depth)) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(slot, bucket_depth, bucket), one row a slot of the directory, and its depth, so at most 2**max_depth rows.

    ``keys`` has a column ``key``. The first depth is the one at which as many keys, evenly spread, fit; each round
    rewrites the keys of overfull buckets only. A quarter of the directory's slots are enough for all keys, as the
    capacity grows with them; a bucket that is still overfull at ``max_depth`` (keys that share so many bits) keeps
    what it has.
    """
    stored = written(keys.select("key").distinct(), "dedup-keys")
    n = stored.count()
    capacity = max(capacity, ceil(n / (1 << max(0, max_depth - 2))))
    depth = min(max_depth, max(0, ceil(log2(n / capacity)) if n else 0))
    stored = stored.withColumn("bucket", _prefix(F.col("key"), depth))
    levels = []
    while True:
        loads = written(stored.groupBy("bucket").agg(F.count(F.lit(1)).alias("load")), "dedup-loads")
        over = loads.where(F.col("load") > capacity).select("bucket")
        last = depth == max_depth or over.isEmpty()
        levels.append((depth, loads.select("bucket") if last else loads.where(F.col("load") <= capacity).select("bucket")))
        if last:
            break
        depth += 1
        # At most 2**max_depth rows of one number.
        stored = written(stored.join(F.broadcast(over), "bucket").select("key", _prefix(F.col("key"), depth).alias("bucket")), "dedup-split")
    slots = None
    for d, buckets in levels:
        width = 1 << (depth - d)
        own = buckets.select(F.explode(F.sequence(F.col("bucket") * width, F.col("bucket") * width + (width - 1))).alias("slot"), F.lit(d).alias("bucket_depth"), "bucket")
        slots = own if slots is None else slots.union(own)
    return written(slots.coalesce(1), "dedup-directory"), depth


def keyed(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """doc_id, norm, key: the normalised text and its hash; fewer ``hash_bits`` make collisions (for tests)."""
    norm = lower_ascii(F.col("text"))
    key = F.xxhash64("norm")
    if hash_bits < 64:
        key = F.shiftleft(_prefix(key, hash_bits), 64 - hash_bits)
    return docs.select("doc_id", norm.alias("norm")).withColumn("key", key)


def build_index(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, index), both on shared files.

    rows: doc_id, key, sha (binary), bucket_depth, bucket, one per input row. index: bucket_depth, bucket, key, sha,
    keep_id, group_size, chain: one per distinct text, where equality is that of all bytes, not of hashes; ``chain``
    counts the texts that share a key. Copies are combined before they are dealt out, so a group of any size costs one
    row per task.
    """
    require(docs, "doc_id", "text")
    with_key = keyed(docs, hash_bits)
    rows = written(with_key.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "dedup-rows")
    slots, depth = directory(rows, capacity, max_depth)
    slot = _prefix(F.col("key"), depth).alias("slot")
    # At most 2**MAX_DEPTH rows of three numbers, some 5 MB.
    to_bucket = lambda df: df.select("*", slot).join(F.broadcast(slots), "slot").drop("slot")
    texts = to_bucket(with_key).groupBy("bucket_depth", "bucket", "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = texts.withColumn("sha", F.unhex(F.sha2("norm", 256))).drop("norm").repartition("bucket_depth", "bucket")
    chain = F.row_number().over(Window.partitionBy("bucket_depth", "bucket", "key").orderBy("sha"))
    return to_bucket(rows), written(owned.withColumn("chain", chain), "dedup-index")


def decisions(docs: DataFrame, **index_options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket_depth, bucket, chain: one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays; a null doc_id is below any other, and if all are null, ``keep_id`` is null and each such row
    counts as kept. Rows that repeat both a doc_id and its text are one document: each is reported alike. An empty
    table gives an empty result. Texts of any length are hashed and compared whole.

    A row finds its text through its slot, in its bucket, by key and the digest of its bytes. Both sides of that join are dealt by its keys
    alone, so that Spark splits the partition of a large group.
    """
    rows, index = build_index(docs, **index_options)
    joined = rows.join(index, ["bucket_depth", "bucket", "key", "sha"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket_depth", "bucket", "chain"
    )


def deduplicated(docs: DataFrame, **index_options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, exactly one per distinct text.

    Only the dropped rows' (doc_id, sha) pairs meet the texts: small sides are broadcast by Spark's own size check,
    larger ones are joined by shuffle.
    """
    found = decisions(docs, **index_options)
    own = docs.withColumn("__gl_sha", F.unhex(F.sha2(lower_ascii(F.col("text")), 256)))

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("__gl_id"), F.unhex("text_sha256").alias("__gl_sha2"))

    same = F.col("doc_id").eqNullSafe(F.col("__gl_id")) & (F.col("__gl_sha") == F.col("__gl_sha2"))
    kept = own.join(pairs(found.where(~F.col("kept"))), same, "left_anti")
    # What is left can repeat only as the same document (doc_id and text alike).
    repeats = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if repeats.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(pairs(repeats), same, "left_anti")
    more = kept.join(pairs(repeats), same, "left_semi").dropDuplicates(["doc_id", "__gl_sha"])
    return once.unionByName(more).select(*docs.columns)


def op7_exact_dedup(spark, sf_dir):
    return decisions(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
}
