"""Mixing sources to target weights (native: DataFrame operations only).

Weighted sampling without replacement after Efraimidis and Spirakis: each document draws an exponential key
-ln(u) / quality; within a source, documents are taken in ascending order of that key until the budget is met. A
source whose budget is at least its own size first gives that many complete epochs; only the rest is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, require, table, written

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: A source's budget stops at so many times its size.
MAX_EPOCHS = 3
#: Key ranges that a source is dealt into for prefix sums.
RANGES = 1024


def _numbered(d: DataFrame) -> DataFrame:
    """Rows with ``repeat``: 0, or of rows that repeat doc_id, text and source their number from 0, whichever has which.

    They are numbered within the partitions they were written in, behind those of the partitions before, so no task holds
    all repeats of a row.
    """
    same = ["doc_id", "hash", "source"]
    once, some = d.where("rows IS NULL").withColumn("repeat", F.lit(0).cast("long")), d.where("rows IS NOT NULL")
    counts = some.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in (*same, "part")], before.alias("before"))
    on = F.col("part") == F.col("_part")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = F.row_number().over(Window.partitionBy(*same, "part").orderBy("hash"))
    some = some.withColumn("own", own).join(counts, on).withColumn("repeat", F.col("before") + F.col("own") - 1)
    return once.unionByName(some.select(*once.columns))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size, hash, key and the columns ``more``: a row per row of ``docs``.

    size: words in the text (null: 0). quality: 1 / (1 + |characters per word - 7|), the weight of the draw: text of
    ordinary word lengths comes first; 1 / 8 without words. u: 52 bits of md5(doc_id), so reruns agree. Where rows of
    several texts share a doc_id, or have none, the text of the smallest hash draws by the doc_id alone and each other
    one by doc_id and hash, so every text has a draw of its own; rows that repeat both draw by their number too.
    """
    require(docs, "doc_id", "text", "source")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = written(docs.select("doc_id", "source", words.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("part"), *more), "mix-texts")
    several = d.groupBy(F.col("doc_id").alias("s_id")).agg(F.min("hash").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("s_id", "first", "rows")
    d = _numbered(d.join(several, F.col("doc_id").eqNullSafe(F.col("s_id")), "left"))
    quality = F.when(F.col("size") > 0, 1.0 / (1.0 + F.abs(F.col("chars") / F.col("size") - 7.0))).otherwise(0.125)
    drawn = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("hash") > F.col("first"), F.concat(F.lit(" "), F.col("hash"))).otherwise(""), F.when(F.col("repeat") > 0, F.concat(F.lit("#"), F.col("repeat"))).otherwise(""))
    bits = F.conv(F.substring(F.md5(drawn.cast("binary")), 1, 13), 16, 10).cast("double")
    return d.withColumn("quality", quality).select("doc_id", "source", "size", "hash", (-F.log((bits + 0.5) / float(1 << 52)) / F.col("quality")).alias("key"), *more)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source, so small whatever the documents.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all sizes in that proportion. A
    target stops at ``max_epochs`` times its source's size; the excess goes to the others by weight until none is
    above. Sources fill up in ascending order of size / weight, so one prefix of that order is at its limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # The rate each weight unit would get if this source and all after it were below their limits.
    s = s.withColumn("rate", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("left_w")).withColumn("capped", F.col("cap") <= F.col("rate") * F.col("w"))
    rate = F.min(F.when(~F.col("capped"), F.col("rate"))).over(everything)
    first = F.min(F.when(~F.col("capped"), F.col("left_w") * -1)).over(everything)
    s = s.withColumn("free_w", first).withColumn("final_rate", F.max(F.when(F.col("left_w") * -1 == F.col("free_w"), F.col("rate"))).over(everything))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("final_rate") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, more: tuple = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken and the columns ``more``: one row per row of ``docs``.

    taken: words that the mix takes of the document, repeats counted: ``epochs`` whole readings, and in the partial
    epoch the words that the budget still allows, so that a source's sum is its target rounded down. The one document
    on the budget's edge is cut. No document exceeds ``max_epochs`` times its size.

    A null source is a source of its own; null and empty texts have size 0 and take part with 0 words; documents with
    equal keys go by doc_id and the text's hash, then by ``more``; repeated rows count each. An empty table gives an empty result.

    Prefix sums run in ranges of the key: no task holds a source, only one of its ``RANGES`` ranges, and the ranges'
    sums (at most sources x RANGES rows) carry the offsets.
    """
    d = written(sized(docs, *more), "mix-sizes").withColumn("range", F.floor(F.col("key") / (F.col("key") + 1.5) * RANGES).cast("int"))
    sums = written(d.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    t = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "before")
    t = t.select(F.col("source").alias("t_source"), "source_size", "target")
    offsets = offsets.join(t, F.col("o_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    offsets = offsets.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "hash", *more).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"), *more)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix reads them: each row as often as it is taken, all columns kept.

    Rows are whole: the document on the budget's edge is read once more if at least half of it is within the budget.
    Documents that the budget leaves out do not appear. Each row has its own decision, whatever its doc_id: rows that
    repeat a doc_id, or have none, are told apart by a row number.
    """
    # Written with their numbers, as those would differ if the rows were read again in other partitions.
    rows = written(docs.withColumn("__gl_row", F.monotonically_increasing_id()), "mix-rows")
    times = F.col("epochs") + F.when((F.col("taken") - F.col("epochs") * F.col("size")) * 2 >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)
    plan = mix(rows, more=("__gl_row",), **options).select("__gl_row", times.cast("int").alias("__gl_times")).where("__gl_times > 0")
    joined = rows.join(plan, "__gl_row")
    return joined.withColumn("__gl_copy", F.explode(F.sequence(F.lit(1), F.col("__gl_times")))).select(*docs.columns)


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, coalesce(length(text), 0) AS chars,
    CAST('0x'||substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS bits FROM documents),
k AS (SELECT *, -ln((bits + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / CASE WHEN size > 0 THEN 1::DOUBLE / (1::DOUBLE + abs(chars::DOUBLE / size - 7::DOUBLE)) ELSE 0.125::DOUBLE END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w, 3::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0) AS room, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w FROM o
  WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT arg_max(room / left_w, left_w) AS rate FROM f WHERE cap > room / left_w * w),
t AS (SELECT source, source_size, least(cap, coalesce(rate * w, cap)) AS target FROM o, r),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
}
