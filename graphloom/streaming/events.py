"""Streams of events and log lines (an extension: the survey's engine has no runtime streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import upsert
from ..sources.storage import shared_dir


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files below ``path`` as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, highest: tumbling windows. State holds the windows that end at most ``late`` before the
    newest event seen in earlier batches; events of older windows are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "highest")


def drained(counts: DataFrame, name: str, keys: tuple = ("start", "event_type")) -> DataFrame:
    """Runs an aggregated stream over all that is there and gives each key's last state, from shared storage.

    Only keys that a batch changes are written. Each batch writes a folder of its own, so a batch that runs again after
    a failure replaces what it wrote.
    """
    spark, out = counts.sparkSession, shared_dir(counts.sparkSession, name)
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
    query = query.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/states/batch={i:09d}")).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], counts.schema)
    states = spark.read.schema(counts.schema).option("basePath", f"{out}/states").parquet(f"{out}/states/batch=*").withColumn("_batch", F.regexp_extract(F.input_file_name(), "batch=([0-9]+)", 1))
    last = F.max_by(F.struct(*[c for c in counts.columns if c not in keys]), "_batch").alias("last")
    return states.groupBy(*keys).agg(last).select(*keys, "last.*").select(*counts.columns)


def merge_log(lines: DataFrame, out: str, key: str, seq: str, kept: tuple = (), counted: str | None = None, checkpoint: str | None = None):
    """Merges a stream of log lines by ``key`` into versions below ``out``: each batch makes the next one (K5, K6).

    Of lines with one key in a batch the one with the largest ``seq`` holds, for columns ``kept`` that with the
    smallest; ``counted`` is summed over all lines. A repeated batch writes the same version again. Each version is the
    whole table, so batches should be large.
    """

    def merge(df: DataFrame, i: int) -> None:
        value = lambda c: F.sum(c) if c == counted else F.min_by(c, seq) if c in kept else F.max_by(c, seq)
        new = df.groupBy(key).agg(*[value(c).alias(c) for c in df.columns if c != key]).select(*df.columns)
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in df.schema])
        if i:
            new = upsert(df.sparkSession.read.schema(df.schema).parquet(f"{out}/version={i - 1:09d}"), new, key, kept, counted)
        new.write.mode("overwrite").parquet(f"{out}/version={i:09d}")

    return lines.writeStream.option("checkpointLocation", checkpoint or f"{out}/checkpoint").foreachBatch(merge).trigger(availableNow=True).start()
