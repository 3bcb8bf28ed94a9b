"""Helpers that the training-data operators share: shared storage, lineage cuts and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_dir

#: A word, here and in every contract: a maximal run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to shared storage and rereads it: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def require(df: DataFrame, *columns: str) -> None:
    """Raises ValueError for a missing column; further columns of any name do no harm."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def lower_ascii(text):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
