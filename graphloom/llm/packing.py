"""Packing along a space-filling curve.

Each document becomes a hashed vector of its token ids, projected to three dimensions by fixed random directions and
placed on a Hilbert curve. Documents are laid end to end in curve order and cut at every sequence boundary, so that
neighbours share sequences and only the last sequence has padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import require, table, written
from .tokens import encoder, vocabulary

LENGTH = 2048
#: The id that ends each document.
END = 1
HASHED, DIMS, BITS = 1024, 3, 10


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of integer ``points`` (rows x dims, 0 <= x < 2**bits), by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def places(vectors: np.ndarray) -> np.ndarray:
    """Curve index of hashed vectors (rows x HASHED): unit length, projected to N(0, 1) like coordinates, quantised."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = vectors / np.where(norm > 0, norm, 1) @ np.random.default_rng(8).standard_normal((HASHED, DIMS))
    return hilbert(np.clip((flat + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, 2 or 4 bytes an id, without the end id), width, n (with it), curve: a row per document."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        w = enc.dtype.itemsize
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = list(enc.encode(part.column("text").to_pylist()))
                hashed = np.array([np.bincount(np.frombuffer(x, enc.dtype) % HASHED, minlength=HASHED) for x in ids], dtype=float).reshape(-1, HASHED)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([w] * len(ids), pa.int32()), pa.array([len(x) // w + 1 for x in ids], pa.int64()), pa.array(places(hashed), pa.int64())],
                    names=["doc_id", "ids", "width", "n", "curve"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, width int, n long, curve long")


def starts(tokens: DataFrame) -> DataFrame:
    """row, at: where each document begins in the stream. Only (row, curve, n) are moved.

    Range partitions by (curve, hash of the row), so documents with one curve index are dealt evenly too; a partition's
    rows are summed in order, and the partitions' totals (a row each) give the offsets.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tokens.select("row", "n", "curve", F.xxhash64("row").alias("mix")).repartitionByRange(parts, "curve", "mix")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "pack-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total")).select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("curve", "mix", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return inner.join(totals, "part").select("row", (F.col("base") + F.col("inside")).alias("at"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids as little-endian uint32 if
    ``with_ids``. A document of any length is cut at each sequence boundary; null and empty texts are one end id.
    Repeated rows are packed each; equal curve places go by a hash of the row; an empty table gives an empty result.
    """
    tokens = written(tokenized(docs, path or vocabulary("word_bpe_49k.json")).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    joined = tokens.drop("curve").join(starts(tokens), "row").select("doc_id", "ids", "width", "n", "at")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), 500):
                out = []
                for r in batch.slice(at, 500).to_pylist():
                    ids = np.append(np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4"), np.uint32(end)).astype("<u4")
                    begin = 0
                    while begin < r["n"]:
                        sequence, offset = divmod(r["at"] + begin, length)
                        stop = min(r["n"], begin + length - offset)
                        raw = ids[begin:stop].tobytes()
                        out.append((r["doc_id"], begin, stop - begin, crc32(raw), r["n"], sequence, offset) + (raw,) * with_ids)
                        begin = stop
                types = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    return joined.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary uint32), n: whole sequences from pieces with ids; a group is one sequence long."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n"))


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
