"""Token files with directly addressable codes.

Ids are split into chunks of ``BITS`` bits, least first. Level k holds the k-th chunk of every id that has one, a
bitmap that says which of them continue on level k + 1, and a directory with the bitmap's rank at each block. Id i is
read by following its rank from level to level, without decoding others; the files are plain bytes, so that only the
bytes on that way are read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import require, shared_dir, table
from .tokens import encoder, vocabulary

MAGIC = b"GLDAC2\0\0"
#: Ids after which a segment ends; documents are never split, so a longer one has a segment of its own.
SEGMENT = 1 << 18
BLOCK_BITS = 512
END = 0
MANIFEST = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("size", pa.int64())])


def dac_levels(ids: np.ndarray) -> list[tuple[int, bytes]]:
    """Each level of uint32 ``ids``: how many chunks it has; chunks, bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8)
        padded = np.zeros(-(-len(rest) // BLOCK_BITS) * BLOCK_BITS, dtype=bool)
        padded[: len(rest)] = more
        blocks = padded.reshape(-1, BLOCK_BITS).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append((len(rest), chunks.tobytes() + np.packbits(padded).tobytes() + ranks.tobytes()))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def segment(doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    """Header (magic, documents, levels, chunks of each), doc_ids, their null flags, where each document begins, levels."""
    levels = dac_levels(ids)
    head = MAGIC + struct.pack(f"<QI{len(levels)}Q", len(doc_ids), len(levels), *(n for n, _ in levels))
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([head, names, np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes(), *(raw for _, raw in levels)])


class Segment:
    """Reads what ``segment`` wrote through ``read(place, size)``, only the bytes that are needed.

    ``segment[i]`` reads one chunk, the bitmap of one block and one rank a level, whatever the segment's length.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 52)
        if head[:8] != MAGIC:
            raise ValueError("not a segment of a token file")
        self.n_docs, levels = struct.unpack_from("<QI", head, 8)
        self.names, at = 20 + 8 * levels, 20 + 8 * levels + 17 * self.n_docs + 8
        self.levels = []
        for n in struct.unpack_from(f"<{levels}Q", head, 20):
            blocks = -(-n // BLOCK_BITS)
            self.levels.append((n, at, at + n, at + n + blocks * BLOCK_BITS // 8))
            at += n + blocks * BLOCK_BITS // 8 + 4 * (blocks + 1)

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for _, chunks, bitmap, ranks in self.levels:
            value |= self.read(chunks + i, 1)[0] << shift
            block, inside = divmod(i, BLOCK_BITS)
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + block * BLOCK_BITS // 8, inside // 8 + 1), np.uint8))
            if not bits[inside]:
                return value
            i = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] + int(bits[:inside].sum())
            shift += 8
        return value

    def documents(self) -> tuple[list, np.ndarray]:
        """doc_ids, and the places of their first ids (one more at the end)."""
        n, raw = self.n_docs, self.read(self.names, 17 * self.n_docs + 8)
        doc_ids, nulls = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        return [None if z else int(x) for x, z in zip(doc_ids, nulls, strict=True)], np.frombuffer(raw, "<u8", n + 1, 9 * n)

    def all(self) -> np.ndarray:
        """Every id, as uint32."""
        out = None
        for n, chunks, bitmap, ranks in reversed(self.levels):
            level = np.frombuffer(self.read(chunks, n), np.uint8).astype(np.uint32)
            if out is not None:
                level[np.unpackbits(np.frombuffer(self.read(bitmap, ranks - bitmap), np.uint8))[:n].astype(bool)] |= out << np.uint32(8)
            out = level
        return out


def opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end: int = END) -> None:
    """Writes the ids of all documents, each ended by ``end``, below ``out`` in ascending doc_id order.

    A task writes the segments of its key range, one behind the other, to a new binary file in ``out``/segments; where
    they lie is a Parquet table in ``out``/manifest: part, start in the part, n_ids, n_docs, file, place, size. Spark
    commits one attempt of each task to the manifest, so what a lost executor leaves is never read. ``out`` is a
    shared folder that tasks reach (file, hdfs, s3, gs).

    Null texts are as empty ones (one end id); null doc_ids come first; rows with one doc_id are dealt and ordered by a
    hash of the text, so none of them meets in one task. Texts count whole; an empty table gives an empty manifest.
    """
    require(docs, "doc_id", "text")
    path = path or vocabulary("byte_bpe_50k.json")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start, place, names, raws, size, rows = encoder(path, True), None, 0, 0, [], [], 0, []
        last, width = np.array([end], enc.dtype).tobytes(), enc.dtype.itemsize
        store, folder = opened(out)
        file = f"segments/{uuid4().hex}.dac"
        store.create_dir(f"{folder}/segments", recursive=True)
        with store.open_output_stream(f"{folder}/{file}") as stream:
            for batch in batches:
                if part is None and len(batch):
                    part = batch.column("part")[0].as_py()
                for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(x.as_py() for x in batch.column("text")), strict=True):
                    names.append(doc_id)
                    raws.append(raw)
                    size += len(raw) // width + 1
                    if size >= SEGMENT:
                        made = segment(names, [len(x) // width + 1 for x in raws], np.frombuffer(last.join(raws) + last, enc.dtype))
                        stream.write(made)
                        rows.append((part, start, size, len(names), file, place, len(made)))
                        start, place, names, raws, size = start + size, place + len(made), [], [], 0
            if raws:
                made = segment(names, [len(x) // width + 1 for x in raws], np.frombuffer(last.join(raws) + last, enc.dtype))
                stream.write(made)
                rows.append((part, start, size, len(names), file, place, len(made)))
        if rows:  # only now that the file is whole
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MANIFEST.types, strict=True)], schema=MANIFEST)

    ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, start long, n_ids long, n_docs long, file string, place long, size long").write.parquet(f"{out}/manifest")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """part, first (ids of all segments before), n_ids, n_docs, file, place, size of each segment in ``out``.

    Parts are in order; their totals, a row each, are summed to the parts' first ids.
    """
    files = spark.read.schema("part int, start long, n_ids long, n_docs long, file string, place long, size long").parquet(f"{out}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # As many rows as parts, which the writer's number of partitions bounds.
    return files.join(F.broadcast(bases), "part").select("part", (F.col("base") + F.col("start")).alias("first"), "n_ids", "n_docs", "file", "place", "size")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files at ``out``; start counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(out)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{folder}/{r['file']}") as file:
                    raw = file.read_at(r["size"], r["place"])
                held = Segment(lambda at, n, raw=raw: raw[at : at + n])
                (doc_ids, at), ids = held.documents(), held.all().astype("<u4")
                at = at.astype(np.int64)
                crc = [crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(at[:-1] + r["first"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest(spark, out).select("first", "file", "place", "size").repartition(parts, "file", "place")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(spark: SparkSession, out: str, i: int, count: Callable[[int], None] = lambda n: None) -> int:
    """The id at place ``i`` of all ids in ``out``: a few reads of at most 64 bytes in one file, nothing else decoded.

    ``count`` is told the size of each read. IndexError beyond the last id.
    """
    found = manifest(spark, out).where((F.col("first") <= i) & (F.col("first") + F.col("n_ids") > i)).first()
    if i < 0 or found is None:
        raise IndexError(i)
    store, folder = opened(out)
    with store.open_input_file(f"{folder}/{found['file']}") as file:

        def read(at: int, n: int) -> bytes:
            count(n)
            return file.read_at(n, found["place"] + at)

        return Segment(read)[i - found["first"]]


def op10_token_files(spark, sf_dir):
    out = shared_dir(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), out)
    return read_tokens(spark, out)


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
