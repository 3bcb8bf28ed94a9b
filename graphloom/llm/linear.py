"""Hashed logistic regression: bounded labelled sample, follow-the-regularised-leader training, distributed scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import require

#: Hashed features; the last index is the bias.
SLOTS = 1 << 18
#: The most labelled rows that a model is fitted on: those with the smallest hash of doc_id.
SAMPLE = 6000

#: A text to (feature indices, values), both of one length, each index once.
Featurise = Callable[[str | None], tuple[np.ndarray, np.ndarray]]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, featurise: Featurise, rows: int = SAMPLE) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(label, features) of at most ``rows`` labelled documents.

    Only (doc_id, label) of the sample is sent to the documents, at most ``rows`` pairs; features are made where the
    documents are read. Null labels and labels of no document are left out; of several labels the largest holds, and of
    several documents with one doc_id that of the smallest hash of its text, so no more than ``rows`` reach the driver.
    """
    require(labels, "doc_id", label)
    picked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [featurise(t.as_py()) for t in batch.column("text")]
            made = [x if isinstance(x, list) else [x] for x in made]
            cols = [[len(x) for x in made]] + [[b"".join(np.asarray(v[k], t).tobytes() for v in x) for x in made] for k, t in ((0, "<i4"), (1, "<f4"))]
            sizes = [[len(v[0]) for v in x] for x in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "hash")), pa.array(sizes, pa.list_(pa.int32())), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["doc_id", "y", "hash", "sizes", "at", "value"])

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", F.xxhash64("text").alias("hash"), "text")
    made = joined.mapInArrow(run, "doc_id long, y int, hash long, sizes array<int>, at binary, value binary")
    found = made.groupBy("doc_id", "y").agg(F.min_by(F.struct("sizes", "at", "value"), "hash").alias("x")).select("doc_id", "y", "x.*").collect()
    out = []
    for r in sorted(found, key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["at"])):
        cuts = np.cumsum(r["sizes"])[:-1]
        out.append((r["y"], list(zip(np.split(np.frombuffer(r["at"], "<i4"), cuts), np.split(np.frombuffer(r["value"], "<f4"), cuts), strict=True))))
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list, epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, positive_weight: float = 1.0, swapped_weight: float = 0.0, evidence_only: bool = False, least_df: int = 1) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader (proximal), one example at a time.

    ``rows`` are as ``sample`` gives them. If an example has more than one feature set, the others are the same text
    with terms swapped: ``swapped_weight`` times the squared difference of the scores is added to its loss.
    ``evidence_only``: features only speak for label 1, so weights but the bias stay at 0 or above. Features in fewer
    than ``least_df`` examples get no weight.
    """
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    seen = np.zeros(SLOTS + 1, dtype=np.int64)
    for _, sets in rows:
        seen[sets[0][0]] += 1
    seen[SLOTS] = least_df
    bias = np.array([SLOTS], dtype=np.int32)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        penalty = np.where(at == SLOTS, 0.0, l1)
        w = np.where((np.abs(zi) <= penalty) | (seen[at] < least_df), 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[at])) / alpha + l2))
        return np.where((w < 0) & (at != SLOTS), 0.0, w) if evidence_only else w

    def update(at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
        n[at] += g * g

    for _ in range(epochs):
        for y, sets in rows:
            (at, x), others = sets[0], sets[1:] if swapped_weight else []
            at, x = np.append(at, bias), np.append(x, np.float32(1))
            w = weights(at)
            p = sigmoid(w @ x)
            update(at, (p - y) * (positive_weight if y else 1.0) * x, w)
            for at2, x2 in others:
                both = np.union1d(at, np.append(at2, bias))
                a, b = np.zeros(len(both)), np.zeros(len(both))
                a[np.searchsorted(both, at)], b[np.searchsorted(both, np.append(at2, bias))] = x, np.append(x2, np.float32(1))
                w = weights(both)
                p, q = sigmoid(w @ a), sigmoid(w @ b)
                update(both, 2 * swapped_weight * (p - q) * (p * (1 - p) * a - q * (1 - q) * b), w)
    return weights(np.arange(SLOTS + 1)).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, featurise: Featurise, *more: str) -> DataFrame:
    """doc_id, score and the columns ``more``: sparse dot products over whole texts, next to where they are read.

    The weights are of one fixed size (1 MB), whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.select("doc_id", "text", *[c for c in more if c not in ("doc_id", "text")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text" or "text" in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            dots = []
            for t in batch.column("text"):
                at, x = first(featurise(t.as_py()))
                dots.append(float(w[at].astype(float) @ x) + float(w[-1]))
            names = [c for c in batch.schema.names if c != "text" or "text" in more]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sigmoid(np.array(dots)), pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(run, f"{schema}, score double")


def first(made):
    return made[0] if isinstance(made, list) else made
