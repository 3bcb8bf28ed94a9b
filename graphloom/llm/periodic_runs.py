"""Stretches of words that repeat with a period, found by block convolution.

A run has smallest period q and at least ``EXPONENT`` * q words. With B the power of two at or below q, it holds a block
of B words that begins at a multiple of B and recurs q words on, all inside the run. So at each dyadic scale B every
aligned block is held against the window of the next distances B to 2 * B - 1: the sums of squared differences at all
distances come from number-theoretic transforms, exact modulo a prime, and a zero sum, once compared, is an occurrence.
Its distance seeds an extension to both sides. Blocks are only transformed if each of their words occurs again within
2 * B words, as any occurrence needs, and if no run found at a smaller scale spans block and window, as all that recurs
there is known. The words of many documents lie in one flat array.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, require, table

#: The least words of a run, and the least multiple of its period.
LEAST, EXPONENT = 6, 4
#: 15 * 2^27 + 1, a prime with roots of unity of every order up to 2^27; 31 generates its units.
PRIME, ROOT = 2013265921, 31
#: Numbers that are transformed, and words that are searched, at once.
AT_ONCE, WORDS = 1 << 21, 1 << 21
_P = np.uint64(PRIME)
_WORD = re.compile(WORD)


def _twiddles(n: int, inverse: bool) -> np.ndarray:
    w, out = pow(ROOT, (PRIME - 1) // n, PRIME), np.ones(max(n // 2, 1), dtype=np.uint64)
    w, filled = pow(w, -1, PRIME) if inverse else w, 1
    while filled < n // 2:
        out[filled : 2 * filled] = out[:filled] * np.uint64(pow(w, filled, PRIME)) % _P
        filled *= 2
    return out


def transformed(x: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two long), in bit-reversed order."""
    m, n = x.shape
    size = n
    while size > 1:
        parts = x.reshape(m, n // size, 2, size // 2)
        a, b = parts[:, :, 0], parts[:, :, 1]
        x = np.stack([(a + b) % _P, (a + _P - b) * _twiddles(size, False) % _P], axis=2).reshape(m, n)
        size //= 2
    return x


def restored(x: np.ndarray) -> np.ndarray:
    """Rows from their transforms."""
    m, n = x.shape
    size = 2
    while size <= n:
        parts = x.reshape(m, n // size, 2, size // 2)
        a, b = parts[:, :, 0], parts[:, :, 1] * _twiddles(size, True) % _P
        x = np.stack([(a + b) % _P, (a + _P - b) % _P], axis=2).reshape(m, n)
        size *= 2
    return x * np.uint64(pow(n, -1, PRIME)) % _P


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Modulo the prime, sum over j of (block[j] - window[o + j])^2 for offsets o from 0 to B - 1; windows are 2 * B long."""
    size = blocks.shape[1]
    x = np.zeros(windows.shape, dtype=np.uint64)
    x[:, :size] = blocks[:, ::-1]
    products = restored(transformed(x) * transformed(windows) % _P)[:, size - 1 : 2 * size - 1]
    squares = np.zeros((len(windows), 2 * size + 1), dtype=np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    own = (blocks * blocks % _P).sum(axis=1, dtype=np.uint64)[:, None]
    there = squares[:, size : 2 * size] - squares[:, :size]
    return (own + there + 2 * (_P - products)) % _P


def find(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, ordered; ``ids``: the words of all documents, ``ends``: where each ends."""
    n = len(ids)
    counts = np.diff(np.concatenate([[0], ends]))
    doc = np.repeat(np.arange(len(ends)), counts)
    first = np.repeat(ends - counts, counts)  # where the document begins
    # How far on the same word of the same document comes next.
    order = np.lexsort((np.arange(n), ids, doc))
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    following = np.full(n, n + 1)
    following[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # From which word on all words up to ``covered[i]`` lie in one run that begins at or before word i.
    covered = np.zeros(n, dtype=np.int64)
    found = [np.zeros((0, 4), dtype=np.int64)]
    numbers = ids.astype(np.uint64) + np.uint64(1)
    size = 1
    longest = int(counts.max()) if len(counts) else 0
    while EXPONENT * size <= longest:
        near = np.concatenate([[0], np.cumsum(following >= 2 * size)])
        # Aligned blocks that have room for themselves and one occurrence.
        start = np.flatnonzero((np.arange(n) - first) % size == 0)
        start = start[start + 2 * size <= ends[doc[start]]]
        start = start[near[start + size] == near[start]]
        until = np.minimum(start + 3 * size - 1, ends[doc[start]])
        start = start[covered[start] < until]
        seeds = [np.zeros((0, 2), dtype=np.int64)]
        step = max(1, AT_ONCE // (2 * size))
        for i in range(0, len(start), step):
            seeds.append(_seeds(numbers, start[i : i + step], size, ends, doc))
        runs = _extended(ids, np.concatenate(seeds), size, first, ends, doc, covered)
        for _, s, length, _ in runs.tolist():
            covered[s : s + length] = np.maximum(covered[s : s + length], s + length)
        found.append(runs)
        size *= 2
    runs = np.concatenate(found)
    # Of one stretch, the smallest period is its own.
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    keep = np.ones(len(runs), dtype=bool)
    keep[1:] = (runs[1:, 1] != runs[:-1, 1]) | (runs[1:, 2] != runs[:-1, 2])
    runs = runs[keep]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1]))]
    runs[:, 1] -= first[runs[:, 1]]
    return runs


def _seeds(numbers: np.ndarray, start: np.ndarray, size: int, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (place of a block, distance of an occurrence from ``size`` to 2 * size - 1)."""
    at = start[:, None] + np.arange(3 * size)
    inside = at < ends[doc[start]][:, None]
    words = np.where(inside, numbers[np.minimum(at, len(numbers) - 1)], np.uint64(0))
    zero = squared_differences(words[:, :size], words[:, size:]) == 0
    i, o = np.nonzero(zero)
    i, o = i[inside[i, o + 2 * size - 1]], o[inside[i, o + 2 * size - 1]]
    # A sum may be zero modulo the prime only.
    equal = np.ones(len(i), dtype=bool)
    for j in range(size):
        equal &= words[i, j] == words[i, o + size + j]
    return np.stack([start[i[equal]], o[equal] + size], axis=1)


def _extended(ids: np.ndarray, seeds: np.ndarray, size: int, first: np.ndarray, ends: np.ndarray, doc: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """Runs from seeds: neighbouring blocks with one distance are one stretch, which goes on for less than a block."""
    seeds = seeds[covered[seeds[:, 0]] < seeds[:, 0] + seeds[:, 1] + size]
    if not len(seeds):
        return np.zeros((0, 4), dtype=np.int64)
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    new = np.ones(len(seeds), dtype=bool)
    new[1:] = (np.diff(seeds[:, 1]) != 0) | (np.diff(seeds[:, 0]) != size) | (doc[seeds[1:, 0]] != doc[seeds[:-1, 0]])
    at, period = seeds[new].T
    last = np.append(seeds[:, 0][np.flatnonzero(new)[1:] - 1], seeds[-1, 0]) + size  # where its last block ends
    lower, upper = first[at], ends[doc[at]]
    low, high = at.copy(), last.copy()
    going_down, going_up = np.arange(len(at)), np.arange(len(at))
    while len(going_down) or len(going_up):
        k = going_down[low[going_down] > lower[going_down]]
        k = k[ids[low[k] - 1] == ids[low[k] - 1 + period[k]]]
        low[k] -= 1
        going_down = k
        k = going_up[high[going_up] + period[going_up] < upper[going_up]]
        k = k[ids[high[k]] == ids[high[k] + period[k]]]
        high[k] += 1
        going_up = k
    length = high + period - low
    good = length >= np.maximum(LEAST, EXPONENT * period)
    return np.stack([doc[at], low, length, period], axis=1)[good]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with a periodic end in one document of ten, by the checksum of doc_id (null: of no text)."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed: one row per row of ``docs``.

    A run is a stretch of words with smallest period q, of at least 6 and 4 * q words, that goes no further to either
    side; ``collapsed`` is the text without the words after the first period of a run, joined by single blanks.
    ``change`` may give other words for a document. Null and empty texts have no words, no runs and an empty text; whole
    texts of any length are searched, in memory proportional to the longest; repeated rows count each; doc_id may be
    null; an empty table gives an empty result.
    """
    require(docs, "doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        known: dict[str, int] = {}
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0)
        runs = find(words, ends)
        of = [np.zeros((0, 4), dtype=np.int64)] * len(texts)
        cuts = np.flatnonzero(np.diff(runs[:, 0])) + 1
        for own in np.split(runs, cuts) if len(runs) else []:
            of[own[0, 0]] = own
        collapsed = []
        for t, own in zip(texts, of, strict=True):
            if len(own):
                edge = np.zeros(len(t) + 1, dtype=np.int64)
                np.add.at(edge, own[:, 1] + own[:, 3], 1)
                np.add.at(edge, own[:, 1] + own[:, 2], -1)
                t = [w for w, d in zip(t, np.cumsum(edge[:-1]).tolist(), strict=True) if not d]
            collapsed.append(" ".join(t))
        found = [[{"start": s, "length": n, "period": q} for _, s, n, q in own.tolist()] for own in of]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = _WORD.findall(t.as_py() or "")
                ids.append(i)
                texts.append(change(i, words) if change else words)
                held += len(words)
                if held >= WORDS:
                    yield part(ids, texts)
                    ids, texts, held = [], [], 0
            yield part(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)
    # Runs are in order of start and period, so only a greater ratio replaces one.
    greater = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(greater(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    b = F.col("best")
    return found.select("doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {}
