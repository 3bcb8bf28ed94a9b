"""Phrases whose words occur together more often than their parts would, per language.

The first pass over the texts finds which phrases can be frequent. Each task counts the phrases of a chunk of texts and
sends (slot, count) to hash partitions, whose number grows with the input. A partition merges what arrives into one
Misra-Gries summary of more counters than its mass divided by the threshold: whatever it takes off is below the
threshold in all, so every frequent phrase survives, and a survivor is dropped only if its count and all that was taken
off stay below the threshold. The survivors of all partitions are marked in a bit filter of bounded size. The second
pass counts the phrases in the filter exactly, by their words; a phrase that is in it by chance is counted too and then
left out, so the filter saves shuffling and decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, require, table, written
from .words import mixed, word_hashes

#: Occurrences of a frequent phrase, its most words, and the share of them (percent) a longer phrase takes over.
LEAST, WORDS, INSIDE = 10, 3, 50
#: Phrases reported per language.
TOP = 2000
#: Bytes of text whose phrases a task counts at once, and bytes of text per hash partition.
CHUNK, SHARE = 1 << 23, 1 << 24
#: Bits of the filter in all, and of one partition's part of it at most.
FILTER, SLICE = 1 << 28, 1 << 23
#: Ways a part that occurs in many phrases is dealt.
SALT = 8
_DELIMITERS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def counted(raw: bytes) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]], int]:
    """Of a text whose pieces are cut by line breaks and words by blanks: its words, then, for phrases of 1, 2 and 3
    words, (rows of word numbers, counts), and how many words it has."""
    cut = pc.split_pattern(pa.array([raw.replace(b"\n", b" \n ")], pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
    names, code = cut.dictionary.to_pylist(), cut.indices.to_numpy().astype(np.int64)
    places = {n: i for i, n in enumerate(names)}
    code = code[code != places.get(b"", -1)]
    code[code == places.get(b"\n", -1)] = -1
    total = int((code >= 0).sum())
    counts = np.bincount(code[code >= 0], minlength=len(names))
    held = np.flatnonzero(counts)
    found, rows, number = [(held[:, None], counts[held])], np.arange(len(names))[:, None], code
    for size in range(2, WORDS + 1):
        # ``number``: of the phrase of size - 1 words that begins at each place, or -1.
        left, right = number[:-1], code[size - 1 :]
        ok = (left >= 0) & (right >= 0) & (number[1:] >= 0)
        keys, inverse, n = np.unique(left[ok] * len(names) + right[ok], return_inverse=True, return_counts=True)
        number = np.full(len(left), -1)
        number[ok] = inverse
        rows = np.concatenate([rows[keys // len(names)], (keys % len(names))[:, None]], axis=1)
        found.append((rows, n))
    return names, found, total


def hashes(lang: str, names: list[bytes], rows: np.ndarray, of_words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each phrase of one language."""
    x = np.full(len(rows), crc32(lang.encode()) << 8 | rows.shape[1], dtype=np.uint64)
    for k in range(rows.shape[1]):
        x = mixed(x * _STEP + of_words[rows[:, k]])
    return x


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], list, int]]:
    """lang and what ``counted`` gives, for chunks of about CHUNK bytes of text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            raw = text.as_py().encode().translate(_DELIMITERS)
            held.setdefault(lang.as_py(), []).append(raw)
            size += len(raw)
            if size >= CHUNK:
                for k, v in held.items():
                    yield k, *counted(b"\n".join(v))
                held, size = {}, 0
    for k, v in held.items():
        yield k, *counted(b"\n".join(v))


def word_numbers(names: list[bytes]) -> np.ndarray:
    """A hash of each name; the two that are no words have any."""
    return word_hashes(b" ".join(n if n not in (b"", b"\n") else b"-" for n in names), lower=False)


class Summary:
    """Misra-Gries: at most ``capacity`` counters; no count is above the true one, and none lacks more than ``taken``."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts.astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=int)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(self.keys) > self.capacity:
            # The counter next after the last that fits goes to 0, and all others are lowered as much.
            cut = int(-np.partition(-self.counts, self.capacity)[self.capacity])
            left = self.counts > cut
            self.keys, self.counts, self.taken = self.keys[left], self.counts[left] - cut, self.taken + cut

    def at_least(self, least: int) -> np.ndarray:
        """Every key whose true count is ``least`` or more, and some below, if the capacity exceeds mass / least."""
        return self.keys[self.counts + self.taken >= least]


def survivors(docs: DataFrame, parts: int, least: int, bits: int) -> DataFrame:
    """part, marks: for each hash partition, the bits of the slots that can be frequent. ``docs``: lang, text."""
    # A count of ``least`` says all that a larger one would.
    kind = np.dtype("u1" if least < 256 else "<u4")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, found, _ in chunks(batches):
            of_words = word_numbers(names)
            x = np.concatenate([hashes(lang, names, rows, of_words) for rows, _ in found])
            n = np.minimum(np.concatenate([n for _, n in found]), least).astype(kind)
            part, slot = (x >> np.uint64(32)) % np.uint64(parts), x & np.uint64(0xFFFFFFFF)
            order = np.argsort(part << np.uint64(32) | slot)
            part, slot, n = part[order].astype(np.int32), slot[order].astype("<u4"), n[order]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array([slot[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([n[i:j].tobytes() for i, j in cuts], pa.binary())], names=["part", "slots", "counts"])

    def merge(arrived: pa.Table) -> pa.Table:
        slots = [np.frombuffer(s.as_py(), "<u4") for s in arrived.column("slots")]
        counts = [np.frombuffer(c.as_py(), kind) for c in arrived.column("counts")]
        mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
        summary, held, waiting = Summary(mass // least + 1), [], 0
        for s, c in zip(slots, counts, strict=True):
            held.append((s, c))
            waiting += len(s)
            if waiting > summary.capacity:
                summary.merge(np.concatenate([s for s, _ in held]), np.concatenate([c for _, c in held]))
                held, waiting = [], 0
        if held:
            summary.merge(np.concatenate([s for s, _ in held]), np.concatenate([c for _, c in held]))
        marks = np.zeros(bits, dtype=np.uint8)
        marks[_bit(summary.at_least(least), bits)] = 1
        return pa.table({"part": arrived.column("part")[:1], "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    sent = docs.mapInArrow(send, "part int, slots binary, counts binary")
    return sent.groupBy("part").applyInArrow(merge, "part int, marks binary")


def _bit(slot: np.ndarray, bits: int) -> np.ndarray:
    return (slot.astype(np.uint64) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, n: every phrase of 1 to 3 words that occurs ``least`` times or more, counted exactly; a row of
    size 0 has the language's number of words. Null texts are empty, a null language is ``und``."""
    require(docs, "lang", "text")
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text", lower_ascii(F.col("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Slices of 64 bits are the smallest, so the filter stays within its bound.
    parts = min(max(1, -(-size // SHARE)), FILTER // 64)
    bits = min(FILTER // parts, SLICE) // 8 * 8
    marks = np.zeros((parts, bits // 8), dtype=np.uint8)
    # FILTER / 8 bytes at most (32 MB), whatever the input.
    for r in survivors(docs, parts, least, bits).toLocalIterator():
        marks[r["part"]] = np.frombuffer(r["marks"], np.uint8)
    shared = spark.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        schema = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
        for lang, names, found, total in chunks(batches):
            of_words = word_numbers(names)
            yield pa.RecordBatch.from_arrays([[lang], pa.array([0], pa.int32()), [""], [total]], schema=schema)
            for rows, n in found:
                x = hashes(lang, names, rows, of_words)
                part, bit = (x >> np.uint64(32)) % np.uint64(parts), _bit(x & np.uint64(0xFFFFFFFF), bits)
                may = (held[part.astype(np.int64), bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
                phrases = [b" ".join([names[i] for i in r]).decode() for r in rows[may].tolist()]
                k = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([rows.shape[1]] * k, pa.int32()), pa.array(phrases, pa.string()), pa.array(n[may], pa.int64())], schema=schema)

    found = docs.mapInArrow(count, "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least))


def _salt():
    return F.expr(f"pmod(xxhash64(phrase), {SALT})").cast("int")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all phrases of 2 and 3 words that occur ``least`` times or more.

    a, l, r count the phrase, its first and its other part at the cut of the lowest score, floor(10^6 * a * a / (l * r)),
    the first of equal ones; n counts the language's words. Phrases that a longer frequent one holds are left out if it
    has ``inside`` percent of their occurrences. Words are lower-cased A-Z, within pieces between stops and line breaks.
    Null and empty texts have no words; texts and words of any length, repeated rows and further columns are fine; an
    empty table gives an empty result.
    """
    counts = written(frequent(docs, least), "phrases")
    words = counts.where("size = 0").select(F.col("lang").alias("lang_"), F.col("n").alias("words"))
    phrases = counts.where("size > 1").withColumnRenamed("n", "a")
    # Parts such as an article are in many phrases: they are dealt SALT ways, and counts are held ready in each.
    salted = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), "n", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"), _salt().alias("salt"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(salted.withColumnsRenamed({"part": side, "n": name}), ["lang", side, "salt"])
    score = F.expr("(cast(1000000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut"))
    held = phrases.where("size = 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring_index(phrase, ' ', -2)"))).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("cut.a")))
    # One row per language, held ready in each of the ways that its phrases are dealt.
    words = words.withColumn("salt_", F.explode(F.array(*map(F.lit, range(SALT)))))
    left = left.join(words, (F.col("lang") == F.col("lang_")) & (_salt() == F.col("salt_")))
    return left.select("lang", "phrase", "cut.a", "cut.l", "cut.r", F.col("words").alias("n"), "cut.score")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases by score, then a, descending, then phrase; ``rank`` from 1."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First among those of a hash, so that no task sorts a whole language; SALT * top rows of one are left at most.
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", _salt()).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op12_collocations(spark, sf_dir):
    return ranked(collocations(table(spark, sf_dir, "documents"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
    sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) v(k)),
    counts AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL),
    phrases AS (SELECT * FROM counts WHERE size > 1 AND a >= 10),
    cuts AS (
        SELECT p.*, c.k, array_to_string(string_split(phrase, ' ')[1:c.k], ' ') AS first, array_to_string(string_split(phrase, ' ')[c.k + 1:], ' ') AS rest
        FROM phrases p, (VALUES (1), (2)) c(k) WHERE c.k < p.size),
    scored AS (
        SELECT c.lang, c.phrase, c.size, c.a, l.a AS l, r.a AS r, c.k, 1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS score
        FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    held AS (
        SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM phrases WHERE size = 3)
        GROUP BY lang, phrase)
    SELECT l.lang, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) AS rank, l.phrase, a, l, r, n, score::BIGINT AS score
    FROM lowest l JOIN sizes s ON s.lang = l.lang LEFT JOIN held h ON h.lang = l.lang AND h.phrase = l.phrase
    WHERE longer IS NULL OR 100 * longer < 50 * a
    QUALIFY row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, l.phrase) <= 2000
    """
}
