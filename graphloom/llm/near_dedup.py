"""Near dedup: MinHash signatures joined by a multi-index Hamming join, links confirmed on full shingle sets.

A signature has SLOTS slots of 16 bits. It is split into CHUNKS chunks; two signatures that differ in at most
DISTANCE = CHUNKS * (ERRORS + 1) - 1 slots differ in at most ERRORS slots of some chunk (pigeonhole). Each chunk is
indexed once for every choice of ERRORS slots to leave out, so such a pair shares a key: the join by key finds every
pair within that distance.

No bucket's pairs are all written. Equal sets are one class. Members of a bucket are first compared with its least
member; as the order is the same in all buckets, a dense group has few such leads. Links are cut down to forests inside
tasks. A second step compares, for what is still in different components, the members of a bucket outside its largest
component with all others inside tasks, in blocks bounded in members and bytes, and gives out the links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import require, table, written
from .words import mixed, shingles, utf8, word_hashes

SLOTS, CHUNKS, ERRORS = 60, 12, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Pairs farther apart than this are not confirmed: at 0.8 similar sets, under 1 in 100,000 are. With ``far=SLOTS``
#: every pair that shares a key is.
FAR = 27
WIDTH = SLOTS // CHUNKS
LEFT_OUT = list(combinations(range(WIDTH), ERRORS))
#: Members of a bucket, and shingles of theirs, that one task compares with as many others.
MEMBERS, MEMBER_SHINGLES = 1024, 1 << 22
#: Links that a task holds while it cuts them down to a forest.
FOREST = 1 << 20
_MULTIPLY = np.random.default_rng(4).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """SLOTS 16-bit slots of a set of shingle hashes."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (_MULTIPLY[:, None] * found[None, at : at + 4096]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def text_hash() -> Column:
    return F.xxhash64("text").alias("hash")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, set_key (binary, equal for equal sets), sig (binary): a row per row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for raw in utf8(t.as_py() for t in batch.column("text")):
                s = shingles(word_hashes(raw))
                n.append(len(s))
                keys.append(np.array([s.sum(dtype=np.uint64), mixed(s).sum(dtype=np.uint64)]).tobytes() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "hash", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text").mapInArrow(run, "doc_id long, hash long, n_shingles long, set_key binary, sig binary")


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys (rows x number of chunk and left-out choices) of 16-bit signatures; the low 8 bits name the choice."""
    wide, out = sigs.astype(np.uint64), []
    for c in range(CHUNKS):
        chunk = wide[:, c * WIDTH : (c + 1) * WIDTH]
        for left in LEFT_OUT:
            h = np.full(len(wide), len(out) + 1, dtype=np.uint64)
            for i in range(WIDTH):
                if i not in left:
                    h = mixed(h * np.uint64(0x10001) + chunk[:, i] + np.uint64(1))
            out.append((h & ~np.uint64(0xFF)) | np.uint64(len(out)))
    return np.stack(out, axis=1)


def keys(classes: DataFrame) -> DataFrame:
    """key, id: one row per class and index key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                k = index_keys(np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, SLOTS))
                ids = np.repeat(part.column("id").to_numpy(zero_copy_only=False), k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def members_of_buckets(classes: DataFrame) -> DataFrame:
    """key, id, lead, n: members of buckets of two or more, with the least of them.

    Buckets are counted map-side first. Both sides of the join are dealt by its key alone, so that Spark splits the
    partitions of frequent keys.
    """
    rows = keys(classes)
    shared = written(rows.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets")
    return rows.join(shared.hint("merge"), "key")


def near(pairs: DataFrame, classes: DataFrame, far: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose signatures are at most ``far`` slots apart."""
    sig = classes.select("id", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                keep = pa.array((x != y).sum(axis=1) <= far)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, repeats: bool) -> DataFrame:
    """id, shingles (binary, sorted uint64) of the classes with these ids, from the text of one member each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                made = [shingles(word_hashes(raw)).tobytes() for raw in utf8(t.as_py() for t in part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text")
    if repeats:
        texts = texts.dropDuplicates(["doc_id", "hash"])
    chosen = classes.join(ids, "id").select("id", F.col("best.doc_id").alias("b_id"), F.col("best.hash").alias("b_hash"))
    found = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("hash") == F.col("b_hash")))
    return found.select("id", "text").mapInArrow(run, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


class Joined:
    """Union-find by the least id."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def root(self, c: int) -> int:
        top, way = self.top, []
        while (up := top.get(c, c)) != c:
            way.append(c)
            c = up
        for x in way:
            top[x] = c
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart until now."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)
        return a != b


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b), b the least id that a task's links join with a: each task gives out at most one for each id.

    ``links`` (a, b) are dealt by a first. A task holds FOREST links at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Joined(), 0

        def give() -> pa.RecordBatch:
            ids = [x for x in held.top if held.root(x) != x]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held.root(x) for x in ids], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                held.join(a, b)
            n += len(batch)
            if n >= FOREST:
                yield give()
                held, n = Joined(), 0
        yield give()

    return links.repartition("a").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, comp: the least id that each linked id reaches. Labels fall along links and then along themselves."""
    links = written(forest(links), "near-links")
    ends = links.select("a", "b").union(links.select("b", "a"))
    ends = written(ends.union(links.select("a", "a")).union(links.select("b", "b")).toDF("id", "to").distinct(), "near-ends")
    labels = written(ends.groupBy("id").agg(F.min("to").alias("comp")), "near-labels")
    while True:
        reached = ends.join(labels.toDF("to", "far"), "to").groupBy("id").agg(F.min("far").alias("comp"))
        jumped = reached.join(labels.toDF("comp", "far"), "comp").select("id", F.least("comp", "far").alias("comp"))
        new = written(jumped, "near-labels")
        settled = new.toDF("id", "now").join(labels, "id").where("now <> comp").isEmpty()
        labels = new
        if settled:
            return labels


def close_pairs(key: int, x: np.ndarray, y: np.ndarray, comp_x: np.ndarray, comp_y: np.ndarray, same: bool, far: int = FAR) -> np.ndarray:
    """Rows (i, j) of signatures ``x`` and ``y`` at most ``far`` apart, in different components, with ``key`` as the
    first key they share; ``same``: both are one list, and i < j."""
    out = []
    for at in range(0, len(x), 64):
        differ = x[at : at + 64, None, :] != y[None, :, :]
        hit = (differ.sum(axis=2) <= far) & (comp_x[at : at + 64, None] != comp_y[None, :])
        if same:
            hit &= np.arange(at, at + len(differ))[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(hit)
        wrong = differ[i, j].reshape(-1, CHUNKS, WIDTH)
        chunk = np.argmax(wrong.sum(axis=2) <= ERRORS, axis=1)
        wrong = wrong[np.arange(len(i)), chunk]
        fits = np.stack([~np.delete(wrong, leave, axis=1).any(axis=1) for leave in LEFT_OUT], axis=1)
        first = chunk * len(LEFT_OUT) + np.argmax(fits, axis=1)
        mine = first == (key & 0xFF)
        out.append(np.stack([i[mine] + at, j[mine]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def common(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets: one by one for a few pairs, else by products of membership matrices."""
    if len(pairs) <= 64:
        return np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    shared = np.bincount(at) > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    owner, at = owner[shared[at]], column[at[shared[at]]]
    total = np.zeros(len(pairs))
    for low in range(0, int(shared.sum()), 4096):
        inside = (at >= low) & (at < low + 4096)
        m = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        m[owner[inside], at[inside] - low] = 1
        total += (m[: len(left)] @ m[len(left) :].T)[pairs[:, 0], pairs[:, 1]]
    return total.astype(np.int64)


def remaining(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, far: int) -> DataFrame:
    """Links (a, b) between components, by ids of components: their members share a bucket and are similar enough.

    Only buckets of three or more that hold several components take part. The members of a bucket's largest component
    meet the others only, in blocks of at most about MEMBERS rows and MEMBER_SHINGLES shingles; a longer set has a
    block of its own. Each pair is compared once in all, by the first key it shares, on full sets; within a task,
    components that a link has joined are not compared again.
    """
    comp = F.coalesce("comp", "id").alias("comp")
    m = members.where("n > 2").select("key", "id").join(labels, "id", "left").join(classes.select("id", "n_shingles"), "id").select("key", "id", comp, "n_shingles")
    m = written(m, "near-mixed")
    each = m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    top = each.groupBy("key").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / MEMBERS), F.ceil(w / MEMBER_SHINGLES)).cast("int")
    top = written(top.select("key", F.col("main.comp").alias("main"), blocks(F.col("main.n"), F.col("main.w")).alias("of_main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("of_rest")), "near-blocks")
    m = m.join(top, "key")
    in_main = F.col("comp") == F.col("main")
    place = F.xxhash64("id")
    m = m.withColumn("own", F.when(in_main, F.pmod(place, F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(place, F.col("of_rest"))).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)))
    m = m.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp")
    m = m.join(classes.select("id", "sig"), "id").join(sets, "id").select("key", "i", "j", "own", "id", "comp", "sig", "shingles")

    def linked(rows: list) -> set[tuple[int, int]]:
        key, i, j = rows[0][:3]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return set()
        x, y = (np.frombuffer(b"".join(r[6] for r in side), "<u2").reshape(-1, SLOTS) for side in (left, right))
        pairs = close_pairs(key, x, y, np.array([r[5] for r in left]), np.array([r[5] for r in right]), i == j, far)
        a, b = ([np.frombuffer(r[7], np.uint64) for r in side] for side in (left, right))
        size_a, size_b = (np.array([len(s) for s in side]) for side in (a, b))
        joined, out = Joined(), set()
        for at in range(0, len(pairs), 1 << 16):  # what earlier links have joined is left out before it is counted
            some = np.array([p for p in pairs[at : at + (1 << 16)] if joined.root(left[p[0]][5]) != joined.root(right[p[1]][5])], dtype=np.int64).reshape(-1, 2)
            if not len(some):
                continue
            same = common(a, b, some)
            for p, q in some[100 * same >= percent * (size_a[some[:, 0]] + size_b[some[:, 1]] - same)]:
                c, d = left[p][5], right[q][5]
                if joined.join(c, d):
                    out.add((max(c, d), min(c, d)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def give() -> pa.RecordBatch:
            out = linked(held)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != r[:3]:
                    yield give()
                    held = []
                held.append(r)
        if held:
            yield give()

    dealt = m.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInArrow(run, "a long, b long")


def judged(docs: DataFrame, percent: int = 85, far: int = FAR) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, best (none, doc_id, hash): one row per row of ``docs``.

    ``best`` is the row that stays of those linked with this one: the smallest doc_id (rows without one last), then the
    smallest hash. It is null for rows with an empty set.
    """
    rows = written(sketch(docs), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("best")
    classes = rows.where("n_shingles > 0").groupBy("set_key", "sig", "n_shingles").agg(best)
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    members = written(members_of_buckets(classes), "near-members")
    pairs = written(near(members.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), classes, far), "near-pairs")
    repeats = not rows.groupBy("doc_id", "hash").count().where("count > 1").isEmpty()
    sets = written(shingle_sets(docs, classes, members.select("id").distinct(), repeats), "near-sets")
    labels = components(confirmed(pairs, sets, percent))
    # Of one component each in most buckets: few links are left, between components.
    top = components(remaining(members, labels, classes, sets, percent, far))
    comp = classes.select("id", "set_key", "best").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    comp = comp.join(top.toDF("comp", "top"), "comp", "left").select("set_key", "best", F.coalesce("top", "comp").alias("comp"))
    comp = written(comp, "near-components")
    of_comp = written(comp.groupBy("comp").agg(F.min("best").alias("best")), "near-best")
    found = written(comp.drop("best").join(of_comp, "comp").select("set_key", "best"), "near-found")
    return rows.drop("sig").join(found, "set_key", "left").select("doc_id", "hash", "n_shingles", "best")


def near_duplicates(docs: DataFrame, percent: int = 85, far: int = FAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Words are lower-cased (A-Z); a document's set is its distinct 5-word shingles, its whole sequence if it has fewer
    words, and empty without words. Documents with 100 * intersection >= percent * union are linked; component_id is
    the smallest doc_id reachable. Empty sets are linked with nothing. Each row is judged by its own text, whatever
    other rows have its doc_id; rows without doc_id are linked too, and their component_id is null if nothing they
    reach has one. Texts of any length count whole; an empty table gives an empty result.
    """
    component = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    found = judged(docs, percent, far).select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 80, far: int = FAR) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the one with the smallest doc_id.

    Rows without doc_id come last, equal doc_ids go by a hash of the text; rows that repeat both doc_id and text stay
    or go together. Rows without words stay.
    """
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash")))
    dropped = written(judged(docs, percent, far).where(~stays).select(F.col("doc_id").alias("__gl_id"), F.col("hash").alias("__gl_hash")).distinct(), "near-dropped")
    return docs.join(dropped, F.col("doc_id").cast("long").eqNullSafe(F.col("__gl_id")) & (F.xxhash64("text") == F.col("__gl_hash")), "left_anti")


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {
    "op4_near_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * same >= 85 * (na.n + nb.n - same)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id FROM d UNION SELECT r.root, e.b FROM r JOIN e ON r.doc_id = e.a),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
