"""Every operator against a brute-force version, on edge cases and on empty tables."""

import re
from zlib import crc32

import numpy as np
import pytest

from graphloom.llm import exact_dedup, mixing, near_dedup, packing, quality, sharding, token_counts, token_files, topk, toxicity
from graphloom.llm.linear import fit, sigmoid
from graphloom.llm.shared import shared_dir
from graphloom.llm.tokens import encoder, vocabulary
from graphloom.llm.words import shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(edge_docs, no_docs):
    for bits, depth in ((64, 18), (64, 0), (1, 18)):  # one bit: every bucket has chains
        found = rows(exact_dedup.decisions(edge_docs, hash_bits=bits, capacity=1, max_depth=depth))
        lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        texts = [(r.doc_id, lower(r.text)) for r in edge_docs.collect()]
        for r in found:
            same = [i for i, t in texts if any(j == r["doc_id"] and u == t for j, u in texts)]
            assert r["group_size"] == len(same) and r["keep_id"] == max((i for i in same if i is not None), default=None)
        assert len(found) == len(texts)
    assert sorted(r["doc_id"] or 0 for r in rows(exact_dedup.deduplicated(edge_docs))) == [0, 2, 4, 5, 6, 7]
    assert exact_dedup.decisions(no_docs).count() == 0


def test_directory_splits_overfull_buckets(spark):
    """As an index that takes keys one by one, splits a full bucket in two and doubles the directory for it."""
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key").union(spark.range(300).selectExpr("id << 50"))
    all_keys = {r.key % (1 << 64) for r in keys.collect()}
    slots, depth = exact_dedup.directory(keys, capacity=100, max_depth=12)
    want, depths, full = {0: set()}, {0: 0}, 0  # slot: keys of its bucket
    for k in all_keys:
        while True:
            held, d = want[k >> (64 - full) if full else 0], depths[k >> (64 - full) if full else 0]
            if len(held) < 100 or d == 12:
                held.add(k)
                break
            if d == full:
                want, depths, full = {s: want[s // 2] for s in range(2 << full)}, {s: depths[s // 2] for s in range(2 << full)}, full + 1
            first = (k >> (64 - d) if d else 0) << (full - d)
            for s in range(first, first + (1 << (full - d))):
                depths[s] = d + 1
                want[s] = {x for x in held if x >> (63 - d) == s >> (full - d - 1)}
            halves = {h: {x for x in held if x >> (63 - d) == h} for h in (first >> (full - d - 1), (first >> (full - d - 1)) + 1)}
            for s in range(first, first + (1 << (full - d))):
                want[s] = halves[s >> (full - d - 1)]
    found = {r["slot"]: (r["bucket_depth"], r["bucket"]) for r in rows(slots)}
    assert depth >= full - 1 and max(d for d, _ in found.values()) <= 12
    loads = {}
    for k in all_keys:
        d, b = found[k >> (64 - depth)]
        assert b == (k >> (64 - d) if d else 0)
        loads[d, b] = loads.get((d, b), 0) + 1
    assert all(n <= 100 or d == 12 for (d, _), n in loads.items()) and len({d for d, _ in loads}) > 2


def test_mixing(edge_docs, no_docs):
    found = rows(mixing.mix(edge_docs))
    assert len(found) == edge_docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    for s in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and sum(r["taken"] for r in own) == int(own[0]["target"])
    assert mixing.mix(no_docs).count() == 0
    assert set(mixing.mixed(edge_docs).columns) == set(edge_docs.columns)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mixing_decides_by_row(spark, doc_id):
    """Documents of one source that share a doc_id, or have none, are taken one by one up to the source's target."""
    docs = spark.createDataFrame([(doc_id, f"{s}{i} " + "word " * (i % 7 + 3), s, f"{s}{i}") for s in "abc" for i in range(120)] + [(doc_id, "same words here", "a", f"r{i}") for i in range(10)], "doc_id long, text string, source string, taken string")
    targets = {r["source"]: r["target"] for r in rows(mixing.mix(docs))}
    found = rows(mixing.mixed(docs))
    for s, target in targets.items():
        assert abs(sum(len(WORD.findall(r["text"])) for r in found if r["source"] == s) - target) <= 10
    assert all(r["taken"] in {f"r{i}" for i in range(10)} or r["text"].startswith(r["taken"] + " ") for r in found)
    c = [r["key"] for r in rows(mixing.sized(docs)) if r["source"] == "c"]
    assert len(set(c)) == 120
    again = rows(mixing.mixed(docs.repartition(3, "text")))
    assert sorted((r["source"], r["text"]) for r in again) == sorted((r["source"], r["text"]) for r in found)


def test_mixing_targets_fill_up(spark):
    t = {r["source"]: r["target"] for r in rows(mixing.targets(spark.createDataFrame([("a", 1), ("b", 100), ("c", 100), (None, 50)], "source string, source_size long")))}
    sizes, weights, left, open_ = {"a": 1, "b": 100, "c": 100, None: 50}, {"a": 5, "b": 2, "c": 1, None: 5}, 251.0, {"a", "b", "c", None}
    want = {}
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * rate >= 3 * sizes[s]}
        if not full:
            want |= {s: weights[s] * rate for s in open_}
            break
        want |= {s: 3.0 * sizes[s] for s in full}
        left, open_ = left - sum(3.0 * sizes[s] for s in full), open_ - full
    assert t == pytest.approx(want)


def test_topk_is_exact(spark):
    r = np.random.default_rng(1)
    data = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    data += [(300, None), (301, [float("nan")] * 8), (302, [1.0, None]), (303, data[3][1]), (303, data[3][1]), (None, [1.0] * 8), (350, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = rows(topk.search(df))
    v = [(i, np.floor(np.array(x, np.float32).astype(float) * 256).astype(int)) for i, x in data if i is not None and x is not None and len(x) == 8 and np.isfinite(x).all()]
    for q, x in v:
        if q % 50 == 0:
            want = sorted(((-int(x @ y), i) for i, y in v if i != q))[:5]
            assert [(-r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert topk.search(df.where("false")).count() == 0


def test_topk_stops_before_the_lists_end(spark):
    """On the given embeddings every query is answered from its bounds: reading ends early in all blocks."""
    found = rows(topk.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), with_depth=True))
    depths = {(r["query_id"], r["depth"]) for r in found}
    assert len({q for q, _ in depths}) == 40 and max(d for _, d in depths) < 0.95
    print("parts of lists read:", sorted(d for _, d in depths))


def test_topk_bounds_hold_for_any_numbers():
    r = np.random.default_rng(11)
    for top, n in ((3, 40), (1000, 200), (1 << 45, 60)):
        x, q = r.integers(-top, top + 1, (n, 6)), r.integers(-top, top + 1, (5, 6))
        own, ids = np.arange(5) * 7, r.permutation(n)
        for i, best, _ in topk.no_random_access(q, x, own, ids):
            want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True)), ids[j]) for j in range(n) if ids[j] != own[i])[:5]
            assert [(-int(s), ids[j]) for j, s in best] == want


def test_near_dedup(spark, edge_docs, no_docs):
    r = np.random.default_rng(2)
    docs, base = [], [f"w{i}" for i in range(120)]
    for i in range(60):
        w = list(base) if i % 2 else [f"v{i}_{j}" for j in range(30)]
        for k in r.integers(0, len(w), r.integers(0, 3)):
            w[k] = f"e{i}_{k}"
        docs.append((i, " ".join(w)))
    df = edge_docs.select("doc_id", "text").where("doc_id IS NOT NULL").selectExpr("doc_id + 100 AS doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in rows(near_dedup.near_duplicates(df))}
    sets = {r.doc_id: set(shingles(word_hashes((r.text or "").encode())).tolist()) for r in df.collect()}
    top = {i: i for i in sets}
    for _ in range(len(sets)):
        new = {i: min([top[j] for j in sets if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])] + [top[i]]) for i in sets}
        if new == top:
            break
        top = new
    assert {i: r["component_id"] for i, r in found.items()} == top
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_pigeonhole_keys():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = r.integers(0, 1 << 16, near_dedup.SLOTS).astype("<u2")
        b = a.copy()
        at = r.choice(near_dedup.SLOTS, near_dedup.DISTANCE, replace=False)
        b[at] ^= 1
        x, y = near_dedup.index_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


def test_classifiers(spark, edge_docs, no_docs):
    words = "alpha beta gamma delta kappa sigma".split()
    r = np.random.default_rng(4)
    docs = [(i, " ".join(r.choice(words, 20)) + (" idiot" if i % 3 == 0 else "") + (" %%% !!! %%%" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(150)] + [(None, 1, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for mod, truth in ((quality, lambda i: int(i % 4 > 0)), (toxicity, lambda i: int(i % 3 == 0))):
        found = rows(mod.classify(df, labels))
        held = [r for r in found if r["held_out"] or r["doc_id"] >= 150]
        assert np.mean([r["predicted"] == truth(r["doc_id"]) for r in held]) > 0.95
        assert all(0 <= r["score"] <= 1 for r in rows(mod.classify(edge_docs, labels)))
        assert mod.classify(no_docs, labels).count() == 0
        assert {r["score"] for r in rows(mod.classify(df, labels.where("false")))} == {0.5}


def test_swaps_make_identity_terms_neutral():
    texts = [("muslim " * (i % 2) + ("idiot" if i % 2 and i % 8 else "fine") + " talk", int(bool(i % 2 and i % 8))) for i in range(200)]
    data = [(y, toxicity.with_swaps(t)) for t, y in texts]
    w0, w1 = (fit(data, epochs=10, l1=0.1, swapped_weight=s, evidence_only=True) for s in (0.0, 20.0))

    def gap(w):
        a, b = toxicity.with_swaps("muslim talk")
        return abs(sigmoid(w[a[0]] @ a[1] + w[-1]) - sigmoid(w[b[0]] @ b[1] + w[-1]))

    assert gap(w1) < gap(w0)


def test_sentences_are_swapped_one_by_one():
    made = toxicity.with_swaps("A woman sings. One muslim and one woman read! Rain")
    sets = [{int(i) for i in at} for at, _ in made]
    want = ["A woman sings one muslim and read Rain", "A woman man sings one muslim and read Rain", "A woman man sings one christian and read Rain"]
    assert sets == [{int(i) for i in toxicity.features(t)[0]} for t in want]
    assert len(toxicity.with_swaps("nobody here. none")) == len(toxicity.with_swaps(None)) == 1
    assert len(toxicity.with_swaps("a blarg came.", toxicity.swaps((("blarg", "zonk"),)))) == 2


def test_penalty_spares_neutral_mentions(spark):
    """Insults that mostly name one group: held-out neutral mentions of it are flagged less with the penalty, and
    held-out insults without any group are still found."""
    r = np.random.default_rng(13)
    calm, rude, other = "river bread window garden music letter".split(), [f"scum{c}le" for c in "abcdefghijkl"], ["christian", "jewish", "hindu", "buddhist"]
    docs = []
    for i in range(900):
        words = list(r.choice(calm, 8))
        toxic = i % 3 == 0
        if toxic:
            words += [str(r.choice(rude))] * int(r.random() < 0.9)
            words += ["muslim"] if r.random() < 0.8 else []
        elif i % 4 == 1:
            words.append(str(r.choice(other)))
        docs.append((i, " ".join(r.permutation(words)) + ".", int(toxic)))
    docs += [(i, " ".join(r.choice(calm, 8)) + " muslim.", 0) for i in range(1000, 1100)] + [(i, " ".join(r.choice(calm, 8)) + f" {rude[i % 12]}.", 1) for i in range(1100, 1200)]
    df, labels = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in docs if i < 1000], "doc_id long, toxic int")
    flagged = {}
    for weight in (0.0, 40.0):
        found = {x["doc_id"]: x["predicted"] for x in rows(toxicity.classify(df, labels, swapped_weight=weight))}
        flagged[weight] = sum(found[i] for i in range(1000, 1100)), sum(found[i] for i in range(1100, 1200))
    assert flagged[0.0][0] >= 50 > 20 >= flagged[40.0][0] and flagged[40.0][1] >= 90, flagged


def test_sharding(edge_docs, no_docs, spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 37 AS int)) AS text").union(spark.range(400, 500).selectExpr("id", "'copy of one'"))
    found = rows(sharding.assign(docs))
    by = {s: [r for r in found if r["shard"] == s] for s in range(8)}
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) <= 1.1 * min(sizes)
    assert sharding.assign(edge_docs).count() == edge_docs.count() and sharding.assign(no_docs).count() == 0
    assert {r["text_crc32"] for r in rows(sharding.assign(edge_docs.where("doc_id = 3")))} == {0}


def test_sharding_keeps_groups_whole(spark):
    """Groups are torn only above a quarter of a shard's share; bytes, words and rows are balanced, slots gapless."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.range(100_000, 100_400).selectExpr("id", "'one hot text of many copies'")).union(spark.range(50).selectExpr("CAST(NULL AS long)", "'no id'"))
    found, texts = rows(sharding.assign(docs)), [r.text or "" for r in docs.collect()]
    groups: dict = {}
    for r in found:
        groups.setdefault((r["group"]), []).append(r)
    assert sum(len(g) > 1 for g in groups.values()) > 50
    totals = [sum(len(t.encode()) + 1 for t in texts), len(texts)]
    for g in groups.values():
        if len({r["shard"] for r in g}) > 1:
            assert max(sum(r["size"] for r in g) / totals[0], len(g) / totals[1]) > 1 / 32
    for own in (size := {s: [r for r in found if r["shard"] == s] for s in range(8)}).values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    for weigh, near in ((lambda r: r["size"], 1.02), (lambda r: 1, 1.3)):
        loads = [sum(map(weigh, own)) for own in size.values()]
        assert max(loads) <= near * min(loads)


def test_bin_packing_against_a_plain_loop():
    r = np.random.default_rng(12)
    vectors = r.integers(1, 50, (60, 3))
    share = vectors / vectors.sum(axis=0) * 4
    left, want = [[1.0] * 3 for _ in range(4)], {}
    for i in sorted(range(60), key=lambda i: (-sum(w * v for w, v in zip(sharding.IMPORTANCE, share[i], strict=True)), i)):
        dots = [sum(w * v * c for w, v, c in zip(sharding.IMPORTANCE, share[i], room, strict=True)) for room in left]
        want[i] = max(range(4), key=lambda s: (round(dots[s], 9), -s))
        left[want[i]] = [c - v for c, v in zip(left[want[i]], share[i], strict=True)]
    assert sharding.pack(vectors, 4).tolist() == [want[i] for i in range(60)]


def test_shards_with_a_column_of_that_name(spark, edge_docs):
    from pyspark.sql import functions as F

    out = shared_dir(spark, "test-shards")
    docs = edge_docs.withColumn("shard", F.lit("mine")).withColumn("group", F.lit("mine"))
    sharding.write_shards(docs, out)
    assert sorted(map(str, rows(spark.read.parquet(out).select(*docs.columns)))) == sorted(map(str, rows(docs)))


def test_packing(edge_docs, no_docs):
    e = encoder(vocabulary("word_bpe_49k.json"), False)
    pieces = rows(packing.pack(edge_docs, with_ids=True))
    want = sorted(tuple(e.model.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in edge_docs.collect())
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    got, at = [], 0
    for p in stream:
        assert p["sequence_id"] * 2048 + p["offset"] == at and p["offset"] + p["length"] <= 2048 and p["ids_crc32"] == crc32(p["ids"])
        at += p["length"]
        got.append(np.frombuffer(p["ids"], "<u4"))
        if p["start"]:
            got[-2:] = [np.concatenate(got[-2:])]
    assert sorted(tuple(g.tolist()) for g in got) == want
    assert packing.pack(no_docs).count() == 0


def test_hilbert_neighbours():
    side = 8
    grid = np.array([[x, y, z] for x in range(side) for y in range(side) for z in range(side)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_token_files(spark, edge_docs, no_docs):
    e = encoder(vocabulary("byte_bpe_50k.json"), True)
    out = shared_dir(spark, "test-tokens")
    token_files.write_tokens(edge_docs, out)
    found, at = sorted(rows(token_files.read_tokens(spark, out)), key=lambda r: r["start"]), 0
    assert [r["doc_id"] or 0 for r in found] == sorted(r.doc_id or 0 for r in edge_docs.collect())
    crc = sorted((r.doc_id or 0, crc32(np.array(e.model.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in edge_docs.collect())
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in found) == crc
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    out = shared_dir(spark, "test-tokens")
    token_files.write_tokens(no_docs, out)
    assert token_files.read_tokens(spark, out).count() == 0


def test_codes_are_directly_addressable():
    r = np.random.default_rng(5)
    for top in (1, 256, 1 << 16, 1 << 32):
        ids = r.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
        raw = token_files.segment([1, None], [2000, 1000], ids)
        codes = token_files.Segment(lambda at, n: raw[at : at + n])
        assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(0, 3000, 7))
        assert codes.documents()[0] == [1, None] and codes.documents()[1].tolist() == [0, 2000, 3000]


def test_one_token_is_read_from_its_bytes_alone(spark, edge_docs):
    e = encoder(vocabulary("byte_bpe_50k.json"), True)
    out = shared_dir(spark, "test-tokens")
    token_files.write_tokens(edge_docs, out)
    size = sum(r["size"] for r in rows(token_files.manifest(spark, out)))
    texts = {(r.doc_id, crc32(np.array(e.model.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())): r.text for r in edge_docs.collect()}
    for r in rows(token_files.read_tokens(spark, out)):
        ids = e.model.encode(texts[r["doc_id"], r["ids_crc32"]] or "", add_special_tokens=False).ids + [0]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            reads = []
            assert token_files.token(spark, out, r["start"] + i, reads.append) == ids[i]
            assert sum(reads) <= 52 + 4 * 69 and size > 100 * sum(reads)
    with pytest.raises(IndexError):
        token_files.token(spark, out, 10**9)


@pytest.mark.parametrize("name, spaces", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_give_the_tokenizers_ids(name, spaces):
    r, parts = np.random.default_rng(6), ["a", "B", "c", " ", "  ", "\n", ". ", ", ", ".", "'s", "'S", " 't", "1", "é", "J̌", "Σ", "İ", "\xa0", "\x1c", "²", "_", "...", "<|endoftext|>", "!", "\t", "中", "\0", "\x01"]
    texts = ["".join(r.choice(parts, r.integers(0, 25))) for _ in range(2000)]
    e = encoder(vocabulary(name), spaces)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [x.ids for x in e.model.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(edge_docs, no_docs):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    pieces = token_counts.pieces_of(vocabulary("piece_bpe_32k.model"))
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex("[\\x20\\x09-\\x0D]+"), "removed"), pre_tokenizers.Metaspace(prepend_scheme="always")])
    r, count = np.random.default_rng(7), token_counts.Counter(pieces)
    texts = ["".join(r.choice(list("abth ▁中é😀.,1\n"), r.integers(0, 60))) for _ in range(1000)]
    assert [count.text(t) for t in texts] == [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    assert {r["doc_id"]: r["n_tokens"] for r in rows(token_counts.count_tokens(edge_docs)) if r["doc_id"] in (3, 4)} == {3: 0, 4: 0}
    assert token_counts.count_tokens(no_docs).count() == 0


def test_words_match_the_pattern():
    r = np.random.default_rng(8)
    for _ in range(200):
        t = "".join(r.choice(list("abAB \t\nçZ"), r.integers(0, 40)))
        assert len(word_hashes(t.encode())) == len(WORD.findall(t))


def test_pipeline_stages_without_ids(edge_docs, spark):
    """Every stage keeps the columns, whatever doc_ids are null, and many of them."""
    import corpus_pipeline

    more = spark.createDataFrame([(None, f"text {i} of " + "many other words " * (i % 5 + 1) + f"ends in {i * 7}", "en", "d" if i % 2 else "a", i) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    docs, sf = edge_docs.drop("extra").unionByName(more), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "packing" or out.columns == docs.columns
        if name == "mixing":
            own = {r["source"]: r["target"] for r in rows(mixing.mix(docs))}
            size = lambda r: len(WORD.findall(r["text"] or ""))
            largest = max(size(r) for r in rows(docs) if r["source"] == "d")
            assert abs(sum(size(r) for r in rows(out) if r["source"] == "d") - own["d"]) <= largest
        docs = out
    assert docs.count() > 0


#: What the stages call their outputs and what they work with.
CLASHING = ("score", "Predicted", "held_out", "keep_id", "group_size", "kept", "text_sha256", "bucket", "key", "sha", "norm", "n_shingles", "component_id", "set_key", "size", "chars", "hash", "target", "epochs", "taken", "first", "sequence_id", "offset", "length", "start", "ids")


def test_pipeline_stages_with_clashing_columns(edge_docs, spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs, sf = edge_docs.select("*", *[F.concat_ws(" ", F.lit(c), "doc_id").alias(c) for c in CLASHING]), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        found = rows(out)
        assert found
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == c + ("" if r["doc_id"] is None else f" {r['doc_id']}") for r in found for c in CLASHING)
        docs = out


def plain_components(sets, percent):
    """The smallest id reachable over pairs of sets that are similar enough, compared pair by pair."""
    top = {i: i for i in sets}

    def root(i):
        return i if top[i] == i else root(top[i])

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            same = len(sets[i] & sets[j])
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def word_sets(texts):
    """5-word shingles as tuples of words, without the operator's hashes."""
    out = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_on_the_given_documents(spark, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r["component_id"] for r in rows(near_dedup.near_duplicates(docs, percent))}
    assert found == plain_components(word_sets({r.doc_id: r.text for r in docs.collect()}), percent)


def test_near_dedup_of_a_dense_group_with_strays(spark):
    """One large group of near copies, strays that share its buckets, ids that occur twice or not at all, repeats."""
    r, base = np.random.default_rng(9), [f"w{i}" for i in range(100)]
    docs = []
    for i in range(300):
        w = list(base)
        for k in r.integers(0, 100, 1 if i % 10 else 6):
            w[k] = f"e{i}_{k}"
        docs.append((i if i % 50 else None, " ".join(w)))
    docs += [(400 + i, " ".join(f"v{i}_{j}" for j in range(40))) for i in range(20)] + [(400, " ".join(base)), (5, "other text of five words"), (5, "other text of five words")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = word_sets({n: t for n, (_, t) in enumerate(docs)})
    comp = plain_components(sets, 85)
    least = {}
    for n, (i, _) in enumerate(docs):
        if i is not None:
            least[comp[n]] = min(i, least.get(comp[n], i))
    want = sorted((str(i), len(sets[n]), str(least.get(comp[n])), i == least.get(comp[n])) for n, (i, _) in enumerate(docs))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in rows(near_dedup.near_duplicates(df))) == want
    kept = sorted(str(r["doc_id"]) + r["text"] for r in rows(near_dedup.deduplicated(df, 85)))
    members = {}
    for n, (i, t) in enumerate(docs):
        members.setdefault(comp[n], []).append((i is None, i or 0, t))
    assert len({k for k in kept}) == len(members) and [k for k in kept if k.startswith("5other")] == ["5other text of five words"] * 2
    for m in members.values():
        none, i, _ = min(m)
        assert any(k.startswith("None" if none else str(i)) for k in kept)


def test_forests_join_what_the_links_join(spark):
    r = np.random.default_rng(10)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2)) if a != b]
    top = plain_components({i: {1} for i in ()}, 80) or {i: i for i in range(400)}
    for _ in range(400):
        new = dict(top)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == top:
            break
        top = new
    df = spark.createDataFrame(links, "a long, b long")
    assert near_dedup.forest(df).count() < len(links)
    assert {r["id"]: r["comp"] for r in rows(near_dedup.components(df))} == {i: c for i, c in top.items() if i in {x for e in links for x in e}}


def test_pipeline_stages_against_plain_python(spark):
    """Each stage's rows on the given documents, from what the stage before it kept."""
    from collections import Counter as Bag
    from hashlib import md5
    from math import floor, log

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    weights = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for name in stages:
        before, out = rows(docs), stages[name](spark, docs, sf)
        after = rows(out)
        if name == "toxicity":
            score = lambda t: 1 / (1 + np.exp(-float(weights[toxicity.features(t)[0]].sum(dtype=float) + weights[-1])))
            want = Bag(r["doc_id"] for r in before if score(r["text"]) < 0.7)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best[lower(r["text"])] = max(r["doc_id"], best.get(lower(r["text"]), r["doc_id"]))
            want = Bag(best.values())
        elif name == "near_dedup":
            want = Bag({i for i, c in plain_components(word_sets({r["doc_id"]: r["text"] for r in before}), 80).items() if i == c})
        elif name == "mixing":
            size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in before}
            source = {r["doc_id"]: r["source"] for r in before}
            names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
            weight, own = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: sum(n for d, n in size.items() if source[d] == s) for s in names}
            target, open_, left = {}, set(names), float(sum(own.values()))
            while open_:
                rate = left / sum(weight[s] for s in open_)
                full = {s for s in open_ if 3 * own[s] <= rate * weight[s]}
                target |= {s: 3.0 * own[s] for s in full} if full else {s: rate * weight[s] for s in open_}
                left, open_ = left - sum(3.0 * own[s] for s in full), open_ - full if full else set()
            want = Bag()
            chars = {r["doc_id"]: len(r["text"] or "") for r in before}
            for s in names:
                quality = {d: 1 / (1 + abs(chars[d] / size[d] - 7)) if size[d] else 0.125 for d in size if source[d] == s}
                key = {d: -log((int(md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality[d] for d in quality}
                epochs = floor(target[s] / own[s]) if own[s] else 0
                rest = floor(target[s]) - epochs * own[s]
                for d in sorted(key, key=lambda d: (key[d], d)):
                    part, rest = max(0, min(size[d], rest)), rest - size[d]
                    want[d] += epochs + (2 * part >= max(size[d], 1))
            want = +want
        else:
            e, got = encoder(vocabulary("word_bpe_49k.json"), False), {}
            for p in after:
                got.setdefault((p["sequence_id"], p["offset"]), []).append(p)
            assert all(len(p) == 1 for p in got.values())
            at = 0
            for p in sorted(after, key=lambda p: (p["sequence_id"], p["offset"])):
                assert p["sequence_id"] * 2048 + p["offset"] == at
                at += p["length"]
            ids = {r["doc_id"]: e.model.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in before}
            assert Bag((p["doc_id"], p["start"]) for p in after if not p["start"]) == Bag((r["doc_id"], 0) for r in before)
            assert at == sum(len(ids[r["doc_id"]]) for r in before)
            assert all(p["ids_crc32"] == crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in after)
            continue
        assert Bag(r["doc_id"] for r in after) == want, name
        texts = {r["doc_id"]: r["text"] for r in before}
        assert all(r["text"] == texts[r["doc_id"]] for r in after) and out.columns == docs.columns
        docs = corpus_pipeline.written(out, "test-stage")


def test_pipeline_stages_on_an_empty_table(no_docs, spark):
    import corpus_pipeline

    docs, sf = no_docs, "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_operators_ignore_columns_called_like_theirs(edge_docs, spark):
    """Each operator gives the rows that it gives without the further columns."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clashing = edge_docs.select("*", *[F.lit(c).alias(c) for c in CLASHING if c not in edge_docs.columns])

    def tokens(docs):
        out = shared_dir(spark, "test-tokens")
        token_files.write_tokens(docs, out)
        return token_files.read_tokens(spark, out)

    for operator in (
        mixing.mix,
        lambda d: toxicity.classify(d, labels),
        near_dedup.near_duplicates,
        lambda d: quality.classify(d, labels),
        lambda d: sharding.assign(d).drop("slot", "shard"),
        exact_dedup.decisions,
        lambda d: packing.pack(d).select("doc_id", "doc_tokens"),
        token_counts.count_tokens,
        tokens,
    ):
        assert sorted(map(str, rows(operator(clashing)))) == sorted(map(str, rows(operator(edge_docs))))
