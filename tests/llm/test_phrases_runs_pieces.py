"""Sentence pieces, collocations and periodic runs against the library and brute force, on edge cases and empty tables."""

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np

from graphloom.llm import collocations, periodic_runs, sentence_pieces
from graphloom.llm.collocations import Summary
from graphloom.llm.sentence_pieces import Pieces
from graphloom.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "piece_bpe_32k.model"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def strange_texts():
    r = random.Random(3)
    texts = ["", " ", "   ", "  a", "a  ", "▁", "a▁ b", " ▁▁a  ▁", "\0", "a\0 b", "é é ☃ 😀\n\n x\t", "<s> </s> <unk> <0x0A>", "a" * 3000, "日本語のテキスト梦梦", "\n", " \n \n  ", "▁▁"]
    texts += ["".join(r.choice("abcthe ▁\nin é1.日😀\0") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(300)) for _ in range(60)]
    return texts + ["".join(chr(r.choice([r.randint(32, 126), r.randint(0x80, 0x2FFF)])) for _ in range(50)) for _ in range(300)]


def test_pieces_are_the_library_s():
    """Merge rounds and, for long segments, the heap give the library's ids, whatever is remembered."""
    texts = strange_texts()
    for model in (Pieces(vocabulary(MODEL)), Pieces(vocabulary(MODEL), long=0)):
        for _ in range(2):  # the second time words are remembered
            for text, ids in zip(texts, model.encode(texts), strict=True):
                assert ids.tolist() == [1, *model.library.encode(text), 2]
                assert model.decode(ids) == model.library.decode(ids.tolist())


def test_a_round_ends_before_a_better_pair(spark):
    """Where a merge makes a pair of a higher score, that one goes first: as pair by pair, best score and leftmost first."""
    model = Pieces(vocabulary(MODEL))
    r = random.Random(5)
    for _ in range(200):
        # A made vocabulary on letters 0 to 3, in which longer pieces may rank before shorter ones.
        names = [*"abcd"] + sorted({"".join(r.choice("abcd") for _ in range(r.randint(2, 4))) for _ in range(14)})
        score = {n: r.random() for n in names}
        pairs = {(names.index(n[:k]), names.index(n[k:])): n for n in names for k in range(1, len(n)) if n[:k] in names and n[k:] in names}
        keys = np.array(sorted(model._key(a, b) for a, b in pairs), dtype=np.int64)
        of = {model._key(a, b): n for (a, b), n in pairs.items()}
        order = sorted(names, key=lambda n: -score[n])
        model.keys = keys
        model.ranks = np.array([order.index(of[k]) for k in keys.tolist()], dtype=np.int32)
        model.made = np.array([names.index(of[k]) for k in keys.tolist()], dtype=np.int32)
        if not len(keys):
            continue
        words = [[r.randint(0, 3) for _ in range(r.randint(1, 30))] for _ in range(20)]
        final = model._rounds(np.array([s for w in words for s in w], dtype=np.int32), np.array([len(w) for w in words]))
        at = 0
        for w in words:
            want = [names[s] for s in w]
            while True:
                best = min(((order.index(a + b), i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if a + b in names and (names.index(a), names.index(b)) in pairs), default=None)
                if best is None:
                    break
                want[best[1] : best[1] + 2] = [want[best[1]] + want[best[1] + 1]]
            got = final[at : at + len(w)]
            at += len(w)
            assert [names[s] for s in got[got >= 0]] == want
            heap = model._one_by_one(list(w))
            assert [names[s] for s in heap[heap >= 0]] == want


def test_sentence_pieces_operator(spark, edge_docs, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))
    found = rows(sentence_pieces.decode(sentence_pieces.encode(edge_docs.withColumnRenamed("extra", "ids").withColumnRenamed("n_chars", "decoded"))))
    want = [(r.doc_id, [1, *lib.encode(r.text or ""), 2]) for r in edge_docs.collect()]
    assert [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found] == want
    assert [r["decoded"] for r in found] == [lib.decode(ids) for _, ids in want] and [r["n_tokens"] for r in found] == [len(ids) for _, ids in want]
    assert rows(sentence_pieces.encode(edge_docs, with_decoded=True)) == found
    assert sentence_pieces.encode(no_docs, with_decoded=True).count() == 0


def test_op11_digests(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(MODEL))
    found = {r["doc_id"]: r for r in rows(sentence_pieces.op11_sentence_pieces(spark, "/root/testdata/sf0.001"))}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = [1, *lib.encode(d.text or ""), 2]
        assert found[d.doc_id] == {"doc_id": d.doc_id, "n_tokens": len(ids), "ids_sha256": sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "decoded_sha256": sha256(lib.decode(ids).encode()).hexdigest()}


def test_summary_keeps_every_frequent_key():
    """In any order and grouping of what is merged: no count too high, none lacks more than what was taken."""
    r = np.random.default_rng(7)
    for least in (2, 5, 10):
        keys = (r.pareto(0.6, 30000) * 3).astype(np.uint32) % 8000
        true = Counter(keys.tolist())
        summary = Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 37):
            k, n = np.unique(part, return_counts=True)
            summary.merge(k, n)
        assert summary.taken < least and len(summary.keys) <= summary.capacity
        assert all(n <= true[k] <= n + summary.taken for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
        kept = set(summary.at_least(least).tolist())
        assert {k for k, n in true.items() if n >= least} <= kept
    small = Summary(3)
    for k in range(100):
        small.merge(np.array([k, 1000], dtype=np.uint32), np.array([1, 1]))
    assert small.taken <= 200 / 4 and 1000 in small.keys


def plain_collocations(docs, least=10, inside=50, top=2000):
    counts, words = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least:
            continue
        longer = [n for (g, q), n in counts.items() if g == lang and len(q) == 3 and len(p) == 2 and n >= least and p in (q[:2], q[1:])]
        if any(100 * n >= inside * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], words[lang]))
    found = []
    for lang in {o[0] for o in out}:
        found += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (_, s, a, p, l, r, n) in enumerate(sorted(o for o in out if o[0] == lang)[:top])]
    return sorted(found)


def test_collocations(spark, edge_docs, no_docs, monkeypatch):
    r = random.Random(11)
    common = ["of", "the", "new", "york", "city", "Éa", "x\0y", "end"]
    docs = [(None if i % 9 == 0 else "en" if i % 3 else "de", " ".join(r.choice(common) + r.choice(["", "", "", ",", ". ", "\n", "\t", "  "]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    docs += [("en", "New York CITY; new york city")] * 30 + [("fr", None), ("fr", ""), (None, "one two")] + [("de", "lang " * 200)]
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "lang string, text string, n long, size long").repartition(5)
    want = plain_collocations(docs)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert len(want) > 50
    for chunk, share in ((1 << 24, 1 << 25), (300, 1000)):  # one chunk and partition, and many
        monkeypatch.setattr(collocations, "CHUNK", chunk)
        monkeypatch.setattr(collocations, "SHARE", share)
        assert sorted(tuple(r[c] for c in columns) for r in rows(collocations.ranked(collocations.collocations(table)))) == want
    monkeypatch.setattr(collocations, "SLICE", 64)  # a filter that lets nearly all through
    monkeypatch.setattr(collocations, "FILTER", 64)
    assert sorted(tuple(r[c] for c in columns) for r in rows(collocations.ranked(collocations.collocations(table)))) == want
    few = rows(collocations.ranked(collocations.collocations(table), top=5))
    assert sorted(tuple(r[c] for c in columns) for r in few) == plain_collocations(docs, top=5)
    assert collocations.collocations(no_docs).count() == 0
    edge = [(d.lang, d.text) for d in edge_docs.collect()]
    assert sorted(tuple(r[c] for c in columns) for r in rows(collocations.ranked(collocations.collocations(edge_docs)))) == plain_collocations(edge)


def test_scores_pass_64_bits(spark, monkeypatch):
    """Counts whose products need more than 64 bits keep exact scores."""
    a, l, r = 3_000_000_007, 5_000_000_029, 4_000_000_007
    counts = spark.createDataFrame([("en", 0, "", 10**11), ("en", 1, "p", l), ("en", 1, "q", r), ("en", 2, "p q", a)], "lang string, size int, phrase string, n long")
    monkeypatch.setattr(collocations, "frequent", lambda docs, least: counts)
    found = rows(collocations.collocations(counts))
    assert [(r_["a"], r_["l"], r_["r"], r_["score"]) for r_ in found] == [(a, l, r, 10**6 * a * a // (l * r))]


def plain_runs(w, least=6, times=4):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, q, length) for (s, length), q in found.items())


def found_runs(docs):
    ends = np.cumsum([len(d) for d in docs], dtype=np.int64)
    out = [[] for _ in docs]
    for d, s, length, q in periodic_runs.find(np.array([x for d in docs for x in d], dtype=np.int64), ends).tolist():
        out[d].append((s, q, length))
    return out


def test_runs_are_all_found(monkeypatch):
    r = random.Random(13)
    docs = [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], [7] * 700, list(range(100)) * 5, list(range(60)) * 4 + [0], list(range(60)) * 3]
    for _ in range(1500):
        w = [r.randint(0, r.choice([0, 1, 2, 50])) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            unit = [r.randint(0, 2) for _ in range(r.randint(1, 40))]
            w += (unit * r.randint(2, 9))[: r.randint(1, 300)] + [r.randint(0, 2) for _ in range(r.randint(0, 30))]
        docs.append(w)
    want = [plain_runs(d) for d in docs]
    assert sum(map(len, want)) > 800
    assert found_runs(docs) == want
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 64)
    assert found_runs(docs[:200]) == want[:200]


def test_squared_differences_are_exact():
    r = np.random.default_rng(17)
    for size in (1, 2, 8, 64):
        blocks, windows = r.integers(0, 5000, (20, size)).astype(np.uint64), r.integers(0, 5000, (20, 2 * size)).astype(np.uint64)
        windows[:7, :size] = blocks[:7]
        got = periodic_runs.squared_differences(blocks, windows)
        for i in range(20):
            want = [int(((blocks[i].astype(np.int64) - windows[i, o : o + size].astype(np.int64)) ** 2).sum()) % periodic_runs.PRIME for o in range(size)]
            assert got[i].tolist() == want


def plain_op13(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda x: (-(x[2] / x[1]), x[0], x[1]), default=None)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    sha = lambda t: sha256(t.encode()).hexdigest()
    ends = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *ends, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_runs_operator(spark, edge_docs, no_docs, tmp_path):
    docs = [(r.doc_id, r.text) for r in edge_docs.where("length(text) < 1000 or text is null").collect()]
    docs += [(i, f"a b{i} " + "ho  ho\n" * (i % 5) + " ".join(f"w{j % (i % 7 + 1)}" for j in range(i % 40))) for i in range(400)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, runs long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r.values()) for r in rows(periodic_runs.op13_periodic_runs(spark, str(tmp_path)))]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(found, key=key) == sorted((plain_op13(*d) for d in docs), key=key)
    long = rows(periodic_runs.periodic_runs(edge_docs))
    assert [r["runs"] for r in long if r["doc_id"] == 5] == [[{"start": 0, "length": 40000, "period": 5}]]
    assert [r["collapsed"] for r in long if r["doc_id"] == 6] == ["lorem ipsum dolor sit amet x"]
    assert periodic_runs.periodic_runs(no_docs).count() == 0
