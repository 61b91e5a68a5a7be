"""Exact, near-duplicate and substring operators against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from lumenfold.llm import near_dedup, passages, suffix_dedup
from lumenfold.llm._bytes import Prefix
from lumenfold.llm.components import components
from lumenfold.llm.exact_dedup import DigestIndex, dedup_exact

from .conftest import make


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    least = lambda ds: min((d for d in ds if d is not None), default=None)
    return sorted(((d, least(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows), key=repr)


def test_exact(spark, texts):
    df = make(spark, texts)
    index = DigestIndex(spark, "t_exact", 4)
    try:
        got = index.absorb(df).collect()
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(rows)
        assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        # a later batch: what the index knows is dropped, the rest is appended
        more = make(spark, [(100, texts[4]), (101, "brand new"), (102, "brand  new")])
        for _ in range(2):  # given again, as after a lost driver: the same decisions, nothing appended twice
            again = {r["doc_id"]: r for r in index.absorb(more, batch="later").collect()}
            assert not again[100]["kept"] and again[100]["keep_id"] == 4
            assert again[101]["kept"] and not again[102]["kept"] and again[102]["keep_id"] == 101
            assert spark.table("t_exact").count() == len({r["text_sha256"] for r in got}) + 1
        assert index.absorb(df.limit(0)).count() == 0
    finally:
        index.drop()


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_in_batches(spark, texts, batches):
    df = make(spark, [*texts, *texts])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    before = len(spark.catalog.listTables())
    got = dedup_exact(df, batches=batches).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(rows)
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert len(spark.catalog.listTables()) == before
    assert dedup_exact(df.limit(0)).count() == 0


def shingles(t):
    w = re.split(r"[\x09-\x0d\x20]+", (t or "").lower())
    w = [x for x in w if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        ids[find(i)].append(rows[i][0])
    least = lambda ds: min((d for d in ds if d is not None), default=None)
    return sorted(((rows[i][0], least(ids[find(i)]), len(ids[find(i)])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("block", [400_000, 300])
def test_near(spark, texts, words, block):
    """Also with blocks so small that families are split."""
    chain = words(200, 50).split()
    steps = []
    for i in range(12):
        chain = [*chain[: 15 * i], f"new{i}", *chain[15 * i + 1 :]]
        steps.append(" ".join(chain))
    copies = []
    for i in range(60):  # near copies of one text, some so far from it that only others of them link them
        w = words(150, 51).split()
        for j in range(1 + i % 5):
            w[(17 * i + 31 * j) % 150] = f"c{i}x{j}"
        copies.append(" ".join(w))
    df = make(spark, [*texts, *[(200 + i, t) for i, t in enumerate(steps)], *[(300 + i, t) for i, t in enumerate(copies)]])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = near_dedup.near_duplicates(df, block=block).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in got), key=repr) == brute_near(rows)
    heads = [r for r in got if r["representative"]]
    assert len(heads) == len({(r["class_id"], r["class_size"]) for r in got}) and all(r["doc_id"] == r["class_id"] for r in heads)


def test_near_empty(spark, texts):
    assert near_dedup.near_duplicates(make(spark, texts).limit(0)).count() == 0


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(1, 1 << 62, 400, dtype=np.int64).view(np.uint64)
    wa, wb = rng.random(400) * 3, rng.random(400) * 3
    k = 512
    a, b = near_dedup.dart_minhash(e, wa, k), near_dedup.dart_minhash(e, wb, k)
    truth = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - truth) < 0.09
    one = near_dedup.dart_minhash(e[:200], np.ones(200), k)
    two = near_dedup.dart_minhash(e[50:200], np.ones(150), k)
    assert abs((one == two).mean() - 0.75) < 0.09
    assert len(np.unique(near_dedup.dart_minhash(e[:1], np.ones(1), 16))) == 16


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7), (300, 200)] + [(500, 501 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {v for k, v in got.items() if k <= 20} == {0} and got[102] == 100 and got[300] == 200 and got[540] == 500


def brute_substrings(texts, length):
    data = [(t or "").encode() for t in texts]
    count = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for b in data:
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = True
        spans, at = [], None
        for i, c in enumerate([*covered.tolist(), False]):
            if c and at is None:
                at = i
            if not c and at is not None:
                spans.append((at, i))
                at = None
        out.append((len(b), int(covered.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~covered]) if len(b) else b""))
    return out


@pytest.mark.parametrize("most", [500, 2])
def test_substrings(spark, texts, words, most, monkeypatch):
    """Also with a bound so small that anchors are counted, not gathered."""
    passage = words(140, 900)
    more = [words(40, 910 + i) + passage[i : len(passage) - i] + words(40, 930 + i) for i in range(12)]
    more += [passage[:600] * 3, "ab" * 700]
    df = make(spark, [*[t for t in texts if not isinstance(t, tuple) and len(t or "") < 60_000], *more])
    rows = df.select("doc_id", "text").collect()
    full = suffix_dedup.repeated_ranges
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda r, n: full(r, n, most))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(df).collect()}
    for r, (n, removed, spans, kept) in zip(rows, brute_substrings([r["text"] for r in rows], 400), strict=True):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], [(s["start"], s["end"]) for s in g["spans"]], bytes(g["kept"])) == (n, removed, spans, kept)


def test_substrings_of_a_whole_table(spark):
    """Every document of sf0.01 against sorted windows: what is removed, and what stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(docs).collect()}
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    places = [(i, p) for i, (_, b) in enumerate(rows) for p in range(len(b) - 399)]
    hashed = np.array([hash(rows[i][1][p : p + 400]) for i, p in places])  # 64 bits, then the bytes themselves
    order = np.argsort(hashed, kind="stable")
    same = np.flatnonzero(hashed[order][1:] == hashed[order][:-1])
    found = defaultdict(set)
    for k in same.tolist():
        (i, p), (j, q) = places[order[k]], places[order[k + 1]]
        assert rows[i][1][p : p + 400] == rows[j][1][q : q + 400]
        found[i].add(p)
        found[j].add(q)
    assert sum(map(bool, found.values())) > 100
    for i, (doc, b) in enumerate(rows):
        gone = np.zeros(len(b), dtype=bool)
        for p in found[i]:
            gone[p : p + 400] = True
        g = got[doc]
        assert (g["n_bytes"], g["n_removed"], len(g["spans"])) == (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()))
        assert bytes(g["kept"]) == np.frombuffer(b, np.uint8)[~gone].tobytes()


def test_substrings_repeated_rows_and_empty(spark, texts):
    same = [(1, texts[8]), (1, texts[8]), (None, None)]
    got = suffix_dedup.dedup_substrings(make(spark, same)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, len(texts[8].encode()), len(texts[8].encode())]
    assert suffix_dedup.dedup_substrings(make(spark, same).limit(0)).count() == 0


def brute_passages(texts, length):
    split = [(t or "").encode().split() for t in texts]
    docs = defaultdict(set)
    for i, w in enumerate(split):
        for p in range(len(w) - length + 1):
            docs[tuple(w[p : p + length])].add(i)
    return [len({q for p in range(len(w) - length + 1) if len(docs[tuple(w[p : p + length])]) > 1 for q in range(p, p + length)}) for w in split]


@pytest.mark.parametrize("most", [500, 2])
def test_shared_passages(spark, texts, words, most, monkeypatch):
    """Words of passages that documents share, also under 400 bytes; with a bound so small that windows are counted, not gathered."""
    short = " ".join("ab" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(55))
    more = [words(40, 910 + i) + " " + short + " " + words(40, 930 + i) for i in range(12)]
    more += [words(30, 960) + "\t" + short.replace(" ", "\n ") + "\n", words(30, 961) + " " + " ".join(short.split()[:49]), short.replace("abaa", "x"), words(200, 970) * 2, None, " \n"]
    more += [" ".join(short.split()[i : i + 50] + [f"end{i}"]) for i in range(6)] + ["x" * 300 + " " + short, "same " * 120, "same " * 120 + "end", "own " * 200]
    df = make(spark, [*[t for t in texts if not isinstance(t, tuple) and len(t or "") < 60_000], *more])
    rows = df.select("doc_id", "text").collect()
    full = suffix_dedup.shared_ranges
    monkeypatch.setattr(suffix_dedup, "shared_ranges", lambda r, n: full(r, n, most))
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(df).collect()}
    assert [got[r["doc_id"]]["n_shared_words"] for r in rows] == brute_passages([r["text"] for r in rows], 50)
    planted = [got[r["doc_id"]] for r in rows if r["text"] and r["text"].count(short) and not r["text"].startswith("xxx")]
    assert len(short.encode()) < 400 and len(planted) >= 12 and all(g["n_shared_words"] == 55 and g["n_removed"] == 0 for g in planted)


def test_words_of_any_size(monkeypatch):
    """Hashes of words don't depend on the pieces in which they are read."""
    texts = [b"", b" a  bc\t" + b"d" * 100 + b" e", b"x" * 16, b"\n", b"y" * 15 + b" " + b"x" * 16 + b" a"]
    monkeypatch.setattr(passages._bytes, "PIECE", 16)
    got = passages.word_hashes(texts)
    assert [len(g) for g in got] == [len(t.split()) for t in texts] == [0, 4, 1, 0, 3]
    back = {}
    for t, g in zip(texts, got, strict=True):
        for w, h in zip(t.split(), g.tolist(), strict=True):
            assert back.setdefault(w, h) == h
    assert len(set(back.values())) == len(back) == 6


def test_two_stage_sort_of_one_group():
    """The sort alone: contexts of one anchor, with windows that repeat in part."""
    rng = np.random.default_rng(4)
    body = bytes(rng.integers(97, 100, 700, dtype=np.uint8))
    contexts = [body[:560], body[30:600], bytes(rng.integers(97, 123, 20, dtype=np.uint8)) + body[50:600], bytes(rng.integers(97, 123, 500, dtype=np.uint8))]
    at = [100, 70, 70, 60]  # the anchor is at 100 in the body
    n, length = len(contexts), 400
    hits = suffix_dedup.repeats(contexts, np.zeros(n, np.int64), np.array(at), np.zeros(n, np.int64), length)
    found = {(i, p) for i, a, b in hits for p in range(a, b + 1)}
    windows = defaultdict(list)
    for i, c in enumerate(contexts):
        for p in range(len(c) - length + 1):
            windows[c[p : p + length]].append((i, p))
    assert found == {w for ws in windows.values() if len(ws) > 1 for w in ws}


def test_prefix_hash_of_windows():
    data = np.frombuffer(b"abcabcabcx", dtype=np.uint8)
    p = Prefix(data)
    w = p.windows(3)
    assert w[0] == w[3] == w[6] and len(set(w[:3].tolist())) == 3
    assert p.hash(np.array([0]), np.array([6]))[0] == p.hash(np.array([3]), np.array([9]))[0]
