"""Mixing and packing."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import mixing, packing

from .conftest import make


def spec_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = [s for s in open_ if w[s] * unit > most * sizes[s]]
        if not full:
            out |= {s: w[s] * unit for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_and_taken(spark, texts):
    sources = ["b", "a", None, "B", "ä"]
    df = make(spark, [*texts, *[f"w{i} " * (i % 40) for i in range(200)]], [sources[i % 5] if i % 3 else "hot" for i in range(len(texts) + 200)])
    rows = df.select("doc_id", "text", "source").collect()
    got = mixing.mix(df, blocks=8, shards=6, keep=("source",)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    want = spec_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert len(r["shards"]) == -(-r["taken"] // r["size"]) if r["size"] else not r["shards"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df, blocks=8, shards=6, keep=("source",)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    placed = mixing.shuffled(mixing.mix(df, blocks=8, shards=6)).select("shard").collect()
    assert len(placed) == sum(len(r["shards"]) for r in got)


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 7), (None, 13)], "source string, q long")
    for shards in (1, 5, 8):
        got = mixing._split(quotas, shards, 3).collect()
        per = defaultdict(int)
        for r in got:
            per[r["source"]] += r["q"]
        assert per == {"a": 40, "b": 7, None: 13}
        load = defaultdict(int)
        for r in got:
            load[r["shard"]] += r["q"]
        assert len(load) == shards and max(load.values()) - min(load.values()) <= 3


def test_pieces(spark, texts):
    path = packing.default_tokenizer()
    slow = Tokenizer.from_file(path)
    df = make(spark, [*texts, "<|endoftext|> is text", "it's 1234 ok\n\n  end  "])
    got = packing.pack_documents(df, path, 256).collect()
    slow.encode_special_tokens = True
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 256 or 256
        cuts = [(0, len(ids))] if len(ids) <= 256 else [(0, first), *((s, 256) for s in range(first, len(ids), 256))]
        want += [(r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    check_places(got, 256)
    assert packing.pack_documents(df.limit(0), path, 256).count() == 0


def check_places(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packs_as_sequential_best_fit(spark):
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 101, 600), np.repeat([34, 33, 51, 100], 50), rng.integers(40, 60, 300), [100], [1] * 250):
        parts = spark.createDataFrame([(int(i), int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
        rows = packing.pack(parts, 100).collect()
        assert len(rows) == len(lengths) and check_places(rows, 100) == best_fit(list(lengths), 100)
