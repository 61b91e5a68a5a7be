"""Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import merkle

from .conftest import make


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def fold(nodes):
    """Levels of digests, bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = (own, fold([leaf(r, r["text"]) for r in own]))
    top = fold([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, r in enumerate(own):
            bad = r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            at, proof = leaf(r, r["text"].replace("\n", "")) if bad else levels[0][i], []
            for ls, j in ((levels, i), (top, k)):
                for level in ls[:-1]:
                    run = level[j - j % 3 : j - j % 3 + 3]
                    proof += run[: j % 3] + run[j % 3 + 1 :]
                    at = h(*run[: j % 3], at, *run[j % 3 + 1 :])
                    j //= 3
            out.append((r["doc_id"], levels[0][i], levels[-1][0], top[-1][0], h(*proof), at, at == top[-1][0]))
    return sorted(out, key=repr)


def got(df, **kw):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(df, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, changed_where=even, **kw).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows), key=repr)


def test_against_plain(spark, texts):
    sources = [None, "", "é", "z", "Z", "😀", "￮"]
    rows = texts + [f"line {i}\nnext" for i in range(90)] + ["same", "same", (3, "x"), (3, "x"), (3, "y\n")]
    df = make(spark, rows, [sources[i * i % 7] if i < 40 else "hot" for i in range(len(rows))]).cache()
    want = brute(df.collect())
    assert got(df) == want
    assert got(df, rows_per_part=7) == want  # twenty fragments, one round
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_small_tables(spark, monkeypatch):
    df = make(spark, [f"t\n{i}" for i in range(40)], ["one"] * 40).cache()
    assert got(df, rows_per_part=3) == brute(df.collect())
    each = make(spark, [f"t\n{i}" for i in range(40)], [f"s{i:02d}" for i in range(40)]).cache()  # every leaf a subroot
    assert got(each, rows_per_part=3) == brute(each.collect())
    monkeypatch.setattr(merkle, "FAN", 2)  # several rounds
    assert got(each, rows_per_part=3) == brute(each.collect())
    for n in (1, 2, 3, 4):
        some = df.where(f"doc_id < {n}")
        assert got(some) == got(some, rows_per_part=1) == brute(some.collect())
    assert got(df.limit(0)) == []


def test_equal_rows_share_no_range(spark):
    """A third of all rows may be one row: its copies go to several partitions."""
    df = make(spark, [(5, "copy")] * 60 + [f"t{i}" for i in range(30)], ["a"] * 90).cache()
    assert got(df, rows_per_part=10) == brute(df.collect())


@pytest.mark.parametrize("cuts", [(0, 20), (0, 1, 2, 20), (0, 7, 9, 20), tuple(range(21))])
def test_joining_is_associative(cuts):
    """Fragments joined in any grouping give the same root as the whole."""
    sizes = {0: 5, 1: 1, 2: 14, merkle.TOP: 3}
    leaves = [(t, 0, i) for t in (0, 1, 2) for i in range(sizes[t])]
    forest = merkle.Forest(sizes)
    digest = {k: h(str(k)) for k in leaves}
    root = (merkle.TOP, 1, 0)

    def fragment(nodes):
        known = forest.join(nodes)
        return {k: known[k] for k in forest.open(known)}

    whole = fragment(digest)
    assert list(whole) == [root]
    parts = [fragment({k: digest[k] for k in leaves[a:b]}) for a, b in zip(cuts, cuts[1:], strict=False)]
    left, right = {}, {}
    for p in parts:
        left = fragment(left | p)
    for p in reversed(parts):
        right = fragment(p | right)
    assert left == right == whole
    assert all(len(p) <= 12 for p in parts)
