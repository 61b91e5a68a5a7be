"""Divergence audit against plain Python, with fractions of whole numbers."""

import re
from collections import Counter

import pyarrow as pa

from lumenfold.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    """rows of (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(s, TERM.findall(t.translate(UPPER))) for g, s, t in rows if g == lang]
        seen = Counter(w for _, ws in own for w in set(ws))
        kept = sorted(w for w in seen if seen[w] >= 3)
        counts = {s: Counter() for s, _ in own}
        for s, ws in own:
            counts[s].update(w for w in ws if seen[w] >= 3)
        total = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s, c in counts.items():
            parts = {
                "pair": [(o, sum(f(p(c, w), p(d, w)) for w in kept)) for o, d in counts.items() if o != s],
                "term": [(w, f(p(c, w), p(total, w))) for w in kept if c[w] and p(c, w) > p(total, w)],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def got(df, **kw):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in dv.audit(df, **kw).collect())


SCHEMA = "lang string, source string, text string, term string, n int, docs int, v int, part string, rank int, value double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y", 4, 0.5) for r in rows], SCHEMA)


def test_against_plain(spark, texts, words):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "😀", None]), t[1] if isinstance(t, tuple) else t) for t in texts]
    rows += [(rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", "Z", ""]), words(rng.randint(1, 60), i % 7)) for i in range(60)]
    rows += [("de", "x", "Das das DAS Ähre ähre, das_das a1b İ ſ"), ("de", "y", "das-das"), ("de", "z", None), ("de", "x", "das das"), ("de", "x", "das das")]
    rows += [("it", "p", "una volta"), ("it", "q", "due volte"), ("it", "q", ""), ("one", "only", "a a a"), ("one", "only", "a b"), ("one", "only", "a b"), (None, None, None)]
    df = table(spark, rows)
    want = brute(rows)
    assert got(df) == want
    assert {r[:2] for r in want if r[0] == "it"} == {("it", "p"), ("it", "q")} and all(r[4] == 0 for r in want if r[0] == "it")  # no kept term
    assert got(df, top=3) == brute(rows, 3)
    assert got(df.limit(0)) == []


def test_ties_go_by_bytes(spark):
    rows = [("en", s, "b a é z 😀 ￮") for s in "xy" for _ in range(3)] + [("en", "w", "k k k")] * 3
    assert got(table(spark, rows)) == brute(rows)


def test_chunks_hold_whole_terms():
    rows = sorted((lang, term, s, n) for lang in ("a", "b") for term, k in (("t", 1), ("u", 40), ("v", 3), ("w", 17)) for s in "pq" for n in range(k))
    table = pa.table({"lang": [r[0] for r in rows], "source": [r[2] for r in rows], "term": [r[1] for r in rows], "n": pa.array([r[3] for r in rows], pa.int64()), "docs": pa.array([1] * len(rows), pa.int64())})
    for size in (1, 5, 30, 1000):
        chunks = list(dv.chunked(iter(table.to_batches(max_chunksize=4)), dv.FOLD_SQL, size))
        keys = [{(r["lang"], r["term"]) for r in c.to_pylist()} for c in chunks]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 8
        assert sum(sum(c["docs"].to_pylist()) for c in chunks) == len(rows) and sum(sum(c["n"].to_pylist()) for c in chunks) == sum(r[3] for r in rows)


def test_long_texts_by_slices(monkeypatch):
    text = "Über den Wolken, 99 x y\x00z " * 400
    whole = [w.decode() for some in dv.terms_of(text) for w in some]
    monkeypatch.setattr(dv, "SLICE", 7)
    assert [w.decode() for some in dv.terms_of(text) for w in some] == whole == TERM.findall(text.translate(UPPER))
    # what a task holds is bounded: it sends counts on, and they add up
    monkeypatch.setattr(dv, "HELD", 2)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 5, "source": ["s"] * 5, "text": ["p q r", "q r", "s t u v", "p", "p p"]})
    sent = [r for b in dv.count_terms(iter([batch])) for r in b.to_pylist()]
    n, d = Counter(), Counter()
    for r in sent:
        n[r["term"]] += r["n"]
        d[r["term"]] += r["docs"]
    assert n == Counter("p q r q r s t u v p p p".split()) and d == Counter("p q r q r s t u v p p".split())
