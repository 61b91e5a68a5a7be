import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n int, digest string, score double, k int, r int, bucket int, _row long, rank int, rows string"


def make(spark, texts, sources=None):
    """Documents with columns whose names operators use inside."""
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for i, t in enumerate(texts)]
    src = sources or [f"s{i % 3}" for i in range(len(rows))]
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "x", 1, "y", 0.5, 1, 2, 3, 4, 5, "z") for (d, t), s in zip(rows, src, strict=True)], SCHEMA)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def texts(words):
    """Plain, null, empty, blank, very long, repeated, nearly repeated and tied texts."""
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = words(90, 77)
    return [
        words(50, 0), None, "", " \t\n", base, base, base.replace(" ", "  \n", 3), " ".join(near), words(40_000, 2), "x" * 30_000, "😀é" * 700,
        words(30, 3) + " " + passage + " " + words(30, 4), words(20, 5) + " " + passage, passage + " " + words(9, 6), "a", "a b c d", "a b c d e", words(300, 8), words(300, 8), (4, base), (None, base), (None, None),
    ]
