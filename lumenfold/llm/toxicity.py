"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a lexicon learned from labelled texts (words and word beginnings with high log-odds under the
label, so inflected and disguised forms count), second-person words near lexicon words, capitals, punctuation and
obfuscation rates. Everything is fitted on at most `max_rows` labelled rows (a documented bound, taken in hash
order); scoring reads every whole text. Labels, language, source and id never enter a feature.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm._common import lean

# Common insults, second-person words in the four languages of the corpus, and letters that digits and signs stand for.
INSULTS = frozenset("idiot moron loser stupid scum trash clown worthless pathetic disgusting dumb fool hate kill ugly shut crap damn imbecile idiota tonto asqueroso basura dummkopf abschaum blöd imbécile stupide ordure".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

TOKEN = re.compile(r"\w+")
DISGUISED = re.compile(r"(?<!\w)(?:[^\W\d_][.*_\-]){2,}[^\W\d_](?!\w)|[^\W\d_]+[@$!0134570*][^\W\d_]+")
STEM = 5
FEATURES = ("n_words", "lexicon", "lexicon_hits", "strongest", "mean_top", "stems", "stem_hits", "fixed", "fixed_hits", "second", "second_near", "capitals", "shouted", "exclaimed", "punctuation", "disguised", "disguised_hits", "symbols", "repeats", "word_length")


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 3, size: int = 20_000) -> tuple[dict[str, float], dict[str, float]]:
    """(words, word beginnings) -> log-odds under the label, for those clearly on its side (document counts, smoothed)."""
    out = []
    pos, neg = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    for terms in (lambda t: set(words(t)), lambda t: {w[:STEM] for w in words(t) if len(w) > STEM}):
        a, b = Counter(), Counter()
        for text, label in zip(texts, labels, strict=True):
            (a if label else b).update(terms(text))
        odds = {}
        for w, n in a.items():
            if n >= least:
                r = np.log((n + 0.1) / pos) - np.log((b[w] + 0.1) / neg)
                se = np.sqrt(1 / (n + 0.1) + 1 / (b[w] + 1))
                if r > 1.5 and r / se > 2.5:
                    odds[w] = float(r)
        best = sorted(odds, key=lambda w: (-odds[w] * np.log1p(a[w]), w))[:size]
        out.append({w: odds[w] for w in best})
    return out[0], out[1]


def features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    n_chars = max(1, len(text))
    raw = TOKEN.findall(text)
    ws = [w.lower() for w in raw]
    n = max(1, len(ws))
    known = lexicon.keys() & (own := set(ws))
    hits = [lexicon[w] for w in ws if w in lexicon] if known else []
    top = sorted(hits, reverse=True)[:3]
    starts = {w[:STEM] for w in own if len(w) > STEM} & stems.keys()
    stem_hits = sum(w[:STEM] in starts for w in ws if len(w) > STEM) if starts else 0
    fixed = sum(w in INSULTS for w in ws) if not INSULTS.isdisjoint(own) else 0
    second = sum(w in SECOND for w in ws) if not SECOND.isdisjoint(own) else 0
    near = 0
    if second and (known or fixed):
        bad = [i for i, w in enumerate(ws) if w in lexicon or w in INSULTS]
        you = np.array([i for i, w in enumerate(ws) if w in SECOND])
        near = sum(int(np.abs(you - i).min() <= 5) for i in bad)
    odd = [m[0] for m in DISGUISED.finditer(text)]
    plain = [re.sub(r"[.*_\-]", "", unicodedata.normalize("NFKD", x.lower()).translate(LOOKS)) for x in odd]
    odd_hits = sum(w in lexicon or w in INSULTS for w in plain)
    capitals = sum(map(str.isupper, raw)) if raw else 0
    upper = sum(map(str.isupper, text))
    signs = len(text) - sum(map(len, raw))
    spaces = text.count(" ") + text.count("\n")
    return [
        np.log1p(len(ws)), len(hits) / n, len(hits), top[0] if top else 0.0, sum(top) / 3, stem_hits / n, stem_hits, fixed / n, fixed,
        second / n, near / n, upper / n_chars, capitals / n, (text.count("!") + text.count("?")) / n_chars, (signs - spaces) / n_chars,
        len(odd) / n, odd_hits, sum(text.count(c) for c in "*#$%&@") / n_chars, 1 - len(own) / n, sum(map(len, ws)) / n,
    ]


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, grown by histograms; trees are flat arrays."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, l2: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: edge[b-1] < x <= edge[b]
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            prob = 1 / (1 + np.exp(-f))
            self.trees.append(self._grow(binned, edges, y - prob, prob * (1 - prob)))
            f += self._tree(x, self.trees[-1])
        return self

    def _grow(self, binned, edges, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(g))}
        for node in range(size):
            at = rows.pop(node, None)
            if at is None:
                continue
            G, H = g[at].sum(), h[at].sum()
            value[node] = self.rate * G / (H + self.l2)
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(binned[at, j], g[at], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[at, j], h[at], len(e) + 1))[:-1]
                gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
                gain[(hl < self.least / 4) | (H - hl < self.least / 4)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                feature[node], cut[node] = j, edges[j][k]
                left = binned[at, j] <= k
                rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    def _tree(self, x, tree):
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            j = feature[node]
            inner = j >= 0
            right = x[np.arange(len(x)), np.maximum(j, 0)] > cut[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._tree(x, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, value), value rising, to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest and highest score
    for s, v in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1][0] += b[0]
            blocks[-1][1] += b[1]
            blocks[-1][3] = b[3]
    knots = [(s, (b[0] + 0.5 * b[0] / max(b[1], 1)) / (b[1] + 0.5)) for b in blocks for s in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Toxicity:
    """The fitted whole: lexicon, trees, calibration."""

    def fit(self, texts: list[str], labels: np.ndarray, folds: int = 4) -> Toxicity:
        """Calibration uses margins of rows that neither the lexicon nor the trees of their fold have seen."""
        labels = np.asarray(labels, dtype=float)
        self.lexicon, self.stems = learn_lexicon(texts, labels)
        fold = np.arange(len(texts)) % folds
        x, out = np.zeros((len(texts), len(FEATURES))), np.zeros(len(texts))
        for k in range(folds if len(texts) >= 4 * folds else 0):
            rest = np.flatnonzero(fold != k)
            lexicon, stems = learn_lexicon([texts[i] for i in rest], labels[rest])
            own = np.flatnonzero(fold == k)
            x[own] = [features(texts[i], lexicon, stems) for i in own]
        # a row's features come from a lexicon learned without it, so trees don't trust the lexicon too much
        self.trees = Boosted().fit(x, labels)
        for k in range(folds):
            own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
            if len(own) and len(rest):
                out[own] = Boosted().fit(x[rest], labels[rest]).margin(x[own])
        self.knots = isotonic(out, labels) if len(texts) else (np.zeros(1), np.full(1, 0.0))
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin = self.trees.margin(np.array([features(t, self.lexicon, self.stems) for t in texts]))
        p = np.interp(margin, *self.knots)
        # within a flat step the margin still orders the rows, by less than a calibration step
        return np.clip(p + 1e-6 * np.tanh(margin / 8), 0.0, 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 8_000) -> Toxicity:
    """Fit on at most max_rows labelled rows, those with the smallest hash of the id. No labelled row: scores are 0.
    Under 16 labelled rows no folds are made: features are zero in fitting, and all scores are the calibrated base rate."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows ids: bounded
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    return Toxicity().fit([r["text"] for r in got], np.array([r["y"] for r in got], dtype=float))


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score in [0, 1]. Null and empty texts get the score of an empty text; other columns pass through, but for
    one already named `score_col` (in any case), which the new one replaces.

    The model travels with the plan: lexicon and trees are bounded by their parameters.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != score_col.lower()])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in lean(batches):
            p = model.score([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
