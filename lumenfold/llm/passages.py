"""Words in passages that several documents have.

A word is shared if a run of `length` words that covers it also occurs in another document, whatever stands around it and
however words are spaced.

1. Anchors as in suffix_dedup.py, of words: the least hash of all K-word runs picks an anchor in each `length`-word window.
   Windows with one anchor form an interval; its context is all words that its windows cover. An anchor in one document
   alone has no shared window; a context in two documents has only shared ones.
2. Contexts of one document whose anchor another document has are looked at by windows, against one row of each shared
   context. They are gathered by anchor. Where an anchor has over `most` of them, they are counted: first in runs of CELL
   windows, by the words that all windows of a run have (in one document alone: none is shared) and by all words of the
   run (in two: all are shared), then by the windows of what is open.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import _bytes
from lumenfold.llm._bytes import Prefix, intervals, mix, pieces
from lumenfold.llm._common import SPACE, attach, lean, written

#: Words of an anchor; windows in a run.
K, CELL = 6, 6
_RUN = "core: bigint, whole: bigint, at: bigint, windows: array<bigint>"
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NEXT_SPACE = re.compile(rf"[{SPACE}]".encode())


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of each text's words. A word of PIECE bytes and more is hashed by itself, so memory is bounded by PIECE."""
    blob = b"\n".join(texts) + b"\n"
    found, places = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    at = 0
    while at < len(blob):
        piece = np.frombuffer(blob, dtype=np.uint8, count=min(_bytes.PIECE, len(blob) - at), offset=at)
        space = _IS_SPACE[piece]
        gaps = np.flatnonzero(space)
        if len(gaps):
            space = space[: gaps[-1] + 1]
            edge = np.flatnonzero(space[1:] != space[:-1]) + 1
            edge = edge if space[0] else np.concatenate([[0], edge])
            found.append(Prefix(piece[: len(space)]).hash(edge[::2], edge[1::2]))
            places.append(edge[::2] + at)
            at += len(space)
        else:
            end = _NEXT_SPACE.search(blob, at).start()
            found.append(np.frombuffer(blake2b(memoryview(blob)[at:end], digest_size=8).digest(), dtype=np.uint64))
            places.append(np.array([at]))
            at = end
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(np.concatenate(found), np.searchsorted(np.concatenate(places), ends[:-1]))


def anchors(texts: list[bytes], length: int):
    """Arrays (text index, anchor hash, context hash, first start, last start) of all intervals of starts, counted in words."""
    for owners, parts in pieces(word_hashes(texts), length):
        prefix = Prefix(np.concatenate(parts))
        g = prefix.windows(K)
        sizes = np.array([len(p) for p in parts])
        lo, hi, a, own = intervals(g, sizes, length, K)
        context = mix(prefix.hash(lo, hi + length) + (a - lo).astype(np.uint64))
        shift = np.array([off for _, off in owners])[own] - (np.cumsum(sizes) - sizes)[own]
        yield np.array([i for i, _ in owners])[own], g[a].view(np.int64), context.view(np.int64), lo + shift, hi + shift


def cells(words: np.ndarray, w: np.ndarray, lo: int, hi: int, length: int) -> list[dict]:
    """The runs of windows lo..hi, which have one anchor, in fixed ranges of distances to it; w are the hashes of all windows."""
    prefix = Prefix(words[lo : hi + length])
    a = int(np.argmin(prefix.windows(K)[: length - K + 1]))
    cell = np.arange((a - hi + lo) // CELL, a // CELL + 1)
    near, far = a - cell * CELL, a - cell * CELL - CELL + 1
    x, y = np.maximum(0, far), np.minimum(hi - lo, near)
    core = mix(prefix.hash(near, far + length) ^ mix(cell.astype(np.uint64))).view(np.int64).tolist()
    both = mix(w[lo + x].view(np.uint64) ^ mix(w[lo + y].view(np.uint64))).view(np.int64).tolist()
    full = ((x == far) & (y == near)).tolist()
    return [{"core": core[i], "whole": both[i] if full[i] else None, "at": lo + p, "windows": w[lo + p : lo + q + 1]} for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]


def shared_windows(h: np.ndarray, low: np.ndarray, high: np.ndarray, windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Runs (row, first window, last window) of windows in several documents; low and high are two documents of a row, or one twice."""
    sizes = np.array([len(w) for w in windows])
    of = np.repeat(np.arange(len(windows)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.concatenate(windows).view(np.uint64) ^ mix(h.view(np.uint64))[of]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(low[of][order], first) < np.maximum.reduceat(high[of][order], first)
    hit = np.zeros(len(of), dtype=bool)
    hit[order] = several[np.cumsum(new) - 1]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])) + 1
    begin, end = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return list(zip(of[begin].tolist(), place[begin].tolist(), place[end].tolist(), strict=True))


def shared_ranges(rows: DataFrame, length: int, most: int = 500) -> DataFrame:
    """rows(k, r, text) -> (k, r, s, e): ranges of words, perhaps overlapping, that together are all shared words. Documents are told apart by r."""

    def find(batches):
        for batch in lean(batches):
            k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
            for i, h, c, lo, hi in anchors(texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[i], r[i], h, c, lo, hi)], ["k", "r", "h", "c", "lo", "hi"])

    marks = written(rows.mapInArrow(find, "k long, r long, h long, c long, lo long, hi long"), "word-anchors")
    per_h = marks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).where("low < high").select("h", "n")
    marks = written(attach(marks, written(per_h, "shared-anchors"), "h", "n", marks.count()).select("k", "r", F.struct("h", "c").alias("hc"), "lo", "hi"), "shared-marks")
    one = F.min(F.struct("r", "k", "lo", "hi"))
    contexts = written(marks.groupBy("hc").agg(F.count(F.lit(1)).alias("n"), one.alias("one"), F.max("r").alias("high")).withColumn("single", F.expr("one.r = high")), "word-contexts")
    again = attach(marks, contexts.where("n > 1").select("hc", "n", "single"), "hc", "n", marks.count())
    again = written(again.select("k", "r", "hc.h", "lo", "hi", "single"), "word-contexts-again")
    whole = again.where("NOT single").select("k", "r", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))

    first = contexts.select("hc.h", "n", "single", "one.k", "one.r", "one.lo", "one.hi", "high")
    spots = first.where("single AND n = 1").drop("n").unionByName(again.where("single").withColumn("high", F.col("r")))
    # what all documents of an anchor share needs no look
    spots = spots.unionByName(first.where("NOT single").drop("n").join(first.where("single").select("h").distinct(), "h", "left_semi"))
    spots = written(spots, "word-spots")
    # at most a key for every `most` rows
    hot = written(spots.groupBy("h").count().where(F.col("count") > most).select("h", F.lit(True).alias("hot")), "hot-words")
    spots = spots.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spots = spots.groupBy("k", "r").agg(F.collect_list(F.struct("h", "lo", "hi", "high", "single", "hot")).alias("spots"))

    def fetch(batches):
        names = ["k", "r", "h", "lo", "high", "single", "windows", "runs"]
        run = pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("at", pa.int64()), ("windows", pa.list_(pa.int64()))])
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.int64()), pa.list_(run)]
        for batch in lean(batches, 500):
            out = []
            k, r, spots = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i, words in enumerate(word_hashes([t.encode("utf-8") for t in batch.column(2).to_pylist()]) if batch.num_rows else ()):
                w = Prefix(words).windows(length).view(np.int64)
                for s in spots[i]:
                    found = (None, cells(words, w, s["lo"], s["hi"], length)) if s["hot"] else (w[s["lo"] : s["hi"] + 1], None)
                    out.append((k[i], r[i], s["h"], s["lo"], s["high"], s["single"], *found))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    looked = rows.join(spots, ["k", "r"]).select("k", "r", "text", "spots")
    looked = written(looked.mapInArrow(fetch, f"k long, r long, h long, lo long, high long, single boolean, windows array<long>, runs array<struct<{_RUN}>>"), "word-windows")

    def decide(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            h, k, r, high, lo, single = (np.array([x[i] for x in held]) for i in range(6))
            hits = [x for x in shared_windows(h, r, high, [x[6] for x in held]) if single[x[0]]] if held else []
            i, first, last = np.array(hits, dtype=np.int64).reshape(-1, 3).T
            parts = [k[i], r[i], lo[i] + first, lo[i] + last + length] if hits else [np.zeros(0, dtype=np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], ["k", "r", "s", "e"])

        for batch in batches:
            values = batch.column(6)
            flat, at = values.values.to_numpy(), values.offsets.to_numpy()
            columns = (batch.column(i).to_pylist() for i in range(6))
            for j, x in enumerate(zip(*columns, strict=True)):
                if size > 1 << 18 and x[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append((*x, flat[at[j] : at[j + 1]]))
                size += int(at[j + 1] - at[j])
        yield flush()

    few = looked.where("runs IS NULL").select("h", "k", "r", "high", "lo", "single", "windows").repartition("h").sortWithinPartitions("h")
    few = written(few.mapInArrow(decide, "k long, r long, s long, e long"), "word-runs")
    return whole.unionByName(few).unionByName(_hot_ranges(looked.where("runs IS NOT NULL"), length))


def _hot_ranges(looked: DataFrame, length: int) -> DataFrame:
    """Ranges of the shared words among contexts of anchors that have too many to gather: by counting runs, then windows."""
    several = [F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("high").alias("top")]
    runs = written(looked.select("k", "r", "h", "high", "single", F.explode("runs").alias("x")).select("k", "r", "h", "high", "single", F.struct("h", "x.core").alias("hc"), "x.whole", "x.at", "x.windows"), "hot-runs")
    n = runs.count()
    cores = written(runs.groupBy("hc").agg(*several).where("low < top").select("hc", "n"), "shared-cores")
    runs = written(attach(runs, cores, "hc", "n", n).drop("hc", "n").withColumn("hw", F.struct("h", "whole")), "open-runs")
    wholes = written(runs.where("whole IS NOT NULL").groupBy("hw").agg(*several), "wholes")
    known = written(attach(runs.where("whole IS NOT NULL"), wholes, "hw", "n", n), "known-runs")
    settled = known.where("low < top AND single").select("k", "r", F.col("at").alias("s"), (F.col("at") + CELL - 1 + length).alias("e"))
    # one of each shared run stays as a partner for the others
    partner = known.where("low < top").dropDuplicates(["hw"]).withColumns({"r": F.col("low"), "high": F.col("top"), "single": F.lit(False)})
    names = ["k", "r", "h", "high", "single", "at", "windows"]
    rest = runs.where("whole IS NULL").select(names).unionByName(known.where("low = top").select(names)).unionByName(partner.select(names))
    windows = rest.select("k", "r", "h", "high", "single", "at", F.posexplode("windows").alias("i", "w"))
    windows = written(windows.select("k", "r", "high", "single", (F.col("at") + F.col("i")).alias("s"), F.struct("h", "w").alias("hw")), "hot-windows")
    found = written(windows.groupBy("hw").agg(*several).where("low < top").select("hw", "n"), "shared-windows")
    found = attach(windows.where("single"), found, "hw", "n", windows.count())
    return settled.unionByName(found.select("k", "r", "s", (F.col("s") + length).alias("e")))
