"""Near duplicates by DartMinHash, banding, and an exact check.

1. A text is the set (or multiset) of its five-word shingles. Hashed darts fall into the region of every element: unit
   layers of weight times a rank axis, at Poisson distances from hashes of (element, layer, number). Darts up to rank t / total weight, about
   t = k ln k + 2k of them whatever the text's length, get a coordinate by hash; the earliest of each of the k
   coordinates is the signature (a text that leaves a coordinate empty throws on, to twice the rank).
2. Texts with equal sets are one node. Bands of coordinates link nodes that agree in one; connected nodes are a family.
3. In a family the true similarity decides. A search over each family's sets finds the components of all links at or
   above the threshold without listing pairs: each node in turn is compared with those not yet reached.
4. A family too large for one task is dealt into blocks. Each block is searched with some pivots of the family beside it,
   so near copies of one text become one class across all blocks. What is not in the family's largest class by then is
   searched against all blocks: the rest of a large class is never compared with itself, so the work grows with the family
   and what stands apart in it, not with its square; no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._bytes import Prefix, mix
from lumenfold.llm._common import attach, lean, written
from lumenfold.llm.components import components

WORDS = 5
_TIMES = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(WORDS)], dtype=np.uint64)
#: Characters of text that are hashed together.
CHUNK = 1 << 20


def shingle_sets(texts: list[str], words: int = WORDS):
    """(elements, counts) of each text: sorted distinct hashes of runs of `words` lower-case words (split at ASCII white
    space), with how often each occurs. Fewer words: one run of what there is; none: no element."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < CHUNK):
            part.append(texts[at].lower().encode("utf-8", "replace") + b" ")
            size += len(part[-1])
            at += 1
        data = np.frombuffer(b"".join(part), dtype=np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start = edge[~blank[edge]]
        if not blank[0]:
            start = np.append(0, start)
        end = edge[blank[edge]]
        word = Prefix(data).hash(start, end)
        bounds = np.cumsum([len(p) for p in part])
        first = np.searchsorted(start, np.append(0, bounds[:-1]))
        last = np.append(first[1:], len(start))
        run = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
        for i in range(words):
            run += word[i : i + len(run)] * _TIMES[i]
        run = mix(run)
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= words:
                yield np.unique(run[a : b - words + 1], return_counts=True)
            elif b > a:
                yield mix((word[a:b] * _TIMES[: b - a]).sum(keepdims=True)), np.ones(1, dtype=np.int64)
            else:
                yield np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k earliest darts (uint64) of a weighted set; equal in a coordinate with the probability of the weighted Jaccard similarity."""
    total = float(weights.sum())
    if total <= 0:
        return np.zeros(k, dtype=np.uint64)
    layers = np.ceil(weights).astype(np.int64)
    if layers.max() > 1:
        of = np.repeat(np.arange(len(elements)), layers)
        layer = np.arange(len(of)) - np.repeat(np.cumsum(layers) - layers, layers)
        region, room = mix(elements[of] + layer.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), weights[of] - layer
    else:
        region, room = elements, weights
    whole = bool((room >= 1).all())
    limit = (k * math.log(k) + 2 * k) / total
    while True:
        darts, ranks = [], []
        live, rank, number = region, np.zeros(len(region)), 1
        space = room
        while len(live):
            d = mix(live + np.uint64(number * 0x9FB21C651E98DF25 % (1 << 64)))
            rank = rank - np.log(((d >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            near = rank <= limit
            live, rank, d, space = live[near], rank[near], d[near], space[near]
            if whole:
                darts.append(d)
                ranks.append(rank)
            else:  # a dart's place on the weight axis of its layer
                inside = (mix(d + np.uint64(5)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < space
                darts.append(d[inside])
                ranks.append(rank[inside])
            number += 1
        dart, rank = np.concatenate(darts), np.concatenate(ranks)
        dart = mix(dart + np.uint64(3))
        order = np.argsort(rank, kind="stable")
        coordinate = (dart % np.uint64(k)).astype(np.int64)[order]
        found, first = np.unique(coordinate, return_index=True)
        if len(found) == k:
            return dart[order[first]]
        limit *= 2


def bands_of(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for i in range(rows.shape[1]):
        key = mix(key ^ rows[:, i]) + np.uint64(i)
    return key


def search(sets: list[np.ndarray], counts: list[np.ndarray], threshold: float, sides: np.ndarray | None = None) -> np.ndarray:
    """Root (an index) of each set's component under links of similarity >= threshold.

    With sides (0 or 1 for each set) only links between the two sides are looked for: components of that graph.
    """
    m = len(sets)
    root = np.arange(m)
    if m < 2:
        return root
    sizes = np.array([c.sum() for c in counts], dtype=np.float64)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    count = np.concatenate(counts)
    starts = np.append(0, np.cumsum([len(s) for s in sets]))
    by_element = np.argsort(element, kind="stable")
    left = m  # sets not reached yet; postings hold few besides them

    def postings(keep):
        order = by_element[keep[owner[by_element]]]
        e = element[order]
        first = np.searchsorted(e, np.arange(element.max() + 2))
        return owner[order], count[order], first

    reached = np.zeros(m, dtype=bool)
    who, many, first = postings(~reached)
    held = m
    for seed in range(m):
        if reached[seed]:
            continue
        reached[seed] = True
        left -= 1
        queue = [seed]
        while queue and left:
            i = queue.pop()
            own, n = element[starts[i] : starts[i + 1]], count[starts[i] : starts[i + 1]]
            lo, hi = first[own], first[own + 1]
            length = hi - lo
            at = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
            shared = np.bincount(who[at], np.minimum(many[at], np.repeat(n, length)), m)
            union = sizes[i] + sizes - shared
            close = (shared >= threshold * union - 1e-9) & ~reached & (shared > 0)
            if sides is not None:
                close &= sides != sides[i]
            new = np.flatnonzero(close)
            reached[new] = True
            root[new] = seed
            left -= len(new)
            queue += new.tolist()
            if left and left < held / 2:
                who, many, first = postings(~reached)
                held = left
    return root


def _family_links(batches, threshold: float, weighted: bool):
    """Rows (block, side, v, text), sorted by block, to links (u, v). In a block with sides 0 and 1, links between the two;
    in one with side 0 alone, or side 2 (pivots) beside it, links among all."""
    held: list[tuple] = []

    def flush():
        seen, texts, ids, sides = set(), [], [], []
        for _, side, v, text in held:
            if (v, side == 1) not in seen:
                seen.add((v, side == 1))
                ids.append(v)
                texts.append(text)
                sides.append(int(side == 1))
        pairs = list(shingle_sets(texts))
        counts = [c if weighted else np.ones_like(c) for _, c in pairs]
        root = search([s for s, _ in pairs], counts, threshold, np.array(sides) if len(set(sides)) > 1 else None)
        return [(ids[i], ids[r]) for i, r in enumerate(root.tolist()) if ids[i] != ids[r]]

    def batch(rows):
        cols = list(zip(*rows, strict=True)) if rows else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["u", "v"])

    out = []
    for b in lean(batches):
        for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[-1][0] != row[0]:
                out += flush()
                held = []
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            held.append(row)
    if held:
        out += flush()
    yield batch(out)


def _small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A written table of few columns, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


#: Pivots of a large family; more of them leave less apart after the first round.
PIVOTS = 16


def _large_links(large: DataFrame, links, block: int) -> DataFrame:
    """large(component, v, words, spot, blocks, text): written rows of families in more than one block -> links(u, v), in two
    rounds. links: from rows (b, side, v, text)."""
    # one pivot of each of some blocks: the node with the least hash there
    pivot = large.where(F.col("spot") < PIVOTS).groupBy("component", "spot").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    pivots = large.join(_small(written(pivot.select("v"), "pivots")), "v", "left_semi").select("component", "v", "text", F.col("blocks").alias("n"))
    spots = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("spot")
    beside = pivots.select("component", spots, "v", "text").select(F.struct("component", "spot", F.lit(-1).alias("other")).alias("b"), F.lit(2).alias("side"), "v", "text")
    own = large.select(F.struct("component", "spot", F.lit(-1).alias("other")).alias("b"), F.lit(0).alias("side"), "v", "text")
    first = written(links(own.unionByName(beside)), "links")
    found = written(components(first), "pivot-classes")
    # the largest class of each family rests; what is apart meets all blocks
    nodes = large.select("component", "v", "words").join(found.select(F.col("node").alias("v"), F.col("component").alias("class")), "v", "left")
    nodes = written(nodes.withColumn("class", F.coalesce("class", "v")), "pivot-nodes")
    sizes = nodes.groupBy("component", "class").agg(F.count(F.lit(1)).alias("n"))
    rest = sizes.groupBy("component").agg(F.max_by("class", F.struct("n", "class")).alias("class"))
    apart = written(nodes.join(rest, ["component", "class"], "left_anti").select("component", "v", "words"), "apart")
    dealt = apart.groupBy("component").agg(F.ceil(F.sum("words") / block).cast("int").alias("parts"))
    dealt = written(dealt, "apart-parts")
    marked = large.join(_small(dealt), "component")
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    every = marked.select("component", "spot", parts, "v", "text").select(F.struct("component", "spot", "other").alias("b"), F.lit(1).alias("side"), "v", "text")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("spot")
    part = F.pmod(F.xxhash64("v", F.lit(7)), F.col("parts")).cast("int").alias("other")
    alone = marked.join(apart.select("v"), "v", "left_semi").select("component", blocks, part, "v", "text")
    alone = alone.select(F.struct("component", "spot", "other").alias("b"), F.lit(0).alias("side"), "v", "text")
    return first.unionByName(written(links(every.unionByName(alone)), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 24, band_rows: int = 5, weighted: bool = False, block: int = 50_000) -> DataFrame:
    """One row per input row: id, class_id (least id of its class), class_size (rows), representative (exactly one row
    of each class, one with the least id), text_hash (xxhash64 of the text, to find the row again).

    A class is a connected component of links of similarity >= threshold. Null counts as empty; texts without words
    are one class; repeated rows are one class. Null ids come last. `block` bounds the shingles that a task of the
    exact search gathers for one side. Empty input: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("r"), text.alias("text"))

    def sign(batches):
        for batch in lean(batches):
            ids, r = batch.column(0), batch.column(1)
            out = ([], [], [], [])
            for e, c in shingle_sets(batch.column(2).to_pylist()):
                w = c if weighted else np.ones(len(e), dtype=np.int64)
                both = e + w.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) if weighted else e
                out[0].append(int(mix(both).sum().view(np.int64)) if len(e) else 0)
                out[1].append(int(np.bitwise_xor.reduce(mix(both ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(e) else 0)
                out[2].append(int(w.sum()))
                signature = dart_minhash(e, w.astype(np.float64), bands * band_rows)
                out[3].append(bands_of(signature, bands).view(np.int64))
            keys = pa.array(out[3], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, r, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), keys], ["id", "r", "d1", "d2", "n", "bands"])

    signed = written(rows.mapInArrow(sign, "id long, r long, d1 long, d2 long, n long, bands array<long>").withColumn("row", F.monotonically_increasing_id()), "signed")
    total = signed.count()
    # equal sets are one node, numbered by its first row
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "r"))
    nodes = signed.groupBy("d1", "d2", "n").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("d1", "d2", "n", F.col("first.row").alias("v"), F.col("first.id").alias("id"), F.col("first.r").alias("r"), "copies"), "nodes")
    keyed = signed.select(F.col("row").alias("v"), "bands").join(nodes.select("v"), "v", "left_semi")
    keyed = written(keyed.select("v", F.posexplode("bands").alias("band", "key")), "bands")
    buckets = keyed.groupBy("band", "key").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = written(buckets.withColumn("bk", F.struct("band", "key")).select("bk", "m", "c"), "buckets")
    candidates = attach(keyed.withColumn("bk", F.struct("band", "key")), buckets, "bk", "c", max(1, total) * bands)
    stars = written(candidates.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
    families = written(components(stars), "families")
    # families' texts, one a node; large families in blocks
    members = families.join(nodes.select(F.col("v").alias("node"), "n", F.coalesce("id", F.lit(-(1 << 62))).alias("k"), "r"), "node")
    members = written(members, "members")
    sizes = members.groupBy("component").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("c"))
    sizes = written(sizes.withColumn("blocks", F.when(F.col("words") <= 2 * block, 1).otherwise(F.ceil(F.col("words") / block)).cast("int")), "sizes")
    placed = attach(members, sizes.drop("words"), "component", "c", max(1, total))
    spot = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = placed.select("k", "r", F.col("node").alias("v"), "component", F.col("n").alias("words"), "blocks", spot.alias("spot"))
    texts = rows.select(F.coalesce("id", F.lit(-(1 << 62))).alias("k"), "r", "text").join(placed, ["k", "r"])
    texts = written(texts.select("component", "v", "words", "spot", "blocks", "text"), "family-texts")

    def links(dealt: DataFrame) -> DataFrame:
        dealt = dealt.repartition("b").sortWithinPartitions("b").select(F.to_json("b").alias("block"), "side", "v", "text")
        return dealt.mapInArrow(lambda it: _family_links(it, threshold, weighted), "u long, v long")

    small = texts.where("blocks = 1").select(F.struct("component").alias("b"), F.lit(0).alias("side"), "v", "text")
    stars = written(links(small), "links")
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if not sizes.where("blocks > 1").isEmpty():
        found = found.unionByName(components(_large_links(texts.where("blocks > 1"), links, block)))
    found = written(found, "classes")
    # classes over nodes, then over rows
    named = nodes.join(found.withColumnRenamed("node", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    named = written(named.select("d1", "d2", "n", "v", "id", "component", "copies"), "named")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "v"))
    classes = named.groupBy("component").agg(least.alias("first"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("c"))
    classes = written(classes.select("component", F.col("first.id").alias("class_id"), F.col("first.v").alias("head"), "class_size", "c"), "class-heads")
    named = attach(named.drop("id"), classes, "component", "c", total).withColumn("set", F.struct("d1", "d2", "n"))
    facts = written(named.select("set", "class_id", "class_size", "head", "copies"), "class-facts")
    out = attach(signed.select("id", "r", "row", F.struct("d1", "d2", "n").alias("set")), facts, "set", "copies", total)
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("head")).alias("representative"), F.col("r").alias("text_hash"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
