"""Removal of long repeated byte strings, by sorted suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus.

1. Anchors. The least hash of all 48-byte substrings of a `length`-byte window picks an anchor in it, by the window's
   content alone, so equal windows have equal anchors at equal places. Windows with one anchor form an interval of
   starts (about `length` / 2 of them); its context is all bytes its windows cover. An anchor whose hash occurs once
   has no repeated window; a context that occurs twice has only repeated ones. Both are settled by counting.
2. What is left (edges of repeated passages, edits in near copies) is gathered by anchor hash. Runs of 44 starts whose
   common bytes occur once are settled, too. The suffixes at the others are sorted in two stages: those smaller than
   their successors directly, the rest induced by one scan over the buckets of their first bytes. Neighbours with a
   common prefix of `length` bytes are the repeated strings.
3. An anchor with over `most` different contexts is not gathered: its runs, finer runs and at last single windows are
   counted by hash, which combines before any shuffle and needs no group in one place.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm._bytes import Prefix, intervals, mix, pieces
from lumenfold.llm._common import attach, lean, written
from lumenfold.llm.passages import shared_ranges

#: Bytes of an anchor; starts in a run.
K, CELL = 48, 44
ROW = "k long, r long"


def anchors(texts: list[bytes], length: int):
    """Arrays (text index, first start, last start, anchor position, anchor hash) and 128-bit context hashes (bytes) of all intervals of starts."""
    for owners, parts in pieces(texts, length):
        raw = b"".join(parts)
        g = Prefix(np.frombuffer(raw, dtype=np.uint8)).windows(K)
        sizes = np.array([len(p) for p in parts])
        first = np.cumsum(sizes) - sizes
        lo, hi, a, own = intervals(g, sizes, length, K)
        context = [blake2b(raw[x : y + length], digest_size=16, salt=d.to_bytes(8, "little")).digest() for x, y, d in zip(lo.tolist(), hi.tolist(), (a - lo).tolist(), strict=True)]
        shift = np.array([off for _, off in owners])[own] - first[own]
        yield np.array([i for i, _ in owners])[own], lo + shift, hi + shift, a + shift, g[a].view(np.int64), context


def cells(lo: np.ndarray, hi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(interval index, cell, first start, last start) of the runs of starts; a cell is a fixed range of distances to the anchor."""
    c0, c1 = (a - hi) // CELL, (a - lo) // CELL
    n = c1 - c0 + 1
    of = np.repeat(np.arange(len(lo)), n)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + c0[of]
    return of, cell, np.maximum(lo[of], a[of] - cell * CELL - CELL + 1), np.minimum(hi[of], a[of] - cell * CELL)


def repeats(contexts: list[bytes], lo: np.ndarray, a: np.ndarray, group: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Runs (context index, first start, last start) of repeated windows, among contexts of whole groups.

    contexts[i] holds the bytes from start lo[i] on; a is the anchor's position. Two-stage suffix sorting.
    """
    sizes = np.array([len(c) for c in contexts])
    base = np.cumsum(sizes + 1) - sizes - 1
    # bytes of UTF-8 are below 255: one more leaves 0 for the ends of contexts
    data = np.zeros(int(base[-1] + sizes[-1] + 2), dtype=np.uint8)
    for b, c in zip(base.tolist(), contexts, strict=True):
        data[b : b + len(c)] = np.frombuffer(c, dtype=np.uint8) + np.uint8(1)
    hi = lo + sizes - length
    of, cell, p1, p2 = cells(lo, hi, a)
    to_data = base - lo
    q1, q2 = p1 + to_data[of], p2 + to_data[of]
    anchor = a[of] + to_data[of]
    prefix = Prefix(data)
    nearest, farthest = anchor - cell * CELL, anchor - cell * CELL - CELL + 1
    key = mix(group[of].view(np.uint64) * np.uint64(1 + (1 << 20)) + cell.astype(np.uint64))
    core = prefix.hash(nearest, farthest + length) ^ key
    _, inverse, count = np.unique(core, return_inverse=True, return_counts=True)
    open_ = count[inverse] > 1
    full = open_ & (q1 == farthest) & (q2 == nearest)
    found = []
    if full.any():
        at = np.flatnonzero(full)
        _, inverse, count = np.unique(prefix.hash(q1[at], q2[at] + length) ^ key[at], return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        found += list(zip(of[at].tolist(), p1[at].tolist(), p2[at].tolist(), strict=True))
        # one of each whole run stays as a partner for the others
    at = np.flatnonzero(open_)
    if not len(at):
        return found
    wanted = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(q1[at].tolist(), q2[at].tolist(), strict=True)]))
    # smaller than the successor: the first byte that differs is greater
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    after = np.append(change + 1, n - 1)[np.searchsorted(change, np.arange(n), side="left")]
    smaller = data[after] > data
    smaller[data == 0] = True
    step = np.where(smaller, np.arange(n), n - 1)
    next_smaller = np.minimum.accumulate(step[::-1])[::-1]
    taken = np.zeros(n, dtype=bool)
    taken[wanted] = True
    last = next_smaller[wanted[np.append(wanted[1:] != wanted[:-1] + 1, True)]]
    for x, y in zip(wanted[np.append(wanted[1:] != wanted[:-1] + 1, True)].tolist(), last.tolist(), strict=True):
        taken[x : y + 1] = True  # up to a suffix that is sorted directly
    every = np.flatnonzero(taken)
    text = data.tobytes()
    direct = every[smaller[every]].tolist()
    direct.sort(key=lambda s: text[s : s + length + 1])
    per_byte = np.bincount(data[every], minlength=256)
    head = (np.cumsum(per_byte) - per_byte).tolist()
    order = np.full(len(every), -1, dtype=np.int64)
    bytes_of = data[np.array(direct, dtype=np.int64)]
    n_direct = np.bincount(bytes_of, minlength=256)
    start = np.cumsum(per_byte) - n_direct - (np.cumsum(n_direct) - n_direct)
    order[np.arange(len(direct)) + start[bytes_of]] = direct
    order = order.tolist()
    induced = (taken & ~smaller).tobytes()
    for s in order:
        if s > 0 and induced[s - 1]:
            b = text[s - 1]
            order[head[b]] = s - 1
            head[b] += 1
    mark = np.zeros(n, dtype=bool)
    mark[wanted] = True
    asked = mark.tobytes()
    repeated = np.zeros(n, dtype=bool)
    before, before_text = -1, b""
    for s in order:
        if asked[s]:
            t = text[s : s + length]
            if t == before_text:
                repeated[s] = repeated[before] = True
            before, before_text = s, t
    hit = np.flatnonzero(repeated)
    if len(hit):
        cuts = np.flatnonzero(hit[1:] != hit[:-1] + 1) + 1
        first, end = hit[np.concatenate([[0], cuts])], hit[np.concatenate([cuts - 1, [len(hit) - 1]])]
        who = np.searchsorted(base, first, side="right") - 1
        found += list(zip(who.tolist(), (first - to_data[who]).tolist(), (end - to_data[who]).tolist(), strict=True))
    return found


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def repeated_ranges(rows: DataFrame, length: int, most: int = 500) -> DataFrame:
    """rows(k, r, text) -> (k, r, s, e): byte ranges, perhaps overlapping, that together are all repeated bytes."""

    def find(batches):
        for batch in lean(batches):
            k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t.encode("utf-8") for t in batch.column(2).to_pylist()]
            for i, lo, hi, a, h, c in anchors(texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(k[i]), pa.array(r[i]), pa.array(h), pa.array(c, pa.binary()), *(pa.array(x) for x in (lo, hi, a))], ["k", "r", "h", "c", "lo", "hi", "a"])

    marks = written(rows.mapInArrow(find, f"{ROW}, h long, c binary, lo long, hi long, a long"), "anchors")
    total = marks.count()
    counts = written(marks.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")), "contexts")
    per_h = counts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n_h"), F.count_if(F.col("n") == 1).alias("single")).where("n_h > 1")
    per_h = written(per_h, "anchor-counts")
    facts = attach(counts, per_h, "h", "m", total)
    # a context needs a look at its bytes if it is one of several of its anchor, not all of which are repeated
    facts = facts.select("h", "c", "n", "m", ((F.col("m") > 1) & (F.col("single") > 0)).alias("look")).where("n > 1 OR look")
    facts = facts.withColumn("hc", F.struct("h", "c")).select("hc", "n", "m", "look")
    known = attach(marks.withColumn("hc", F.struct("h", "c")), written(facts, "facts"), "hc", "n", total).drop("hc")
    known = written(known, "known")
    whole = known.where("n > 1").select("k", "r", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    one = known.where("look AND n > 1").dropDuplicates(["h", "c"]).unionByName(known.where("look AND n = 1"))
    spots = one.groupBy("k", "r").agg(F.collect_list(F.struct("h", "lo", "hi", "a", F.col("n").alias("n"), "m")).alias("spots"))

    def fetch(batches):
        for batch in lean(batches, 500):
            out = []
            for k, r, text, spots in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8")
                out += [(k, r, s["h"], s["lo"], s["a"], s["n"] == 1, s["m"], data[s["lo"] : s["hi"] + length]) for s in spots]
            yield _batch(out, ["k", "r", "h", "lo", "a", "single", "m", "data"], [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary()])

    looked = rows.join(spots, ["k", "r"]).select("k", "r", "text", "spots")
    looked = written(looked.mapInArrow(fetch, f"{ROW}, h long, lo long, a long, single boolean, m long, data binary"), "looked")

    def sort(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows):
            lo, a, h = (np.array([x[i] for x in rows], dtype=np.int64) for i in (3, 4, 2))
            hits = repeats([x[6] for x in rows], lo, a, h, length) if rows else []
            return _batch([(rows[i][0], rows[i][1], s, e + length) for i, s, e in hits if rows[i][5]], ["k", "r", "s", "e"], [pa.int64()] * 4)

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size > 1 << 19 and x[2] != held[-1][2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(x)
                size += len(x[6])
        yield flush(held)

    few = looked.where(F.col("m") <= most).drop("m").repartition("h").sortWithinPartitions("h")
    few = few.select("k", "r", "h", "lo", "a", "single", "data").mapInArrow(sort, f"{ROW}, s long, e long")

    many = looked.where(F.col("m") > most).select("k", "r", "h", "lo", "a", "single", "data")
    settled = _hot_ranges(many, length)
    out = whole.unionByName(written(few, "sorted"))
    return out if settled is None else out.unionByName(settled)


#: Starts of runs within runs, for anchors with many contexts.
FINE = 11
_FINE_RUN = "core bigint, whole bigint, at bigint, to bigint"
_RUN = f"{_FINE_RUN}, subs array<struct<core:bigint,whole:bigint,at:bigint,to:bigint,windows:array<bigint>>>"


def _runs(prefix: Prefix, salt: np.uint64, lo: int, hi: int, a: int, width: int, length: int):
    """(core, whole or None, first start, last start) of the runs of starts lo..hi in cells of `width` distances to the
    anchor a; positions count from the context's beginning. The core is what all windows of the cell share; the whole,
    known if the run fills its cell, is what they cover."""
    out = []
    for cell in range((a - hi) // width, (a - lo) // width + 1):
        near, far = a - cell * width, a - cell * width - width + 1
        p1, p2 = max(lo, far), min(hi, near)
        mark = mix(np.array([salt + np.uint64(cell * 64 + width)], dtype=np.uint64))[0]
        one = lambda x, y: int((prefix.hash(np.array([x]), np.array([y]))[0] ^ mark).view(np.int64))
        out.append((one(near, far + length), one(far, near + length) if (p1, p2) == (far, near) else None, p1, p2))
    return out


def _hot_ranges(many: DataFrame, length: int) -> DataFrame | None:
    """Repeated ranges among contexts of anchors that have too many to gather: by counting runs, finer runs, windows.

    A run whose core occurs once has no repeated window; one whose whole occurs twice has only such. Wholes and windows count
    by anchor and hash, 128 bits together. What is open goes
    on to finer runs, one of each settled whole with it as a partner. Counts combine before they are shuffled.
    """

    def deal(batches):
        names = ["k", "r", "h", "single", "core", "whole", "at", "to", "subs"]
        sub = pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("at", pa.int64()), ("to", pa.int64()), ("windows", pa.list_(pa.int64()))])
        for batch in lean(batches, 200):
            rows = []
            for k, r, h, lo, a, single, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                raw = np.frombuffer(data, dtype=np.uint8)
                prefix = Prefix(raw)
                starts = np.arange(len(raw) - length + 1)
                salt = mix(np.array([h], dtype=np.int64).view(np.uint64))[0]
                own = (prefix.hash(starts, starts + length) ^ mix(salt + (a - lo - starts).astype(np.uint64))).view(np.int64)
                for core, full, p1, p2 in _runs(prefix, salt, 0, len(starts) - 1, a - lo, CELL, length):
                    subs = [{"core": c, "whole": w, "at": lo + x, "to": lo + y, "windows": own[x : y + 1].tolist()} for c, w, x, y in _runs(prefix, salt, p1, p2, a - lo, FINE, length)]
                    rows.append((k, r, h, single, core, full, lo + p1, lo + p2, subs))
            yield _batch(rows, names, [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.list_(sub)])

    runs = written(many.mapInArrow(deal, f"{ROW}, h long, single boolean, {_RUN}"), "runs")
    if runs.isEmpty():
        return None
    ranges = []
    for below in ("subs", "windows"):
        n = runs.count()
        cores = written(runs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cores")
        open_ = written(attach(runs, cores, "core", "n", n).drop("n", "core").withColumn("hw", F.struct("h", "whole")), "open")
        wholes = written(open_.where("whole IS NOT NULL").groupBy("hw").agg(F.count(F.lit(1)).alias("n")), "wholes")
        known = written(attach(open_.where("whole IS NOT NULL"), wholes, "hw", "n", n), "known-runs")
        ranges.append(known.where("n > 1 AND single").select("k", "r", F.col("at").alias("s"), (F.col("to") + length).alias("e")))
        partner = known.where("n > 1").dropDuplicates(["h", "whole"]).withColumn("single", F.lit(False))
        rest = open_.where("whole IS NULL").unionByName(known.where("n = 1").drop("n")).unionByName(partner.drop("n"))
        if below == "subs":
            runs = written(rest.select("k", "r", "h", "single", F.explode("subs").alias("x")).select("k", "r", "h", "single", "x.*"), "fine-runs")
    windows = rest.select("k", "r", "h", "single", "at", F.posexplode("windows").alias("i", "w"))
    windows = written(windows.select("k", "r", "single", (F.col("at") + F.col("i")).alias("s"), F.struct("h", "w").alias("w")), "windows")
    again = written(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows-again")
    ranges.append(attach(windows.where("single"), again, "w", "n", windows.count()).select("k", "r", "s", (F.col("s") + length).alias("e")))
    return ranges[0].unionByName(ranges[1]).unionByName(ranges[2])


def joined_ranges(ranges) -> list[list[int]]:
    """Maximal ranges, sorted, from ranges (start, end) that may overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: int = 50) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans (array of removed byte ranges, maximal), kept (binary), n_shared_words.

    n_shared_words counts the words in runs of `words` words and more that another document has too (see passages.py).
    It reports passages, of any number of bytes; nothing goes by it. Rows with the same id and text are one document there.

    Null counts as empty; texts shorter than `length` lose nothing. Repeated rows are repeated texts: both lose what
    they share. Matches never cross documents. Empty input: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))
    rows = docs.select(key.alias("k"), F.xxhash64(text, F.col(id_col)).alias("r"), text.alias("text"), F.col(id_col).alias("id"))
    texts = rows.select("k", "r", "text")
    ranges = repeated_ranges(texts, length).withColumn("of_words", F.lit(False))
    ranges = ranges.unionByName(shared_ranges(texts, words).withColumn("of_words", F.lit(True)))
    ranges = ranges.groupBy("k", "r").agg(F.collect_list(F.struct("s", "e", "of_words")).alias("ranges"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in lean(batches):
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8")
                spans, shared = (joined_ranges((x["s"], x["e"]) for x in ranges or () if x["of_words"] == of_words) for of_words in (False, True))
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                out.append((len(data), sum(e - s for s, e in spans), [{"start": s, "end": e} for s, e in spans], b"".join(kept), sum(e - s for s, e in shared)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rest = _batch(out, ["n_bytes", "n_removed", "spans", "kept", "n_shared_words"], [pa.int64(), pa.int64(), span, pa.binary(), pa.int64()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest.columns], ["id", *rest.schema.names])

    joined = rows.join(ranges, ["k", "r"], "left").select("id", "text", "ranges")
    out = joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, n_shared_words long")
    return out.withColumnRenamed("id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")
