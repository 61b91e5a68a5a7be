"""Exact quantiles of every element of an array column, by key, without exploding the arrays.

A double's bits, read as an order-preserving integer, are settled in steps from the top: tasks count, for each key and
element, how many values fall into each bucket of the next bits (of those that share what is settled so far), and a window
over the summed counts finds the buckets that hold the wanted ranks. Three passes settle 16, 16 and 32 bits. Counts are
sparse; what passes the driver is a few numbers a key and element.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = (16, 16, 32)
#: Counts that a task holds before it sends them on.
HELD = 1 << 21


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 counts as 0."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_bits(bits: np.ndarray) -> np.ndarray:
    bits = bits.astype(np.uint64)
    return np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of the list column; null rows and null elements are NaN."""
    out = np.full((len(column), width), np.nan)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    out[ok] = column.drop_null().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _sparse(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def array_quantiles(df: DataFrame, key: str, array_col: str, width: int, qs: list[float], of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, keys: list | None = None) -> tuple[list, np.ndarray]:
    """(keys, values of shape keys x qs x width): quantiles by linear interpolation between order statistics.

    NaN, null elements and null arrays are left out; an element without values gives NaN. `of(key numbers, matrix)` maps a
    batch's matrix in the task, say to residuals. `keys` fixes the keys and their order (else all of df that are not null).
    Keys are few: samples, controls.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    if keys is None:
        keys = sorted(r[0] for r in df.select(key).distinct().collect() if r[0] is not None)
    out = np.full((len(keys), len(qs), width), np.nan)
    if not keys or not width:
        return keys, out
    numbers = F.broadcast(spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), f"{key} {kind}, _k int"))  # a row a key
    rows = df.join(numbers, key).select("_k", array_col)
    ranks = [0.0] * len(qs)
    settled: np.ndarray | None = None  # (key, element, want): bits found so far
    done = 0
    wants = 2 * len(qs)
    alive = np.zeros((len(keys), width), bool)
    for bits in STEPS:
        shift, found, before = np.uint64(64 - done - bits), settled, np.uint64(64 - done)

        def count(batches, bits=bits, shift=shift, found=found, before=before):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def send():
                codes, counts = _sparse(*(np.concatenate(v) for v in zip(*held, strict=True)))
                group, bucket = codes >> np.int64(bits), codes & np.int64((1 << bits) - 1)
                cell, want = group // wants, group % wants
                return pa.RecordBatch.from_arrays([pa.array(v) for v in (cell // width, cell % width, want, bucket, counts)], ["k", "pos", "want", "bucket", "n"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = matrix(batch.column(1), width)
                x = x if of is None else of(k, x)
                cell = k[:, None] * width + np.arange(width)
                ok = ~np.isnan(x)
                cell, value = cell[ok], ordered_bits(x[ok])
                bucket = ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
                if found is None:
                    codes = (cell * wants << np.int64(bits)) | bucket
                else:  # for each rank wanted, the values that share its settled bits; ranks with the same bits count once
                    top, parts = value >> before, []
                    flat = found.reshape(-1, wants)
                    for w in range(wants):
                        mine = top == flat[cell, w]
                        for v in range(w):
                            mine &= flat[cell, v] != flat[cell, w]
                        parts.append(((cell[mine] * wants + w) << np.int64(bits)) | bucket[mine])
                    codes = np.concatenate(parts)
                held.append(_sparse(codes, np.ones(len(codes), np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    yield send()
                    held, size = [], 0
            if held:
                yield send()

        counted = rows.mapInArrow(count, "k long, pos long, want long, bucket long, n long").groupBy("k", "pos", "want", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("k", "pos", "want").orderBy("bucket")
        counted = counted.withColumn("to", F.sum("n").over(w)).withColumn("from", F.col("to") - F.col("n"))
        if found is None:
            total = Window.partitionBy("k", "pos", "want")
            counted = counted.withColumn("total", F.sum("n").over(total))
            wanted = F.array(*[f((F.col("total") - 1) * F.lit(float(q))).cast("long") for q in qs for f in (F.floor, F.ceil)])
            hit = counted.select("*", F.posexplode(wanted).alias("w", "rank"))
        else:  # the rank within the settled bits, for each want that shares them
            table = [(int(i), int(p), int(first_same(found, i, p, w)), int(w), int(ranks[i, p, w])) for i, p in zip(*np.nonzero(alive), strict=True) for w in range(wants)]
            left = spark.createDataFrame(table, "k long, pos long, want long, w int, rank long")  # some rows a key and element
            hit = counted.withColumn("total", F.lit(0)).join(F.broadcast(left), ["k", "pos", "want"])
        got = hit.where((F.col("from") <= F.col("rank")) & (F.col("rank") < F.col("to"))).select("k", "pos", "w", "bucket", (F.col("rank") - F.col("from")).alias("inner"), "total").collect()
        if found is None:
            settled, ranks, totals = np.zeros((len(keys), width, wants), np.uint64), np.zeros((len(keys), width, wants), np.int64), np.zeros((len(keys), width), np.int64)
            for r in got:
                totals[r["k"], r["pos"]] = r["total"]
                alive[r["k"], r["pos"]] = True
        else:
            settled = settled.copy()
        for r in got:
            at = r["k"], r["pos"], r["w"]
            settled[at] = (settled[at] << np.uint64(bits)) | np.uint64(r["bucket"])
            ranks[at] = r["inner"]
        done += bits
    value = from_bits(settled)
    for j, q in enumerate(qs):
        low, high = value[:, :, 2 * j], value[:, :, 2 * j + 1]
        at = (totals - 1) * q
        out[:, j] = np.where(alive, low + (high - low) * (at - np.floor(at)), np.nan)
    return keys, out


def first_same(found: np.ndarray, k: int, pos: int, want: int) -> int:
    """The first wanted rank of a key and element that has the same settled bits."""
    return int(np.flatnonzero(found[k, pos] == found[k, pos, want])[0])
