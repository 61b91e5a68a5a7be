"""Nearest-neighbour join in a plane or a space of few axes, exact and distributed.

The reference points of each key fall into cells of a k-d partition, cut at medians of a sample. A query first meets the
points of its own cell; the distance of its k-th neighbour there then tells which other cells can hold a nearer one, and it
meets those. Only the cells' borders, boxes and sizes pass through the driver, one row for LEAF reference points.

Of equal points only the k with the smallest ids can be neighbours, so no point is too crowded to cut; queries of a crowded
cell are dealt into parts, each with a copy of the cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.tables import written

#: Reference points of a cell, sampled points of a cell that its cuts are medians of, and queries that meet a cell in one task.
LEAF, SAMPLED, CROWD = 4_000, 64, 50_000


class Cells:
    """The k-d trees of all keys. A node is (axis, cut, left, right), a leaf its cell's number; boxes come later."""

    def __init__(self):
        self.nodes: list[tuple[int, float, int, int]] = []  # a leaf: (-1, 0, cell, 0)
        self.roots: dict[int, int] = {}
        self.n = 0

    def grow(self, key: int, sample: np.ndarray, cells: int) -> None:
        """A tree for a key with about so many cells."""
        self.roots[key] = self._grow(sample, cells)

    def _grow(self, sample: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        spread = np.ptp(sample, axis=0) if len(sample) > 1 else np.zeros(1)
        axis = int(spread.argmax())
        if cells > 1 and spread[axis] > 0:
            values = np.sort(sample[:, axis])
            cut = values[len(values) // 2]
            if cut == values[0]:  # left is what lies below the cut
                cut = values[np.searchsorted(values, cut, side="right")]
            low = sample[:, axis] < cut
            left = self._grow(sample[low], cells // 2)
            right = self._grow(sample[~low], cells - cells // 2)
            self.nodes[at] = (axis, float(cut), left, right)
        else:
            self.nodes[at] = (-1, 0.0, self.n, 0)
            self.n += 1
        return at

    def home(self, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The cell of each point; -1 for keys without a tree."""
        out = np.full(len(x), -1, np.int64)
        work = [(root, np.flatnonzero(keys == key)) for key, root in self.roots.items()]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            axis, cut, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
                continue
            low = x[rows, axis] < cut
            work += [(left, rows[low]), (right, rows[~low])]
        return out

    def boxed(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Cells:
        """With the extent and size of each cell's points (empty cells: count 0), and of each node's."""
        n = len(self.nodes)
        self.low, self.high, self.count = np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf), np.zeros(n, np.int64)
        for at in range(n - 1, -1, -1):  # children come after their node
            axis, _, left, right = self.nodes[at]
            if axis < 0:
                self.low[at], self.high[at], self.count[at] = low[left], high[left], count[left]
            else:
                self.low[at], self.high[at] = np.minimum(self.low[left], self.low[right]), np.maximum(self.high[left], self.high[right])
                self.count[at] = self.count[left] + self.count[right]
        return self

    def reach(self, keys: np.ndarray, x: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells with points that may be within d2 of a row's point; nothing is lost to rounding."""
        rows_out, cells_out = [], []
        d2 = d2 * (1 + 1e-9)
        work = [(root, np.flatnonzero(keys == key)) for key, root in self.roots.items()]
        while work:
            node, rows = work.pop()
            if not len(rows) or not self.count[node]:
                continue
            p = x[rows]
            gap = np.maximum(np.maximum(self.low[node] - p, p - self.high[node]), 0)
            rows = rows[(gap**2).sum(1) <= d2[rows]]
            axis, _, left, right = self.nodes[node]
            if axis < 0:
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), left))
            else:
                work += [(left, rows), (right, rows)]
        return (np.concatenate(rows_out), np.concatenate(cells_out)) if rows_out else (np.empty(0, np.int64), np.empty(0, np.int64))

    def enough(self, keys: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each point's key has k points, or all there are: down the tree while the half that
        the point is in has k, then the far corner of that node's box."""
        out = np.full(len(x), np.inf)
        work = [(root, np.flatnonzero(keys == key)) for key, root in self.roots.items()]
        while work:
            node, rows = work.pop()
            if not len(rows):
                continue
            axis, cut, left, right = self.nodes[node]
            far = np.maximum(np.abs(x[rows] - self.low[node]), np.abs(self.high[node] - x[rows]))
            if self.count[node] >= k:
                out[rows] = (far**2).sum(1)
            if axis >= 0:
                low = x[rows, axis] < cut
                for child, some in ((left, rows[low]), (right, rows[~low])):
                    if self.count[child] >= k:
                        work.append((child, some))
        return out


def _matrix(table, axes: list[str]) -> np.ndarray:
    return np.stack([table.column(a).to_numpy(zero_copy_only=False) for a in axes], 1) if len(axes) else np.empty((table.num_rows, 0))


def closest(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, squared distance) of the k nearest points of each query, ties by id; in order of query, distance and id."""
    order = np.argsort(ids, kind="stable")
    r, ids = r[order], ids[order]
    out = []
    step = max(1, block // max(1, len(r)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        d2 = np.zeros((len(part), len(r)))
        for j in range(r.shape[1]):
            d2 += (part[:, j : j + 1] - r[:, j][None]) ** 2
        if len(r) > k:
            last = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            row, col = np.nonzero(d2 <= last)
        else:
            row, col = (v.ravel() for v in np.indices(d2.shape))
        d = d2[row, col]
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        first = np.searchsorted(row, np.arange(len(part)))
        rank = np.arange(len(row)) - first[row]
        keep = rank < k
        out.append((row[keep] + at, ids[col[keep]], d[keep]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0))


def knn_join(queries: DataFrame, reference: DataFrame, k: int, q_id: str, r_id: str, axes: list[str], key: str | None = None, leaf: int = LEAF, crowd: int = CROWD, seed: int = 1) -> DataFrame:
    """(q_id, ref_id, rank, d2): the k nearest reference points of each query by Euclidean distance, ties by ref_id; fewer where
    the reference has fewer. With a key, each query meets the points of its own key only (few keys: controls, samples).

    q_id names a query row, r_id (a whole number) a reference row. Rows with a null or NaN coordinate or a null key have no
    neighbours and are none. Empty inputs: no rows.
    """
    spark = queries.sparkSession
    xs = [f"x{i}" for i in range(len(axes))]

    def points(df: DataFrame, id_col: str) -> DataFrame:
        df = df.select(F.lit(0).alias("key_value") if key is None else F.col(key).alias("key_value"), F.col(id_col).alias("id"), *[F.col(a).cast("double").alias(x) for a, x in zip(axes, xs, strict=True)])
        for x in xs:
            df = df.where(F.col(x).isNotNull() & ~F.isnan(x))
        return df

    same = Window.partitionBy("key_value", *xs).orderBy("id")
    ref = points(reference, r_id).withColumn("id", F.col("id").cast("long")).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    ref = written(ref, "knn-reference")
    sizes = ref.groupBy("key_value").count().collect()  # a row a key
    names = {r["key_value"]: i for i, r in enumerate(sorted((r for r in sizes if r["key_value"] is not None), key=lambda r: str(r["key_value"])))}
    cells = {names[r["key_value"]]: max(1, -(-r["count"] // leaf)) for r in sizes if r["key_value"] is not None}
    q_type, key_type = queries.schema[q_id].dataType.simpleString(), ref.schema["key_value"].dataType.simpleString()
    numbered = spark.createDataFrame([(v, i) for v, i in names.items()], f"key_value {key_type}, key int")
    ref = ref.join(F.broadcast(numbered), "key_value").drop("key_value")  # a row a key
    wanted = points(queries, q_id).join(F.broadcast(numbered), "key_value").drop("key_value")

    trees = Cells()
    split = {i for i, n in cells.items() if n > 1}
    sample: dict[int, np.ndarray] = {}
    if split:  # SAMPLED points a cell
        share = F.element_at(F.create_map(*[F.lit(v) for i in split for v in (i, min(1.0, SAMPLED / leaf))]), F.col("key"))
        some = ref.where(F.col("key").isin(sorted(split))).where(F.pmod(F.xxhash64(F.lit(seed), "id", *xs), F.lit(1 << 20)) < share * (1 << 20))
        got = some.select("key", *xs).toPandas()
        sample = {i: g[xs].to_numpy() for i, g in got.groupby("key")}
    for i, n in sorted(cells.items()):
        trees.grow(i, sample.get(i, np.empty((0, len(xs)))), n)

    def housed(batches):
        for batch in batches:
            cell = trees.home(batch.column("key").to_numpy(zero_copy_only=False), _matrix(batch, xs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    columns = ", ".join(f"{x} double" for x in xs)
    points_q = f"key int, id {q_type}, {columns}"

    def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries with a part of their cell, and a copy of each cell for each of its parts."""
        load = rows.groupBy("cell").count().withColumn("parts", F.ceil(F.col("count") / crowd).cast("int")).drop("count")
        load = F.broadcast(written(load, "knn-load"))  # a row a cell
        rows = rows.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("id", *xs), F.col("parts")).cast("int")).drop("parts")
        copies = ref.join(load, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", *xs)
        return rows, copies

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        who, ids, d2 = closest(_matrix(left, xs), _matrix(right, xs), right.column("id").to_numpy(), k)
        at = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=left.num_rows))]).astype(np.int32)
        refs, dist = pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.ListArray.from_arrays(pa.array(at), pa.array(d2))
        return pa.table([*(left.column(c) for c in ("key", "id", *xs, "cell")), refs, dist], names=["key", "id", *xs, "cell", "refs", "d2"])

    found = f"{points_q}, cell long, refs array<bigint>, d2 array<double>"

    def met(rows: DataFrame) -> DataFrame:
        left, right = dealt(rows)
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(meet, found)

    def ranked_neighbours(every: DataFrame) -> DataFrame:
        """A row a query and cell met, k candidates each, to the k best of each query."""
        pairs = every.groupBy("id", *xs).agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2", "refs")))), 1, k).alias("near")) if split else every.select("id", F.arrays_zip("d2", "refs").alias("near"))
        out = pairs.select("id", F.posexplode("near").alias("rank", "n"))
        return out.select(F.col("id").alias(q_id), F.col("n.refs").alias("ref_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.d2").alias("d2"))

    if not split:  # a cell a key, its number the key's: nothing to widen to
        own = F.element_at(F.create_map(*[F.lit(v) for i in cells for v in (i, int(trees.nodes[trees.roots[i]][2]))] or [F.lit(0), F.lit(0)]), F.col("key")).cast("long")
        ref = ref.select("key", "id", *xs, own.alias("cell"))
        return ranked_neighbours(met(written(wanted.select("key", "id", *xs, own.alias("cell")), "knn-queries")))

    ref = written(ref.select("key", "id", *xs).mapInArrow(housed, f"key int, id long, {columns}, cell long"), "knn-cells")
    box = ref.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{f.__name__}_{x}") for x in xs for f in (F.min, F.max)]).collect()  # a row a cell
    low, high, count = np.full((trees.n, len(xs)), np.inf), np.full((trees.n, len(xs)), -np.inf), np.zeros(trees.n, np.int64)
    for r in box:
        low[r["cell"]], high[r["cell"]], count[r["cell"]] = [r[f"min_{x}"] for x in xs], [r[f"max_{x}"] for x in xs], r["n"]
    trees.boxed(low, high, count)

    at_home = written(wanted.select("key", "id", *xs).mapInArrow(housed, f"{points_q}, cell long"), "knn-queries")

    first = written(met(at_home), "knn-home")

    def widened(batches):
        for batch in batches:
            keys, x = batch.column("key").to_numpy(zero_copy_only=False), _matrix(batch, xs)
            home, d2 = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("d2")
            sizes = np.array([len(v) for v in d2.to_pylist()]) if batch.num_rows else np.empty(0, np.int64)
            last = np.array([v[-1] if v else np.inf for v in d2.to_pylist()])
            within = np.where(sizes >= k, last, trees.enough(keys, x, k))
            rows, cell = trees.reach(keys, x, within)
            other = cell != home[rows]
            rows, cell = rows[other], cell[other]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("key", "id", *xs)), pa.array(cell)], ["key", "id", *xs, "cell"])

    more = written(first.mapInArrow(widened, f"{points_q}, cell long"), "knn-wider")
    return ranked_neighbours(first.unionByName(met(more)))
