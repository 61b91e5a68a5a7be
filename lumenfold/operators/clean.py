"""Filters, background matching and sampling of control events."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.functions.arrays import EPS
from lumenfold.functions.stats import is_large, quantiles, settled, with_row_of
from lumenfold.operators.unmix import apply_kernel


def unsaturated(df: DataFrame, array_col: str, limit: float) -> DataFrame:
    """Events whose every detector is below the limit."""
    return df.where(F.forall(array_col, lambda x: x < limit))


def below_ceiling(df: DataFrame, x: str, y: str, max_x: float | None, max_y: float | None) -> DataFrame:
    for c, m in ((x, max_x), (y, max_y)):
        df = df if m is None else df.where(F.col(c) < m)
    return df


def ratio_filter(df: DataFrame, keys: list[str], area: str, height: str, q: float) -> DataFrame:
    """Events whose area/height ratio is strictly below its exact quantile in the sample. Large tables: the limits (a row a
    sample) are settled at once, so that what follows does not find them again."""
    large = is_large(df)
    df = df.withColumn("_ratio", F.col(area) / (F.col(height) + EPS))
    limits = quantiles(df, keys, "_ratio", q, "_limit", large)
    return df.join(F.broadcast(settled(limits)) if large else limits, keys).where("_ratio < _limit").drop("_ratio", "_limit")


def singlets(df: DataFrame, keys: list[str], pairs: list[tuple[str, str, float]]) -> DataFrame:
    """Ratio filters one after another: each quantile is that of the events the one before has left."""
    for area, height, q in pairs:
        df = ratio_filter(df, keys, area, height, q)
    return df


def not_like(df: DataFrame, array_col: str, spectra, threshold: float = 0.99) -> DataFrame:
    """Events whose cosine with every spectrum, after taking off the event's own mean, is below the threshold."""
    S = np.asarray(spectra, dtype=float)

    def greatest(X):
        C = X - X.mean(1, keepdims=True)
        return [((C @ S.T) / (np.linalg.norm(C, axis=1)[:, None] * np.linalg.norm(S, axis=1) + EPS)).max(1)]

    scored = apply_kernel(df, array_col, S.shape[1], greatest, [("_like", "double")], drop=False)
    return scored.where(F.col("_like") < threshold).drop("_like")


def positives(df: DataFrame, value: str, negatives: DataFrame, q: float = 0.99, most: int | None = None, id_col: str = "event_id") -> DataFrame:
    """Events above the negatives' quantile; the brightest `most` of them if given."""
    limit = quantiles(negatives, [], value, q, "_limit")
    df = df.where(F.col(value) > limit.first()["_limit"])
    return df if most is None else df.orderBy(F.col(value).desc(), id_col).limit(most)


def candidates(df: DataFrame, value: str, n: int, keys: list[str]) -> DataFrame:
    """Without the rows that cannot be among the n largest of their key: a sketch gives a value that n rows surely reach (by
    at least twice its error), and all rows from it on stay, some in a thousand of a large key."""
    accuracy, slack = 10_000, 3e-4
    shares = [2.0**-k for k in range(1, 12)]
    sketch = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(1 - s) for s in shares]), F.lit(accuracy))
    found = df.groupBy(*keys).agg(sketch.alias("_b"), F.count(value).alias("_n"))
    least = F.coalesce(*[F.when(F.col("_n") * (s - slack) > n, F.get("_b", F.lit(i))) for i, s in reversed(list(enumerate(shares)))])
    rows = with_row_of(df, found.select(*keys, least.alias("_least")), keys)
    return rows.where(F.col("_least").isNull() | (F.col(value).cast("double") >= F.col("_least"))).drop("_least")


#: Up to this number Spark limits the groups of a window before the shuffle.
GROUP_LIMIT = 1000
#: Parts that a key's candidates are ranked in first.
PARTS = 64


def top(df: DataFrame, value: str, n: int, keys: list[str] = (), id_col: str | list[str] = "event_id") -> DataFrame:
    """The n rows with the largest value (by key if keys are given), ties by id (a column or several).

    Small n is planned as a group limit before the shuffle. For more rows of a large table, those that cannot be among them
    are left out first, and the rest is ranked in parts by a hash of the id, then as a whole, so that no task sorts a key's
    rows, though all be equal.
    """
    order = [F.col(value).desc(), *([id_col] if isinstance(id_col, str) else id_col)]
    if not keys:
        return df.orderBy(*order).limit(n)

    def first(df, *by):
        return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")

    if n > GROUP_LIMIT and is_large(df):
        df = candidates(df, value, n, list(keys)).withColumn("_of", F.pmod(F.xxhash64(*order[1:]) if order[1:] else F.monotonically_increasing_id(), F.lit(PARTS)))
        df = first(df, *keys, "_of").drop("_of")
    return first(df, *keys)


def top_and_bottom(df: DataFrame, value: str, n_top: int, n_bottom: int, keys: list[str], id_col: str = "event_id") -> DataFrame:
    """Brightest and dimmest rows of each key, each row once though there be few; role tells which end."""
    up = Window.partitionBy(*keys).orderBy(F.col(value).desc(), id_col)
    down = Window.partitionBy(*keys).orderBy(F.col(value), id_col)
    bright = df.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= n_top).drop("_r").withColumn("role", F.lit("positive"))
    dim = df.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n_bottom).drop("_r").withColumn("role", F.lit("negative"))
    return bright.unionByName(dim.join(bright.select(*keys, id_col), [*keys, id_col], "left_anti"))


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 1) -> DataFrame:
    """n rows in the order of a seeded hash of the id: uniform, and the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)
