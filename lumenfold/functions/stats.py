"""Exact robust statistics as DataFrame compositions: distributed, without approximation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Consistency constant of the median absolute deviation.
MAD_SCALE = 1.4826


def quantile(c, q: float):
    """Linear interpolation between order statistics, counted exactly by value frequencies."""
    return F.percentile(c, F.lit(q))


#: From this size of the input on, quantiles are found by bracketing: a key's distinct values would fill a task.
LARGE = 32 << 20
#: The same for keys of several columns, which are many and share the values among tasks.
LARGE_KEYS = 2 << 30


def is_large(df: DataFrame, limit: int | None = None) -> bool:
    """By the size of what it reads, without a job. Event files, whose source gives none, are not large: they hold controls and
    single samples; a pool of very many is better read from Parquet, or `bracketed` asked for."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60) > (LARGE if limit is None else limit)


def with_row_of(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of the one row that each key has in `few` (few rows: by broadcast). A null key is a key."""
    there = few.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(F.broadcast(there), same).drop(*[f"_of_{k}" for k in keys])


def settled(few: DataFrame) -> DataFrame:
    """The few rows themselves (a row a key), computed once, whatever is built on them."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def _bracketed(df: DataFrame, keys: list[str], values: list, qs: list[float]) -> DataFrame:
    """(keys, _c, _q): number and quantiles of every value column, by two passes.

    A sketch brackets each quantile; then the rows inside a bracket (some in ten thousand) are counted by value, all others by
    the gap between brackets that they lie in, and ranked by running sums. Equal values count together, so ties take no room.
    """
    at = [v.cast("double") for v in values]
    if len(at) == 1:
        rows = df.select(*keys, F.lit(0).alias("_c"), at[0].alias("_v"))
    else:
        rows = df.select(*keys, F.posexplode(F.array(*at)).alias("_c", "_v"))
    keys = [*keys, "_c"]
    accuracy, slack = 10_000, 5e-4
    ends = [e for q in qs for e in (max(0.0, q - slack), min(1.0, q + slack))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), F.lit(accuracy))
    bracket = rows.groupBy(*keys).agg(sketch.alias("_b"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    few = F.col("_n") < 100_000  # then all rows are inside
    lo = [F.when(few | F.lit(ends[2 * i] <= 0), F.col("_lo")).otherwise(F.get("_b", F.lit(2 * i))).alias(f"_lo{i}") for i in range(len(qs))]
    hi = [F.when(few | F.lit(ends[2 * i + 1] >= 1), F.col("_hi")).otherwise(F.get("_b", F.lit(2 * i + 1))).alias(f"_hi{i}") for i in range(len(qs))]
    near = with_row_of(rows, bracket.select(*keys, "_n", *lo, *hi), keys)
    inside, below = F.lit(False), F.lit(None).cast("double")
    for i in range(len(qs)):
        inside = inside | ((F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}")))
        below = F.greatest(below, F.when(F.col(f"_hi{i}") < F.col("_v"), F.col(f"_hi{i}")))
    inside = F.coalesce(inside, F.lit(False))  # null values only keep their key
    counted = near.groupBy(*keys, F.when(inside, F.col("_v")).otherwise(below).alias("_at"), (~inside).alias("_gap"), "_n").agg(F.count("_v").alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_to", F.sum("_m").over(w))
    holds = lambda r: F.min(F.when(F.col("_to") > r, F.struct("_at", "_gap")))
    wanted = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    out = ranked.groupBy(*keys, "_n").agg(*[holds(f(r)).alias(f"_{side}{i}") for i, r in enumerate(wanted) for side, f in (("x", F.floor), ("y", F.ceil))])
    found = []
    for i, r in enumerate(wanted):
        x, y = (F.when(F.col(f"_{side}{i}._gap"), F.raise_error(F.lit("a quantile outside its bracket")).cast("double")).otherwise(F.col(f"_{side}{i}._at")) for side in "xy")
        found.append(F.when(F.col("_n") > 0, F.when(x == y, x).otherwise(x + (y - x) * (r - F.floor(r)))))
    return out.select(*keys, F.array(*found).alias("_q"))


def column_quantiles(df: DataFrame, keys: list[str], values: list, qs: list[float], bracketed: bool | None = None) -> DataFrame:
    """(keys, q0, q1, ..): for each value column the array of its exact quantiles in each key, nulls left out.

    Small tables: one aggregate over value frequencies. Large ones by brackets. Both are exact.
    """
    values = [F.col(v) if isinstance(v, str) else v for v in values]
    if bracketed is None:
        bracketed = is_large(df, LARGE if len(keys) < 2 else LARGE_KEYS)
    if not bracketed:
        return df.groupBy(*keys).agg(*[F.percentile(v, F.array(*[F.lit(float(q)) for q in qs])).alias(f"q{i}") for i, v in enumerate(values)])
    long = _bracketed(df, keys, values, qs)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(values))])


def quantiles(df: DataFrame, keys: list[str], value: str, q: float, name: str, bracketed: bool | None = None) -> DataFrame:
    """(keys, name): the exact quantile of each key, nulls left out; see column_quantiles()."""
    return column_quantiles(df, keys, [value], [q], bracketed).select(*keys, F.get("q0", F.lit(0)).alias(name))


def positions(df: DataFrame, key: str, name: str) -> DataFrame:
    """df(key) with each row's place in the order of a numeric key, from 0: ranges of keys are ranked apart and shifted by the
    rows before them, so no task holds all rows. Equal keys take neighbouring places."""
    parts = max(1, df.rdd.getNumPartitions())
    cuts = sorted(set(df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    part = sum((F.when(F.col(key) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    rows = df.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return rows.withColumn("_own", inner).join(F.broadcast(sums), "_part").select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))


def pct_above(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """(keys, pct): the share of values above a threshold, in per cent; nulls left out."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg((100 * F.avg((F.col(value) > threshold).cast("double"))).alias("pct"))


def with_mad(df: DataFrame, keys: list[str], value: str, bracketed: bool | None = None) -> DataFrame:
    """One row per key (one in all without keys): median and scaled MAD of value (two passes, joined on the key)."""
    if not keys:
        return with_mad(df.withColumn("_all", F.lit(1)), ["_all"], value, bracketed).drop("_all")
    if bracketed is None:
        bracketed = is_large(df, LARGE if len(keys) < 2 else LARGE_KEYS)
    med = quantiles(df, keys, value, 0.5, "median", bracketed)
    med = settled(med) if bracketed else med
    dev = with_row_of(df, med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(dev, keys, "_dev", 0.5, "mad", bracketed)
    return with_row_of(med, mad.withColumn("mad", F.lit(MAD_SCALE) * F.col("mad")), keys)


def histogram(df: DataFrame, keys: list[str], value, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins; what lies outside counts in the edge bins. bin from 1."""
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((value - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int") + 1))
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def weights_of(df: DataFrame, array_col: str, floor: float = 1e-6) -> DataFrame:
    """(pos, mean, weight) of each detector: weight = 1 / max(|mean|, floor)."""
    long = df.select(F.posexplode(array_col).alias("pos", "v"))
    return long.groupBy("pos").agg(F.avg("v").alias("mean")).withColumn("weight", 1.0 / F.greatest(F.abs("mean"), F.lit(floor)))
